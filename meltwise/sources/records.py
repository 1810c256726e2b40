"""Scans and sinks for nested records, run tables and triples."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meltwise.operators.checkpoints import ensure_checkpoint_dir

c = F.col
POINTS = T.ArrayType(T.StructType([T.StructField("temp_c", T.StringType()), T.StructField("value", T.DoubleType())]))
RECORD = T.StructType([
    T.StructField("alloy", T.StringType()), T.StructField("processing", T.StringType()), T.StructField("form", T.StringType()),
    T.StructField("composition", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("yield_strength", POINTS), T.StructField("uts", POINTS), T.StructField("elongation", POINTS), T.StructField("elasticity", POINTS),
])


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder, for written tables."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def scan_records(spark: SparkSession, *paths: str, schema: T.StructType = RECORD) -> DataFrame:
    """JSON-lines records with a declared schema; blank lines are skipped by the reader."""
    return spark.read.schema(schema).json(list(paths))


def parse_tolerant(lines: DataFrame, schema: T.StructType = RECORD) -> DataFrame:
    """Lines (column value) to (record, outcome): json, literal, header, blank or rejected.

    Strict JSON first, then the same text with single quotes and None/True/False rewritten.
    """
    bad = "_bad"
    strict = T.StructType([*schema.fields, T.StructField(bad, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad, "allowSingleQuotes": "false"}
    text = F.trim("value")
    fixed = text
    for pattern, to in ((r"'", '"'), (r"\bNone\b", "null"), (r"\bTrue\b", "true"), (r"\bFalse\b", "false")):
        fixed = F.regexp_replace(fixed, pattern, to)
    x = lines.select("value", F.from_json(text, strict, options).alias("a"), F.from_json(fixed, strict, options).alias("b"))
    shape = text.startswith("{") & text.endswith("}")
    outcome = (
        F.when(F.coalesce(text, F.lit("")) == "", "blank").when(text.startswith("==>"), "header")
        .when(shape & c(f"a.{bad}").isNull(), "json").when(shape & c(f"b.{bad}").isNull(), "literal").otherwise("rejected"))
    names = [f.name for f in schema.fields]
    pick = lambda s: F.struct(*[c(f"{s}.{n}").alias(n) for n in names])
    return x.select("value", outcome.alias("outcome"), F.when(outcome == "json", pick("a")).when(outcome == "literal", pick("b")).alias("record"))


def scan_tolerant(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of tolerant line files."""
    parsed = parse_tolerant(spark.read.text(list(paths)))
    return parsed.where(c("record").isNotNull()).select("record.*"), parsed.where(c("outcome") == "rejected").select("value")


def melt_sheet(sheet: DataFrame, keys: list[str]) -> DataFrame:
    """Wide temperature columns (``t20C`` style text cells) to (keys, temp_c, value); ``-`` is missing."""
    temps = [n for n in sheet.columns if n not in keys]
    long = sheet.unpivot(keys, temps, "name", "cell")
    value = F.regexp_extract("cell", r"([-+]?\d*\.?\d+)", 1).try_cast("double")
    temp = F.regexp_extract("name", r"(\d+)", 1).try_cast("int")
    return long.where(c("cell").isNotNull() & (c("cell") != "-")).select(*keys, temp.alias("temp_c"), value.alias("value")).where(c("value").isNotNull())


def points_from_cell(cell: Column, default_temp: str = "20") -> Column:
    """A cell that is a JSON series, a JSON map or a scalar, as an array of points."""
    text = F.regexp_replace(F.nullif(F.trim(cell), F.lit("-")), "'", '"')
    series = F.from_json(text, POINTS)
    scalar = text.try_cast("double")
    one = F.array(F.struct(F.lit(default_temp).alias("temp_c"), scalar.alias("value")))
    empty = F.from_json(F.lit("[]"), POINTS)
    return F.when(scalar.isNotNull(), one).when(text.startswith("["), series).otherwise(empty)


def scan_runs(spark: SparkSession, paths: dict[str, str], schema: str) -> DataFrame:
    """Run tables of several arms, tagged; columns an arm lacks read as null."""
    out = None
    for tag, path in paths.items():
        x = spark.read.schema(schema).option("header", True).csv(path).withColumn("run", F.lit(tag))
        out = x if out is None else out.unionByName(x, allowMissingColumns=True)
    return out


def replace_triples(triples: DataFrame, path: str) -> None:
    """Write triples so that only the partitions (named graphs) present in the input are replaced.

    Tasks write what they hold, a file for each partition: gathering a predicate first would make one task of it.
    """
    (triples.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("graph", "p").parquet(path))


def append_missing(work: DataFrame, path: str, keys: list[str]) -> int:
    """Append the rows whose key the table at ``path`` does not hold yet; returns how many."""
    done = work.sparkSession.read.parquet(path).select(*keys)
    fresh = work.join(done, keys, "left_anti")
    before = done.count()
    fresh.write.mode("append").parquet(path)
    return work.sparkSession.read.parquet(path).count() - before


def fingerprint(df: DataFrame) -> DataFrame:
    """Order-insensitive content hash and row count."""
    h = F.xxhash64(*[c(n) for n in sorted(df.columns)])
    return df.agg(F.bit_xor(h).alias("content_xor"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("content_sum"), F.count("*").alias("n"))
