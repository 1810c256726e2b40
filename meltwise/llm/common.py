"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meltwise.operators.checkpoints import ensure_checkpoint_dir
from meltwise.operators.common import small_batches  # noqa: F401

ROW = "_row"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pack(df: DataFrame, **cols: Column) -> DataFrame:
    """The whole input row as one struct beside working columns, so no input column can clash with them."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias(ROW), *[c.alias(k) for k, c in cols.items()])


def unpack(df: DataFrame, names: list[str], **outs: Column) -> DataFrame:
    """The packed row's columns and ``outs``; an output takes the place of an input column of its name."""
    taken = {k.lower() for k in outs}
    kept = [F.col(ROW).getField(c).alias(c) for c in names if c.lower() not in taken]
    return df.select(*kept, *[c.alias(k) for k, c in outs.items()])


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone; other letters keep their case."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Number of runs without blanks and line breaks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_key(seed: str, doc_id: Column, text: Column) -> Column:
    """Hash-random key of a row: from its id, or from its text where the id is null."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))))


def text_column(df: DataFrame) -> Column:
    return df["text"] if "text" in df.columns else F.lit(None).cast("string")


def sums_before(df: DataFrame, part: str, bucket: str, order: list[str], value: str, out: str, facts: DataFrame | None = None) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows before this one, within ``part``.

    A distributed prefix sum. ``bucket`` cuts each part into ranges of the order (it must rise with ``order``); the
    bucket sums are added up first, so that a part of any size is sorted in as many tasks as it has buckets. ``facts``
    may hold part, bucket and value alone, where they are at hand more cheaply than in ``df``.
    """
    sums = (df if facts is None else facts).groupBy(part, bucket).agg(F.sum(value).alias("_s"))
    w = Window.partitionBy(part).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col(part).alias("_p"), F.col(bucket).alias("_b"), F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_off"))
    inner = Window.partitionBy(part, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn(out, F.coalesce(F.sum(value).over(inner), F.lit(0)))
    joined = rows.join(offsets, (F.col(part) == F.col("_p")) & (F.col(bucket) == F.col("_b")))
    return joined.withColumn(out, (F.col(out) + F.col("_off")).cast("long")).drop("_p", "_b", "_off")


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the session's shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_path(spark: SparkSession) -> str:
    """A fresh path in the folder that driver and executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"


CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession):
    """Shuffle files of a finished step go at once, for jobs whose every step reads what the one before has written."""
    before = spark.conf.get(CLEAN)
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEAN, before)


def written(df: DataFrame) -> DataFrame:
    """The rows from a table in the shared folder: a lineage cut whose size the planner knows."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Removes tables of ``written`` that nothing reads any more, once their successors are written."""
    for df in tables:
        if path := getattr(df, "_written_at", None):
            jvm, session = df.sparkSession._jvm, df.sparkSession._jsparkSession
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(session.sessionState().newHadoopConf()).delete(place, True)
