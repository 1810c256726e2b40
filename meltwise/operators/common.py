"""Small helpers shared by the operators."""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def const_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small declared table as a DataFrame (fixed size, so safe to broadcast)."""
    return spark.createDataFrame(rows, schema)


def rnd(c: Column, digits: int = 6) -> Column:
    """Round for output; adding 0.0 turns a negative zero into zero."""
    return F.round(c, digits) + F.lit(0.0)


def total(columns: list[Column]) -> Column:
    return reduce(add, columns)


def part_of(component: str, column: str = "composition") -> Column:
    """Amount of a component in a composition map; absent means 0."""
    return F.coalesce(F.try_element_at(F.col(column), F.lit(component)), F.lit(0.0))


def map_total(column: str = "composition") -> Column:
    return F.aggregate(F.map_values(column), F.lit(0.0), lambda acc, v: acc + v)


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows per group. Spark limits each group map-side before the shuffle, so a hot
    group sends at most n rows per task."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def first_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_n(df, keys, order, 1, "_rn").drop("_rn")


def lookup(mapping: dict, key: Column, default) -> Column:
    """A declared constant by key as a CASE expression, so it stays inside generated code."""
    out = None
    for value in sorted(set(mapping.values())):
        names = [k for k, v in mapping.items() if v == value]
        cond = key.isin(names)
        out = F.when(cond, F.lit(float(value))) if out is None else out.when(cond, F.lit(float(value)))
    return out.otherwise(F.lit(default) if default is not None else F.lit(None).cast("double"))


def rnd_even(col, digits: int = 3):
    """Rounded in two plain steps, first to nine decimals, so that values on a rounding midpoint agree between engines."""
    fine = F.floor(col * 1e9 + 0.5) / 1e9
    scale = float(10**digits)
    return F.floor(fine * scale + 0.5) / scale


def rnd_even_sql(sql: str, keys: str, columns: list[str], digits: int = 3) -> str:
    """The query with ``columns`` rounded in the same two steps."""
    scale = float(10**digits)
    each = [f"floor(floor({x} * 1e9 + 0.5) / 1e9 * {scale} + 0.5) / {scale} AS {x}" for x in columns]
    return f"SELECT {keys}, {', '.join(each)} FROM ({sql})"


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Python workers take so many rows at a time, for steps whose rows are long."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)
