"""Temperature-tolerant joins, change application and comparisons between record versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meltwise.operators.common import first_row

c = F.col


def tolerance_join(rows: DataFrame, measurements: DataFrame, keys: list[str], tolerance: float = 5.0) -> DataFrame:
    """Attach per row and property the first measurement in list order within the tolerance.

    ``rows`` has the keys and ``at``; ``measurements`` has the keys, property, pos, temp_c and value.
    The pick is an aggregate (min_by), so matches combine map-side.
    """
    near = rows.join(measurements, keys).where(F.abs(c("temp_c") - c("at")) < tolerance)
    return near.groupBy(*keys, "at", "property").agg(
        F.min_by("value", "pos").alias("value"), F.min_by("temp_c", "pos").alias("temp_c"))


def nearest_temperature(measurements: DataFrame, keys: list[str], target: Column | float,
                        window: float | None = None) -> DataFrame:
    """Value closest to the target per group; ties keep the first in list order."""
    gap = F.abs(c("temp_c") - target)
    x = measurements if window is None else measurements.where(gap < window)
    return x.groupBy(*keys).agg(
        F.min_by("value", F.struct(gap, c("pos"))).alias("value"),
        F.min_by("temp_c", F.struct(gap, c("pos"))).alias("temp_c"))


def exact_then_nearest(measurements: DataFrame, keys: list[str], target: float) -> DataFrame:
    x = nearest_temperature(measurements, keys, F.lit(target))
    return x.withColumn("how", F.when(c("temp_c") == target, "exact").otherwise("nearest"))


def apply_ledger(cells: DataFrame, ledger: DataFrame, keys: list[str]) -> DataFrame:
    """Set, add or withdraw cells. ``cells`` is (keys, value), ``ledger`` is (keys, to_value).

    One full outer join on the cell key: a null ``to_value`` withdraws, a missing cell is added.
    Returns keys, value and outcome (kept, set, added, withdrawn, unchanged, absent).
    """
    x = cells.withColumn("_has", F.lit(True)).join(ledger.withColumn("_edit", F.lit(True)), keys, "full_outer")
    has, edit = c("_has").isNotNull(), c("_edit").isNotNull()
    outcome = (
        F.when(~edit, "kept").when(has & c("to_value").isNull(), "withdrawn")
        .when(~has & c("to_value").isNull(), "absent").when(~has, "added")
        .when(c("value") == c("to_value"), "unchanged").otherwise("set"))
    value = F.when(edit, c("to_value")).otherwise(c("value"))
    return x.select(*keys, value.alias("value"), outcome.alias("outcome"))


def cell_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Changed, added and removed cells between two (keys, value) tables."""
    x = old.withColumnRenamed("value", "old").withColumn("_o", F.lit(True)).join(
        new.withColumnRenamed("value", "new").withColumn("_n", F.lit(True)), keys, "full_outer")
    kind = F.when(c("_o").isNull(), "added").when(c("_n").isNull(), "removed").otherwise("changed")
    return x.where(~c("old").eqNullSafe(c("new")) | c("_o").isNull() | c("_n").isNull()).select(
        *keys, "old", "new", kind.alias("kind"))


def fallback_fill(records: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """Fill a missing value from the first non-empty one of the same group, in input order."""
    have = records.where(c(value).isNotNull())
    first = first_row(have, [group], [c(order)]).select(group, c(value).alias("_fill"))
    return records.join(first, group, "left").withColumn(
        "filled", c(value).isNull() & c("_fill").isNotNull()).withColumn(value, F.coalesce(value, "_fill")).drop("_fill")


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Counts of rows on one side only (both zero when the multisets agree)."""
    left = a.exceptAll(b).select(F.lit("only_left").alias("side"))
    right = b.exceptAll(a).select(F.lit("only_right").alias("side"))
    sides = a.sparkSession.createDataFrame([("only_left",), ("only_right",)], "side string")
    n = left.unionByName(right).groupBy("side").agg(F.count("*").alias("n"))
    return sides.join(n, "side", "left").select("side", F.coalesce("n", F.lit(0)).alias("n"))
