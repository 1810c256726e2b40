"""Ranks and rank statistics that do not put a whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

c = F.col


def running_count(counts: DataFrame, keys: list[str], value: str, n: str, slices: int = 64, few: bool = False) -> DataFrame:
    """Add ``_before``: how many counted rows of the group have a smaller value.

    ``counts`` has one row per distinct value. Values are cut into slices by sketch quantiles, the
    slice totals are summed in a tiny window, and the running sum inside a slice is a window
    partitioned by (keys, slice), so a group spreads over ``slices`` tasks. ``few`` says that there are few groups, so that
    what has a row for each of them, or for their slices, is broadcast.
    """
    slices = max(2, slices)
    probs = F.array(*[F.lit(i / slices) for i in range(1, slices)])
    edges = counts.groupBy(*keys).agg(F.percentile_approx(value, probs, 1000).alias("_edges"))
    small = F.broadcast if few else lambda df: df
    x = (counts.join(small(edges), keys) if keys else counts.crossJoin(F.broadcast(edges))).withColumn(
        "_slice", F.size(F.filter("_edges", lambda e: e < c(value)))
    ).drop("_edges")
    totals = x.groupBy(*keys, "_slice").agg(F.sum(n).alias("_t"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(*keys, "_slice", F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_base"))
    inner = W.partitionBy(*keys, "_slice").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    return (
        x.join(small(totals), [*keys, "_slice"])
        .withColumn("_before", c("_base") + F.coalesce(F.sum(n).over(inner), F.lit(0)))
        .drop("_base", "_slice")
    )


def average_ranks(df: DataFrame, keys: list[str], value: str, rank: str) -> DataFrame:
    """Mid ranks (ties share their mean rank), joined back by value."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_c"))
    ranks = running_count(counts, keys, value, "_c").select(
        *keys, value, (c("_before") + (c("_c") + 1) / 2.0).alias(rank)
    )
    return df.join(ranks, [*keys, value])


def row_ranks(df: DataFrame, keys: list[str], order: str, tie: str, rank: str = "rank") -> DataFrame:
    """Exact 1-based row numbers by (order, tie): the base of the order value plus the place among ties."""
    counts = df.groupBy(*keys, order).agg(F.count("*").alias("_c"))
    base = running_count(counts, keys, order, "_c").select(*keys, order, "_before")
    ties = W.partitionBy(*keys, order).orderBy(tie)
    return (
        df.withColumn("_tie", F.row_number().over(ties))
        .join(base, [*keys, order])
        .withColumn(rank, c("_before") + c("_tie"))
        .drop("_before", "_tie")
    )


def signed_rank(df: DataFrame, keys: list[str], diff: str) -> DataFrame:
    """Signed-rank statistic W, wins, losses and the normal two-sided p with tie correction."""
    nonzero = df.where(c(diff) != 0).withColumn("_abs", F.abs(c(diff)))
    counts = nonzero.groupBy(*keys, "_abs").agg(
        F.count("*").alias("_c"), F.count_if(c(diff) > 0).alias("_pos")
    )
    ranked = running_count(counts, keys, "_abs", "_c").withColumn("_r", c("_before") + (c("_c") + 1) / 2.0)
    stats = ranked.groupBy(*keys).agg(
        F.sum(c("_pos") * c("_r")).alias("w_plus"), F.sum((c("_c") - c("_pos")) * c("_r")).alias("w_minus"),
        F.sum("_c").alias("n_nonzero"), F.sum("_pos").alias("losses"),
        F.sum(c("_c").cast("double") * c("_c") * c("_c") - c("_c")).alias("_ties"),
    )
    n = c("n_nonzero").cast("double")
    w = F.least("w_plus", "w_minus")
    var = n * (n + 1) * (2 * n + 1) / 24.0 - c("_ties") / 48.0
    z = F.try_divide(w - n * (n + 1) / 4.0, F.sqrt(var))
    few = n < 6
    return stats.select(
        *keys, "n_nonzero", F.when(~few, w).alias("w"),
        F.when(~few, n - c("losses")).cast("long").alias("wins"),
        F.when(~few, c("losses")).alias("losses"), F.when(~few, z).alias("z"), F.when(~few, two_sided(z)).alias("p"),
    )


def two_sided(z: Column) -> Column:
    """Two-sided normal tail of a z score: the rational form of the error function, good to 1.5e-7."""
    x = F.abs(z) / 2.0**0.5
    u = 1.0 / (1.0 + 0.3275911 * x)
    series = u * (0.254829592 + u * (-0.284496736 + u * (1.421413741 + u * (-1.453152027 + u * 1.061405429))))
    return F.least(F.lit(1.0), series * F.exp(-x * x))
