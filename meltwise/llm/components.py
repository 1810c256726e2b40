"""Connected components of link tables, whole on executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltwise.llm.common import cut


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every end of ``edges`` (a, b): label is the smallest vertex that links reach.

    Each round hangs the neighbours of every vertex on the smallest of them, first the larger neighbours and then the
    smaller ones with the vertex itself; chains shrink by a factor each time, and when nothing changes every edge points from a vertex to
    its component's smallest. Rounds are cut by checkpoints; sums tell when it has settled.
    """
    pairs = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())

    known = state(pairs)
    while known[0]:
        both = pairs.select("v", "u").unionByName(pairs.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = both.where("u > v").join(least.withColumnRenamed("v", "_v"), F.col("v") == F.col("_v")).select(F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least.withColumnRenamed("v", "_v"), F.col("v") == F.col("_v")).select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u")
        pairs = cut(small.unionByName(least.select("v", F.col("m").alias("u"))).distinct())
        now = state(pairs)
        if now == known:
            break
        known = now
    top = pairs.select(F.col("u").alias("v")).distinct()
    return pairs.groupBy("v").agg(F.min("u").alias("label")).unionByName(top.join(pairs.select(F.col("v").alias("_v")), F.col("v") == F.col("_v"), "left_anti").select("v", F.col("v").alias("label")))
