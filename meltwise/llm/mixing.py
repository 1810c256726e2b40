"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact budgets, repeated epochs.

Each source's budget is cut in the order of a hash-random key. The keys are spread evenly, so their first hex digits
are ready-made range partitions: a source is sorted in up to 4,096 tasks whatever its share of the rows, and the
prefix sum of a row is the sum of the ranges before its own plus a running sum inside it. Everything is DataFrame
operations; only one row per source meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meltwise.llm.common import cut, pack, row_key, sums_before, text_column, unpack, word_count

DIGITS = 3


def source_targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(_src, _null, ssize) to the same with ``target``: weighted shares of ``share`` x all sizes, none over ``cap`` x its source.

    Sources in code-point order, null last, take the weights in turn. The excess of capped sources goes to the others by
    weight until none is above: taken by rising cap / weight, the capped sources are the first ones, so running sums
    over one row per source give the level at once.
    """
    everywhere = Window.partitionBy(F.lit(1))
    by_name = everywhere.orderBy("_null", "_src")
    n = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.lit(float(weights[-1]))
    for i, w in enumerate(weights[:-1]):
        weight = F.when(n == i, F.lit(float(w))).otherwise(weight)
    df = sizes.withColumn("_w", weight).withColumn("_cap", F.lit(cap) * F.col("ssize"))
    order = everywhere.orderBy(F.col("_cap") / F.col("_w"), "_null", "_src")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    total = everywhere.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    df = df.withColumn("_left", F.lit(share) * F.sum("ssize").over(total) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    df = df.withColumn("_wleft", F.sum("_w").over(total) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    df = df.withColumn("_full", F.col("_cap") * F.col("_wleft") <= F.col("_w") * F.col("_left"))
    level = F.min(F.when(~F.col("_full"), F.struct(F.col("_cap") / F.col("_w"), "_null", "_src", "_left", "_wleft"))).over(total)
    df = df.withColumn("_level", level)
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_w") * F.col("_level._left") / F.col("_level._wleft"))
    return df.select("_src", "_null", "ssize", target.alias("target"))


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: str = "mix", size: Column | None = None) -> DataFrame:
    """Every row of ``docs`` with what the mix takes of it.

    Adds ``size`` (words unless given), ``source_size``, ``target`` (both of its source), ``taken`` (words taken, repeats
    counted) and ``copies`` (whole copies for a writer: full epochs, and one more if at least half of the document fits
    under the cut). A budget of e sizes and a rest is e epochs and the first documents of the hash order up to the rest;
    the document at the cut counts in part in ``taken``, so that a source's taken words are its budget exactly.

    Null source: one more source, last in order. Null text: size 0, nothing taken. Null id: ordered by its text. Repeated
    rows count each for itself; ties in the order change nothing but which of two equal rows is cut. Empty table: no rows.
    """
    text = text_column(docs)
    name = F.concat(F.when(docs["source"].isNull(), F.lit("n:")).otherwise(F.lit("s:")), F.coalesce(docs["source"].cast("string"), F.lit("")))
    key, n = row_key(seed, docs["doc_id"], text), (word_count(text) if size is None else size).cast("long")
    facts = cut(docs.select(name.alias("_part"), F.substring(key, 1, DIGITS).alias("_bucket"), n.alias("_size")).groupBy("_part", "_bucket").agg(F.sum("_size").alias("_size")))
    rows = pack(docs, _size=n, _part=name, _key=key, _bucket=F.substring(key, 1, DIGITS), _h=F.xxhash64(docs["doc_id"], text))
    rows = sums_before(rows, "_part", "_bucket", ["_key", "_size", "_h"], "_size", "_before", facts)
    sizes = facts.groupBy("_part").agg(F.sum("_size").alias("ssize"))
    sizes = sizes.select(F.substring("_part", 3, 1 << 30).alias("_src"), F.col("_part").startswith("n:").alias("_null"), "ssize")
    targets = source_targets(sizes, weights, share, cap).withColumn("_q", F.concat(F.when(F.col("_null"), F.lit("n:")).otherwise(F.lit("s:")), F.col("_src"))).drop("_src", "_null")
    rows = rows.join(targets, F.col("_part") == F.col("_q"))
    budget = F.floor("target")
    epochs = F.when(F.col("ssize") > 0, F.floor(budget / F.greatest(F.col("ssize"), F.lit(1)))).otherwise(0).cast("long")
    rows = rows.withColumn("_e", epochs).withColumn("_rest", (budget - F.col("_e") * F.col("ssize")).cast("long"))
    part = F.greatest(F.lit(0), F.least(F.col("_size"), F.col("_rest") - F.col("_before")))
    copies = F.col("_e") + (F.col("_before") * 2 + F.col("_size") <= F.col("_rest") * 2).cast("long")
    return unpack(
        rows, docs.columns, size=F.col("_size"), source_size=F.col("ssize"), target=F.col("target"),
        taken=(F.col("_e") * F.col("_size") + part).cast("long"), copies=copies,
    )


def write_copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each whole copy that the mix takes."""
    return mixed.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select(*columns)
