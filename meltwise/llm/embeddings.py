"""Embedding near-dedup: balanced binary codes by iterative quantisation, multi-index Hamming tables, exact rerank.

A rotation of the sample's principal axes is learned so that signs lose little (iterative quantisation); every vector
gets a code. A code is cut into parts, each the key of a table; two codes within REACH bits differ by little in one
part at least, so each code looks up every key near its own part in every table. Codes that meet are compared whole,
and the vectors of those that pass are compared by cosine in double precision. Equal vectors are one class throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meltwise.llm.common import cut
from meltwise.llm.components import components

BITS = 64
REACH = 9  # every pair of codes within so many bits meets in some table
WHOLE = 18  # codes farther apart than this are not compared further


def learn_rotation(sample: np.ndarray, bits: int = BITS, rounds: int = 50, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection (d x bits): principal axes turned so that the codes lie close to the projected vectors."""
    mean = sample.mean(0)
    x = sample - mean
    _, _, axes = np.linalg.svd(x.T @ x)
    axes = axes[: min(bits, x.shape[1])].T
    v = x @ axes
    turn, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((v.shape[1], v.shape[1])))
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
        turn = (u @ w).T
    return mean, axes @ turn


def codes(df: DataFrame, unit: Column, model: tuple[np.ndarray, np.ndarray] | None) -> Column:
    """64-bit code of each unit vector, as a signed long. Vectors of another length than the sample's take the signs of their first 64 numbers."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        mean, axes = shared.value
        for s in batches:
            signs = np.zeros((len(s), BITS), bool)
            fits = np.array([len(v) == len(mean) for v in s], bool)
            if fits.any():
                x = np.stack(s[fits].to_list()) - mean
                signs[np.flatnonzero(fits)[:, None], np.arange(axes.shape[1])] = x @ axes >= 0
            for i in np.flatnonzero(~fits):
                v = np.asarray(s.iat[i])[:BITS]
                signs[i, : len(v)] = v >= 0
            yield pd.Series(np.packbits(signs, axis=1, bitorder="little").view("<i8")[:, 0].astype(np.int64))

    return F.pandas_udf(run, "long")(unit)


def code_pairs(coded: DataFrame, tables: int, bits: int) -> DataFrame:
    """(key, a, b), a < b: distinct codes of one key that meet in a table and differ in WHOLE bits at most."""
    bounds = [(bits * t // tables, bits * (t + 1) // tables) for t in range(tables)]
    radius = ceil((REACH + 1) / tables) - 1
    part = [F.shiftrightunsigned(F.col("code"), lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1)) for lo, hi in bounds]
    own = F.array(*[F.struct(F.lit(t).alias("t"), p.alias("sub")) for t, p in enumerate(part)])
    near = F.array(*[
        F.struct(F.lit(t).alias("t"), F.array(*[F.lit(sum(1 << i for i in c)).cast("long") for r in range(radius + 1) for c in combinations(range(hi - lo), r)]).alias("flips"), p.alias("p"))
        for t, (p, (lo, hi)) in enumerate(zip(part, bounds, strict=True))
    ])
    held = coded.select("key", "code", F.inline(own)).select(F.col("key").alias("_k"), F.col("t").alias("_t"), F.col("sub").cast("long").alias("_sub"), F.col("code").alias("b"))
    asked = coded.select("key", F.col("code").alias("a"), F.inline(near)).select("key", "a", "t", "p", F.explode("flips").alias("f")).select("key", "a", "t", F.col("p").cast("long").bitwiseXOR(F.col("f")).alias("sub"))
    met = asked.join(held, (F.col("key") == F.col("_k")) & (F.col("t") == F.col("_t")) & (F.col("sub") == F.col("_sub")) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= WHOLE))
    return met.select("key", "a", "b").distinct()


def near_duplicates(vectors: DataFrame, least: float = 0.93, sample_rows: int = 10_000, tables: int | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row (vec_id, embedding, label).

    Rows of one non-null label whose cosine is ``least`` or more are linked; vectors that are null, zero or hold null or non-finite
    numbers link with nothing, nor do vectors of different lengths. ``sample_rows`` bounds what the rotation is learned from; every
    vector is indexed. ``tables`` follows the number of vectors of the largest label (parts of about log2(n) - 2 bits, 2 to 5 tables);
    the probes of each grow so that codes within REACH bits always meet.

    n_links counts all other linked rows, copies too. component_id is the smallest vec_id that links reach; null ids are never
    that, and a component of null ids alone has a null one. Empty table: no rows.
    """
    x = F.transform("embedding", lambda v: v.cast("double"))
    fine = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select("vec_id", "label", F.when(F.col("label").isNotNull() & fine, x).alias("_x"))
    top = F.array_max(F.transform("_x", lambda v: F.abs(v)))
    rows = rows.withColumn("_top", top).withColumn("_x", F.when(F.col("_top") > 0, F.transform("_x", lambda v: v / F.col("_top"))))
    rows = rows.withColumn("_c", F.when(F.col("_x").isNotNull(), F.xxhash64("label", "_x", "_top")))
    classes = rows.where("_x is not null").groupBy("_c").agg(F.count("*").alias("n"), F.first("label").alias("label"), F.first("_x").alias("_x"))
    norm = F.sqrt(F.aggregate("_x", F.lit(0.0), lambda s, v: s + v * v))
    classes = cut(classes.withColumn("_n", norm).select("_c", "n", F.struct("label", F.size("_x").alias("d")).alias("key"), F.transform("_x", lambda v: v / F.col("_n")).alias("unit")))
    counts = classes.groupBy("key").count().agg(F.max("count"), F.sum("count")).first()
    if not counts[0]:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"), F.lit(True).alias("kept"))
    drawn = classes.where(F.pmod(F.xxhash64(F.lit("itq"), "_c"), F.lit(1 << 20)) < int(min(1.0, sample_rows / counts[1]) * (1 << 20))).select("unit").toArrow().column("unit").to_pylist() or [r[0] for r in classes.select("unit").limit(1).collect()]
    usual = max((len(v) for v in drawn), key=[len(v) for v in drawn].count)
    model = learn_rotation(np.array([v for v in drawn if len(v) == usual]))
    tables = tables or max(2, min(5, BITS // max(1, ceil(log2(counts[0] + 1)) - 2)))
    coded = cut(classes.withColumn("code", codes(classes, F.col("unit"), model)))
    pairs = code_pairs(coded.select("key", "code").distinct(), tables, BITS)
    # the vectors of each pair of codes, and of each code with itself
    left = coded.select(F.col("key").alias("_k1"), F.col("code").alias("_a"), F.col("_c").alias("u"), F.col("n").alias("nu"), F.col("unit").alias("x"))
    right = coded.select(F.col("key").alias("_k2"), F.col("code").alias("_b"), F.col("_c").alias("v"), F.col("n").alias("nv"), F.col("unit").alias("y"))
    dot = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    across = pairs.join(left, (F.col("key") == F.col("_k1")) & (F.col("a") == F.col("_a"))).select("_k1", "b", "u", "nu", "x")
    across = across.join(right, (F.col("_k1") == F.col("_k2")) & (F.col("b") == F.col("_b"))).where(dot >= least).select("u", "v", "nu", "nv")
    inside = left.join(right, (F.col("_k1") == F.col("_k2")) & (F.col("_a") == F.col("_b")) & (F.col("u") < F.col("v"))).where(dot >= least).select("u", "v", "nu", "nv")
    links = cut(across.unionByName(inside))
    ends = links.select(F.col("u").alias("_c"), F.col("nv").alias("m")).unionByName(links.select(F.col("v").alias("_c"), F.col("nu").alias("m"))).groupBy("_c").agg(F.sum("m").alias("m"))
    labels = components(links.select(F.col("u").alias("a"), F.col("v").alias("b")))
    known = classes.select("_c", "n").join(ends, "_c", "left").join(labels.withColumnRenamed("v", "_c"), "_c", "left").select(F.col("_c").alias("_d"), "n", "m", F.coalesce("label", "_c").alias("_root"))
    named = rows.select("vec_id", "_c").join(known, F.col("_c") == F.col("_d"), "left")
    least_id = named.where("_root is not null").groupBy("_root").agg(F.min("vec_id").alias("_least")).withColumnRenamed("_root", "_r")
    named = named.join(least_id, F.col("_root") == F.col("_r"), "left")
    found = F.when(F.col("_root").isNull(), F.col("vec_id")).otherwise(F.col("_least")).cast("long")
    return named.select("vec_id", F.coalesce(F.col("n") - 1 + F.coalesce("m", F.lit(0)), F.lit(0)).cast("long").alias("n_links"), found.alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
