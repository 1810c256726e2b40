"""Error metrics over long prediction tables.

Every metric is an aggregate with partial aggregation, so a slice that holds most of the rows still
sends one partial row per task. ALL rows come from grouping sets, not from extra passes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meltwise.operators.checkpoints import cut
from meltwise.operators.ranks import running_count

c = F.col


def scorable(nonzero: bool = True) -> Column:
    ok = c("actual").isNotNull() & c("pred").isNotNull()
    return ok & (c("actual") != 0) if nonzero else ok


def r2() -> Column:
    """1 - SSE / SST with SST from the variance aggregate; null below two points or when constant."""
    sst = F.var_pop("actual") * F.count("*")
    sse = F.sum((c("actual") - c("pred")) * (c("actual") - c("pred")))
    return F.when((F.count("*") >= 2) & (F.min("actual") != F.max("actual")), 1.0 - sse / sst)


def mae() -> Column:
    return F.avg(F.abs(c("pred") - c("actual")))


def error_suite(df: DataFrame, keys: list[str]) -> DataFrame:
    """n, R2, MAE, RMSE, MAPE, tolerance shares, bias and spread per slice of at least two rows."""
    err = c("pred") - c("actual")
    pct = F.abs(err / c("actual")) * 100.0
    return (
        df.where(scorable())
        .groupBy(*keys)
        .agg(
            F.count("*").alias("n"), r2().alias("r2"), mae().alias("mae"),
            F.sqrt(F.avg(err * err)).alias("rmse"), F.avg(pct).alias("mape"),
            *[(F.count_if(pct <= k) * 100.0 / F.count("*")).alias(f"within_{k}") for k in (10, 15, 20, 25)],
            F.avg(err).alias("bias"), F.stddev_pop(err).alias("std_error"),
            F.avg("actual").alias("mean_actual"), F.avg("pred").alias("mean_pred"),
        )
        .where(c("n") >= 2)
    )


def sliced(df: DataFrame, sets: list[list[Column]], keys: list[Column], aggs: list[Column]) -> DataFrame:
    """Aggregate over grouping sets; a key outside the set reads as ALL."""
    return df.groupingSets(sets, *keys).agg(*aggs)


def common_rows(df: DataFrame, arm: str, key: list[str]) -> DataFrame:
    """Keep the rows whose key every arm produced.

    The rows of a key (arms x seeds of them) are gathered once with the set of its arms and spread
    again where the set is full: one shuffle, or none of a table already spread by a part of the key. The number of arms is a one-row aggregate joined in.
    """
    arms = df.agg(F.count_distinct(arm).alias("_arms"))
    rest = [x for x in df.columns if x not in key]
    held = df.groupBy(*key).agg(F.collect_set(arm).alias("_seen"), F.collect_list(F.struct(*rest)).alias("_rows"))
    full = held.join(F.broadcast(arms), F.size("_seen") == c("_arms"))
    return full.select(*key, F.inline("_rows")).select(*df.columns)


def with_all(df: DataFrame, column: str) -> list[list[Column]]:
    return [[c(column)], []]


def two_level_seed(df: DataFrame, keys: list[str], seed: str = "seed") -> DataFrame:
    """Metric per seed, then mean and sample deviation over seeds."""
    per_seed = df.where(scorable()).groupBy(*keys, seed).agg(mae().alias("mae"), r2().alias("r2"),
                                                            F.count("*").alias("n"))
    return per_seed.groupBy(*keys).agg(
        F.avg("mae").alias("mae"), F.stddev_samp("mae").alias("mae_sd"), F.avg("r2").alias("r2"),
        F.max("n").alias("n"), F.count("*").alias("n_seeds"),
    )


def seed_ensemble(df: DataFrame, key: list[str]) -> DataFrame:
    """Mean prediction over the seeds that produced a row."""
    return df.groupBy(*key).agg(
        F.first("actual").alias("actual"), F.avg("pred").alias("pred"), F.count("pred").alias("n_seeds")
    )


def align_arms(df: DataFrame, key: list[str], arms: list[int]) -> DataFrame:
    """One row per key with a prediction column per arm (a pivot, so one shuffle for all arms)."""
    wide = df.groupBy(*key).pivot("arm", arms).agg(F.avg("pred"))
    wide = wide.select(*key, *[c(str(a)).alias(f"pred_{a}") for a in arms])
    base = df.groupBy(*key).agg(F.max("actual").alias("actual"))
    return wide.join(base, key)


def paired_errors(df: DataFrame, key: list[str], a: int, b: int) -> DataFrame:
    """Absolute errors of two arms on the rows both scored."""
    pred = lambda arm: F.avg(F.when(c("arm") == arm, c("pred")))
    return (
        df.where(c("arm").isin(a, b))
        .groupBy(*key)
        .agg(F.max("actual").alias("actual"), pred(a).alias("a"), pred(b).alias("b"))
        .where(c("a").isNotNull() & c("b").isNotNull() & (c("actual") != 0))
        .select(*key, "actual", F.abs(c("a") - c("actual")).alias("err_a"),
                F.abs(c("b") - c("actual")).alias("err_b"))
    )


def leave_one_out(entity_sums: DataFrame, keys: list[str]) -> DataFrame:
    """Relative change without each entity, from totals minus the entity's own sums.

    ``entity_sums`` has one row per entity with s_new and s_ref. The group totals are an aggregate
    joined back, so no window holds a whole group in one task.
    """
    totals = entity_sums.groupBy(*keys).agg(F.sum("s_new").alias("t_new"), F.sum("s_ref").alias("t_ref"))
    x = entity_sums.join(totals, keys)
    left_new, left_ref = c("t_new") - c("s_new"), c("t_ref") - c("s_ref")
    point = 100.0 * (c("t_new") - c("t_ref")) / c("t_ref")
    x = x.select("*", point.alias("point"), F.try_divide(100.0 * (left_new - left_ref), left_ref).alias("without"))
    return x.groupBy(*keys).agg(
        F.max("point").alias("point"), F.min("without").alias("loo_min"), F.max("without").alias("loo_max"),
        F.max_by("entity", F.struct(F.round(F.abs(c("without") - c("point")), 9), -c("entity")))
        .alias("most_influential"),
    )


DRAW_BLOCK = 1 << 23  # entities whose sums one task holds, 128 MB
DRAW_PART = 256  # entities whose sums travel as one row
DRAW_PICKS = 1 << 16  # picks that are made at a time


def mixed(h: np.ndarray) -> np.ndarray:
    """32-bit numbers mixed by shifts and fixed odd factors; wraps around, so any engine with 64-bit products repeats it."""
    h = h ^ (h >> np.uint32(16))
    h = h * np.uint32(0x85EBCA6B)
    h = h ^ (h >> np.uint32(13))
    h = h * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def _draws(n: int, first: int, draws: range, sums: np.ndarray) -> np.ndarray:
    """Sums of the picks of some draws that fall into a block: ``sums`` holds s_new + i s_ref of the block's entities."""
    out, whole = np.zeros(len(draws), complex), len(sums) == n
    keys = mixed(np.arange(draws.start, draws.stop, dtype=np.uint32) + np.uint32(0x5BD1E995))
    for i in range(0, n, DRAW_PICKS):
        picks = mixed(np.arange(i, min(n, i + DRAW_PICKS), dtype=np.uint32))
        for d, key in enumerate(keys):
            entity = mixed(picks ^ key).astype(np.uint64)
            entity *= np.uint64(n)
            entity >>= np.uint64(32)
            if not whole:
                entity -= np.uint64(first)  # what lies before the block wraps around to large numbers
                entity = entity[entity < len(sums)]
            out[d] += sums[entity.view(np.int64)].sum()
    return out


def _draw_sums(keys: list[str], block: int):
    """Function of the tasks' rows (sorted by task; each a part of a block's sums) that gives b_new and b_ref of the task's draws."""
    def drawn(head: dict, sums: np.ndarray) -> pa.RecordBatch:
        draws = range(head["from"], head["to"])
        got = _draws(head["n"], head["first"], draws, sums)
        names = {k: pa.array([head[k]] * len(draws), pa.string()) for k in keys}
        return pa.RecordBatch.from_pydict({"draw": pa.array(draws, pa.int64()), "b_new": got.real.copy(), "b_ref": got.imag.copy()} | names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, sums = None, np.empty(0, complex)
        for batch in batches:
            task = batch["_task"].to_numpy()
            starts = np.flatnonzero(np.diff(task, prepend=-1)).tolist() if head is None else np.flatnonzero(np.diff(task, prepend=head["_task"])).tolist()
            for a, b in zip([0, *starts], [*starts, len(task)], strict=True):
                if a == b:
                    continue
                own = batch.slice(a, b - a)
                if head is None or head["_task"] != task[a]:
                    if head is not None:
                        yield drawn(head, sums)
                    head = own.select([*keys, "_task", "n", "first", "from", "to"]).slice(0, 1).to_pylist()[0]
                    sums = np.empty(min(block, head["n"] - head["first"]), complex)
                size = pc.list_value_length(own["new"]).to_numpy(zero_copy_only=False)
                at = np.repeat(own["_part"].to_numpy() * DRAW_PART - head["first"] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                sums.real[at], sums.imag[at] = own["new"].flatten().to_numpy(), own["ref"].flatten().to_numpy()
        if head is not None:
            yield drawn(head, sums)

    return run


def cluster_bootstrap(entity_sums: DataFrame, keys: list[str], draws: int = 10_000, block: int | None = None) -> DataFrame:
    """Percentile interval of the relative change by resampling entities with replacement, as many as the group has in every draw.

    ``entity_sums`` has one row per entity with s_new and s_ref; ``keys`` are strings. Entities are numbered in their order, and pick i of draw d takes the
    entity whose number a hash of (i, d) gives, so a run repeats exactly whatever the partitioning. A task holds a block of entities and makes
    some draws: it adds the sums of the picks that fall into the block, and these are added up over blocks. A group is one block up to
    ``block`` entities, so its picks are made once. There are as many slices of draws as keep all cores busy, hence a block's copies
    get fewer as blocks get more, and what is shuffled are about as many blocks as there are tasks.
    """
    block = -(-(block or DRAW_BLOCK) // DRAW_PART) * DRAW_PART
    entity_sums = cut(entity_sums.select(*keys, "entity", "s_new", "s_ref"))
    sizes = cut(entity_sums.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("s_new").alias("t_new"), F.sum("s_ref").alias("t_ref")))
    rows, blocks = sizes.agg(F.sum("n"), F.sum(F.ceil(c("n") / block))).first()
    busy = 3 * entity_sums.sparkSession.sparkContext.defaultParallelism
    slices = max(1, min(draws, -(-busy // max(1, blocks or 0))))
    cuts = max(2, -(-(rows or 0) // (1 << 18)))
    numbered = running_count(entity_sums.withColumn("_c", F.lit(1)), keys, "entity", "_c", cuts, few=(blocks or 0) * cuts < 100_000)
    numbered = numbered.withColumn("_part", F.floor(c("_before") / DRAW_PART))
    listed = F.sort_array(F.collect_list(F.struct("_before", "s_new", "s_ref")))
    parts = numbered.groupBy(*keys, "_part").agg(listed.alias("_r")).select(
        *keys, "_part", F.floor(c("_part") * DRAW_PART / block).alias("_block"), F.transform("_r", lambda r: r["s_new"]).alias("new"), F.transform("_r", lambda r: r["s_ref"]).alias("ref"))
    # one row for each task
    tasks = sizes.select(*keys, "n", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(c("n") / block) - 1)).alias("_block"))
    tasks = tasks.select("*", (c("_block") * block).alias("first"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_slice"))
    tasks = tasks.select(*keys, "n", "_block", "first", F.floor(c("_slice") * draws / slices).alias("from"), F.floor((c("_slice") + 1) * draws / slices).alias("to"),
                         (F.row_number().over(W.orderBy(*keys, "_block", "_slice")) - 1).alias("_task"))
    places = max(1, min(4096, (blocks or 0) * slices))
    work = parts.join(F.broadcast(tasks), [*keys, "_block"]).repartitionById(places, F.pmod(c("_task"), F.lit(places))).sortWithinPartitions("_task")
    schema = ", ".join(["draw long, b_new double, b_ref double", *[f"{k} string" for k in keys]])
    sums = work.mapInArrow(_draw_sums(keys, block), schema).groupBy(*keys, "draw").agg(F.sum("b_new").alias("b_new"), F.sum("b_ref").alias("b_ref"))
    change = F.try_divide(100.0 * (c("b_new") - c("b_ref")), c("b_ref"))
    boot = sums.groupBy(*keys).agg(
        F.percentile(change, F.lit(0.025)).alias("lo"), F.percentile(change, F.lit(0.975)).alias("hi"),
        F.avg(F.when(change >= 0, 1.0).otherwise(0.0)).alias("p_ge0"),
    )
    point = sizes.select(*keys, c("n").alias("n_entities"), F.try_divide(100.0 * (c("t_new") - c("t_ref")), c("t_ref")).alias("point"))
    return point.join(boot, keys)


def top_share(df: DataFrame, keys: list[str], entity: str, value: str) -> DataFrame:
    """Each entity's share of its group's net value, by size of contribution."""
    totals = df.groupBy(*keys).agg(F.sum(value).alias("net"))
    return df.join(totals, keys).withColumn("share", F.try_divide(c(value), c("net")))


def exact_quantiles(df: DataFrame, keys: list[str], value: str, qs: list[float],
                    accuracy: int = 10000, small: int | None = None, few: bool = False) -> DataFrame:
    """Exact linear-interpolated quantiles, one row per group with a column q<permille> each.

    ``percentile`` keeps every distinct value of a group in one buffer. Here a mergeable sketch
    brackets each quantile first (its rank error is at most n / accuracy). Values inside a bracket
    are counted one by one, the stretches between brackets only as totals, and the ranks come from a
    running sum over those counts. Groups up to ``small`` rows are counted value by value.
    ``few`` says that there are few groups: their brackets are broadcast, so that no task gets a whole group's rows, and the running
    sum is taken over slices of the values.
    """
    small = 4 * accuracy if small is None else small
    pad = 3.0 / accuracy
    edges = [e for q in qs for e in (max(0.0, q - pad), min(1.0, q + pad))]
    base = df.where(c(value).isNotNull()).select(*keys, c(value).alias("_x"))
    brackets = base.groupBy(*keys).agg(
        F.percentile_approx("_x", F.array(*[F.lit(e) for e in edges]), accuracy).alias("_edges"),
        F.count("*").alias("_n"),
    )
    marked = base.join(F.broadcast(brackets) if few else brackets, keys) if keys else base.crossJoin(F.broadcast(brackets))
    inside = c("_n") <= small
    for i, q in enumerate(qs):
        above = F.lit(True) if q - pad <= 0 else c("_x") >= F.get("_edges", F.lit(2 * i))
        below = F.lit(True) if q + pad >= 1 else c("_x") <= F.get("_edges", F.lit(2 * i + 1))
        inside = inside | (above & below)
    stretch = F.size(F.filter("_edges", lambda e: e < c("_x")))
    counts = (
        marked.groupBy(*keys, F.when(inside, c("_x")).alias("_v"), F.when(~inside, stretch).alias("_s"))
        .agg(F.count("*").alias("_c"), F.min("_x").alias("_o"), F.first("_n").alias("_n"))
    )
    if few:
        ranked = running_count(cut(counts), keys, "_o", "_c", few=True).withColumn("_end", c("_before") + c("_c"))
    else:
        w = W.partitionBy(*keys).orderBy("_o").rowsBetween(W.unboundedPreceding, 0)
        ranked = counts.withColumn("_end", F.sum("_c").over(w))
    start = c("_end") - c("_c")
    aggs = []
    for q in qs:
        pos = (c("_n") - 1) * q
        near = F.round(pos)
        pos = F.when(F.abs(pos - near) < 1e-9, near).otherwise(pos)
        at = lambda r: F.max(F.when((start <= r) & (r < c("_end")), c("_v")))
        low, high, frac = at(F.floor(pos)), at(F.ceil(pos)), F.max(pos - F.floor(pos))
        aggs.append((low + (high - low) * frac).alias(f"q{round(q * 1000)}"))
    return ranked.groupBy(*keys).agg(*aggs)
