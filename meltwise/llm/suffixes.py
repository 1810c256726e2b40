"""Suffix-array dedup: every byte of a 200-byte string that also starts elsewhere goes.

Difference-cover blockwise construction, with a cover chosen by content (a string synchronizing set): every 200-byte string holds one
cover point, equal strings hold it at the same place, and about one position in 75 is a point. So the suffixes that could have
an equal 200-byte beginning are known from the points' ranks alone, and the suffix order is only made where those leave it open:

1. Points are ranked by the name of the 48 bytes at them; points of a rank that occurs once are done, with all their suffixes.
2. A point speaks for a run of suffixes that reach it first. Runs that are equal as a whole are long ties, resolved by the
   rank of the run: all their suffixes are repeated, and one run stands for all in what follows.
3. What is left are runs that agree at the point and differ farther off, at the edges of copied passages. They are sorted one bucket
   at a time (a bucket holds the runs of some ranks): what follows the point and, backwards, what precedes it, each with the
   lengths of common prefixes. Two suffixes are equal for 200 bytes if they are in one group of both orders.

A rank with very many different runs is not sorted in one task: its suffixes are spread by the names of their 200 bytes.
Names are 64-bit hashes; strings count as equal where two independent names, or a name and its length and rank, agree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltwise.llm.common import tidy, written
from meltwise.llm.cover import BATCH, GRAM, REPEAT, STARTS, Names, cover

REST = REPEAT - GRAM
BUCKET = 20_000  # runs sorted at once
HOT = 100_000  # different runs of one rank, from which on its suffixes are spread


def pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, offset, bytes) in batches of about BATCH bytes; a longer text comes in pieces that overlap by a string less a byte."""
    batch, size = [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - REPEAT + 1), BATCH):
            batch.append((i, a, t[a : a + BATCH + REPEAT - 1]))
            size += len(batch[-1][2])
            if size >= BATCH:
                yield batch
                batch, size = [], 0
    if batch:
        yield batch


def _points(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cover points of each batch's texts: rank name, run name, text key, where the run starts, lies and how long it is, and copies."""
    for pdf in parts:
        pdf = pdf[pdf.text.notna()]
        copies = pdf.groupby("k").size()
        pdf = pdf.drop_duplicates("k")
        keys, times = pdf.k.to_numpy(), copies.loc[pdf.k].to_numpy()
        for batch in pieces([t.encode("utf-8", "surrogatepass") for t in pdf.text]):
            buf = np.frombuffer(b"".join(t for _, _, t in batch), np.uint8)
            ends = np.cumsum([len(t) for _, _, t in batch])
            one, two = Names(buf, 0), Names(buf, 1)
            piece, point, low, count = cover(one, ends)
            owner = np.array([i for i, _, _ in batch])[piece]
            shift = (np.array([a for _, a, _ in batch]) - np.concatenate(([0], ends[:-1])))[piece]
            yield pd.DataFrame({
                "c": one.of(point, point + GRAM).view(np.int64), "b": two.of(low, low + count - 1 + REPEAT).view(np.int64), "k": keys[owner],
                "spot": ((low + shift) << 16) | ((point - low) << 8) | count, "w": times[owner].astype(np.int32),
            })


def removal(data: bytes, starts: np.ndarray, counts: np.ndarray) -> tuple[int, int, int, str]:
    """(n_bytes, n_removed, n_spans, kept_sha256) when the strings that start at ``starts``, ``starts`` + 1, ... go."""
    order = np.argsort(starts, kind="stable")
    spans: list[tuple[int, int]] = []
    if len(order):
        a, far = starts[order], np.maximum.accumulate((starts + counts - 1 + REPEAT)[order])
        new = np.flatnonzero(np.concatenate(([True], a[1:] > far[:-1])))
        spans = [(int(a[i]), int(far[j - 1])) for i, j in zip(new, [*new[1:], len(a)], strict=True)]
    digest, at, gone = hashlib.sha256(), 0, 0
    for x, y in spans:
        digest.update(data[at:x])
        at, gone = y, gone + y - x
    digest.update(data[at:])
    return len(data), gone, len(spans), digest.hexdigest()


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"


STAGED = f"k long, text string, gone array<long>, open boolean, {RESULT}, runs array<struct<c long, spot long, bw int, hot boolean, run binary>>"


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Result of each text, or the text itself where runs are open; and the bytes of the runs that others are compared with."""
    for pdf in batches:
        out = []
        for k, text, gone, asked, is_open, size, plain in zip(pdf.k, pdf.text, pdf.gone, pdf.asked, pdf.open, pdf.n_bytes, pdf.plain, strict=True):
            if plain is not None:
                out.append((k, None, None, False, size, 0, 0, plain, None))
                continue
            data, runs = text.encode("utf-8", "surrogatepass"), []
            for r in asked:
                low, count = r["spot"] >> 16, r["spot"] & 255
                runs.append({"c": r["c"], "spot": r["spot"], "bw": r["bw"], "hot": r["hot"], "run": data[low : low + count - 1 + REPEAT]})
            if is_open:
                out.append((k, text, gone, True, None, None, None, None, runs))
            else:
                spots = np.asarray(gone, np.int64)
                out.append((k, None, None, False, *removal(data, spots >> 16, spots & 255), runs))
        names = ["k", "text", "gone", "open", "n_bytes", "n_removed", "n_spans", "kept_sha256", "runs"]
        yield pd.DataFrame(out, columns=names).astype({"n_bytes": "Int64", "n_removed": "Int64", "n_spans": "Int64"})


def _close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Result of each text whose open runs have been sorted."""
    for pdf in batches:
        out = []
        for k, text, gone, found in zip(pdf.k, pdf.text, pdf.gone, pdf.found, strict=True):
            spots = np.asarray(gone, np.int64)
            more = found if found is not None else []
            starts = np.concatenate((spots >> 16, np.array([r["start"] for r in more], np.int64)))
            counts = np.concatenate((spots & 255, np.array([r["count"] for r in more], np.int64)))
            out.append((k, *removal(text.encode("utf-8", "surrogatepass"), starts, counts)))
        yield pd.DataFrame(out, columns=["k", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _order(rows: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of byte rows within ranks, and each one's common prefix with the one before (-1 at a new rank)."""
    keyed = np.concatenate((rank.astype(">u4").view(np.uint8).reshape(-1, 4), rows), axis=1)
    order = np.argsort(np.ascontiguousarray(keyed).view(f"V{keyed.shape[1]}").ravel(), kind="stable")
    s, r = rows[order], rank[order]
    differs = s[1:] != s[:-1]
    common = np.where(differs.any(1), differs.argmax(1), s.shape[1])
    return order, np.concatenate(([-1], np.where(r[1:] != r[:-1], -1, common)))


def sort_bucket(pdf: pd.DataFrame) -> pd.DataFrame:
    """(k, start, count): repeated strings of the runs with one occurrence, among all runs of a bucket's ranks."""
    n = len(pdf)
    spot, bw = pdf.spot.to_numpy(), pdf.bw.to_numpy()
    low, before, count = spot >> 16, (spot >> 8) & 255, spot & 255
    rank = np.unique(pdf.c.to_numpy(), return_inverse=True)[1]
    left, right = np.zeros((n, REST), np.uint8), np.zeros((n, REST), np.uint8)
    for i, (run, d) in enumerate(zip(pdf.run, before, strict=True)):
        b = np.frombuffer(run, np.uint8)
        left[i, :d] = b[:d][::-1]
        after = b[d + GRAM : d + REPEAT]
        right[i, : len(after)] = after
    groups = []
    for rows in (left, right):
        order, common = _order(rows, rank)
        groups.append((order, common))
    repeated = np.zeros((n, STARTS), bool)
    ids = [np.empty(n, np.int64), np.empty(n, np.int64)]
    for d in range(STARTS):  # strings that start d bytes before their point
        own = np.flatnonzero((before >= d) & (before - count < d))
        if len(own) < 2:
            continue
        for side, width in ((0, d), (1, REST - d)):
            order, common = groups[side]
            ids[side][order] = np.cumsum(common < width)
        _, at = np.unique(ids[0][own] * (n + 1) + ids[1][own], return_inverse=True)
        repeated[own, d] = np.bincount(at, bw[own])[at] > 1
    out: list[tuple[int, int, int]] = []
    keys = pdf.k.to_numpy()
    for i in np.flatnonzero((bw == 1) & repeated.any(1)):
        starts = np.sort(low[i] + before[i] - np.flatnonzero(repeated[i]))
        cuts = np.flatnonzero(np.diff(starts) > 1) + 1
        out += [(keys[i], p[0], len(p)) for p in np.split(starts, cuts)]
    return pd.DataFrame(out, columns=["k", "start", "count"], dtype=np.int64)


def _spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Names of all strings of runs, for ranks too large to sort."""
    for pdf in batches:
        for k, c, spot, bw, run in zip(pdf.k, pdf.c, pdf.spot, pdf.bw, pdf.run, strict=True):
            low, before, count = spot >> 16, (spot >> 8) & 255, spot & 255
            buf = np.frombuffer(run, np.uint8)
            at = np.arange(count)
            yield pd.DataFrame({"k": k, "c": c, "d": before - at, "h": Names(buf, 1).of(at, at + REPEAT).view(np.int64), "start": low + at, "bw": np.int32(bw)})


def repeated_strings(docs: DataFrame, bucket: int = BUCKET, hot: int = HOT) -> DataFrame:
    """(k, n_bytes, n_removed, n_spans, kept_sha256): one row for each distinct text of ``docs``, k = xxhash64(text), null as empty.

    Copies of a text are counted, not compared. Texts move once, each distinct one to one task; texts whose
    outcome hangs on an open run move once more.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("k"), "text")
    with tidy(spark):
        points = keyed.mapInPandas(_points, "c long, b long, k long, spot long, w int")
        ranks = written(points.groupBy("c").agg(F.sum("w").alias("n")).where("n > 1").select(F.col("c").alias("_c")))
        hits = written(points.join(ranks, F.col("c") == F.col("_c")).select("c", "b", "k", "spot", "w"))
        per_run = hits.groupBy("c", "b").agg(F.sum("w").alias("bw"), F.min(F.struct("k", "spot")).alias("rep"))
        per_run = written(per_run)
        per_rank = per_run.groupBy(F.col("c").alias("_c")).agg(F.count("*").alias("runs")).where("runs > 1")
        asked = written(per_run.join(per_rank, F.col("c") == F.col("_c")).select("c", F.least("bw", F.lit(2)).cast("int").alias("bw"), F.col("rep.k").alias("k"), F.col("rep.spot").alias("spot"), (F.col("runs") > hot).alias("hot")))
        ties = per_run.where("bw > 1").select(F.col("c").alias("_c"), F.col("b").alias("_b"))
        gone = hits.join(ties, (F.col("c") == F.col("_c")) & (F.col("b") == F.col("_b"))).select("k", "spot", F.lit(0).cast("long").alias("c"), F.lit(None).cast("int").alias("bw"), F.lit(None).cast("boolean").alias("hot"))
        known = gone.unionByName(asked.select("k", "spot", "c", "bw", "hot")).groupBy("k").agg(
            F.collect_set(F.when(F.col("bw").isNull(), F.col("spot"))).alias("gone"),
            F.collect_set(F.when(F.col("bw").isNotNull(), F.struct("c", "spot", "bw", "hot"))).alias("asked"),
            F.coalesce(F.bool_or(F.col("bw") == 1), F.lit(False)).alias("open"),
        )
        known = written(known.withColumnRenamed("k", "_k"))
        texts = keyed.groupBy("k").agg(F.first("text").alias("text"))
        held = texts.join(known, F.col("k") == F.col("_k"), "left").drop("_k")
        told = F.col("open").isNotNull()  # texts without a repeated point go through with their result
        held = held.select(
            "k", F.when(told, F.col("text")).alias("text"), "gone", "asked", F.coalesce("open", F.lit(False)).alias("open"),
            F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.when(~told, F.sha2(F.coalesce("text", F.lit("")), 256)).alias("plain"),
        )
        staged = written(held.mapInPandas(_judge, STAGED))
        runs = staged.where(F.size("runs") > 0).select("k", F.inline("runs"))
        n = asked.where(~F.col("hot")).count()
        sorted_runs = runs.where(~F.col("hot")).groupBy(F.pmod("c", F.lit(max(1, -(-n // bucket)))).alias("bucket")).applyInPandas(sort_bucket, "k long, start long, count long")
        spread = runs.where("hot").select("k", "c", "spot", "bw", "run").mapInPandas(_spread, "k long, c long, d int, h long, start long, bw int")
        many = spread.groupBy(F.col("c").alias("_c"), F.col("d").alias("_d"), F.col("h").alias("_h")).agg(F.sum("bw").alias("n")).where("n > 1")
        spread = spread.where("bw = 1").join(many, (F.col("c") == F.col("_c")) & (F.col("d") == F.col("_d")) & (F.col("h") == F.col("_h"))).select("k", "start", F.lit(1).cast("long").alias("count"))
        found = sorted_runs.unionByName(spread).groupBy(F.col("k").alias("_k")).agg(F.collect_list(F.struct("start", "count")).alias("found"))
        found = written(found)
        open_texts = staged.where("open").select("k", "text", "gone").join(found, F.col("k") == F.col("_k"), "left").drop("_k")
        closed = open_texts.mapInPandas(_close, f"k long, {RESULT}")
        return written(closed.unionByName(staged.where("not open").select("k", "n_bytes", "n_removed", "n_spans", "kept_sha256")))


def remove_repeats(docs: DataFrame, **sizes: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): one row per row of ``docs``.

    ``n_spans`` counts maximal removed runs. Null and empty texts: nothing to remove. Copies of a text of 200 bytes or more are removed whole,
    all of them, as their strings start elsewhere too. Null ids and repeated rows keep their rows. Empty table: no rows.
    """
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_key"))
    found = repeated_strings(docs, **sizes)
    return rows.join(found, F.col("_key") == F.col("k")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
