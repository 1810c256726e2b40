"""Source divergence audit: how a source's use of words departs from other sources of its language, by minimal perfect hashes.

A first pass finds exactly the terms that stand in enough documents of a language. They are dealt into shards, and each shard gets a minimal perfect
hash: bits of a few levels, the rank of a key's bit being its slot, and the keys themselves in slot order, so that a word that is not a key
is known by comparison. The hashes are broadcast, as many shards at a time as ROUND_BYTES hold, and a second pass over the documents
increments dense slots of each group (language, source). All figures are exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meltwise.llm.bytewords import byte_table, slices, words_of
from meltwise.llm.common import written

TEXT_BYTES = 8 << 20  # bytes of text worked on at a time
SHARD_TERMS = 1 << 16  # keys of one hash
ROUND_BYTES = 96 << 20  # hashes that are broadcast at a time
HELD = 4 << 20  # dense slots that a task holds before it hands their counts on
CELLS = 1 << 21  # terms x sources of a block whose pairs are compared at a time
STRIP = 256  # sources compared with all others in one task
PER_LEVEL = 2  # bits a key at each level
TABLE = byte_table(bytes(b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122)))


# Minimal perfect hashes


def key_hashes(keys: list[bytes]) -> np.ndarray:
    """128-bit hashes of keys, as rows of two unsigned longs."""
    import xxhash

    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(k) for k in keys), "<u8").reshape(-1, 2)


def _bit(hashes: np.ndarray, level: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = hashes[:, 0] + hashes[:, 1] * np.uint64(2 * level + 1)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
    return (x % np.uint64(bits)).astype(np.int64)


class PerfectHash:
    """Slots 0 to n - 1 of n distinct keys, and -1 for any other key."""

    def __init__(self, keys: list[bytes]):
        hashes = key_hashes(keys)
        left, self.levels, level, base = np.arange(len(keys)), [], 0, 0
        slot = np.zeros(len(keys), np.int64)
        while len(left):
            if level > 200:
                raise ValueError("keys are not distinct")
            bits = max(64, PER_LEVEL * len(left) + 63 & ~63)
            at = _bit(hashes[left], level, bits)
            alone = np.bincount(at, minlength=bits) == 1
            rank = np.cumsum(alone) - 1
            mine = alone[at]
            slot[left[mine]] = base + rank[at[mine]]
            blocks = alone.reshape(-1, 64)
            self.levels.append((bits, np.packbits(blocks, axis=1, bitorder="little").view("<u8").ravel(), base + np.cumsum(blocks.sum(1)) - blocks.sum(1)))
            base += int(alone.sum())
            left, level = left[~mine], level + 1
        order = np.empty(len(keys), np.int64)
        order[slot] = np.arange(len(keys))
        self.keys = pa.array([keys[i] for i in order.tolist()], pa.large_binary())

    def slots(self, keys: list[bytes], hashes: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, words, before) in enumerate(self.levels):
            at = _bit(hashes[open_], level, bits)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[open_[hit]] = before[at[hit] >> 6] + below[hit]
            open_ = open_[~hit]
        asked = np.flatnonzero(out >= 0)
        if len(asked):
            stored = self.keys.take(pa.array(out[asked]))
            same = pc.equal(stored, pa.array([keys[i] for i in asked.tolist()], pa.large_binary())).to_numpy(zero_copy_only=False)
            out[asked[~same]] = -1
        return out


def _key(lang: str, term: bytes) -> bytes:
    """A term holds no zero byte, so the first one ends it."""
    return term + b"\0" + lang.encode("utf-8", "surrogatepass")


# Passes over the documents


def _facts(docs: DataFrame) -> DataFrame:
    """(lang, source, text) with empty strings for nulls."""
    return docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def _document_frequency(facts: DataFrame) -> DataFrame:
    """(lang, term, df): documents that hold a term, added up in blocks of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch["lang"].dictionary_encode()
            langs = coded.indices.to_numpy()
            for start, raw in slices(batch["text"], TEXT_BYTES):
                w = words_of(raw, TABLE, in_order=False, breaks=False)
                n = len(w.names)
                once = np.unique(w.doc * max(1, n) + w.code)  # a document counts a term once
                own, number = np.unique(langs[start + once // max(1, n)].astype(np.int64) * max(1, n) + once % max(1, n), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [coded.dictionary.take(pa.array(own // max(1, n))), w.names.take(pa.array(own % max(1, n))).cast(pa.large_string()).cast(pa.string()), pa.array(number)], names=["lang", "term", "df"]
                )

    return facts.select("lang", "text").mapInArrow(run, "lang string, term string, df long")


def kept_terms(docs: DataFrame, least: int = 10) -> DataFrame:
    """(lang, term): terms in at least ``least`` documents of their language."""
    return _document_frequency(_facts(docs)).groupBy("lang", "term").agg(F.sum("df").alias("df")).where(F.col("df") >= least).select("lang", "term")


def perfect_hashes(terms: DataFrame, shards: int) -> DataFrame:
    """(shard, n, hash): a pickled minimal perfect hash of each shard's (language, term) keys."""
    import pickle

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [_key(x, t.encode("utf-8", "surrogatepass")) for x, t in zip(b["lang"].to_pylist(), b["term"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array((key_hashes(keys)[:, 0] % np.uint64(shards)).astype(np.int32)), pa.array(keys, pa.binary())], names=["shard", "key"])

    def build(table: pa.Table) -> pa.Table:
        hashed = PerfectHash(table["key"].to_pylist())
        return pa.table({"shard": table["shard"].slice(0, 1), "n": pa.array([table.num_rows], pa.int32()), "hash": pa.array([pickle.dumps(hashed)], pa.binary())})

    return terms.select("lang", "term").mapInArrow(deal, "shard int, key binary").groupBy("shard").applyInArrow(build, "shard int, n int, hash binary")


def _slot_terms(hashes: DataFrame) -> DataFrame:
    """(shard, slot, lang, term) as the stored keys have it."""
    import pickle

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, raw in zip(b["shard"].to_pylist(), b["hash"].to_pylist(), strict=True):
                keys = [k.partition(b"\0") for k in pickle.loads(raw).keys.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(keys), pa.int32()), pa.array(range(len(keys)), pa.int32()), pa.array([k[2].decode("utf-8", "surrogatepass") for k in keys], pa.string()), pa.array([k[0].decode("utf-8", "surrogatepass") for k in keys], pa.string())],
                    names=["shard", "slot", "lang", "term"],
                )

    return hashes.select("shard", "hash").mapInArrow(run, "shard int, slot int, lang string, term string")


def _recount(facts: DataFrame, held: dict[int, bytes], shards: int) -> DataFrame:
    """(lang, source, shard, slot, c): occurrences of the held shards' terms in each group, as tasks have counted them."""
    import pickle

    shared = facts.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = {s: pickle.loads(raw) for s, raw in shared.value.items()}
        dense: dict[tuple[str, str, int], np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source, shard), slots in dense.items():
                at = np.flatnonzero(slots)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(at), pa.string()), pa.array([source] * len(at), pa.string()), pa.array(np.full(len(at), shard, np.int32)), pa.array(at.astype(np.int32)), pa.array(slots[at])],
                    names=["lang", "source", "shard", "slot", "c"],
                )
            dense.clear()

        size = 0
        for batch in batches:
            group = pa.table([batch["lang"], batch["source"]], names=["l", "s"])
            groups = [(g["l"], g["s"]) for g in group.group_by(["l", "s"]).aggregate([]).to_pylist()]
            number = {g: i for i, g in enumerate(groups)}
            mine = np.array([number[k] for k in zip(group["l"].to_pylist(), group["s"].to_pylist(), strict=True)])
            for start, raw in slices(batch["text"], TEXT_BYTES):
                w = words_of(raw, TABLE, in_order=False, breaks=False)
                if not len(w.code):
                    continue
                n = len(w.names)
                own, counts = np.unique(mine[start + w.doc] * n + w.code, return_counts=True)
                group, code = own // n, own % n
                for lang in sorted({x for x, _ in (groups[g] for g in np.unique(group).tolist())}):
                    # a language's terms of the block are looked up once
                    rows = np.flatnonzero(np.array([x == lang for x, _ in groups])[group])
                    asked = np.unique(code[rows])
                    keys = [_key(lang, t) for t in w.names.take(pa.array(asked)).to_pylist()]
                    hashed = key_hashes(keys)
                    shard = (hashed[:, 0] % np.uint64(shards)).astype(np.int64)
                    slot = np.full(len(keys), -1, np.int64)
                    for s, perfect in hashes.items():
                        at = np.flatnonzero(shard == s)
                        slot[at] = perfect.slots([keys[i] for i in at.tolist()], hashed[at])
                    at = np.searchsorted(asked, code[rows])
                    rows, at = rows[slot[at] >= 0], at[slot[at] >= 0]
                    part = group[rows] * shards + shard[at]
                    order = np.argsort(part, kind="stable")
                    for some in np.split(order, np.flatnonzero(np.diff(part[order])) + 1):
                        if len(some):
                            key = (lang, groups[group[rows[some[0]]]][1], int(shard[at[some[0]]]))
                            if key not in dense:
                                dense[key] = np.zeros(len(hashes[key[2]].keys), np.int64)
                                size += len(hashes[key[2]].keys)
                            dense[key][slot[at[some]]] += counts[rows[some]]
                    if size > HELD:
                        yield from out()
                        size = 0
        yield from out()

    return facts.mapInArrow(run, "lang string, source string, shard int, slot int, c long")


def counts(docs: DataFrame, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """Counts (lang, source, shard, slot, c) above zero of every group, and the terms (shard, slot, lang, term) they are of."""
    facts = _facts(docs)
    terms = written(kept_terms(docs, least))
    shards = max(1, -(-terms.count() // SHARD_TERMS))
    hashes = written(perfect_hashes(terms, shards).withColumn("bytes", F.octet_length("hash")))
    partial, now, size = [], [], 0
    for shard, bytes_ in sorted(map(tuple, hashes.select("shard", "bytes").collect())):
        if now and size + bytes_ > ROUND_BYTES:
            partial.append(now)
            now, size = [], 0
        now.append(shard)
        size += bytes_
    partial.append(now)
    rounds = [_recount(facts, dict(map(tuple, hashes.where(F.col("shard").isin(p)).select("shard", "hash").collect())), shards) for p in partial]
    counted = rounds[0]
    for more in rounds[1:]:
        counted = counted.unionByName(more)
    return written(counted.groupBy("lang", "source", "shard", "slot").agg(F.sum("c").alias("c"))), written(_slot_terms(hashes))


# Figures


def _share(c: Column, n: Column, v: Column) -> Column:
    """Smoothed share in billionths, rounded down, and one more."""
    above = (F.lit(1_000_000_000).cast("decimal(10,0)") * (c + 2).cast("decimal(19,0)")).alias("above")
    below = n.cast("decimal(19,0)") + v.cast("decimal(18,0)") * 2
    return F.call_function("div", above, below) + 1


def _gap(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _strips(block: pa.Table, groups: pa.Table) -> pa.Table:
    """Sums of the gaps of each source of the strip with every later one, over the block's terms."""
    n = groups.num_rows
    order = np.argsort(groups["sid"].to_numpy())
    sid, zero = groups["sid"].to_numpy()[order], groups["zero"].to_numpy()[order]
    terms, column = np.unique(block["slot"].to_numpy(), return_inverse=True)
    share = np.repeat(zero[:, None], len(terms), axis=1)
    share[np.searchsorted(sid, block["sid"].to_numpy()), column] = block["p"].to_numpy()
    strip = groups["strip"][0].as_py()
    a = np.flatnonzero((sid >= strip * STRIP) & (sid < (strip + 1) * STRIP))
    out = [[], [], []]
    for i in a.tolist():
        if i + 1 < n:
            p, q = share[i], share[i + 1 :]
            out[0].append(np.full(n - i - 1, sid[i]))
            out[1].append(sid[i + 1 :])
            out[2].append(((p - q) ** 2 // (p + q)).sum(1))
    columns = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in out]
    return pa.table({"lang": pa.array([groups["lang"][0].as_py()] * len(columns[0]), pa.string()), "a": columns[0], "b": columns[1], "value": columns[2]})


def audit(docs: DataFrame, least: int = 10, most: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group its gaps to the language's other sources, and the ``most`` terms it overuses most.

    Nulls of lang, source and text are empty strings; repeated rows count each time. Every group that occurs is compared, also one without terms;
    a language without kept terms has gaps of 0. Ties go by the item's bytes. Other columns are not read. Empty table: no rows.
    """
    counted, terms = counts(docs, least)
    vocabulary = terms.groupBy("lang").agg(F.count("*").alias("v"))
    sums = counted.groupBy("lang", "source").agg(F.sum("c").alias("n"))
    groups = _facts(docs).select("lang", "source").distinct()
    by_lang = Window.partitionBy("lang")
    groups = groups.join(sums, ["lang", "source"], "left").join(vocabulary, "lang", "left").na.fill(0, ["n", "v"])
    groups = groups.withColumn("all", F.sum("n").over(by_lang)).withColumn("sources", F.count("*").over(by_lang))
    groups = written(groups.withColumn("sid", (F.row_number().over(by_lang.orderBy("source")) - 1).cast("long")))
    of_lang = counted.groupBy("lang", "shard", "slot").agg(F.sum("c").alias("lc"))
    named = counted.join(groups, ["lang", "source"]).join(of_lang, ["lang", "shard", "slot"]).withColumn("p", _share(F.col("c"), F.col("n"), F.col("v")))
    named = written(named.select("lang", "source", "sid", "sources", "shard", "slot", "p", _share(F.col("lc"), F.col("all"), F.col("v")).alias("q")))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    over = named.where("p > q").join(terms.select("shard", "slot", F.col("term").alias("item")), ["shard", "slot"]).withColumn("value", _gap(F.col("p"), F.col("q")))
    over = over.select("lang", "source", F.lit("term").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    width = F.greatest(F.lit(64), F.floor(F.lit(CELLS) / F.col("sources"))).cast("int")
    strip = F.explode(F.sequence(F.lit(0), F.floor((F.col("sources") - 1) / STRIP).cast("int")))
    cells = named.select("lang", "shard", F.floor(F.col("slot") / width).cast("int").alias("block"), strip.alias("strip"), "sid", "slot", "p")
    cells = written(cells)
    blocks = cells.select("lang", "shard", "block", "strip").distinct()
    zeros = groups.where("v > 0").select("lang", "sid", _share(F.lit(0).cast("long"), F.col("n"), F.col("v")).alias("zero"))
    sides = written(blocks.join(zeros, "lang").select("lang", "shard", "block", "strip", "sid", "zero"))
    keys = ["lang", "shard", "block", "strip"]
    gaps = cells.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInArrow(_strips, "lang string, a long, b long, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    gaps = written(gaps)
    both = gaps.unionByName(gaps.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    one = groups.select("lang", "source", F.col("sid").alias("a"))
    pairs = one.join(groups.select("lang", F.col("source").alias("item"), F.col("sid").alias("b")), "lang").where("a <> b").join(both, ["lang", "a", "b"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0).cast("long")).alias("value")).withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(over).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
