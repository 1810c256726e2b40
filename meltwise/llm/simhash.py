"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint is a majority vote over the hashes of a text's shingles. Two fingerprints within radius 2 have a common
neighbour within 1 of both, so every distinct fingerprint emits itself and its 64 one-bit variants; all that meet at a
variant are within 2 of each other. At most 65 fingerprints can meet at one, whatever the data hold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meltwise.llm.common import cut, discard, pack, small_batches, tidy, unpack, written
from meltwise.llm.components import components

BITS = 64
SLAB = 1 << 16


def fingerprint_text(text: str | None, words: int) -> int:
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    starts, ends = starts[:n].tolist(), ends[min(words, len(tokens)) - 1 :].tolist()
    votes = np.zeros(BITS, np.int64)
    for i in range(0, n, SLAB):
        votes += _votes(np.array([digest(joined[a:b], 42) for a, b in zip(starts[i : i + SLAB], ends[i : i + SLAB], strict=True)], "<u8"))
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def _votes(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)


def fingerprint(text: Column, words: int = 3) -> Column:
    """64-bit SimHash of the whole text's ``words``-word shingles, as a signed long; 0 for null and for no words.

    Words are runs without blanks and line breaks, A-Z lower-cased; a shorter text is one shingle. A bit is set if it
    is set in over half of the shingles' XXH64 (seed 42), repeated shingles counted each time.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(np.array([fingerprint_text(t, words) for t in s], np.uint64).view(np.int64))

    return F.pandas_udf(run, "long")(text)


def links(prints: DataFrame, fp: str = "fp") -> DataFrame:
    """(a, b) of distinct fingerprints within 2 bits that connect all that such links connect.

    All who meet at a variant are linked to the smallest of them, which holds every group together with one row per member.
    """
    flips = F.concat(F.array(F.lit(0).cast("long")), F.array(*[F.lit((1 << i) - (1 << 64 if i == 63 else 0)).cast("long") for i in range(BITS)]))
    balls = prints.select(F.col(fp).alias("b"), F.explode(flips).alias("_flip")).select("b", F.col("b").bitwiseXOR(F.col("_flip")).alias("_v"))
    met = balls.withColumn("a", F.min("b").over(Window.partitionBy("_v"))).where("a <> b").select("a", "b").distinct()
    return met.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of ``docs``; component_id is the smallest id that links reach.

    Equal fingerprints are one class, so copies of any number never meet one by one. Null ids keep their row; they are
    never the smallest, and a component of null ids alone has a null id. Empty table: no rows.
    """
    rows = cut(docs.select("doc_id", fingerprint(docs["text"], words).alias("fp")))
    prints = rows.groupBy("fp").agg(F.min("doc_id").alias("_least"))
    labels = components(links(prints.select("fp")))
    named = prints.join(labels.select(F.col("v").alias("_v"), "label"), F.col("fp") == F.col("_v"), "left").withColumn("_root", F.coalesce("label", "fp"))
    least = named.groupBy("_root").agg(F.min("_least").alias("component_id"))
    found = named.select(F.col("fp").alias("_fp"), "_root").join(least.withColumnRenamed("_root", "_r"), F.col("_root") == F.col("_r")).select("_fp", "component_id")
    return rows.join(found, F.col("fp") == F.col("_fp")).select("doc_id", "fp", "component_id")


# Documents alike at word level: fingerprints propose, an exact join of shingle sets decides and completes

CLASS = 4  # one shingle of so many tells which sets have too much of their own
FEW = 4  # pairs left for each held shingle at which rounds end
SENT = 1 << 23  # shingles that are sent to pairs at a time, or as many as there are least common ones
ROWS = 500  # texts or sets that a Python worker takes at a time
MARK = 2048  # bits of a set's mark
CHUNK = 512  # members of a part of a shingle's documents that is compared with another part as a whole


def shingle_set(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles, as signed longs; none for a text without words."""
    import xxhash

    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, np.int64)
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    starts, ends = starts[:n].tolist(), ends[min(words, len(tokens)) - 1 :].tolist()
    return np.unique(np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)], np.uint64).view(np.int64))


def shingles(text: Column, words: int) -> Column:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([shingle_set(t, words) for t in s])

    return F.pandas_udf(run, "array<long>")(text)


def summary(text: Column, words: int) -> Column:
    """(u, n, fp, c) of a text's set of shingles: its name, its size, its SimHash, in which every distinct shingle votes once, and the members whose hash CLASS divides."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import xxhash

        for s in batches:
            rows = []
            for t in s:
                h = shingle_set(t, words)
                votes = sum((_votes(h[i : i + SLAB].view(np.uint64)) for i in range(0, len(h), SLAB)), np.zeros(BITS, np.int64))
                rows.append((xxhash.xxh3_64_intdigest(h.tobytes()), len(h), np.packbits(votes * 2 > len(h), bitorder="little").view("<u8")[0], h[h % CLASS == 0]))
            u, n, fp, c = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pd.DataFrame({"u": np.array(u, np.uint64).view(np.int64), "n": np.array(n, np.int32), "fp": np.array(fp, np.uint64).view(np.int64), "c": pd.Series(c, dtype=object)})

    return F.pandas_udf(run, "struct<u:long,n:int,fp:long,c:array<long>>")(text)


def _mark(h: Column) -> Column:
    """MARK bits of a set as longs: those that the low bits of its members name."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            bits = np.zeros((len(s), MARK), np.uint8)
            for i, x in enumerate(s):
                bits[i, np.asarray(x, np.int64) & (MARK - 1)] = 1
            yield pd.Series(list(np.packbits(bits, axis=1).view(np.int64)))

    return F.pandas_udf(run, "array<long>")(h)


def _lacks(a: Column, b: Column) -> Column:
    """How many members of a set marked ``a`` one marked ``b`` lacks at least: a bit of ``a`` that ``b`` has not stands for a member or more."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda n, x: n + x)


def _needed(n: Column, similarity: float) -> Column:
    """How many members of a set of ``n`` a set of that similarity must hold."""
    return F.ceil(similarity * n - 1e-9)


def may_be_alike(sets: DataFrame, similarity: float) -> DataFrame:
    """(u) of the sets (``u`` name, ``n`` size, ``c`` some members, chosen by the member alone) that may have another of that similarity.

    A member that no other set holds is in no other; a set with too many of them is like none. Nothing else is left out.
    """
    held = sets.select("u", F.explode("c").alias("s")).groupBy("s").agg(F.min("u").alias("x"), F.max("u").alias("y"))
    own = held.where("x = y").groupBy(F.col("x").alias("_u")).agg(F.count("*").alias("own"))
    named = sets.groupBy("u").agg(F.first("n").alias("n")).where("n > 0").join(own, F.col("u") == F.col("_u"), "left")
    return named.where(F.col("n") - F.coalesce("own", F.lit(0)) >= _needed(F.col("n"), similarity)).select("u")


def _least_common(sets: DataFrame, similarity: float) -> DataFrame:
    """(u, n, x): of each set ``h`` the shingles that several sets hold and that are among its least common, of which sets of that similarity share one.

    ``x`` is a list of (s, i), ``i`` the shingle's place in its set. Any one order of all shingles makes this true; this one goes by the number of rows that hold a
    shingle, so that those of a single set come first and meet nobody.
    """
    each = sets.select("u", F.size("h").alias("n"), F.explode("h").alias("s"))
    shared = written(each.groupBy("s").agg(F.min("u").alias("x"), F.max("u").alias("y"), F.count("*").alias("c")).where("x <> y").select(F.col("s").alias("_s"), "c"))
    each = each.join(shared, F.col("s") == F.col("_s")).select("s", "u", "n", "c").distinct()
    own = Window.partitionBy("u")
    place = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("c", "s")) - 1
    some = each.withColumn("i", place.cast("int")).where(F.col("i") <= F.col("n") - _needed(F.col("n"), similarity))
    held = written(some.groupBy("u").agg(F.first("n").alias("n"), F.collect_list(F.struct("s", "i")).alias("x")))
    discard(shared)
    return held


def similar_sets(sets: DataFrame, similarity: float, proposed: DataFrame | None = None, fetch: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(a, b) of different sets (``u`` name, ``h`` distinct longs; repeated rows are one) that connect all that pairs of this Jaccard similarity connect.

    Pairs of ``proposed`` (a, b) come first, so that the join need not bring them together again. For the rest: two such sets share one of their
    least common shingles. All who hold such a shingle are compared with one of them, hash-drawn
    anew each round, while many pairs are left and this brings sets together; then all pairs of a shingle that no link has connected
    yet are compared, however many. Every link is verified: marks of MARK bits leave out what lacks too much of the other, and the
    sets of the remaining pairs are compared. ``fetch`` gives the sets (u, h) of names (u), if it can do so with less work than
    reading ``sets``; tables of a step go when the next has been written.
    """
    marks = written(sets.select("u", F.size("h").alias("n"), _mark(F.col("h")).alias("k")).dropDuplicates(["u"]))
    held = _least_common(sets, similarity)

    def able(a: str, b: str) -> Column:
        """Whether lengths and places of a shared shingle leave room for the similarity."""
        na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
        rest = F.least(na - F.col(f"{a}.i"), nb - F.col(f"{b}.i")) + F.least(F.col(f"{a}.i"), F.col(f"{b}.i"))
        return (F.least(na, nb) >= similarity * F.greatest(na, nb) - 1e-9) & (rest * (1 + similarity) >= similarity * (na + nb) - 1e-9)

    def verified(pairs: DataFrame, edges: DataFrame | None) -> DataFrame:
        """``edges`` with those of ``pairs`` that are alike enough."""
        pairs = written(pairs.distinct())
        ends = lambda df, *cols: [df.select(F.col("u").alias(f"_{x}"), *[F.col(y).alias(f"{y}{x}") for y in cols]) for x in "ab"]

        def met(pairs: DataFrame, one: DataFrame, two: DataFrame, longs: float, fit: Column) -> list[DataFrame]:
            """Those of ``pairs`` that fit; rows are sent to their pairs, some pairs at a time, so that no more than a share of all shingles is on the way at once."""
            turns, out = max(1, int(-(-pairs.count() * 2 * longs // max(SENT, size)))), []
            for i in range(turns):
                joined = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(turns)) == i).join(one, F.col("a") == F.col("_a")).join(two, F.col("b") == F.col("_b"))
                out.append(written(joined.where(fit).select("a", "b")))
            return out

        total = lambda na, nb: similarity * (F.col(na) + F.col(nb)) - 1e-9
        most = F.least(F.col("na") - _lacks(F.col("ka"), F.col("kb")), F.col("nb") - _lacks(F.col("kb"), F.col("ka")))
        close = met(pairs, *ends(marks, "n", "k"), MARK // 64, most * (1 + similarity) >= total("na", "nb"))
        near = reduce(DataFrame.unionByName, close)
        named = written(near.select(F.col("a").alias("u")).unionByName(near.select(F.col("b").alias("u"))).distinct())
        some = sets.join(named.withColumnRenamed("u", "_n"), F.col("u") == F.col("_n"), "left_semi").select("u", "h") if fetch is None else fetch(named)
        some = written(some.dropDuplicates(["u"]).withColumn("n", F.size("h")))
        parts = met(near, *ends(some, "n", "h"), some.agg(F.avg("n")).first()[0] or 0, F.size(F.array_intersect("ha", "hb")) * (1 + similarity) >= total("na", "nb"))
        more = reduce(DataFrame.unionByName, parts)
        out = written(more if edges is None else edges.unionByName(more))
        discard(pairs, named, some, edges, *close, *parts)
        return out

    size = held.agg(F.sum(F.size("x"))).first()[0] or 0
    edges, known, turn = verified(proposed, None) if proposed is not None else None, -1, 0
    labels = mixed = None
    while True:
        now, found = held.withColumn("g", F.col("u")), 0
        if edges is not None:
            discard(labels)
            labels = written(components(edges)).withColumnRenamed("v", "_v")
            now, found = held.join(labels, F.col("u") == F.col("_v"), "left").withColumn("g", F.coalesce("label", "u")).drop("_v", "label"), edges.count()
        # labels meet sets, not each of their shingles
        now = now.select("u", "n", "g", F.explode("x").alias("x")).select("x.s", "u", "n", "x.i", "g")
        drawn = F.struct(F.xxhash64(F.lit(turn), F.col("u")).alias("o"), "u", "g", "n", "i")
        mixed = now.groupBy("s", "g").agg(F.count("*").alias("m"), F.min(drawn).alias("hub")).groupBy("s").agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("q"), F.min("hub").alias("hub"))
        mixed = written(mixed.where("m * m > q").select(F.col("s").alias("_s"), "m", "q", "hub"))
        now = now.join(mixed, F.col("s") == F.col("_s")).select("s", "m", "hub", F.struct("u", "g", "n", "i").alias("own"))
        left = mixed.agg(F.sum((F.col("m") * F.col("m") - F.col("q")) / 2)).first()[0] or 0
        if found == known or left <= FEW * size:
            break
        pairs = now.where((F.col("hub.g") != F.col("own.g")) & able("hub", "own")).select(F.least("hub.u", "own.u").alias("a"), F.greatest("hub.u", "own.u").alias("b"))
        edges, known, turn = verified(pairs, edges), found, turn + 1
        discard(mixed)
    # what no link has connected: parts of a shingle's holders, each part with each
    parts = now.select("s", F.col("own"), F.ceil(F.col("m") / CHUNK).cast("int").alias("c")).withColumn("mine", F.pmod(F.xxhash64("own.u"), F.col("c")).cast("int"))
    parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("c") - 1)))
    one = parts.select(F.col("s").alias("s1"), F.col("mine").alias("x1"), F.col("other").alias("y1"), F.col("own").alias("one"))
    two = parts.select(F.col("s").alias("s2"), F.col("other").alias("x2"), F.col("mine").alias("y2"), F.col("own").alias("two"))
    meet = (F.col("s1") == F.col("s2")) & (F.col("x1") == F.col("x2")) & (F.col("y1") == F.col("y2")) & (F.col("one.u") < F.col("two.u")) & (F.col("one.g") != F.col("two.g")) & able("one", "two")
    edges = verified(one.join(two, meet).select(F.col("one.u").alias("a"), F.col("two.u").alias("b")), edges)
    discard(held, marks, labels, mixed)
    return edges


def _proposals(rows: DataFrame) -> DataFrame:
    """(a, b) of sets (u, fp) whose fingerprints are equal or within 2 bits, by ball hashing: each to one set of its fingerprint, and those linked."""
    first = written(rows.groupBy("fp").agg(F.min("u").alias("r")))
    same = rows.join(first.withColumnRenamed("fp", "_f"), F.col("fp") == F.col("_f")).where("u <> r").select(F.col("u").alias("a"), F.col("r").alias("b"))
    ends = lambda n: first.select(F.col("fp").alias(f"_{n}"), F.col("r").alias(f"r{n}"))
    near = links(first.select("fp")).join(ends("a"), F.col("a") == F.col("_a")).join(ends("b"), F.col("b") == F.col("_b")).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    both = same.unionByName(near)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the smallest id, null ids last.

    Near-duplicates are texts whose sets of ``words``-word shingles have a Jaccard similarity of ``similarity`` or more, and all that
    such links connect. SimHash balls (radius 2, as ``near_duplicates``) propose pairs, which the similarity verifies; a pair alike by 0.8 differs in ten bits
    of 64 on average, so the exact join finds the others and no pair is missed. Sets with too much of their own are like none; the others are worked out anew
    from their texts, and only they are kept and compared. Texts without words (null, too) are one group. Among repeated rows of one id and text one
    stays. Empty table: no rows.
    """
    key = lambda df: F.xxhash64(F.coalesce(df["text"], F.lit("")))
    with tidy(docs.sparkSession), small_batches(docs.sparkSession, ROWS):
        told = written(docs.select(key(docs).alias("k"), "doc_id", summary(docs["text"], words).alias("x")).select("k", "doc_id", "x.*"))
        some = written(may_be_alike(told, similarity).withColumnRenamed("u", "_u"))
        rows = written(told.select("k", "doc_id", "u", "fp"))
        discard(told)
        # one row speaks for a set; copies are not read again
        one = rows.join(some, F.col("u") == F.col("_u"), "left_semi").groupBy("u").agg(F.min(F.struct("k", "doc_id")).alias("o"), F.first("fp").alias("fp"))
        one = written(one.select("u", "fp", "o.k", "o.doc_id"))
        texts = docs.select(key(docs).alias("_key"), docs["doc_id"].alias("_own"), docs["text"].alias("_text"))
        met = texts.join(one, (F.col("_key") == F.col("k")) & F.col("_own").eqNullSafe(F.col("doc_id")))
        sets = written(met.select("u", shingles(F.col("_text"), words).alias("h")))
        edges = similar_sets(sets, similarity, _proposals(one.select("u", "fp")))
        labels = written(components(edges))
        discard(edges, one, some, sets)
    named = rows.select("k", "doc_id", "u").join(labels.withColumnRenamed("v", "_v"), F.col("u") == F.col("_v"), "left").withColumn("_root", F.coalesce("label", "u"))
    stays = named.groupBy("_root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id").alias("id"), F.col("k").alias("k"))).alias("s")).select(F.col("s.id").alias("_id"), F.col("s.k").alias("_k"))
    kept = pack(docs, _key=key(docs), _own=docs["doc_id"], _order=F.xxhash64(*[docs[f"`{c}`"] for c in docs.columns if c != "text"]))
    kept = kept.join(stays, (F.col("_key") == F.col("_k")) & F.col("_own").eqNullSafe(F.col("_id")), "left_semi")
    kept = kept.groupBy("_key", "_own").agg(F.min_by("_row", "_order").alias("_row"))
    return unpack(kept, docs.columns)
