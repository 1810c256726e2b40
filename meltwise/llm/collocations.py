"""Phrase collocations by multikey three-way quicksort of suffix pointers.

Every word of a text begins a suffix of up to LONGEST words that ends with its piece. Suffixes are routed over the cluster by their leading
words: equal ones are added up where they are read, and ranges of words cut a frequent leading word by the words that
follow it, so no leading word is too frequent for a task. Each task sorts pointers to its suffixes by multikey three-way quicksort: one word
at a time, three ways around a pivot; what equals the pivot goes on to the next word, and its size is the count of the phrase so far. Parts
that hold fewer than the least count are abandoned, unless they touch the first or last suffix of the task, whose phrases may go on in the
neighbouring one; those counts are added up afterwards.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meltwise.llm.bytewords import byte_table, slices, words_of
from meltwise.llm.common import tidy, written

LONGEST = 4
PART_BYTES = 6 << 20  # bytes of text whose suffixes one task sorts
BORDER_ROWS = 20  # sampled suffixes for each border between tasks
SAMPLE_BYTES = 16 << 20  # bytes of text that are sampled at least
SALTS = 8  # parts into which look-ups of one phrase are dealt
TABLE = byte_table(b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d")


class _Block(NamedTuple):
    """Distinct suffixes of some texts in the order of language and words, with their number."""

    lang: np.ndarray  # place of the language among the block's, in byte order
    langs: list[bytes]
    word: np.ndarray  # LONGEST rows: place of each word among ``closed``, 0 after the last
    closed: pa.Array  # the words, each closed by a tab, which no word holds
    count: np.ndarray

    def key(self, i: int) -> tuple[bytes, ...]:
        return (self.langs[self.lang[i]], *[self.closed[int(w)].as_py() for w in self.word[:, i] if w])


def _block(raw: list[bytes], lang: np.ndarray, langs: list[bytes]) -> _Block:
    w = words_of(raw, TABLE)
    n = len(w.code)
    own, more = lang[w.doc], len(w.names) + 1
    at = np.zeros((LONGEST, n), np.int32)
    for i in range(min(LONGEST, n)):
        at[i, : n - i] = np.where(w.piece[i:] == w.piece[: n - i], w.code[i:] + 1, 0)
    first, last = at[0] * np.int64(more) + at[1], at[2] * np.int64(more) + at[3]
    order = np.lexsort((last, first, own))
    own, first, last = own[order], first[order], last[order]
    new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (first[1:] != first[:-1]) | (last[1:] != last[:-1])))) if n else np.zeros(0, np.int64)
    closed = pa.concat_arrays([pa.array([b""], pa.large_binary()), pc.binary_join_element_wise(w.names, pa.scalar(b"\t", pa.large_binary()), pa.scalar(b"", pa.large_binary()))])
    return _Block(own[new], langs, at[:, order[new]], closed, np.diff(np.append(new, n)))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    for batch in batches:
        coded = batch["lang"].dictionary_encode()
        names = [x.encode("utf-8", "surrogatepass") for x in coded.dictionary.to_pylist()]
        order = sorted(range(len(names)), key=names.__getitem__)
        rank = np.empty(len(names), np.int32)
        rank[order] = np.arange(len(names))
        codes = rank[coded.indices.to_numpy()]
        for start, raw in slices(batch["text"]):
            yield _block(raw, codes[start : start + len(raw)], [names[i] for i in order])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(docs["lang"], F.lit("und")).alias("lang"), docs["text"])


def borders(docs: DataFrame, parts: int, size: int) -> list[tuple[bytes, ...]]:
    """Suffixes that cut all suffixes into ``parts`` ranges of about equal size, from a hash-drawn sample of texts.

    They decide where a suffix is sorted, never what is counted. BORDER_ROWS suffixes a range are looked at on the driver.
    """
    if parts == 1:
        return []
    share = max(1, size // max(SAMPLE_BYTES, parts * BORDER_ROWS * 1000))
    step = max(1, size // share // 8 // (parts * BORDER_ROWS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            keys = [block.key(i) for i in range(step // 2, len(block.lang), step)]
            yield pa.RecordBatch.from_arrays([pa.array([list(k) for k in keys], pa.list_(pa.binary()))], names=["k"])

    some = _texts(docs).where(F.pmod(F.xxhash64("text"), F.lit(share)) == 0)
    keys = sorted(tuple(map(bytes, r.k)) for r in some.mapInArrow(run, "k array<binary>").collect())
    return [keys[len(keys) * i // parts] for i in range(1, parts)] if keys else []


def suffixes(docs: DataFrame, cuts: list[tuple[bytes, ...]]) -> DataFrame:
    """(part, lang, w, c): the texts' suffixes, those alike within a block of text added up, and the range of ``cuts`` they belong to."""
    shared = docs.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches):
            n = len(block.lang)
            at = [bisect_left(range(n), cut, key=block.key) for cut in shared.value]
            part = np.repeat(np.arange(len(at) + 1), np.diff([0, *at, n])).astype(np.int32)
            langs = pa.array([x.decode("utf-8", "surrogatepass") for x in block.langs], pa.string())
            for i in range(0, n, 100_000):
                own = slice(i, i + 100_000)
                text = pc.binary_join_element_wise(*[block.closed.take(pa.array(w[own])) for w in block.word], pa.scalar(b"", pa.large_binary()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[own]), langs.take(pa.array(block.lang[own])), text.cast(pa.large_string()).cast(pa.string()), pa.array(block.count[own].astype(np.int64))], names=["part", "lang", "w", "c"]
                )

    return _texts(docs).mapInArrow(run, "part int, lang string, w string, c long")


def multikey_quicksort(keys: np.ndarray, weight: np.ndarray, least: int, edges: tuple[int, ...] = ()) -> list[tuple[int, int, int]]:
    """(row, depth, count) for each prefix of rows of ``keys`` (rows x depth, 0 ends a row) that ``least`` rows by weight share.

    All parts of one round are split at once. A part without a weight of ``least`` is abandoned, unless it holds a row of ``edges``.
    """
    edge = np.zeros(len(keys), bool)
    edge[list(edges)] = True
    pointer, size, depth = np.arange(len(keys)), np.array([len(keys)] if len(keys) else [], np.int64), np.zeros(min(1, len(keys)), np.int64)
    found = []
    while len(size):
        begin = np.cumsum(size) - size
        part = np.repeat(np.arange(len(size)), size)
        word = keys[pointer, depth[part]]
        three = np.sort(np.stack([word[begin], word[begin + size // 2], word[begin + size - 1]]), axis=0)
        pivot = three[1]
        side = part * 3 + np.sign(word - pivot[part]) + 1
        count = np.bincount(side, minlength=3 * len(size))
        begin3 = np.cumsum(count) - count
        place = np.empty(len(word), np.int64)
        for s in range(3):
            mask = side % 3 == s
            own = side[mask]
            # rank among the rows of the same part and side, in order
            place[mask] = begin3[own] + np.arange(len(own)) - np.repeat(np.cumsum(count[s::3]) - count[s::3], count[s::3])
        moved = np.empty_like(pointer)
        moved[place] = pointer
        pointer = moved
        full = count > 0
        starts = begin3[full]
        total = np.zeros(3 * len(size), np.int64)
        touches = np.zeros(3 * len(size), bool)
        if len(starts):
            total[full] = np.add.reduceat(weight[pointer], starts)
            touches[full] = np.logical_or.reduceat(edge[pointer], starts)
        keep = full & ((total >= least) | touches)
        equal = np.zeros(3 * len(size), bool)
        equal[1::3] = pivot > 0  # 0: the rows have ended
        hit = np.flatnonzero(keep & equal)
        deeper = np.repeat(depth, 3)
        found.extend(zip(pointer[begin3[hit]].tolist(), (deeper[hit] + 1).tolist(), total[hit].tolist(), strict=True))
        deeper[1::3] += 1
        ended = np.zeros(3 * len(size), bool)
        ended[1::3] = (pivot == 0) | (deeper[1::3] >= keys.shape[1])
        keep &= ~ended
        pointer = pointer[np.repeat(keep, count)]
        size, depth = count[keep], deeper[keep]
    return found


def _counts(rows: pa.Table, least: int) -> pa.RecordBatch:
    """Prefix counts of one task's suffixes; the empty phrase counts all of a language's words."""
    text, lang = rows["w"].combine_chunks().cast(pa.large_binary()), rows["lang"].combine_chunks().dictionary_encode()
    n = len(text)
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    ends = np.flatnonzero(data == 9)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    row = np.searchsorted(offsets, starts, "right") - 1
    lengths = np.concatenate(([0], np.cumsum(ends - starts))).astype(np.int64)
    word = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(lengths), pa.py_buffer(data[data != 9])]).dictionary_encode()
    begins = np.searchsorted(row, np.arange(n))
    keys = np.zeros((n, LONGEST + 1), np.int32)
    rank = np.argsort(np.argsort([x.encode("utf-8", "surrogatepass") for x in lang.dictionary.to_pylist()]))
    keys[:, 0] = rank[lang.indices.to_numpy()] + 1
    place = np.empty(len(word.dictionary), np.int32)
    place[pc.sort_indices(word.dictionary).to_numpy()] = np.arange(1, len(place) + 1)
    keys[row, np.arange(len(row)) - begins[row] + 1] = place[word.indices.to_numpy()]
    least_row, most_row = np.arange(n), np.arange(n)
    for d in range(LONGEST + 1):
        least_row = least_row[keys[least_row, d] == keys[least_row, d].min()]
        most_row = most_row[keys[most_row, d] == keys[most_row, d].max()]
    found = multikey_quicksort(keys, rows["c"].to_numpy(), least, (int(least_row[0]), int(most_row[0])))
    # the phrase of a prefix: as many words of its row
    at = np.array([f[0] for f in found], np.int64)
    depth = np.array([f[1] for f in found], np.int64) - 1
    stop = np.where(depth > 0, ends[np.minimum(begins[at] + depth - 1, max(0, len(ends) - 1))] + 1 if len(ends) else 0, offsets[at])
    bytes_ = data.tobytes()
    phrases = [bytes_[a:b].decode("utf-8", "surrogatepass") for a, b in zip(offsets[at].tolist(), stop.tolist(), strict=True)]
    langs = lang.dictionary.take(lang.indices.take(pa.array(at)))
    return pa.RecordBatch.from_arrays([langs, pa.array(phrases, pa.string()), pa.array(depth, pa.int32()), pa.array([f[2] for f in found], pa.int64())], names=["lang", "p", "d", "f"])


def phrase_counts(docs: DataFrame, least: int = 30) -> DataFrame:
    """(lang, p, d, f): phrases of ``d`` words (1 to LONGEST, each closed by a tab) that occur ``least`` times or more, and d = 0: all words."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    cuts = borders(docs, parts, size)
    routed = suffixes(docs, cuts).repartitionById(len(cuts) + 1, "part").drop("part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            found = _counts(pa.Table.from_batches(held), least)
            for i in range(0, found.num_rows, 100_000):
                yield found.slice(i, 100_000)

    partial = routed.mapInArrow(run, "lang string, p string, d int, f long")
    return partial.groupBy("lang", "p", "d").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("d") == 0))


def _wide(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def collocations(docs: DataFrame, least: int = 30, most: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``most`` best phrases of two to LONGEST words with count ``a`` of ``least`` or more.

    The score of a phrase is that of its worst cut into two parts with counts l and r: floor(2000000 a / (l + r)), the leftmost on ties. Phrases
    inside a longer candidate with at least four fifths of their count are left out. Ties go by count and then by the phrase's bytes.

    Null texts are empty, a null language is ``und``; repeated rows count each time; other columns are not read. Empty table: no rows.
    """
    with tidy(docs.sparkSession):
        counts = written(phrase_counts(docs, least))
    words = F.split(F.expr("substring(p, 1, length(p) - 1)"), "\t")
    closed = lambda x: F.concat(F.array_join(x, "\t"), F.lit("\t"))
    long = counts.where("d > 1").select("lang", "p", "d", F.col("f").alias("a"), words.alias("x"))
    # both parts of every cut, looked up in salted parts: a frequent word is part of very many phrases
    cuts = long.select("lang", "p", "d", "a", F.explode(F.sequence(F.lit(1), F.col("d") - 1)).alias("k"), "x")
    sides = cuts.select("lang", "p", "d", "a", "k", F.posexplode(F.array(closed(F.slice("x", F.lit(1), F.col("k"))), closed(F.slice("x", F.col("k") + 1, F.col("d") - F.col("k"))))).alias("side", "q"))
    sides = sides.withColumn("s", F.pmod(F.xxhash64("p"), F.lit(SALTS)).cast("int"))
    held = counts.where(f"d > 0 AND d < {LONGEST}").select(F.col("lang").alias("_l"), F.col("p").alias("_p"), "f", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s"))
    both = sides.join(held, (F.col("q") == F.col("_p")) & (F.col("lang") == F.col("_l")) & (F.col("s") == F.col("_s")))
    scored = both.groupBy("lang", "p", "d", "a", "k").agg(F.max(F.when(F.col("side") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("f"))).alias("r"))
    scored = scored.withColumn("_a", _wide(F.col("a"))).withColumn("_lr", _wide(F.col("l")) + _wide(F.col("r"))).withColumn("score", F.expr("(cast(2000000 as decimal(7,0)) * _a) div _lr"))
    worst = scored.groupBy("lang", "p", "d", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("w"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("d") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("d") - n + 1), lambda i: closed(F.slice("x", i, n)))))
    inside = long.where("d > 2").select("lang", F.explode(spans).alias("q"), "a").groupBy("lang", "q").agg(F.max("a").alias("longer"))
    left = worst.join(inside.select(F.col("lang").alias("_l"), F.col("q").alias("_q"), "longer"), (F.col("p") == F.col("_q")) & (F.col("lang") == F.col("_l")), "left")
    left = left.where(F.col("longer").isNull() | (_wide(F.col("longer")) * 100 < _wide(F.col("a")) * 80))
    phrase = F.translate(F.expr("substring(p, 1, length(p) - 1)"), "\t", " ")
    rows = left.select("lang", phrase.alias("phrase"), "a", "w.l", "w.r", "w.score")
    best = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= most)
    total = counts.where("d = 0").select(F.col("lang").alias("_l"), F.col("f").alias("n"))
    return best.join(total, F.col("lang") == F.col("_l")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
