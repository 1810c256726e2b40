"""Best-fit packing of token sequences by exact-complement hashing.

Only the number of pieces of each length matters for the packing, so it is worked out on the driver from at most CAPACITY counts, however
many documents there are. From the longest length down, what is missing to a full sequence is looked up among the lengths, the sums of pairs
and the sums of triples that are left, and consumed as often as the counts allow. Lengths that nothing completes are filled by the best
fitting lengths, again with an exact end where one turns up. Every step uses up a length, so there are a few thousand steps at most.
Rows then take their places by their rank among the rows of their length, a distributed prefix sum.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meltwise.llm.bytewords import BLOCK
from meltwise.llm.common import sums_before, written

CAPACITY = 1024
END = 2
REMEMBERED = 700_000  # stretches of text whose ids a worker keeps
BUCKET_ROWS = 100_000  # rows of one length that are ranked in one sort
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
TOGETHER = 1000  # stretches that are given to the tokenizer as one text
_BLANK = b"\x20\x09\x0a\x0b\x0c\x0d"
_IS_BLANK = np.isin(np.arange(256), list(_BLANK))
_IS_LETTER = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])
_IS_MARK = np.isin(np.arange(256), list(b".,;:!?)(-/|\"'"))
_workers: dict = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# Tokens


class _Stretches:
    """Ids of stretches of text, each by the tokenizer; a worker keeps those of up to REMEMBERED stretches."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes[i] = len(token)  # a byte-level token has a character for each byte
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, "<u4"), 1
        self.flat[0] = END
        self.first, self.size = np.zeros(1 << 14, np.int64), np.ones(1 << 14, np.int64)

    def _add(self, stretches: list[bytes], ids: np.ndarray, sizes: np.ndarray) -> None:
        n, total = len(self.known) + 1, int(sizes.sum())
        while n + len(stretches) > len(self.first):
            self.first, self.size = np.resize(self.first, 2 * len(self.first)), np.resize(self.size, 2 * len(self.size))
        while self.used + total > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + total] = ids
        self.first[n : n + len(stretches)] = self.used + np.cumsum(sizes) - sizes
        self.size[n : n + len(stretches)] = sizes
        self.known.update(zip(stretches, range(n, n + len(stretches)), strict=True))
        self.used += total

    def _encode(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)]

    def _learn(self, new: list[bytes]) -> None:
        # stretches from a blank to another character stay apart when they stand in a row; the others go one by one
        joined = [r for r in new if r[0] in _BLANK and r[-1] not in _BLANK]
        for i in range(0, len(joined), TOGETHER):
            some = joined[i : i + TOGETHER]
            ids = np.array(self._encode([b"".join(some)])[0], "<u4")
            ends = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum([len(r) for r in some])) + 1
            self._add(some, ids, np.diff(ends, prepend=0))
        single = [r for r in new if not (r[0] in _BLANK and r[-1] not in _BLANK)]
        for i in range(0, len(single), TOGETHER):
            some = single[i : i + TOGETHER]
            ids = self._encode(some)
            self._add(some, np.array([x for one in ids for x in one], "<u4"), np.array([len(one) for one in ids], np.int64))

    def places(self, stretches: list[bytes]) -> np.ndarray:
        """Where the ids of each stretch stand in ``first`` and ``size``; END stands at 0."""
        if len(self.known) + len(stretches) > REMEMBERED:
            self._forget()
        self._learn([r for r in stretches if r not in self.known])
        return np.fromiter(map(self.known.__getitem__, stretches), np.int64, len(stretches))


def _stretch_starts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Places at which no token of the tokenizer goes on, among them ``begins``.

    The tokenizer takes its tokens from a blank with a run of letters, of digits or of other marks, or from a run of blanks. So a token starts at the
    first of several blanks, and where a mark follows a letter.
    """
    before, blank = data[:-1], _IS_BLANK[data]
    latin = np.zeros(len(data), bool)  # last bytes of the letters from U+00C0 to U+00FF
    latin[1:] = (before == 0xC3) & (data[1:] >= 0x80) & (data[1:] != 0x97) & (data[1:] != 0xB7)
    letter = _IS_LETTER[data] | latin
    seen = (data < 0x80) & ~blank & (data > 0x20) | latin  # a character that is surely no blank
    cut = np.zeros(len(data), bool)
    cut[1:] = blank[1:] & seen[:-1] | _IS_MARK[data[1:]] & letter[:-1]
    cut[begins[begins < len(data)]] = True
    return np.flatnonzero(cut)


def token_ids(raws: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """All ids of some texts, END after each text, and where each text ends among them."""
    if path not in _workers:
        _workers[path] = _Stretches(path)
    worker = _workers[path]
    ends = np.cumsum([len(r) for r in raws])
    data = np.frombuffer(b"".join(raws), np.uint8)
    starts = _stretch_starts(data, (ends - [len(r) for r in raws])) if len(data) else np.zeros(0, np.int64)
    offsets = np.append(starts, len(data)).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    places = np.append(worker.places(coded.dictionary.to_pylist()), 0)
    closing = np.searchsorted(starts, ends)  # stretches before each text's end
    code = np.insert(coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), closing, len(places) - 1)
    place = places[code]
    size = worker.size[place]
    at = np.cumsum(size)
    take = np.arange(at[-1] if len(at) else 0) + np.repeat(worker.first[place] - (at - size), size)
    return worker.flat[take], at[closing + np.arange(len(raws))]


def _small(rows: pa.RecordBatch, names: list[str]) -> Iterator[tuple[list, list[bytes]]]:
    """Ids and texts of a batch in runs of about half of BLOCK bytes."""
    ids, raws, size = [], [], 0
    for doc, text in zip(rows[names[0]], rows[names[1]], strict=True):
        raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
        if raws and size + len(raw) > BLOCK // 2:
            yield ids, raws
            ids, raws, size = [], [], 0
        ids.append(doc.as_py())
        raws.append(raw)
        size += len(raw)
    if raws:
        yield ids, raws


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every row's ids with END, cut into pieces of at most ``capacity``; the first may be shorter."""
    path = path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for docs_, raws in _small(batch, ["doc_id", "text"]):
                flat, ends = token_ids(raws, path)
                rows, begin = [], 0
                for doc, end in zip(docs_, ends.tolist(), strict=True):
                    n = end - begin
                    k = -(-n // capacity)
                    cuts = [0, *range(n - capacity * (k - 1), n + 1, capacity)]
                    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        own = flat[begin + a : begin + b]
                        rows.append((doc, i, a, b - a, zlib.crc32(own.tobytes()), own) if with_ids else (doc, i, a, b - a, zlib.crc32(own.tobytes())))
                    begin = end
                columns = list(zip(*rows, strict=True))
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


# The packing, on counts of lengths


class Share(NamedTuple):
    length: int
    rank: int  # of the first row of this length that is meant
    each: int  # rows that one sequence takes
    bins: int
    sequence: int  # of the first row
    offset: int


class _Stock:
    """Pieces left of every length, and which lengths and sums of two lengths are to be had."""

    def __init__(self, counts: list[int], capacity: int):
        self.capacity, self.left = capacity, np.zeros(capacity + 1, np.int64)
        self.left[: len(counts)] = counts
        self.left[0] = 0
        self._index()

    def _index(self) -> None:
        self.have = self.left > 0
        self.sums = np.convolve(self.have.astype(np.int64), self.have.astype(np.int64))[: self.capacity + 1] > 0

    def take(self, pattern: dict[int, int], bins: int) -> None:
        before = self.have
        for length, each in pattern.items():
            self.left[length] -= each * bins
        if not np.array_equal(self.left > 0, before):
            self._index()

    def times(self, pattern: dict[int, int]) -> int:
        return min(int(self.left[length]) // each for length, each in pattern.items())

    def _with(self, pattern: dict[int, int], *more: int) -> dict[int, int] | None:
        out = dict(pattern)
        for length in more:
            out[length] = out.get(length, 0) + 1
        return out if self.times(out) > 0 else None

    def completed(self, pattern: dict[int, int], gap: int, most: int = 3) -> dict[int, int] | None:
        """``pattern`` with up to ``most`` (three) lengths more that fill the gap; the longest ones there are."""
        if gap == 0:
            return pattern
        if self.have[gap] and most > 0 and (out := self._with(pattern, gap)):
            return out
        if most > 1 and (out := self._pair(pattern, gap)):
            return out
        if most < 3:
            return None
        others = np.arange(gap - 2, 0, -1)
        for a in others[self.have[others] & self.sums[gap - others]].tolist():
            if 3 * a < gap:
                break
            if out := self._pair(pattern, gap - a, a, a):
                return out
        return None

    def _pair(self, pattern: dict[int, int], gap: int, most: int | None = None, *more: int) -> dict[int, int] | None:
        if not self.sums[gap]:
            return None
        a = np.arange(min(gap - 1, most or gap), (gap - 1) // 2, -1)
        for x in a[self.have[a] & self.have[gap - a]].tolist():
            if out := self._with(pattern, *more, x, gap - x):
                return out
        return None

    def filled(self, pattern: dict[int, int], gap: int, most: int) -> dict[int, int]:
        """``pattern`` with the best fitting lengths, and an exact end of up to ``most`` lengths as soon as there is one."""
        while gap:
            if out := self.completed(pattern, gap, most):
                return out
            fits = [x for x in np.flatnonzero(self.have[: gap + 1])[::-1].tolist() if self._with(pattern, x)]
            if not fits:
                break
            pattern, gap = self._with(pattern, fits[0]), gap - fits[0]
        return pattern


def pack_counts(counts: list[int], capacity: int = CAPACITY) -> list[Share]:
    """Which rows of each length go into which sequences; ``counts[n]`` is the number of pieces of length n.

    Pairs and triples that fill a sequence now may be missed by a longer gap later, so three plans are made, exact ends of up to three lengths
    first, of one length first, and of one length throughout; the one with fewest sequences is taken.
    """
    plans = [_plan(counts, capacity, *how) for how in ((3, 3), (1, 3), (1, 1))]
    return min(plans, key=lambda plan: plan[-1].sequence + plan[-1].bins if plan else 0)


def _plan(counts: list[int], capacity: int, first: int, last: int) -> list[Share]:
    stock, used, shares, sequence = _Stock(counts, capacity), [0] * (capacity + 1), [], 0

    def give(pattern: dict[int, int]) -> None:
        nonlocal sequence
        bins, offset = stock.times(pattern), 0
        stock.take(pattern, bins)
        for length in sorted(pattern, reverse=True):
            shares.append(Share(length, used[length], pattern[length], bins, sequence, offset))
            used[length] += pattern[length] * bins
            offset += pattern[length] * length
        sequence += bins

    for length in range(capacity, 0, -1):
        while stock.have[length] and (pattern := stock.completed({length: 1}, capacity - length, first)):
            give(pattern)
    for length in range(capacity, 0, -1):
        while stock.have[length]:
            give(stock.filled({length: 1}, capacity - length, last))
    return shares


def assign(rows: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``rows`` (``length`` 1 to ``capacity``) with sequence_id and offset.

    ``order`` names the columns that tell rows apart; rows alike in all of them may change places. A length's rows are ranked in buckets of
    about BUCKET_ROWS rows, so a length that a third of all rows share is spread like the others.
    """
    counts = [0] * (capacity + 1)
    for length, n in rows.groupBy("length").count().collect():
        counts[length] = n
    shares = sorted(pack_counts(counts, capacity))
    buckets = F.array(*[F.lit(max(1, -(-n // BUCKET_ROWS))).cast("long") for n in counts])
    key = F.pmod(F.xxhash64(*order), F.lit(1 << 32))
    keyed = rows.withColumn("_o", key).withColumn("_bucket", F.floor(F.col("_o") * F.get(buckets, F.col("length").cast("int")) / (1 << 32)))
    ranked = sums_before(keyed.withColumn("_one", F.lit(1).cast("long")), "length", "_bucket", ["_o", *order], "_one", "_rank")
    reach = max(counts) + 1
    table = np.array(shares, np.int64).reshape(-1, 6)
    begins = table[:, 0] * reach + table[:, 1]

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(length, rank):
        import pandas as pd

        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        at = table[np.searchsorted(begins, length * reach + rank, "right") - 1]
        i = rank - at[:, 1]
        return pd.DataFrame({"sequence_id": at[:, 4] + i // at[:, 2], "offset": at[:, 5] + i % at[:, 2] * length})

    return ranked.withColumn("_at", place("length", "_rank")).select(*rows.columns, "_at.sequence_id", "_at.offset")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): one row per piece of every row of ``docs`` (doc_id, text).

    A row's ids are the tokenizer's (special tokens are not added) and END. Null and empty texts are END alone. Repeated rows and null ids
    are packed like others; other columns are not read. Very long texts become many full pieces, each a sequence of its own. Sequences
    are numbered from 0 without gaps, their pieces lie side by side from offset 0. Empty table: no rows.
    """
    found = written(pieces(docs, path, capacity))
    return assign(found, ["doc_id", "piece", "start", "ids_crc32"], capacity)


def sequences(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves."""
    keys = ["doc_id", "piece", "start", "length", "ids_crc32"]
    texts = pieces(docs, path, capacity, with_ids=True).dropDuplicates(keys).select(*[F.col(k).alias(f"_{k}") for k in keys], "ids")
    joined = pack(docs, path, capacity).join(texts, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return joined.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_p")).select("sequence_id", F.flatten(F.transform("_p", lambda p: p["ids"])).alias("ids"))
