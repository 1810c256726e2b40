"""Words of whole batches of texts at once, as numbers into a dictionary; small helpers of the operators that count words."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 6 << 20  # bytes of text worked on at a time, unless one text alone is longer
UPPER = bytes(range(65, 91))


def byte_table(apart: bytes, broken: bytes = b"") -> bytes:
    """A translation that lower-cases A-Z and turns ``apart`` into blanks and ``broken`` into line breaks."""
    table = bytearray(range(256))
    for b in UPPER:
        table[b] = b + 32
    for b in apart:
        table[b] = 32
    for b in broken:
        table[b] = 10
    return bytes(table)


class Words(NamedTuple):
    names: pa.Array  # distinct words, in byte order if asked for
    code: np.ndarray  # each word's place among them
    doc: np.ndarray  # each word's text
    piece: np.ndarray | None  # rises by one at each line break between words


def slices(texts: pa.Array, block: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``block`` bytes, with the place of the first; null texts are empty."""
    start, size, held = 0, 0, []
    for i, v in enumerate(texts):
        raw = v.as_py()
        raw = b"" if raw is None else raw.encode("utf-8", "surrogatepass") if isinstance(raw, str) else raw
        if held and size + len(raw) > block:
            yield start, held
            start, size, held = i, 0, []
        held.append(raw)
        size += len(raw)
    if held:
        yield start, held


def words_of(raw: list[bytes], table: bytes, in_order: bool = True, breaks: bool = True) -> Words:
    """The words of some texts: runs without blanks and line breaks after ``table``; ``names`` and ``piece`` as asked for."""
    data = np.frombuffer(b"\n".join(raw).translate(table), np.uint8)
    apart = (data == 32) | (data == 10)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], apart, [True])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    ends = np.cumsum([len(r) + 1 for r in raw])
    offsets = np.concatenate(([0], np.cumsum(end - start))).astype(np.int64)
    array = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(data[~apart])])
    coded = array.dictionary_encode()
    names = coded.dictionary
    code = coded.indices.to_numpy(zero_copy_only=False)
    if in_order:
        order = pc.sort_indices(names).to_numpy()
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        names, code = names.take(pa.array(order)), rank[code]
    doc = np.repeat(np.arange(len(raw)), np.diff(np.searchsorted(start, ends), prepend=0))
    return Words(names, code, doc, np.cumsum(data == 10, dtype=np.int32)[start] if breaks else None)
