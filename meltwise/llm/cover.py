"""Rolling names of byte strings and the content-defined cover of a batch of texts."""

from __future__ import annotations

import numpy as np

REPEAT = 200  # bytes of a string that counts as repeated
GRAM = 48  # bytes that a cover point is chosen by
STARTS = REPEAT - GRAM + 1  # cover candidates in a string
BATCH = 1 << 20  # bytes taken at once
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2^64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, BATCH + 4096)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _powers[base] = tuple(out)
    return have


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Names:
    """64-bit names of all substrings of a buffer: equal strings have equal names, wherever they stand."""

    def __init__(self, buf: np.ndarray, which: int):
        self.base = _BASES[which]
        power, _ = _power(self.base, len(buf) + 1)
        symbols = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(self.base | 1))
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(symbols[buf] * power[: len(buf)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        _, inverse = _power(self.base, len(self.sums))
        return _mix((self.sums[end] - self.sums[start]) * inverse[start] + (end - start).astype(np.uint64))

    def grams(self, width: int) -> np.ndarray:
        _, inverse = _power(self.base, len(self.sums))
        n = len(self.sums) - width
        return _mix((self.sums[width:] - self.sums[:-width]) * inverse[:n]) if n > 0 else np.zeros(0, np.uint64)


def cover(names: Names, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The cover of texts that lie one after another in a buffer: (text, point, low, count), a row per run of strings.

    Every string of REPEAT bytes holds one cover point: the first of its GRAM-byte substrings with the least name. Equal strings have
    it at the same place. The ``count`` strings that start at ``low``, ``low`` + 1, ... have the point ``point``.
    """
    gram = names.grams(GRAM)
    n = len(gram)
    if n < STARTS:
        return (np.zeros(0, np.int64),) * 4
    key = (gram & np.uint64(0xFFFFFFFFFF000000)) | np.arange(n, dtype=np.uint64)
    rows = -(-n // STARTS)
    padded = np.full(rows * STARTS, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = key
    grid = padded.reshape(rows, STARTS)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    point = (np.minimum(right[: n - STARTS + 1], left[STARTS - 1 : n]) & np.uint64(0xFFFFFF)).astype(np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    text = np.repeat(np.arange(len(ends)), ends - starts)[: len(point)]
    inside = np.arange(len(point)) + REPEAT <= ends[text]
    first = np.flatnonzero(inside & np.concatenate(([True], (point[1:] != point[:-1]) | (text[1:] != text[:-1]) | ~inside[:-1])))
    stop = np.flatnonzero(inside & np.concatenate(((point[1:] != point[:-1]) | (text[1:] != text[:-1]) | ~inside[1:], [True])))
    return text[first], point[first], first, stop - first + 1
