"""Language identification by prediction by partial matching over bytes.

Every language has a context tree of order 0 to 3: how often each byte followed each context in its training texts.
A byte costs -log2(count / (n + d)) bits in the longest known context (n: its total, d: its distinct followers); a byte that never
followed it first pays the escape, -log2(d / (n + d)), and is then priced one order lower, at last at 8 bits. The trees
are frozen after training, so the cost of each known 4-byte string is a table row with one column per language, and
a text's code length is a sum of table rows. Strings unknown to all languages walk down the same tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 3
CHUNK = 1 << 20
UNKNOWN = "und"


def grams(buf: np.ndarray) -> np.ndarray:
    """The 4-byte string that ends at each byte of ``buf`` but the first three, as numbers."""
    b = buf.astype(np.uint32)
    return (b[:-3] << 24) | (b[1:-2] << 16) | (b[2:-1] << 8) | b[3:]


class Trees:
    """The frozen context trees of all languages."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, count: np.ndarray):
        """Counts of 4-byte strings: ``lang`` has places in ``langs``. Shorter strings are their endings."""
        self.langs, n = langs, len(langs)
        self.codes, self.costs, self.escapes = [], [], []
        lower_codes, lower = None, None
        for k in range(ORDER + 1):
            code = (gram & ((1 << (8 * (k + 1))) - 1)).astype(np.int64)
            codes, at = np.unique(code, return_inverse=True)
            counts = np.zeros((len(codes), n))
            np.add.at(counts, (at, lang), count)
            contexts, parent = np.unique(codes >> 8, return_inverse=True)
            total, kinds = np.zeros((len(contexts), n)), np.zeros((len(contexts), n))
            np.add.at(total, parent, counts)
            np.add.at(kinds, parent, counts > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                direct = -np.log2(counts / (total + kinds)[parent])
            below = np.full((len(codes), n), 8.0) if k == 0 else lower[np.searchsorted(lower_codes, codes & ((1 << (8 * k)) - 1))]
            cost = np.where(counts > 0, direct, escape[parent] + below)
            self.codes.append(codes)
            self.costs.append(cost.astype(np.float32))
            self.escapes.append((contexts, escape.astype(np.float32)))
            lower_codes, lower = codes, cost
        # the longest strings are found by a hashed table; those that share a place with another wait in a sorted list
        top = self.codes[-1].astype(np.uint32)
        self.bits = max(10, int(len(top) * 8).bit_length())
        self.places = np.full(1 << self.bits, -1, np.int32)
        self.places[self._hash(top)] = np.arange(len(top), dtype=np.int32)
        self.top = np.append(top, np.uint32(0))
        lost = np.flatnonzero(self.places[self._hash(top)] != np.arange(len(top)))
        self.spilled = (top[lost], lost)

    def _hash(self, code: np.ndarray) -> np.ndarray:
        return (code * np.uint32(2654435769)) >> np.uint32(32 - self.bits)

    def _find(self, code: np.ndarray) -> np.ndarray:
        row = self.places[self._hash(code)]
        row[(self.top[row] != code) | (row < 0)] = -1
        codes, rows = self.spilled
        if len(codes) and (miss := np.flatnonzero(row < 0)).size:
            at = np.minimum(np.searchsorted(codes, code[miss]), len(codes) - 1)
            hit = codes[at] == code[miss]
            row[miss[hit]] = rows[at[hit]]
        return row

    def bits_of(self, code: np.ndarray) -> np.ndarray:
        """Cost in bits of each byte, given as the 4-byte string it ends, in each language."""
        row = self._find(code)
        out = self.costs[-1][row]
        rest = np.flatnonzero(row < 0)
        if rest.size:
            out[rest] = 0
            for k in range(ORDER, -1, -1):
                c = code[rest].astype(np.int64) & ((1 << (8 * (k + 1))) - 1)
                if k < ORDER:
                    at = np.minimum(np.searchsorted(self.codes[k], c), len(self.codes[k]) - 1)
                    known = self.codes[k][at] == c
                    out[rest[known]] += self.costs[k][at[known]]
                    rest, c = rest[~known], c[~known]
                contexts, escape = self.escapes[k]
                at = np.minimum(np.searchsorted(contexts, c >> 8), len(contexts) - 1)
                seen = contexts[at] == c >> 8
                out[rest[seen]] += escape[at[seen]]
            out[rest] += 8.0
        return out

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each text in each language; every text starts from an empty context (three zero bytes)."""
        out = np.zeros((len(texts), len(self.langs)))
        batch, room = [], 0
        for i, t in enumerate(texts):
            for a in range(0, len(t), CHUNK):  # a long text in pieces, each with the three bytes before it
                batch.append((i, t[max(0, a - ORDER) : a].rjust(ORDER, b"\0") + t[a : a + CHUNK]))
                room += len(batch[-1][1])
                if room >= CHUNK:
                    self._add(batch, out)
                    batch, room = [], 0
        self._add(batch, out)
        return out

    def _add(self, batch: list[tuple[int, bytes]], out: np.ndarray) -> None:
        if batch:
            buf = np.frombuffer(b"".join(t for _, t in batch), np.uint8)
            ends = np.cumsum([len(t) for _, t in batch])
            starts = np.concatenate(([0], ends[:-1]))
            cost = self.bits_of(grams(buf))
            bounds = np.stack([starts, np.minimum(ends - ORDER, len(cost))], 1).ravel()
            sums = np.add.reduceat(np.vstack([cost, np.zeros((1, cost.shape[1]), np.float32)]), bounds, axis=0, dtype=np.float64)[::2]
            np.add.at(out, [i for i, _ in batch], sums)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", rows_per_lang: int = 2000) -> Trees | None:
    """Context trees from the rows of ``docs`` with text and language; None if there are none.

    ``rows_per_lang`` bounds the sample: about so many rows of each language, by a hash of their text, whole. The strings of
    the sample are counted on the executors; what comes to the driver is one row per language and distinct 4-byte string.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    n = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    langs = sorted(n)
    if not langs:
        return None
    place = F.element_at(F.create_map(*[x for i, k in enumerate(langs) for x in (F.lit(k), F.lit(i))]), F.col(lang))
    rate = F.element_at(F.array(*[F.lit(min(1.0, rows_per_lang / n[k])) for k in langs]), place + 1)
    sample = rows.where(F.pmod(F.xxhash64(F.lit("ppm"), F.col(text)), F.lit(1 << 20)) < rate * (1 << 20)).select(place.alias("lang"), F.col(text).alias("text"))

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for k, group in pdf.groupby("lang"):
                texts = [t.encode("utf-8", "surrogatepass") for t in group.text]
                buf = b"".join(b"\0" * ORDER + t for t in texts)
                keep = np.ones(len(buf), bool)
                ends = np.cumsum([len(t) + ORDER for t in texts])
                for j in range(ORDER):
                    keep[np.concatenate(([0], ends[:-1])) + j] = False
                code = grams(np.frombuffer(buf, np.uint8))[keep[ORDER:]] if len(buf) > ORDER else np.zeros(0, np.uint32)
                gram, c = np.unique(code, return_counts=True)
                yield pd.DataFrame({"lang": np.int32(k), "gram": gram.astype(np.int64), "n": c.astype(np.int64)})

    counts = sample.mapInPandas(count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    if not counts.num_rows:
        return None
    return Trees(langs, *[counts.column(c).to_numpy() for c in ("lang", "gram", "n")])


def identify(df: DataFrame, trees: Trees | None, text: Column) -> Column:
    """A struct (lang, score, bits_per_byte) for each row: the language of the shortest code, and its posterior.

    The score is 2^-bits of the language over the sum of all. Null and empty texts and those without a letter: ``und``, 0,
    null; so is every text if nothing was learned. Ties: the first language in order.
    """
    shared = df.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import regex

        letter, model = regex.compile(r"\p{L}"), shared.value
        for s in batches:
            lang = np.full(len(s), UNKNOWN, object)
            score, per = np.zeros(len(s)), np.full(len(s), np.nan)
            known = [i for i, t in enumerate(s) if model is not None and t is not None and letter.search(t)]
            for a in range(0, len(known), 256):
                part = known[a : a + 256]
                texts = [s.iat[i].encode("utf-8", "surrogatepass") for i in part]
                bits = model.code_lengths(texts)
                best = bits.argmin(1)
                least = bits[np.arange(len(part)), best]
                lang[part] = np.array(model.langs, object)[best]
                score[part] = 1 / np.exp2(least[:, None] - bits).sum(1)
                per[part] = least / [len(t) for t in texts]
            yield pd.DataFrame({"lang": lang, "score": score, "bits_per_byte": per})

    return F.pandas_udf(run, "lang string, score double, bits_per_byte double")(text)
