"""Toxic spans by a linear-chain conditional random field, scored with forward-backward marginals.

A chain is a sentence: its words, in order, each tagged toxic or not. Token labels come from the labelled documents:
every word of a clean document is not toxic, and in a toxic document those words are that, or whose stems are, far
more common in toxic documents than in clean ones. The field learns a weight for every word and stem of the sample, a
bias and four transitions by gradient ascent on the tags' likelihood: what the tags hold less the marginals.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from sys import intern

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"[^\W_]+|[.!?\n]")
BREAKS = frozenset(".!?\n")
CHARS_AT_ONCE = 4 << 20
SPAN = 0.5
FLOOR = 0.02


def marginals(pull: np.ndarray, starts: np.ndarray, lengths: np.ndarray, trans: np.ndarray, pairs: bool = False):
    """Each token's chance of the toxic tag. ``pull`` is its log-odds by itself, ``trans[a, b]`` the score of tag b after a.

    All chains go forward and backward together, the longest first, so that step t works on a shrinking prefix of them.
    With ``pairs`` also the expected number of each transition.
    """
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    active = np.searchsorted(-lengths, -np.arange(1, (lengths[0] if len(lengths) else 0) + 1), side="right")
    odds, m = np.exp(np.clip(pull, -30, 30)), np.exp(trans)
    fwd = np.empty(len(pull))  # share of the toxic tag, given what came up to here
    a0, a1 = None, None
    for t, k in enumerate(active):
        at = starts[:k] + t
        if t == 0:
            b0, b1 = np.ones(k), odds[at]
        else:
            b0 = a0[:k] * m[0, 0] + a1[:k] * m[1, 0]
            b1 = (a0[:k] * m[0, 1] + a1[:k] * m[1, 1]) * odds[at]
        z = b0 + b1
        a0, a1 = b0 / z, b1 / z
        fwd[at] = a1
    out = np.empty(len(pull))
    expected = np.zeros((2, 2))
    n = len(starts)
    r0, r1 = np.ones(n), np.ones(n)  # what follows, for either tag
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = starts[:k] + t
        if t + 1 < len(active):
            j = active[t + 1]
            nxt = at[:j] + 1
            o1 = odds[nxt] * r1[:j]
            o0 = r0[:j].copy()
            if pairs:
                p = fwd[at[:j]]
                w = [(1 - p) * m[0, 0] * o0, (1 - p) * m[0, 1] * o1, p * m[1, 0] * o0, p * m[1, 1] * o1]
                z = w[0] + w[1] + w[2] + w[3]
                expected += np.array([(x / z).sum() for x in w]).reshape(2, 2)
            b0, b1 = m[0, 0] * o0 + m[0, 1] * o1, m[1, 0] * o0 + m[1, 1] * o1
            z = b0 + b1
            r0[:j], r1[:j] = b0 / z, b1 / z
        x1, x0 = fwd[at] * r1[:k], (1 - fwd[at]) * r0[:k]
        out[at] = x1 / (x0 + x1)
    return (out, expected) if pairs else out


def lowered(text: str) -> str:
    """Lower case without a change of length, so that offsets hold."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


def features(word: str) -> list[str]:
    """The word itself and its beginnings of 4 to 7 letters (marked): stems that inflected forms share."""
    return [word, *[f"^{word[:k]}" for k in range(4, 8) if len(word) >= k]]


class Pulls(dict):
    """Word -> its log-odds, worked out when first met; forgotten as a whole when it grows large."""

    def __init__(self, weights: dict[str, float], bias: float):
        super().__init__({b: np.nan for b in BREAKS})
        self.weights, self.bias = weights, bias

    def __missing__(self, word: str) -> float:
        if len(self) > 400_000:
            self.clear()
            self.update({b: np.nan for b in BREAKS})
        get = self.weights.get
        self[word] = x = self.bias + sum(get(f, 0.0) for f in features(word))
        return x


def chains(breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs between breaks; the last token is a break."""
    stop = np.flatnonzero(breaks)
    first = np.concatenate(([0], stop[:-1] + 1)) if len(stop) else stop
    keep = stop > first
    return first[keep], (stop - first)[keep]


class Field:
    """A trained field, shared by all executors; its size is bounded by the training sample."""

    def __init__(self, weights: dict[str, float], bias: float, trans: np.ndarray):
        self.weights, self.bias, self.trans = weights, bias, trans
        self.slope, self.level = 1.0, 0.0
        self._pulls = None

    def __getstate__(self):
        return self.__dict__ | {"_pulls": None}

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds of all words (none at breaks), and where each text's words end."""
        if self._pulls is None:
            self._pulls = Pulls(self.weights, self.bias)
        pulls, out, ends = self._pulls, [], []
        for t in texts:
            out.extend([pulls[w] for w in TOKEN.findall(lowered(t))])
            out.append(np.nan)
            ends.append(len(out))
        return np.array(out), np.array(ends, np.int64)

    def weigh(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginals, where each text's words end, and each text's expected number of toxic words."""
        pull, ends = self.tokens(texts)
        breaks = np.isnan(pull)
        p = np.where(breaks, 0.0, marginals(np.where(breaks, 0.0, pull), *chains(breaks), self.trans))
        return p, ends, np.add.reduceat(np.where(p >= FLOOR, p, 0.0), np.concatenate(([0], ends[:-1])))

    def score(self, texts: list[str | None]) -> list[tuple[float, str]]:
        """Score and offending offsets of each text."""
        out: list[tuple[float, str]] = []
        batch: list[str] = []
        size = 0
        for t in texts:
            batch.append(t or "")
            size += len(batch[-1])
            if size > CHARS_AT_ONCE:
                out += self._score(batch)
                batch, size = [], 0
        return out + self._score(batch)

    def _score(self, texts: list[str]) -> list[tuple[float, str]]:
        if not texts:
            return []
        p, ends, amount = self.weigh(texts)
        chance = 1 / (1 + np.exp(-(self.slope * np.log(amount + FLOOR) + self.level)))
        result = [(float(x), "") for x in chance]
        toxic = np.flatnonzero(p >= SPAN)
        owner = np.searchsorted(ends, toxic, side="right")
        for d in np.unique(owner):
            inside = set((toxic[owner == d] - (ends[d - 1] if d else 0)).tolist())
            spans = [f"{m.start()}:{m.end()}" for k, m in enumerate(TOKEN.finditer(lowered(texts[d]))) if k in inside]
            result[d] = (result[d][0], ",".join(spans))
        return result


def weak_tags(texts: list[set[str]], toxic: np.ndarray, lean: float = 1.5, support: float = 0.03) -> set[str]:
    """Features that are more common in toxic than in clean texts by ``lean`` nats, in ``support`` of the toxic ones at least (and in 3).

    The most frequent come first; weaker ones must show it again in the texts without those, else features that
    happen to stand in the same few texts would be taken for toxic ones.
    """
    n1, n0 = int(toxic.sum()), int((~toxic).sum())
    good = Counter(f for s, x in zip(texts, toxic, strict=True) if not x for f in s)
    found: set[str] = set()
    left = [s for s, x in zip(texts, toxic, strict=True) if x]
    while True:
        bad = Counter(f for s in left for f in s)
        bad = {f: c for f, c in bad.items() if c >= max(3, support * n1) and np.log((c + 0.5) / (n1 + 1)) - np.log((good[f] + 0.5) / (n0 + 1)) >= lean}
        if not bad:
            return found
        found |= {f for f, c in bad.items() if 2 * c >= max(bad.values())}
        left = [s for s in left if not s & found]


def fit(texts: list[str], toxic: np.ndarray, share: float | None = None, rounds: int = 30, shrink: float = 0.01, at_least: int = 4) -> Field:
    """The field of labelled texts: ``rounds`` steps of gradient ascent over all their chains, each weight at its own pace
    (resilient propagation). A line then turns a text's expected number of toxic words into its chance of the toxic label, with
    ``share`` the labels' own share of toxic texts.
    """
    words = [[intern(w) for w in TOKEN.findall(lowered(t))] for t in texts]
    kinds = {w: i for i, w in enumerate(dict.fromkeys(w for ws in words for w in ws if w not in BREAKS))}
    parts = {w: features(w) for w in kinds}
    held_by = [{f for w in set(ws) - BREAKS for f in parts[w]} for ws in words]
    bad = weak_tags(held_by, toxic)
    seen = Counter(f for s in held_by for f in s)
    del held_by
    index = {f: i for i, f in enumerate(sorted(f for f, c in seen.items() if c >= at_least or f in bad))}
    pairs = np.array([(k, index[f]) for w, k in kinds.items() for f in parts[w] if f in index], np.int64).reshape(-1, 2)
    is_bad = np.array([not bad.isdisjoint(parts[w]) for w in kinds] + [False])
    ids = np.array([kinds.get(w, len(kinds)) for ws in words for w in (*ws, ".")], np.int64)
    breaks = ids == len(kinds)
    starts, lengths = chains(breaks)
    tag = is_bad[ids] & np.repeat(toxic, [len(ws) + 1 for ws in words])
    inner = np.flatnonzero(~breaks[:-1] & ~breaks[1:])
    held = np.bincount(tag[inner] * 2 + tag[inner + 1], minlength=4).reshape(2, 2)
    n, m = len(index), len(kinds)
    weights = np.zeros(n + 5)  # of features, then a bias and the transitions
    weights[n] = np.log((tag.sum() + 1) / (len(ids) + 2))
    pace, last = np.full(len(weights), 0.5), np.zeros(len(weights))

    def pulls() -> np.ndarray:
        each = np.append(weights[n] + np.bincount(pairs[:, 0], weights[pairs[:, 1]], minlength=m), 0.0)
        return each[ids]

    for _ in range(rounds):
        p, expected = marginals(pulls(), starts, lengths, weights[n + 1 :].reshape(2, 2), pairs=True)
        miss = np.bincount(ids, np.where(breaks, 0.0, tag - p), minlength=m + 1)
        grad = np.concatenate((np.bincount(pairs[:, 1], miss[pairs[:, 0]], minlength=n), [miss.sum()], (held - expected).ravel())) - shrink * weights
        turn = np.sign(grad) * np.sign(last)
        pace = np.clip(pace * np.where(turn > 0, 1.2, np.where(turn < 0, 0.5, 1.0)), 1e-4, 3.0)
        last = np.where(turn < 0, 0.0, grad)
        weights = weights + np.sign(last) * pace
    field = Field({f: float(weights[i]) for f, i in index.items() if abs(weights[i]) > 1e-3}, float(weights[n]), weights[n + 1 :].reshape(2, 2))
    x = np.log(np.concatenate([field.weigh(texts[i : i + 64])[2] for i in range(0, len(texts), 64)]) + FLOOR)
    share = float(toxic.mean()) if share is None else share
    each = np.where(toxic, share / max(1, toxic.sum()), (1 - share) / max(1, (~toxic).sum())) * len(texts)
    field.slope, field.level = _line(x, toxic.astype(float), each)
    return field


def _line(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope (not below 0) and level of a weighted logistic line, by Newton's method with a slight pull to slope 1."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(weight * (y - p) * x).sum() - (a - 1), (weight * (y - p)).sum() - 0.01 * b])
        v = weight * p * (1 - p)
        h = np.array([[(v * x * x).sum() + 1, (v * x).sum()], [(v * x).sum(), v.sum() + 0.01]])
        step = np.linalg.solve(h, g)
        a, b = a + np.clip(step[0], -1, 1), b + np.clip(step[1], -2, 2)
    return max(float(a), 0.0), float(b)


def train(docs: DataFrame, labels: DataFrame, toxic_rows: int = 800, clean_rows: int = 1600, max_chars: int = 20_000) -> Field | None:
    """The field of a bounded sample: about ``toxic_rows`` and ``clean_rows`` labelled rows (doc_id, toxic) by a hash of their id.

    Only texts of up to ``max_chars`` characters train, copies once; with 2,400 rows that bounds what reaches the driver. None
    if no labelled row has a text.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r[0]: r[1] for r in marks.groupBy(F.col("toxic") > 0).count().collect()}
    rate = F.when(F.col("toxic") > 0, F.lit(min(1.0, toxic_rows / max(1, n.get(True, 0))))).otherwise(F.lit(min(1.0, clean_rows / max(1, n.get(False, 0)))))
    chosen = marks.where(F.pmod(F.xxhash64(F.lit("crf"), "doc_id"), F.lit(1 << 20)) < rate * (1 << 20)).select(F.col("doc_id").alias("_id"), "toxic")
    texts = docs.where(F.col("text").isNotNull() & (F.length("text") <= max_chars)).select("doc_id", "text")
    # about 2,400 rows of two numbers, whatever the tables hold
    sample = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).groupBy("text").agg(F.max("toxic").alias("toxic")).orderBy("text").toArrow()
    if not sample.num_rows:
        return None
    share = n.get(True, 0) / max(1, n.get(True, 0) + n.get(False, 0))
    return fit(sample.column("text").to_pylist(), sample.column("toxic").to_numpy() > 0, share)


def score(df: DataFrame, field: Field | None, text: Column) -> Column:
    """A struct (score, spans) for each row's whole text.

    Tokens whose marginal is a half or more are spans ("start:end", code points, comma-joined); the score is the fitted chance of
    the toxic label, given the sum of the marginals. Null and empty texts have no tokens and score as such; if nothing was
    learned, all score 0 without spans.
    """
    shared = df.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for s in batches:
            rows = model.score(list(s)) if model else [(0.0, "")] * len(s)
            yield pd.DataFrame(rows, columns=["score", "spans"])

    return F.pandas_udf(run, "score double, spans string")(text)
