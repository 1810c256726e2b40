"""Lexical, dense and fused retrieval."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meltwise.operators.checkpoints import cut
from meltwise.operators.common import small_batches, top_n

c = F.col
BLOCK = 2048  # vectors of a block
PART = 1 << 27  # bytes of references that a task holds
SCORED = 1000  # documents whose scores are added up at a time
NO_ID = -(1 << 63)  # stands for a null id
SOME = 1 << 18  # pairs whose true difference is taken at a time


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def bm25_scores(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(qid, doc_id, score) of every document that holds a term of the query.

    ``docs`` is (doc_id, text), ``queries`` is (qid, text). Whole texts are tokenised; postings are
    aggregated per (document, term) before anything else shuffles, terms no query uses leave the plan
    by a semi join, and scores are sums with partial aggregation.
    """
    words = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), tokens(c("text")).alias("w"))
    length = words.select("doc_id", F.size("w").alias("dl"))
    stats = length.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))
    terms = queries.where(c("qid").isNotNull()).select("qid", F.explode(F.array_distinct(tokens(c("text")))).alias("term"))
    vocab = terms.select("term").distinct()
    postings = (
        words.select("doc_id", F.size("w").alias("dl"), F.explode("w").alias("term"))
        .join(vocab, "term", "left_semi").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf")))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    x = postings.join(df, "term").crossJoin(F.broadcast(stats))
    idf = F.log(1.0 + (c("n_docs") - c("df") + 0.5) / (c("df") + 0.5))
    part = idf * c("tf") * (k1 + 1.0) / (c("tf") + k1 * (1.0 - b + b * c("dl") / c("avg_dl")))
    return x.select("term", "doc_id", part.alias("part")).join(terms, "term").groupBy("qid", "doc_id").agg(F.round(F.sum("part"), 6).alias("score"))


def bm25(docs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Top k documents per query: (qid, doc_id, score, rank)."""
    return top_n(bm25_scores(docs, queries), ["qid"], [F.desc("score"), c("doc_id")], k)


def unit_vector(column: str) -> Column:
    norm = f"sqrt(aggregate({column}, 0D, (s, x) -> s + cast(x AS double) * cast(x AS double)))"
    return F.expr(f"transform({column}, x -> coalesce(try_divide(cast(x AS double), {norm}), 0D))")


def packed(vectors: DataFrame, name: str, rows: int) -> DataFrame:
    """Blocks of up to ``rows`` of a partition's (``name``, vec): (n, ids, vecs) with both as bytes. Nothing is shuffled."""

    def run(batches):
        for pdf in batches:
            for i in range(0, len(pdf), rows):
                some = pdf.iloc[i:i + rows]
                yield pd.DataFrame({"n": [len(some)], "ids": [some[name].to_numpy(np.int64).tobytes()], "vecs": [np.vstack(some["vec"].to_numpy()).astype(float).tobytes()]})

    return vectors.select(name, "vec").mapInPandas(run, "n int, ids binary, vecs binary")


class _Best:
    """The k nearest rows so far of the queries of one block, by distance rounded to nine digits and id."""

    def __init__(self, qid: np.ndarray, q: np.ndarray, k: int, skip_self: bool):
        self.qid, self.q, self.k, self.skip_self = qid, q, k, skip_self
        # one product gives squared distances: (q, |q|^2, 1) x (-2 r, 1, |r|^2)
        self.wide = np.hstack([q, (q * q).sum(1)[:, None], np.ones((len(q), 1))]).astype(np.float32)
        self.blur = 4e-7 * self.wide.shape[1]  # more than single precision blurs them, for vectors of length 1
        self.bound = np.full(len(q), np.inf)
        self.i, self.rid, self.d = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)

    def take(self, rid: np.ndarray, r: np.ndarray) -> None:
        near = self.wide @ np.hstack([-2.0 * r, np.ones((len(r), 1)), (r * r).sum(1)[:, None]]).astype(np.float32).T
        want = self.k + self.skip_self
        open_ = np.flatnonzero(np.isinf(self.bound))
        if len(open_) and len(rid) >= want:
            self.bound[open_] = np.sqrt(np.maximum(np.partition(near[open_], want - 1, axis=1)[:, want - 1], 0.0) + self.blur)
        # single precision finds what may be near enough, the true difference in double precision decides
        i, j = np.nonzero(near <= ((self.bound + 1e-8) ** 2 + self.blur).astype(np.float32)[:, None])
        if self.skip_self:
            other = self.qid[i] != rid[j]
            i, j = i[other], j[other]
        for x in range(0, len(i), SOME):
            at, to = i[x:x + SOME], j[x:x + SOME]
            self._keep(at, rid[to], np.sqrt(((self.q[at] - r[to]) ** 2).sum(1)))

    def _keep(self, i: np.ndarray, rid: np.ndarray, d: np.ndarray) -> None:
        i, rid, d = np.append(self.i, i), np.append(self.rid, rid), np.append(self.d, d)
        order = np.lexsort((rid, d.round(9), i))
        place = np.arange(len(i)) - np.searchsorted(i[order], i[order])
        order, place = order[place < self.k], place[place < self.k]
        self.i, self.rid, self.d = i[order], rid[order], d[order]
        full = place == self.k - 1
        self.bound[self.i[full]] = np.minimum(self.bound[self.i[full]], self.d[full])

    def rows(self) -> pd.DataFrame:
        return pd.DataFrame({"qid": self.qid[self.i], "rid": self.rid, "distance": self.d})


def nearest_of_all(queries: DataFrame, refs: DataFrame, k: int, skip_self: bool = False, block: int = BLOCK) -> DataFrame:
    """k nearest of all ``refs`` (rid, vec) for every one of ``queries`` (qid, vec), unit vectors: (qid, rid, distance, rank), ties by smaller rid.

    For vectors of many coordinates, of which every query would have to visit most blocks of a tree. Each block of queries meets each block of
    references: a task holds one part of the references, a block of queries passes it, and only the best k of each query leave the task.
    Vectors are shuffled once, to make blocks; later only k rows are for each query and part of references. Pairs are still all
    compared, so time grows with the square. Among exact copies of a reference only the smallest ids can be in an answer; the others are left out.
    """
    spark, schema = queries.sparkSession, "qid long, rid long, distance double"
    refs = cut(packed(top_n(refs, ["vec"], [c("rid")], k + skip_self, "_copy"), "rid", block))
    asked = cut(packed(queries.repartition(max(1, -(-queries.count() // block)), "qid"), "qid", block))
    parts = -(-(refs.agg(F.sum(F.length("vecs"))).first()[0] or 0) // PART)
    if not parts:
        return spark.createDataFrame([], schema + ", rank int")

    def search(batches):
        best, own = None, None
        for pdf in batches:
            for x in pdf.itertuples():
                if own != x.ids:
                    if best is not None:
                        yield best.rows()
                    own = x.ids
                    best = _Best(np.frombuffer(x.ids, np.int64), np.frombuffer(x.vecs).reshape(x.n, -1), k, skip_self)
                best.take(np.frombuffer(x.r_ids, np.int64), np.frombuffer(x.r_vecs).reshape(x.r_n, -1))
        if best is not None:
            yield best.rows()

    held = refs.coalesce(parts).select(*[c(x).alias(f"r_{x}") for x in refs.columns])
    with small_batches(spark, 16):
        found = asked.crossJoin(held.hint("shuffle_replicate_nl")).mapInPandas(search, schema)
        return cut(top_n(found, ["qid"], [F.round("distance", 9), c("rid")], k))


def cosine_top_k(queries: DataFrame, items: DataFrame, k: int, skip_self: bool = False) -> DataFrame:
    """Exact cosine neighbours: on unit vectors the order of cosine is the order of distance."""
    q = queries.select("qid", unit_vector("embedding").alias("vec"))
    r = items.select("rid", unit_vector("embedding").alias("vec"))
    x = nearest_of_all(q, r, k, skip_self=skip_self)
    return x.withColumn("cosine", 1.0 - c("distance") * c("distance") / 2.0)


class _Heads:
    """The first ``depth`` rows so far of every query's list, and how long the lists are."""

    def __init__(self, owner: np.ndarray, depth: int):
        queries = int(owner.max()) + 1 if len(owner) else 0
        self.owner, self.depth, self.length, self.least = owner, depth, np.zeros(queries, np.int64), np.full(queries, -np.inf)
        self.q, self.d, self.s = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)

    def take(self, ids: np.ndarray, score: np.ndarray) -> None:
        np.add.at(self.length, self.owner, (~np.isnan(score)).sum(0))
        i, x = np.nonzero(score >= self.least[self.owner])
        q, d, s = np.append(self.q, self.owner[x]), np.append(self.d, ids[i]), np.append(self.s, score[i, x])
        order = np.lexsort((d, -s, q))
        place = np.arange(len(q)) - np.searchsorted(q[order], q[order])
        order, place = order[place < self.depth], place[place < self.depth]
        self.q, self.d, self.s = q[order], d[order], s[order]
        full = place == self.depth - 1
        self.least[self.q[full]] = self.s[full]


class ScoredLists:
    """Complete lists (qid, doc_id, score) that are worked out where their rows lie, and never written or shuffled.

    ``rows`` is a table to be read again for each question, with NO_ID for null ids, which have a place in the lists but are not among the answers; ``score`` turns a batch of it into ids and a matrix of scores, a column for each of
    ``qids``, without a number where a row is not in a query's list. Columns of one qid are one list.
    """

    def __init__(self, rows: DataFrame, qids: list[int], score: Callable[[pd.DataFrame], tuple[np.ndarray, np.ndarray]]):
        self.rows, self.score = rows, score
        self.qids, self.owner = np.unique(np.array(qids, np.int64), return_inverse=True)

    def heads(self, depth: int, left: set[int] | None = None) -> tuple[DataFrame, DataFrame]:
        """(qid, doc_id, score) of the first rows of each list, of the queries ``left`` only, and (qid, count) of all that have a row."""
        score, qids, owner = self.score, self.qids, self.owner
        asked = np.ones(len(owner), bool) if left is None else np.isin(qids, list(left))[owner]

        def run(batches):
            found = _Heads(owner, depth)
            for pdf in batches:
                ids, scores = score(pdf)
                found.take(ids, np.where(asked, scores, np.nan))
            yield pd.DataFrame({"qid": qids[found.q], "doc_id": found.d, "score": found.s, "n": 0})
            some = found.length > 0
            yield pd.DataFrame({"qid": qids[some], "doc_id": 0, "score": 0.0, "n": found.length[some]})

        told = cut(self.rows.mapInPandas(run, "qid long, doc_id long, score double, n long"))
        first = top_n(told.where("n = 0").drop("n"), ["qid"], [F.desc("score"), c("doc_id")], depth).drop("rank")
        return first.where(c("doc_id") != NO_ID), told.where("n > 0").groupBy("qid").agg(F.sum("n").alias("count"))

    def ranks(self, wanted: DataFrame) -> DataFrame:
        """(qid, doc_id, rank): as ``ranks_of``. ``wanted`` is a few rows for each query and is collected."""
        score, qids, owner, spark = self.score, self.qids, self.owner, self.rows.sparkSession
        pairs = wanted.select("qid", "doc_id").toPandas().merge(pd.DataFrame({"qid": qids[owner], "x": np.arange(len(owner))}), on="qid")
        shared = spark.sparkContext.broadcast((pairs["x"].to_numpy(int), pairs["doc_id"].to_numpy(np.int64)))

        def fetch(batches):
            q, d = shared.value
            order = np.argsort(d, kind="stable")
            q, d = q[order], d[order]
            for pdf in batches:
                ids, scores = score(pdf)
                start, stop = np.searchsorted(d, ids, "left"), np.searchsorted(d, ids, "right")
                i = np.repeat(np.arange(len(ids)), stop - start)
                at = np.arange(len(i)) - np.repeat(np.cumsum(stop - start) - (stop - start), stop - start) + start[i]
                made = pd.DataFrame({"q": owner[q[at]], "doc_id": ids[i], "s": -scores[i, q[at]]})
                yield made[made["s"].notna()]

        known = self.rows.mapInPandas(fetch, "q int, doc_id long, s double").distinct().toPandas().sort_values(["q", "s", "doc_id"])
        lists = {q: (x["s"].to_numpy(), x["doc_id"].to_numpy()) for q, x in known.groupby("q")}
        held = spark.sparkContext.broadcast(lists)

        def count(batches):
            n = {q: np.zeros(len(s) + 1, np.int64) for q, (s, _) in held.value.items()}
            for pdf in batches:
                ids, scores = score(pdf)
                for x, q in enumerate(owner):
                    if q in held.value:
                        s, d = held.value[q]
                        there = ~np.isnan(scores[:, x])
                        n[q] += np.bincount(_places(-scores[there, x], ids[there], s, d), minlength=len(s) + 1)
            for q, x in n.items():
                yield pd.DataFrame({"q": q, "p": np.arange(len(x)), "n": x})

        counted = self.rows.mapInPandas(count, "q int, p int, n long").groupBy("q", "p").agg(F.sum("n").alias("n")).toPandas()
        out = []
        for q, x in counted.sort_values(["q", "p"]).groupby("q"):
            ranks = np.cumsum(x["n"].to_numpy())
            out += [(int(qids[q]), int(d), int(r)) for d, r in zip(lists[q][1], ranks)]
        return spark.createDataFrame(out, "qid long, doc_id long, rank long")


def _places(s: np.ndarray, ids: np.ndarray, at: np.ndarray, d: np.ndarray) -> np.ndarray:
    """How many of the pairs (``at``, ``d``), which are in order, are less than each pair (``s``, ``ids``)."""
    out, stop = np.searchsorted(at, s, "left"), np.searchsorted(at, s, "right")
    tied = np.flatnonzero(stop > out)
    if len(tied):
        order = np.lexsort((np.append(np.ones(len(d)), np.zeros(len(tied))), np.append(d, ids[tied]), np.append(at, s[tied])))
        less = np.empty(len(order), np.int64)
        less[order] = np.cumsum(order < len(d))
        out[tied] = less[len(d):]
    return out


def cosine_lists(queries: DataFrame, items: DataFrame, skip_self: bool = False) -> ScoredLists:
    """Lists of all items for every query; score is less the rounded distance of the unit vectors. Queries are broadcast."""
    asked = queries.where(c("qid").isNotNull()).select("qid", unit_vector("embedding").alias("v")).collect()
    qids = [r.qid for r in asked]
    shared = items.sparkSession.sparkContext.broadcast(np.array([r.v for r in asked], float))

    def score(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        ids = pdf["doc_id"].to_numpy(np.int64)
        if not len(ids) or not qids:
            return ids, np.zeros((len(ids), len(qids)))
        out = -np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (np.vstack(pdf["v"].to_numpy()) @ shared.value.T))).round(9)
        if skip_self:
            out[ids[:, None] == np.array(qids)] = np.nan
        return ids, out

    return ScoredLists(items.select(F.coalesce("rid", F.lit(NO_ID)).alias("doc_id"), unit_vector("embedding").alias("v")), qids, score)


def bm25_lists(docs: DataFrame, queries: DataFrame, k1: float = 1.2, b: float = 0.75) -> ScoredLists:
    """Lists of ``bm25_scores``. Of each document the numbers and counts of its query terms are kept, once; queries and their terms are broadcast."""
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = docs.sparkSession
    terms = queries.where(c("qid").isNotNull()).select("qid", F.explode(F.array_distinct(tokens(c("text")))).alias("term")).distinct().toPandas()
    vocab, qids = sorted(terms["term"].unique()), sorted(int(q) for q in terms["qid"].unique())
    # terms of queries, by term
    number, column = {t: i for i, t in enumerate(vocab)}, {q: i for i, q in enumerate(qids)}
    uses = terms.assign(t=terms["term"].map(number), q=terms["qid"].map(column)).sort_values(["t", "q"])
    first = np.searchsorted(uses["t"].to_numpy(int), np.arange(len(vocab) + 1))
    asks = uses["q"].to_numpy(int)

    def counted(batches):
        known = pa.array(vocab, pa.string())
        for batch in batches:
            w = batch.column("w")
            at = pc.list_parent_indices(w).to_numpy(zero_copy_only=False)
            t = pc.fill_null(pc.index_in(pc.list_flatten(w).cast(pa.string()), value_set=known), -1).to_numpy(zero_copy_only=False)
            key, n = np.unique(at[t >= 0] * max(1, len(vocab)) + t[t >= 0], return_counts=True)
            ends = np.searchsorted(key, np.arange(len(w) + 1) * max(1, len(vocab))).astype(np.int32)
            arrays = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (key % max(1, len(vocab)), n)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("dl"), *arrays], names=["doc_id", "dl", "t", "n"])

    words = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), tokens(c("text")).alias("w")).select("doc_id", F.size("w").alias("dl"), "w")
    own = words.mapInArrow(counted, "doc_id long, dl int, t array<int>, n array<int>")
    # rows of one id are one document
    rows = cut(own.groupBy("doc_id").agg(F.collect_list(F.struct("dl", "t", "n")).alias("x")).select(
        "doc_id", "x.dl", F.transform("x", lambda x: F.size(x["t"])).alias("size"), F.flatten("x.t").alias("t"), F.flatten("x.n").alias("n")))
    n_docs, avg_dl = rows.select(F.explode_outer("dl").alias("dl")).agg(F.count("*"), F.avg("dl")).first()

    def postings(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
        """Document, length, term and count, one row for each of a document's lengths and terms."""
        parts = pdf["dl"].map(len).to_numpy(int)
        size = np.concatenate([np.zeros(0, int), *pdf["size"]]).astype(int)
        doc = np.repeat(np.repeat(np.arange(len(pdf)), parts), size)
        dl = np.repeat(np.concatenate([np.zeros(0), *pdf["dl"]]).astype(float), size)
        t, n = np.concatenate([np.zeros(0, int), *pdf["t"]]).astype(int), np.concatenate([np.zeros(0, int), *pdf["n"]]).astype(int)
        if (parts > 1).any():
            order = np.lexsort((t, dl, doc))
            doc, dl, t, n = doc[order], dl[order], t[order], n[order]
            new = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (dl[1:] != dl[:-1]) | (t[1:] != t[:-1]))) if len(t) else np.zeros(0, int)
            doc, dl, t, n = doc[new], dl[new], t[new], np.add.reduceat(n, new) if len(t) else n
        return doc, dl, t, n

    def frequencies(batches):
        df = np.zeros(len(vocab), np.int64)
        for pdf in batches:
            df += np.bincount(postings(pdf)[2], minlength=len(vocab))
        yield pd.DataFrame({"t": np.arange(len(vocab)), "df": df})

    df = np.zeros(len(vocab))
    for r in rows.mapInPandas(frequencies, "t int, df long").groupBy("t").agg(F.sum("df").alias("df")).collect():
        df[r.t] = r.df
    idf = np.log(1.0 + (n_docs - df + 0.5) / (df + 0.5))
    shared = spark.sparkContext.broadcast((idf, first, asks))

    def score(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        idf, first, asks = shared.value
        ids, out = pdf["doc_id"].to_numpy(np.int64), np.full((len(pdf), len(qids)), np.nan)
        for i in range(0, len(pdf), SCORED):
            doc, dl, t, n = postings(pdf.iloc[i:i + SCORED])
            part = idf[t] * n * (k1 + 1.0) / (n + k1 * (1.0 - b + b * dl / (avg_dl or 1.0)))
            many = first[t + 1] - first[t]
            row = np.repeat(np.arange(len(t)), many)
            at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + first[t][row]
            key, shape = doc[row] * len(qids) + asks[at], out[i:i + SCORED].shape
            total = np.bincount(key, part[row], shape[0] * shape[1]).reshape(shape)
            out[i:i + SCORED] = np.where(np.bincount(key, minlength=shape[0] * shape[1]).reshape(shape) > 0, np.floor(total * 1e6 + 0.5) / 1e6, np.nan)
        return ids, out

    return ScoredLists(rows, qids, score)


def ranks_of(scored: DataFrame, wanted: DataFrame) -> DataFrame:
    """(qid, doc_id, rank): places of the ``wanted`` (qid, doc_id) in the list of all ``scored`` (qid, doc_id, score), best first, ties by id.

    No list is sorted: every scored row finds its place among the few wanted ones of its query, and the rows at each place are counted.
    """
    mine = F.struct((-c("score")).alias("s"), c("doc_id").alias("d"))
    lists = cut(wanted.join(scored, ["qid", "doc_id"]).groupBy("qid").agg(F.sort_array(F.collect_set(mine)).alias("_w")))
    placed = scored.join(lists, "qid").select("qid", F.size(F.filter("_w", lambda w: w < mine)).alias("_p"))
    counts = placed.groupBy("qid", "_p").agg(F.count("*").alias("_n"))
    each = lists.select("qid", F.posexplode("_w").alias("_p", "_x")).join(counts, ["qid", "_p"], "left")
    up_to = W.partitionBy("qid").orderBy("_p").rowsBetween(W.unboundedPreceding, 0)
    return each.select("qid", c("_x.d").alias("doc_id"), F.sum(F.coalesce("_n", F.lit(0))).over(up_to).alias("rank"))


class TableLists:
    """``ScoredLists`` of a table (qid, doc_id, score)."""

    def __init__(self, scored: DataFrame):
        self.scored = scored

    def heads(self, depth: int, left: set[int] | None = None) -> tuple[DataFrame, DataFrame]:
        own = self.scored if left is None else self.scored.where(c("qid").isin(list(left)))
        return top_n(own, ["qid"], [F.desc("score"), c("doc_id")], depth).drop("rank"), self.scored.groupBy("qid").count()

    def ranks(self, wanted: DataFrame) -> DataFrame:
        return ranks_of(self.scored.join(wanted.select("qid").distinct(), "qid", "left_semi"), wanted)


def fuse(lexical: DataFrame | ScoredLists, dense: DataFrame | ScoredLists, k: int, alpha: float = 0.5, damping: int = 60, depth: int | None = None) -> DataFrame:
    """(qid, doc_id, score, rank): reciprocal-rank fusion of two complete lists (qid, doc_id, score), weight alpha on the dense one.

    A threshold algorithm: the first ``depth`` of both lists are candidates, and their places in both complete lists are counted, so their
    scores are exact. A document in neither head scores at most what the next place of both gives; where the k-th candidate does not beat
    that, the heads are doubled, until it does or both lists have ended. The first depth is one that k documents of the
    weightier list always suffice for.
    """
    weights = [(x if hasattr(x, "heads") else TableLists(x), w) for x, w in ((lexical, 1.0 - alpha), (dense, alpha))]
    if depth is None:
        depth = max(k, int((damping + k) / max(alpha, 1.0 - alpha)) - damping + 1)
    done = left = lengths = None
    while True:
        told = [x.heads(depth, left) for x, _ in weights]
        if lengths is None:
            lengths = cut(told[0][1].unionByName(told[1][1]).groupBy("qid").agg(F.max("count").alias("longest")))
        some = cut(told[0][0].unionByName(told[1][0]).select("qid", "doc_id").distinct())
        parts = [x.ranks(some).select("qid", "doc_id", (F.lit(w) / (damping + c("rank"))).alias("s")) for x, w in weights]
        scored = parts[0].unionByName(parts[1]).groupBy("qid", "doc_id").agg(F.round(F.sum("s"), 9).alias("score"))
        best = cut(top_n(scored, ["qid"], [F.desc("score"), c("doc_id")], k))
        last = best.groupBy("qid").agg(F.min("score").alias("_least"), F.count("*").alias("_n")).join(lengths, "qid")
        unseen = round(1.0 / (damping + depth + 1), 9)
        sure = ((c("_n") == k) & (c("_least") > unseen)) | (c("longest") <= depth)
        # one row for each query
        left = {r.qid for r in last.where(~sure).select("qid").collect()}
        best = best.where(~c("qid").isin(list(left))) if left else best
        done = best if done is None else done.unionByName(best)
        if not left:
            return done.select("qid", "doc_id", "score", "rank")
        depth *= 2
