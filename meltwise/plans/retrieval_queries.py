"""Retrieval over documents and embeddings, and name lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from meltwise.operators import lookup
from meltwise.operators import retrieval as rt
from meltwise.operators.checkpoints import cut
from meltwise.operators.common import rnd
from meltwise.plans.fixture_sql import FIXTURE_SQL
from meltwise.plans.registry import query

c = F.col

FIXTURE_SQL["f_words"] = r"""
    SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\pL\pN]+'), lambda w : w <> '') AS w FROM documents"""
FIXTURE_SQL["f_bm25"] = r"""
    WITH q AS (SELECT DISTINCT item_id AS qid, unnest(list_filter(string_split_regex(lower(text), '[^\pL\pN]+'), lambda w : w <> '')) AS term FROM benchmark),
     s AS (SELECT count(*) AS n, avg(len(w)) AS avg_dl FROM f_words),
     p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM f_words) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
     d AS (SELECT term, count(*) AS df FROM p GROUP BY term)
    SELECT qid, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))), 6) AS score FROM p JOIN d USING (term) JOIN q USING (term), s GROUP BY qid, doc_id"""
FIXTURE_SQL["f_lex"] = "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM f_bm25"
FIXTURE_SQL["f_cos"] = """
    SELECT a.vec_id AS qid, b.vec_id AS doc_id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id"""
FIXTURE_SQL["f_dense"] = """
    SELECT qid, doc_id, cosine, row_number() OVER (PARTITION BY qid ORDER BY round(sqrt(greatest(0, 2 - 2 * cosine)), 9), doc_id) AS rank FROM f_cos"""
FIXTURE_SQL["f_fused"] = """
    SELECT * FROM (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM (
      SELECT qid, doc_id, round(sum(s), 9) AS score FROM (SELECT qid, doc_id, 0.5 / (60 + rank) AS s FROM f_lex UNION ALL SELECT qid, doc_id, 0.5 / (60 + rank) FROM f_dense WHERE qid IN (SELECT item_id FROM benchmark)) GROUP BY ALL)) WHERE rank <= 5"""


def lexical(t, k: int = 20):
    return rt.bm25(t.documents.select("doc_id", "text"), t.benchmark.select(c("item_id").alias("qid"), "text"), k)


def dense(t, k: int = 20, queries=None):
    e = t.embeddings
    q = e.select(c("vec_id").alias("qid"), "embedding") if queries is None else queries
    return rt.cosine_top_k(q, e.select(c("vec_id").alias("rid"), "embedding"), k, skip_self=True)


def benchmark_dense(t, k: int = 20):
    """Dense lists for the benchmark items, whose query vector is the embedding with the item's id."""
    q = t.embeddings.join(t.benchmark.select(c("item_id").alias("vec_id")), "vec_id", "left_semi").select(c("vec_id").alias("qid"), "embedding")
    return dense(t, k, q).select("qid", c("rid").alias("doc_id"), "rank")


@query("keyword_search", "SELECT qid, doc_id, score, rank FROM f_lex WHERE rank <= 20")
def keyword_search(t):
    return lexical(t).select("qid", "doc_id", "score", "rank")


@query("vector_search", "SELECT qid, doc_id, round(cosine, 6) + 0 AS cosine, rank FROM f_dense WHERE rank <= 5")
def vector_search(t):
    x = dense(t, 5)
    return x.select("qid", c("rid").alias("doc_id"), rnd(c("cosine")).alias("cosine"), "rank")


def hybrid(t, k: int = 5):
    """Fusion of the complete lists of the benchmark items."""
    e = t.embeddings
    asked = e.join(t.benchmark.select(c("item_id").alias("vec_id")), "vec_id", "left_semi").select(c("vec_id").alias("qid"), "embedding")
    lexical = rt.bm25_lists(t.documents.select("doc_id", "text"), t.benchmark.select(c("item_id").alias("qid"), "text"))
    return rt.fuse(lexical, rt.cosine_lists(asked, e.select(c("vec_id").alias("rid"), "embedding"), skip_self=True), k)


@query("hybrid_search", "SELECT qid, doc_id, score, rank FROM f_fused")
def hybrid_search(t):
    return hybrid(t).select("qid", "doc_id", "score", "rank")


@query("recall_at_k", """
    SELECT count(*) AS queries, count(f.doc_id) AS found, round(count(f.doc_id) / count(*), 8) AS recall FROM (SELECT qid, doc_id FROM f_dense WHERE rank = 1 AND qid IN (SELECT item_id FROM benchmark)) d
    LEFT JOIN f_fused f USING (qid, doc_id)""")
def recall_at_k(t):
    """Share of queries whose nearest item by vector is among the first k fused results."""
    truth = benchmark_dense(t, 1).select("qid", "doc_id")
    hit = hybrid(t).select("qid", "doc_id", F.lit(1).alias("hit"))
    x = truth.join(hit, ["qid", "doc_id"], "left")
    return x.agg(F.count("*").alias("queries"), F.count("hit").alias("found"), rnd(F.count("hit") / F.count("*"), 8).alias("recall"))


FIXTURE_SQL["f_names"] = "SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT name FROM f_entity"
FIXTURE_SQL["f_targets"] = """
    SELECT DISTINCT substr(p_name, 1, 2) || substr(p_name, 4) AS target FROM part UNION SELECT 'zzz unknown' UNION SELECT DISTINCT upper(left(p_name, 1)) || 'x' || substr(p_name, 3) FROM part
    UNION SELECT DISTINCT ' Alloy' || (o_custkey % 300) FROM orders WHERE o_custkey % 7 = 0 UNION SELECT DISTINCT 'all' || chr(243) || 'y ' || (o_custkey % 300) FROM orders WHERE o_custkey % 7 = 1"""
KEY = "translate(lower({}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"
FIXTURE_SQL["f_keys"] = f"""
    SELECT k AS b, min(name) AS name FROM (SELECT name, trim({KEY.format("trim(regexp_replace(regexp_replace(trim(replace(lower(name), '*', '')), '\\((forged|cast)\\)', '', 'g'), '\\b(wrought|cast|bar|sheet|plate|forged)\\b', '', 'g'))")}) AS k FROM f_names)
    WHERE k <> '' GROUP BY k"""
FIXTURE_SQL["f_scored"] = f"""
    SELECT target, name, 1 - levenshtein(a, b) / greatest(length(a), length(b))::DOUBLE + CASE WHEN contains(b, a) THEN 0.5 ELSE 0 END AS score
    FROM (SELECT target, {KEY.format('trim(target)')} AS a FROM f_targets) t, f_keys WHERE a <> ''"""
FIXTURE_SQL["f_matched"] = "SELECT target, name AS match, round(score, 9) AS score, row_number() OVER (PARTITION BY target ORDER BY round(score, 9) DESC, name) AS k FROM f_scored"


def names(t):
    """Part names and alloy names; the alloys' hold marks, routes and forms that are no part of the core name."""
    return t.part.select(c("p_name").alias("name")).unionByName(t.entity.select("name")).distinct()


def targets(t):
    """Names with a letter missing, names with a letter changed in a word, alloys with another spelling, and one that matches nothing."""
    part, orders = t.part, t.orders
    typo = F.concat(F.substring("p_name", 1, 2), F.expr("substring(p_name, 4)"))
    other = F.concat(F.upper(F.substring("p_name", 1, 1)), F.lit("x"), F.expr("substring(p_name, 3)"))
    number = (c("o_custkey") % 300).cast("string")
    alloys = lambda rest, text: orders.where(c("o_custkey") % 7 == rest).select(F.concat(F.lit(text), number).alias("target"))
    extra = part.limit(1).select(F.lit("zzz unknown").alias("target"))
    all_ = part.select(typo.alias("target")).union(part.select(other.alias("target"))).union(alloys(0, " Alloy")).union(alloys(1, "allóy ")).union(extra)
    return all_.distinct()


@query("fuzzy_match", "SELECT target, match, score FROM f_matched WHERE k = 1 AND score >= 0.5")
def fuzzy_match(t):
    return lookup.best_match(targets(t), names(t))


@query("fuzzy_match_ratio")
def fuzzy_match_ratio(t):
    """The same lookup by matched characters; tests compare it with all pairs."""
    return lookup.best_match(targets(t), names(t), lookup.RATIO)


@query("multi_lookup", """
    SELECT target, match, score, CASE WHEN score >= 0.8 THEN 1 ELSE 2 END AS attempt FROM f_matched WHERE k = 1 AND score >= 0.3""")
def multi_lookup(t):
    """Many names, a second and looser attempt for the ones not found, one row per name."""
    wanted = targets(t)
    first = cut(lookup.best_match(wanted, names(t), least=0.8).withColumn("attempt", F.lit(1)))
    rest = wanted.join(first.select("target"), "target", "left_anti")
    second = lookup.best_match(rest, names(t), least=0.3, levels=(0.5,)).withColumn("attempt", F.lit(2))
    return first.unionByName(second)
