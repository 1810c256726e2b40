"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meltwise.llm import collocations, decontam, divergence, embeddings, language, licenses, mixing, packing, secrets, sharding, simhash, suffixes, toxicity
from meltwise.llm.common import cut, table, word_count

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def fold(column: str, n: int):
    """Remainder of the id's CRC-32 (of its decimal text) by ``n``; null for a null id."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(n))


@query("op3_kd_shards")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of near-equal bytes and its place there; law ``bytes``."""
    out = sharding.shard(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5('mix:' || doc_id) AS k FROM documents
), s AS (
  SELECT source, sum(size)::DOUBLE AS n, ([5.0, 2.0, 1.0])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1]::DOUBLE AS w FROM d GROUP BY source
), o AS (
  SELECT *, row_number() OVER (ORDER BY 2.0 * n / w, source NULLS LAST) AS r FROM s
), lvl AS (
  SELECT *, 1.5 * sum(n) OVER () - coalesce(sum(2.0 * n) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS room,
         sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS rest
  FROM o
), f AS (SELECT *, 2.0 * n * rest <= w * room AS capped FROM lvl),
lo AS (SELECT room AS room0, rest AS rest0 FROM f WHERE NOT capped ORDER BY r LIMIT 1),
t AS (SELECT source, n, CASE WHEN capped THEN 2.0 * n ELSE w * room0 / rest0 END AS target FROM f LEFT JOIN lo ON true),
e AS (SELECT *, floor(target)::BIGINT AS budget, CASE WHEN n > 0 THEN floor(floor(target) / n)::BIGINT ELSE 0 END AS ep FROM t),
p AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bef FROM d)
SELECT p.doc_id, p.source, p.size, e.n::BIGINT AS source_size, e.target,
       (e.ep * p.size + greatest(0, least(p.size, e.budget - e.ep * e.n::BIGINT - p.bef)))::BIGINT AS taken,
       (e.ep + (2 * p.bef + p.size <= 2 * (e.budget - e.ep * e.n::BIGINT))::INT)::BIGINT AS copies
FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source
"""


@query("op9_mix", MIX_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes, by its source's target."""
    docs = cut(table(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return mixing.mix(docs, size=F.col("size")).select("doc_id", "source", "size", "source_size", "target", "taken", "copies")


@query("op1_language_id")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by trees learned from the documents that are not held out; ``und`` without a letter."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    trees = language.train(docs.where(~held).select("text", "lang"))
    out = docs.select("doc_id", held.alias("held_out"), language.identify(docs, trees, docs["text"]).alias("_p"))
    return out.select("doc_id", "held_out", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"), F.col("_p.bits_per_byte").alias("bits_per_byte"))


@query("op6_licenses")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases, tags and expressions of every document."""
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", licenses.scan(docs["text"]).alias("_l")).select("doc_id", "_l.*")


@query("op7_simhash")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and the smallest id that fingerprints within 2 bits reach."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def toxicity_field(docs: DataFrame, spark: SparkSession, sf_dir: str):
    labels = table(spark, sf_dir, "labels").where(F.coalesce(fold("doc_id", 4) != 2, F.lit(True)))
    return toxicity.train(docs, labels)


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score by a field learned from labels that are not held out, with its spans."""
    docs = table(spark, sf_dir, "documents")
    scored = docs.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), toxicity.score(docs, toxicity_field(docs, spark, sf_dir), docs["text"]).alias("_s"))
    return scored.select("doc_id", "held_out", F.col("_s.score").alias("score"), (F.col("_s.score") >= 0.3).cast("int").alias("predicted"), F.col("_s.spans").alias("spans"))


EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), r AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT a, min(b) AS m FROM r GROUP BY a),
n AS (SELECT a, count(*) AS k FROM l GROUP BY a)
SELECT vec_id, coalesce(k, 0) AS n_links, m AS component_id, vec_id = m AS kept FROM v JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
"""


@query("op10_embeddings", EMBEDDING_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links of cosine 0.93 or more within its label, and its component."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def secrets_sql() -> str:
    """The same spans in SQL, from the lengths of matches and of the pieces between them."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    kinds = []
    for rank, (kind, pattern, group, least) in enumerate(secrets.BASE_RULES + secrets.OWN_RULES):
        kinds.append(f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, regexp_extract_all(t, {quoted(pattern)}) AS m,
          regexp_extract_all(t, {quoted(pattern)}, {group}) AS g, string_split_regex(t, {quoted(pattern)}) AS p, {least} AS least
          FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents) WHERE regexp_matches(t, {quoted(pattern)})""")
    return f"""
WITH k AS ({' UNION ALL '.join(kinds)}),
u AS (SELECT doc_id, rank, kind, least, unnest(range(len(m))) AS i, m, g, p FROM k),
s AS (
  SELECT doc_id, rank, kind, (list_sum([length(x) FOR x IN p[1:i + 1]]) + coalesce(list_sum([length(x) FOR x IN m[1:i]]), 0))::BIGINT AS a, length(m[i + 1]) AS n, length(g[i + 1]) AS c, least FROM u
),
z AS (SELECT doc_id, rank, kind, a, kind || ':' || a || ':' || (a + n) AS span FROM s WHERE c >= least)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY a, rank) FILTER (rank < 3), '')) AS base_sha256, coalesce(string_agg(span, ',' ORDER BY a, rank), '') AS spans
FROM documents d LEFT JOIN z USING (doc_id) GROUP BY d.doc_id
"""


@query("op4_secrets", secrets_sql())
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: counts of the base kinds, their digest, and all spans."""
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "found")
    n = lambda rank: F.size(F.filter("found", lambda s: s["rank"] == rank)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: s["span"]), ",")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(text(F.filter("found", lambda s: s["rank"] < 3)), 256).alias("base_sha256"), text(F.col("found")).alias("spans"),
    )


@query("op2_decontaminate")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items they give away, plain or with other parameters; one row per document and item."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = cut(decontam.matches(docs, table(spark, sf_dir, "benchmark")))
    named = docs.select("doc_id", decontam.row_hash(docs).alias("_n")).join(found, F.col("_n") == F.col("_k"))
    return named.select("doc_id", "item_id", "matched", "item_tokens", "coverage", "slots", "changed").distinct()


@query("pipeline")
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of ``corpus_pipeline`` over the documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


@query("op5_suffix_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without bytes of repeated 200-byte strings."""
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


DIVERGENCE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents
), w AS (SELECT n, lang, source, unnest(ts) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT n) >= 10),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0)::HUGEINT AS c, 1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 2)) // (coalesce(n.n, 0) + 2 * v.v) AS p
  FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN n USING (lang, source)),
l AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (s + 2)) // (sum(s) OVER (PARTITION BY lang) + 2 * v) AS q FROM (SELECT lang, term, sum(c) AS s FROM c GROUP BY lang, term) JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM f a JOIN f b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
o AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM f JOIN l USING (lang, term) WHERE c > 0 AND p > q
), r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM o)
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
"""


@query("op11_divergence", DIVERGENCE_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every (lang, source) group's gaps to the other sources of its language, and the ten terms it overuses most."""
    return divergence.audit(table(spark, sf_dir, "documents"))


@query("op12_pack")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces of at most 1024 tokens, with the packed sequence and place each goes to."""
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


COLLOCATION_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS n, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents
), w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS x FROM d),
s AS (SELECT lang, k, unnest([array_to_string(x[i:i + k - 1], ' ') FOR i IN range(1, len(x) - k + 2)]) AS p FROM w, range(1, 5) t(k) WHERE len(x) >= k),
f AS (SELECT lang, k, p, count(*) AS f FROM s GROUP BY lang, k, p HAVING count(*) >= 30),
n AS (SELECT lang, sum(len(x))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, p, f AS a, string_split(p, ' ') AS x FROM f WHERE k > 1),
u AS (SELECT lang, k, p, a, x, unnest(range(1, k)) AS cut FROM c),
z AS (SELECT u.lang, u.p, u.a, cut, l.f AS l, r.f AS r, (2000000::HUGEINT * a // (l.f + r.f))::BIGINT AS score
  FROM u JOIN f l ON l.lang = u.lang AND l.p = array_to_string(x[1:cut], ' ') JOIN f r ON r.lang = u.lang AND r.p = array_to_string(x[cut + 1:], ' ')),
b AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, cut) = 1),
i AS (SELECT lang, a, m, x, unnest(range(1, k - m + 2)) AS j FROM (SELECT lang, a, k, x, unnest(range(2, k)) AS m FROM c WHERE k > 2)),
o AS (SELECT lang, array_to_string(x[j:j + m - 1], ' ') AS p, max(a) AS longer FROM i GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.p) AS rank, b.p AS phrase, a, l, r, n, score
FROM b JOIN n ON n.lang = b.lang LEFT JOIN o ON o.lang = b.lang AND o.p = b.p WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a
QUALIFY rank <= 2000
"""


@query("op13_collocations", COLLOCATION_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2,000 best collocations of two to four words of every language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))
