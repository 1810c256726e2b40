"""Secret scans over a trigram inverted index.

Each rule's regular expression is read for the letters that a match cannot do without; they give a Boolean query of
trigrams. Postings (trigram, row) are made for the trigrams that the rules ask for, intersected per rule, and only
rows that pass are matched against the expression itself. Rules without a mandatory trigram read every row. The index
is of lower-cased texts, so a query never misses a match. Everything is DataFrame operations.
"""

from __future__ import annotations

from re import _constants as sre_codes
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meltwise.llm.common import pack, shared_path, unpack

#: The base rules as (kind, expression, group whose length counts, least length).
BASE_RULES = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Rules of this library, in the same form.
OWN_RULES = (
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("google", r"AIza[0-9A-Za-z_-]{35}", 0, 0),
    ("stripe", r"[rs]k_(?:live|test)_[0-9A-Za-z]{16,}", 0, 0),
)
MOST = 64

Query = list[list[frozenset[str]]]  # all of: one of: all of these trigrams


def trigram_query(pattern: str) -> Query:
    """What every match of ``pattern`` contains, in lower case; an empty list if nothing is sure."""
    clauses: Query = []

    def flush(words: set[str]) -> set[str]:
        sets = {frozenset(w[i : i + 3] for i in range(len(w) - 2)) for w in words}
        if sets and all(sets):
            clauses.append(sorted((s for s in sets if not any(o < s for o in sets)), key=sorted))
        return {""}

    def finite(item) -> set[str] | None:
        """All texts that an item can match, if they are few."""
        op, arg = item
        if op is sre_codes.LITERAL:
            return {chr(arg).lower()}
        if op is sre_codes.IN:
            if all(x[0] is sre_codes.LITERAL for x in arg) and len(arg) <= 8:
                return {chr(x[1]).lower() for x in arg}
            return None
        if op is sre_codes.SUBPATTERN:
            return finite_all(arg[3])
        if op is sre_codes.BRANCH:
            parts = [finite_all(p) for p in arg[1]]
            return None if None in parts else set().union(*parts)
        if op in (sre_codes.MAX_REPEAT, sre_codes.MIN_REPEAT) and arg[1] is not sre_codes.MAXREPEAT and arg[1] <= 2:
            one, out = finite_all(arg[2]), set()
            if one is None:
                return None
            for n in range(arg[0], arg[1] + 1):
                words = {""}
                for _ in range(n):
                    words = {a + b for a in words for b in one}
                out |= words
            return out if len(out) <= MOST else None
        return None

    def finite_all(items) -> set[str] | None:
        words = {""}
        for item in items:
            one = finite(item)
            if one is None or len(words) * len(one) > MOST:
                return None
            words = {a + b for a in words for b in one}
        return words

    def walk(items, words: set[str]) -> set[str]:
        for item in items:
            one = finite(item)
            if one is not None and len(words) * len(one) <= MOST:
                words = {a + b for a in words for b in one}
                continue
            words = flush(words)
            op, arg = item
            if one is not None:
                words = one
            elif op is sre_codes.SUBPATTERN:
                words = flush(walk(arg[3], words))
            elif op in (sre_codes.MAX_REPEAT, sre_codes.MIN_REPEAT) and arg[0] >= 1:
                words = flush(walk(arg[2], words))
        return words

    flush(walk(sre_parser.parse(pattern), {""}))
    return clauses


def _spans(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """Structs (start, rank, span) of a rule's matches: from the lengths of the matches and of the pieces between them."""
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    kept = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length) if group else whole
    between = F.transform(F.split(text, pattern, -1), F.length)
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def span(size: Column, i: Column) -> Column:
        start = total(F.slice(between, 1, i + 1)) + total(F.slice(whole, 1, i))
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.concat_ws(":", F.lit(kind), start.cast("string"), (start + size).cast("string")).alias("span"), F.element_at(kept, i + 1).alias("kept"))

    found = F.transform(whole, span)
    return F.filter(found, lambda s: s["kept"] >= least) if least else found


KEY = "_k"


def candidates(docs: DataFrame, text: Column, key: Column, rules: list[tuple]) -> tuple[DataFrame, list[str]]:
    """(_k, kinds): rows that may match indexed rules, and the kinds of the rules that must read every row."""
    queries = {kind: trigram_query(pattern) for kind, pattern, *_ in rules}
    plan = [(t, kind, c, a, len(s), len(q)) for kind, q in queries.items() for c, alternatives in enumerate(q) for a, s in enumerate(alternatives) for t in sorted(s)]
    grams = sorted({p[0] for p in plan})
    low = F.lower(text)
    postings = docs.select(key.alias(KEY), low.alias("_low")).select(KEY, F.explode(F.array_compact(F.array(*[F.when(F.col("_low").contains(t), F.lit(t)) for t in grams]))).alias("gram")).distinct()
    asked = docs.sparkSession.createDataFrame(plan, "_gram string, kind string, clause int, alternative int, need int, clauses int")
    met = postings.join(F.broadcast(asked), F.col("gram") == F.col("_gram"))  # the rules' own trigrams, a few hundred rows
    met = met.groupBy(KEY, "kind", "clause", "alternative").agg(F.count("*").alias("n"), F.first("need").alias("need"), F.first("clauses").alias("clauses")).where("n = need")
    met = met.groupBy(KEY, "kind").agg(F.count_distinct("clause").alias("n"), F.first("clauses").alias("clauses")).where("n = clauses")
    return met.groupBy(KEY).agg(F.collect_set("kind").alias("_kinds")), [k for k, q in queries.items() if not q]


def scan(docs: DataFrame, rules: tuple = BASE_RULES + OWN_RULES) -> DataFrame:
    """Every row of ``docs`` with ``found``: structs (start, rank, span) of all matches, by start and then by rule.

    Spans are "kind:start:end" in code points, end exclusive; matches of a rule do not overlap, and those whose counted group is
    shorter than the rule's least length are dropped. Null text: as empty, nothing found. Repeated rows are found each.
    Empty table: no rows.
    """
    spark, text = docs.sparkSession, F.coalesce(docs["text"], F.lit(""))
    key = F.xxhash64(docs["doc_id"], text)
    chosen, unindexed = candidates(docs, text, key, list(rules))
    path = shared_path(spark)
    chosen.select(F.col(KEY).alias("_ck"), "_kinds").write.parquet(path)
    chosen = spark.read.schema("_ck long, _kinds array<string>").parquet(path)  # read from files, its size is known: small ones need no shuffle
    rows = pack(docs, _k=key, _text=text).join(chosen, F.col(KEY) == F.col("_ck"), "left")
    empty = F.array().cast("array<struct<start:int,rank:int,span:string,kept:int>>")
    parts = []
    for rank, (kind, pattern, group, least) in enumerate(rules):
        wanted = F.col("_text").rlike(pattern) if kind in unindexed else F.coalesce(F.array_contains("_kinds", kind), F.lit(False))
        parts.append(F.when(wanted, _spans(F.col("_text"), rank, kind, pattern, group, least)).otherwise(empty))
    return unpack(rows, docs.columns, found=F.array_sort(F.concat(*parts)))
