"""Name lookup by similarity that loses no match: grams, lengths and counts bound the similarity before it is worked out.

Two names of a similarity share a least number of grams, whatever they are. Grams are ordered by how common they are, and names that share so many
must share one of their rarest (a prefix of that order), so the rarest grams alone are joined; lengths and the similarity itself decide.
Pairs of characters are used where they must be shared, single characters for pairs of names too short or too unlike for that.
Names that hold a target whole are found by the target's rarest block of characters.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meltwise.functions.text import core_name, fold_accents
from meltwise.operators.checkpoints import cut
from meltwise.operators.common import first_row

c = F.col
BLOCK = 3  # characters of a target by which names that hold it whole are found
STRICT = 0.8  # similarity that is tried first: few pairs can reach it, so its index is sharp


@dataclass(frozen=True)
class Measure:
    """A similarity of ``a`` and ``b`` as SQL, with its bounds for lengths ``x`` and ``y`` as SQL.

    ``longest`` is the greatest length that can be similar to length x, ``shared(q)`` the least number of common q-grams.
    """

    score: str
    longest: Callable[[float], str]
    shared: Callable[[int, float], str]


#: One less the edits by the longer length. An edit changes q grams at most.
EDIT = Measure(
    "1D - levenshtein(a, b) / cast(greatest(length(a), length(b)) AS double)",
    lambda s: f"floor(x / {s}D + 1e-9)",
    lambda q, s: f"(greatest(x, y) - {q - 1} - {q} * floor((1 - {s}D) * greatest(x, y) + 1e-9))",
)


def _ratio_sql() -> str:
    """Matched characters over all, twice: the longest common block, then the same to its left and to its right.

    A block is found by lengthening it while it stands in the other text and moving on where it does not; texts still to be compared are kept in a list.
    """
    block = """aggregate(sequence(1, 2 * length(t.x)), named_struct('i', 0, 'n', 0, 'at', 0), (f, _) -> if(f.i + f.n + 1 > length(t.x), f,
      if(instr(t.y, substring(t.x, f.i + 1, f.n + 1)) > 0, named_struct('i', f.i, 'n', f.n + 1, 'at', f.i), named_struct('i', f.i + 1, 'n', f.n, 'at', f.at))))"""
    rest = "slice(s.todo, 2, greatest(size(s.todo) - 1, 0))"
    sides = """filter(array(named_struct('x', substring(t.x, 1, f.at), 'y', substring(t.y, 1, j - 1)), named_struct('x', substring(t.x, f.at + f.n + 1), 'y', substring(t.y, j + f.n))),
      p -> p.x <> '' AND p.y <> '')"""
    split = f"transform(array(instr(t.y, substring(t.x, f.at + 1, f.n))), j -> named_struct('todo', concat({rest}, {sides}), 'm', s.m + f.n))[0]"
    one = f"transform(array({block}), f -> if(f.n = 0, named_struct('todo', {rest}, 'm', s.m), {split}))[0]"
    step = f"if(size(s.todo) = 0, s, transform(array(s.todo[0]), t -> {one})[0])"
    matched = f"aggregate(sequence(1, 2 * least(length(a), length(b)) + 1), named_struct('todo', array(named_struct('x', a, 'y', b)), 'm', 0), (s, _) -> {step}).m"
    return f"if(length(a) + length(b) = 0, 1D, 2D * {matched} / (length(a) + length(b)))"


#: Matched characters stand in order in both texts; every other one is taken out or put in, which changes q or q - 1 grams at most.
RATIO = Measure(
    _ratio_sql(),
    lambda s: f"floor(x * (2 - {s}D) / {s}D + 1e-9)",
    lambda q, s: f"({2 * q - 1} * ceil({s}D * (x + y) / 2 - 1e-9) - {q - 1} * (x + y) - {q - 1})",
)


def _grams(q: int) -> str:
    """Distinct q-grams of ``k``: repeated ones are numbered."""
    return f"""transform(sequence(1, length(k) - {q - 1}), i -> concat(substring(k, i, {q}), ':', size(filter(sequence(1, i), j -> substring(k, j, {q}) = substring(k, i, {q})))))"""


def _index(df: DataFrame, q: int, measure: Measure, least: float, counts: DataFrame) -> DataFrame:
    """(k, g): the rarest grams of each key, as many as a similar key must share one of; no similar pair, no rows."""
    need = measure.shared(q, least)
    lengths = f"sequence(1, cast(greatest(1, {measure.longest(least)}) AS int))"
    if q == 1:
        wanted = f"array_min(transform({lengths}, y -> greatest(1, cast({need} AS int))))"
    else:  # pairs of lengths that need not share a pair of characters are left to single ones
        wanted = f"array_min(filter(transform({lengths}, y -> cast({need} AS int)), n -> n > 0))"
    keyed = df.select("k", F.length("k").alias("x")).where(f"x >= {q}").select("k", F.expr(wanted).alias("n"), F.expr(_grams(q)).alias("gs")).where("n IS NOT NULL")
    each = keyed.select("k", "n", F.size("gs").alias("size"), F.explode("gs").alias("g"))
    common = each.join(counts.withColumnRenamed("g", "_g"), c("g") == c("_g"), "left")
    ordered = common.groupBy("k", "n", "size").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("o"), "g"))).alias("gs"))
    return ordered.select("k", F.explode(F.expr("slice(gs, 1, greatest(1, size - n + 1))")).alias("x")).select("k", c("x.g").alias("g"))


def similar_pairs(targets: DataFrame, names: DataFrame, measure: Measure, least: float) -> DataFrame:
    """(a, b, score): every pair of keys ``k`` of both sides with a similarity of ``least`` or more."""
    if not 0 < least <= 1:
        raise ValueError("a similarity above 0 is needed")
    need = measure.shared(2, least)
    met = None
    for q in (2, 1):
        lengths = f"sequence(1, cast(greatest(1, {measure.longest(least)}) AS int))"
        alone = f"exists({lengths}, y -> {need} < 1)"
        one, two = targets.select("k"), names.select("k")
        if q == 1:  # only keys with a partner length that pairs of characters do not cover
            one, two = (df.withColumn("x", F.length("k")).where(alone).select("k") for df in (one, two))
        counts = two.where(F.length("k") >= q).select(F.explode(F.expr(_grams(q))).alias("g")).groupBy("g").agg(F.count("*").alias("often"))
        left, right = _index(one, q, measure, least, counts), _index(two, q, measure, least, counts)
        hit = left.select(c("k").alias("a"), "g").join(right.select(c("k").alias("b"), c("g").alias("_g")), c("g") == c("_g")).select("a", "b")
        hit = hit.withColumn("x", F.least(F.length("a"), F.length("b"))).where(F.greatest(F.length("a"), F.length("b")) <= F.expr(measure.longest(least))).select("a", "b").distinct()
        met = hit if met is None else met.unionByName(hit)
    return met.distinct().withColumn("score", F.expr(measure.score)).where(c("score") >= least - 1e-9)


def holding_pairs(targets: DataFrame, names: DataFrame) -> DataFrame:
    """(a, b): names that hold a target whole, by the target's rarest block; targets shorter than a block by all they have."""
    blocks = lambda q: f"array_distinct(transform(sequence(1, length(k) - {q - 1}), i -> substring(k, i, {q})))"
    out = None
    for q in range(1, BLOCK + 1):
        some = targets.where(F.length("k") >= BLOCK) if q == BLOCK else targets.where(F.length("k") == q)
        held = names.where(F.length("k") >= q).select(c("k").alias("b"), F.explode(F.expr(blocks(q))).alias("g"))
        counts = held.groupBy("g").agg(F.count("*").alias("often"))
        asked = some.select(c("k").alias("a"), F.explode(F.expr(blocks(q))).alias("_g")).join(counts, c("_g") == c("g"), "left")
        rarest = asked.groupBy("a").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("o"), c("_g").alias("g"))).alias("r")).where("r.o > 0").select("a", c("r.g").alias("_g"))
        hit = rarest.join(held, c("_g") == c("g")).where(F.contains("b", "a")).select("a", "b")
        out = hit if out is None else out.unionByName(hit)
    return out


def best_match(targets: DataFrame, names: DataFrame, measure: Measure = EDIT, least: float = 0.5, boost: float = 0.5, levels: tuple[float, ...] = (STRICT,)) -> DataFrame:
    """(target, match, score): the best name of each target, by similarity and ``boost`` for names that hold it whole.

    ``targets`` is (target), ``names`` (name). Both are compared by their keys: trimmed, in lower case, without accents, names also without asterisks
    and words of form and route. The best score must reach ``least``; ties go to the first name. Similarities of ``levels`` are tried
    first: who finds a match there needs no other, as no pair that is still unseen can score as much. The rest are compared down to
    ``least``, or not at all where only a boosted score could reach it. Names without a key and nulls match nothing.
    """
    asked = targets.select("target", fold_accents(F.trim("target")).alias("k")).distinct().where("k <> ''")
    known = cut(names.select("name", F.trim(fold_accents(core_name(c("name")))).alias("k")).distinct().where("k <> ''").groupBy("k").agg(F.min("name").alias("name")))
    asked = cut(asked)
    keys = asked.select("k").distinct()
    held = holding_pairs(keys, known).withColumn("score", F.expr(measure.score) + boost).where(c("score") >= least - 1e-9)
    held = cut(held)
    found, left = None, keys
    tried = sorted({x for x in levels if x > least} | {least}, reverse=True)
    for level in tried:
        pairs = similar_pairs(left, known, measure, level).where(~F.contains("b", "a")).unionByName(held.join(left.select(c("k").alias("_k")), c("a") == c("_k"), "left_semi").select("a", "b", "score"))
        best = first_row(pairs.withColumn("score", F.round("score", 9)).join(known.select(c("k").alias("_n"), "name"), c("b") == c("_n")), ["a"], [F.desc("score"), c("name")])
        best = cut(best.where(c("score") >= level).select("a", "name", "score"))
        found = best if found is None else found.unionByName(best)
        if level != tried[-1]:
            left = cut(left.join(best.select(c("a").alias("_a")), c("k") == c("_a"), "left_anti"))
    return asked.join(found, c("k") == c("a")).select("target", c("name").alias("match"), "score")
