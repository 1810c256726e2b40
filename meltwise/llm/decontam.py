"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question with other parameters keeps its template. Windows of WIDTH
template tokens are hash-joined, at every place of documents and items. Where a window is poor in words, its own values and a longer
template are joined instead. Rows that meet are then aligned with the item, token by token, and the values
in the slots are compared: the same value must always turn into the same value, or the likeness is a chance of form. The alignment is
a join of single tokens and its figures are hash aggregates, so a document of any length costs in proportion to its meetings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meltwise.llm.common import cut, shared_path, text_column

WIDTH = 5
SHORT = 8  # tokens below which an item is looked for whole
LITERALS = 3  # words that a window holds at least beside its placeholders
BROADCAST_ROWS = 500_000
GAPS = (0, *[2**i for i in range(16)], None)  # distances of shifts that make one run; None: any
NUM, NAME, UNIT = "\ue000", "\ue001", "\ue002"
#: Units of measure that follow a number.
UNITS = (
    "mm", "cm", "m", "km", "in", "inch", "inches", "ft", "feet", "mile", "miles", "mg", "g", "kg", "t", "lb", "lbs", "oz", "ml", "l", "liter", "liters", "litre", "litres",
    "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "k", "c", "f", "degrees", "percent", "dollar", "dollars", "euro", "euros", "cent", "cents", "kb", "mb", "gb", "tb", "hz", "khz", "mhz", "w", "kw", "v", "a", "j", "n", "pa", "meter", "meters", "metre", "metres",
)
_NUMBER = r"\p{N}+(?:[.,]\p{N}+)*"
_NAME = r"(?<=[\p{L}\p{M},;] )\p{Lu}\p{Ll}[\p{L}\p{M}]*"
_UNIT = rf"(?<={NUM} {{1,2}})(?i:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\p{{L}}\p{{M}}])"
_TOKEN = r"[\p{L}\p{M}\x{E000}-\x{E002}]+"
_RAW = rf"{_NUMBER}|{_TOKEN}"


def template(text: Column) -> Column:
    """Tokens of a text with placeholders for numbers, for capitalised words inside a sentence, and for units after a number."""
    t = F.regexp_replace(text, _NAME, NAME)
    t = F.regexp_replace(t, _NUMBER, f" {NUM} ")
    t = F.regexp_replace(t, _UNIT, UNIT)
    return F.regexp_extract_all(F.lower(t), F.lit(_TOKEN), F.lit(0))


def raw_tokens(text: Column) -> Column:
    """The texts' own tokens, one for each token of ``template``."""
    return F.regexp_extract_all(text, F.lit(_RAW), F.lit(0))


def _window_keys(tokens: Column, widths: list[int]) -> Column:
    """(at, h) of every window of the given widths, at every place."""
    at = lambda n: F.transform(
        F.sequence(F.lit(0), F.size(tokens) - n), lambda i: F.struct(i.alias("at"), F.xxhash64(F.lit(n), F.slice(tokens, i + 1, n)).alias("h"))
    )
    none = F.array().cast("array<struct<at:int,h:bigint>>")
    return F.concat(*[F.when(F.size(tokens) >= n, at(n)).otherwise(none) for n in widths])


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is worked out once, however often it is named inside."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _is_slot(x: Column) -> Column:
    return x.isin(NUM, NAME, UNIT)


def _poor(tokens: Column) -> Column:
    """Places of windows with fewer than LITERALS words beside their placeholders."""
    n, few = F.size(tokens), WIDTH - LITERALS + 1
    held = F.when(n >= WIDTH, F.filter(F.sequence(F.lit(0), n - 1), lambda i: _is_slot(F.get(tokens, i)))).otherwise(F.array().cast("array<int>"))
    close = lambda at: F.when(
        F.size(at) >= few,
        F.filter(F.transform(F.sequence(F.lit(0), F.size(at) - few), lambda k: F.struct(F.get(at, k).alias("a"), F.get(at, k + few - 1).alias("z"))), lambda x: x["z"] - x["a"] < WIDTH),
    )
    runs = F.transform(_bound(held, close), lambda x: F.sequence(F.greatest(x["z"] - WIDTH + 1, F.lit(0)), F.least(x["a"], n - WIDTH)))
    return F.coalesce(F.array_distinct(F.flatten(runs)), F.array().cast("array<int>"))


def _poor_keys(rows: DataFrame, most: Column) -> DataFrame:
    """``rows`` (``t`` template, ``r`` raw tokens) with (at, h) for each poor place: its own values, and its template up to LITERALS words.

    The longer template is left out where ``most`` tokens do not reach so many words.
    """
    names = [c for c in rows.columns if c not in ("t", "r")]
    parts = F.transform(_poor(F.col("t")), lambda i: F.struct(i.alias("at"), F.slice("t", i + 1, most).alias("p"), F.slice("r", i + 1, F.lit(WIDTH)).alias("v")))
    places = rows.select(*names, F.inline(parts))
    ends = F.filter(F.sequence(F.lit(1), F.size("p")), lambda i: ~_is_slot(F.get(F.col("p"), i - 1)))
    places = places.withColumn("e", F.get(ends, F.lit(LITERALS - 1)))
    longer = F.when(F.col("e").isNotNull(), F.xxhash64(F.lit("longer"), F.slice("p", F.lit(1), F.coalesce("e", F.lit(0)))))
    return places.select(*names, "at", "e", F.explode(F.array(F.xxhash64(F.lit("values"), F.transform("v", F.lower)), longer)).alias("h")).where("h is not null")


def _runs(shifts: DataFrame) -> DataFrame:
    """``shifts`` (_k, _i, shift, n) with (lo, hi) of every run of neighbouring shifts that holds them, for every distance between neighbours."""
    ahead = Window.partitionBy("_k", "_i").orderBy("shift")
    back = ahead.rowsBetween(Window.unboundedPreceding, 0)
    on = Window.partitionBy("_k", "_i").orderBy(F.desc("shift")).rowsBetween(Window.unboundedPreceding, 0)
    near = shifts.withColumn("_d", F.col("shift") - F.lag("shift").over(ahead)).withColumn("_e", F.lead("shift").over(ahead) - F.col("shift"))

    def run(gap: int | None) -> Column:
        first = F.col("_d").isNull() | (F.lit(False) if gap is None else F.col("_d") > gap)
        last = F.col("_e").isNull() | (F.lit(False) if gap is None else F.col("_e") > gap)
        return F.struct(F.last(F.when(first, F.col("shift")), True).over(back).alias("lo"), F.last(F.when(last, F.col("shift")), True).over(on).alias("hi"))

    every = near.select("_k", "_i", "shift", "n", F.array(*[run(g) for g in GAPS]).alias("_r"))  # the last gap takes all shifts
    out = every.select("_k", "_i", "shift", "n", F.element_at("_r", -1).alias("_w"), F.explode(F.array_distinct("_r")).alias("_x"))
    return out.select("_k", "_i", "shift", "n", "_x.lo", "_x.hi", (F.col("_x") == F.col("_w")).alias("_full"))


def _sized(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def matches(docs: DataFrame, items: DataFrame, least: float = 0.5) -> DataFrame:
    """(_k, item_id, matched, item_tokens, coverage, slots, changed): rows of ``docs`` and items that they give away.

    ``_k`` is ``row_hash`` of the row. An item (item_id, text) is given away if ``least`` of its template's tokens stand in the document in
    their order in one run of shifts (one shift, neighbouring ones, or all together) and its slots are consistent there: over
    the run's aligned slots no value of the item becomes two values. Where a part of the shifts gives the item away with other values,
    only tokens inside common windows count, as single tokens meet by chance at any shift. Of several such runs the one with most tokens, then with fewest
    other values, is told. ``changed`` counts slots with another value: 0 for a plain copy.

    Items of fewer than SHORT tokens, or with fewer than LITERALS words in all, are looked for whole at every place. Null and
    empty texts match nothing; a null item id is a value like others. Repeated rows of either side are one match. Empty tables: no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(items["text"], F.lit(""))
    items = cut(items.select("item_id", template(text).alias("tokens"), raw_tokens(text).alias("raw")).where(F.size("tokens") > 0).distinct())
    items = items.withColumn("_i", _name(F.col("item_id"), F.to_json("raw")))
    whole = (F.size("tokens") < SHORT) | (F.size(F.filter("tokens", lambda x: ~_is_slot(x))) < LITERALS)
    lengths = sorted(r[0] for r in items.where(whole).select(F.size("tokens")).distinct().collect())
    key, text = row_hash(docs), F.coalesce(text_column(docs), F.lit(""))

    # windows that meet; a window of placeholders alone says nothing: such places have keys of their own
    long = items.where(F.size("tokens") >= SHORT)
    rich = long.select("_i", "tokens", F.inline(_window_keys(F.col("tokens"), [WIDTH]))).where(F.size(F.filter(F.slice("tokens", F.col("at") + 1, F.lit(WIDTH)), lambda x: ~_is_slot(x))) >= LITERALS)
    entire = items.where(whole).select("_i", F.lit(0).alias("at"), F.xxhash64(F.size("tokens"), F.col("tokens")).alias("h"))
    asked = cut(rich.select("_i", "at", "h").unionByName(entire).select("_i", F.col("at").alias("_at"), F.col("h").alias("_h")))
    held = docs.select(key.alias("_k"), template(text).alias("t")).select("_k", F.inline(_window_keys(F.col("t"), sorted({WIDTH, *lengths}))))
    met = held.join(_sized(asked, asked.count()), F.col("h") == F.col("_h")).select("_k", "_i", (F.col("at") - F.col("_at")).alias("shift"))
    asked = cut(_poor_keys(long.select("_i", F.col("tokens").alias("t"), F.col("raw").alias("r")), F.size("t")).select("_i", "at", "e", F.col("h").alias("_h")))
    if n_poor := asked.count():
        reach = asked.agg(F.max("e")).first()[0] or WIDTH
        asked = asked.drop("e").withColumnRenamed("at", "_at")
        held = _poor_keys(docs.select(key.alias("_k"), template(text).alias("t"), raw_tokens(text).alias("r")), F.lit(reach))
        hit = held.select("_k", F.col("at").alias("_p"), F.col("h").alias("_g")).join(_sized(asked, n_poor), F.col("_g") == F.col("_h"))
        met = met.unionByName(hit.select("_k", "_i", (F.col("_p") - F.col("_at")).alias("shift")))
    met = _filed(met.distinct())

    # places of an item whose token stands in the document at a shift: narrow rows, however long the document is
    hit = _filed(met.select(F.col("_k").alias("_mk")).distinct())
    named = docs.select(key.alias("_dk"), text.alias("_text")).join(_sized(hit, hit.count()), F.col("_dk") == F.col("_mk"), "left_semi").dropDuplicates(["_dk"])
    both = lambda t, r: F.posexplode(F.arrays_zip(t.alias("t"), r.alias("r")))
    told = named.select("_dk", both(template(F.col("_text")), raw_tokens(F.col("_text"))).alias("_p", "_x")).select("_dk", "_p", F.col("_x.t").alias("_t"), F.col("_x.r").alias("b"))
    parts = items.select(F.col("_i").alias("_pi"), F.size("tokens").alias("item_tokens"), both(F.col("tokens"), F.col("raw")).alias("j", "_x")).select("_pi", "item_tokens", "j", F.col("_x.t").alias("kind"), F.col("_x.r").alias("a"))
    wanted = met.join(parts, F.col("_i") == F.col("_pi"))
    places = wanted.join(told, (F.col("_k") == F.col("_dk")) & (F.col("j") + F.col("shift") == F.col("_p")) & (F.col("kind") == F.col("_t")))
    island = F.col("j") - F.row_number().over(Window.partitionBy("_k", "_i", "shift").orderBy("j"))
    places = places.select("_k", "_i", "item_tokens", "shift", "j", "kind", "a", "b", island.alias("_l"))
    firm = F.count("*").over(Window.partitionBy("_k", "_i", "shift", "_l")) >= WIDTH
    places = _filed(places.withColumn("firm", firm).drop("_l"))

    # every run that has enough places, all of them and those inside common windows alone
    runs = _runs(places.groupBy("_k", "_i", "shift").agg(F.count("*").alias("n")))
    enough = F.sum("n").over(Window.partitionBy("_k", "_i", "lo", "hi"))
    runs = runs.withColumn("_n", enough).select(F.col("_k").alias("_rk"), F.col("_i").alias("_ri"), F.col("shift").alias("_rs"), "lo", "hi", "_full", "_n")
    same = (F.col("_k") == F.col("_rk")) & (F.col("_i") == F.col("_ri")) & (F.col("shift") == F.col("_rs")) & (F.col("_n") >= least * F.col("item_tokens"))
    run = ["_k", "_i", "item_tokens", "lo", "hi", "_full"]
    values = places.join(runs, same).groupBy(*run, "j", "kind", "a", "b").agg(F.max("firm").alias("firm"))
    values = values.select("*", F.explode(F.when(F.col("firm"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("_firm"))
    slot = _is_slot(F.col("kind"))
    # by value of the item first: does it become two values?
    values = values.groupBy(*run, "_firm", "j", slot.alias("_slot"), F.when(slot, F.struct("kind", "a")).alias("_a")).agg(
        F.count("*").alias("slots"), F.count_if(F.col("a") != F.col("b")).alias("changed"), F.min("b").alias("_b0"), F.max("b").alias("_b1"))
    values = values.groupBy(*run, "_firm", "_slot", "_a").agg(F.count("*").alias("matched"), F.sum("slots").alias("slots"), F.sum("changed").alias("changed"), F.min("_b0").alias("_b0"), F.max("_b1").alias("_b1"))
    told = values.groupBy(*run, "_firm").agg(
        F.sum("matched").cast("int").alias("matched"), F.coalesce(F.sum(F.when(F.col("_slot"), F.col("slots"))), F.lit(0)).cast("int").alias("slots"),
        F.coalesce(F.sum(F.when(F.col("_slot"), F.col("changed"))), F.lit(0)).cast("int").alias("changed"), F.max(F.col("_slot") & (F.col("_b0") != F.col("_b1"))).alias("_two"))
    fits = ~F.col("_two") & (F.col("_full") | F.col("_firm"))
    told = told.withColumn("coverage", F.col("matched") / F.col("item_tokens")).where((F.col("coverage") >= least) & (fits | (F.col("changed") == 0)))
    best = told.groupBy("_k", "_i").agg(F.max(F.struct("matched", (-F.col("changed")).alias("same"), "item_tokens", "coverage", "slots")).alias("b"))
    best = best.join(items.select(F.col("_i").alias("_pi"), "item_id"), F.col("_i") == F.col("_pi"))
    best = best.groupBy("_k", "item_id").agg(F.max("b").alias("b"))
    return best.select("_k", "item_id", "b.matched", "b.item_tokens", "b.coverage", "b.slots", (-F.col("b.same")).alias("changed"))


def _filed(df: DataFrame) -> DataFrame:
    """The rows from a table in the shared folder: read from files, its size is known, and small ones need no shuffle."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _name(*columns: Column) -> Column:
    """A name of 128 bits."""
    return F.concat(F.hex(F.xxhash64(*columns)), F.lit("-"), F.hex(F.xxhash64(F.lit("other"), *columns)))


def row_hash(docs: DataFrame) -> Column:
    """Names a row by its id and text; equal rows have one name and one fate."""
    return _name(docs["doc_id"], F.coalesce(text_column(docs), F.lit("")))


def decontaminate(docs: DataFrame, items: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without the rows that give an item away; columns and repeated rows stay as they are."""
    bad = _filed(matches(docs, items, least).select(F.col("_k").alias("_bad")).distinct())
    return docs.join(bad, row_hash(docs) == F.col("_bad"), "left_anti")
