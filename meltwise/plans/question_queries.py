"""Ranking by property, target search, question building and answer scoring."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meltwise.functions import statistics, text
from meltwise.operators import ranks
from meltwise.operators.common import const_table, first_row, rnd, top_n
from meltwise.plans.fixture_sql import FIXTURE_SQL
from meltwise.plans.registry import query

c = F.col
CORE = r"""trim(regexp_replace(regexp_replace(trim(replace(lower(name), '*', '')), '\((forged|cast)\)', '', 'g'), '\b(wrought|cast|bar|sheet|plate|forged)\b', '', 'g'))"""

FIXTURE_SQL["f_pref"] = f"""
    SELECT entity, property, name, {CORE} AS core, coalesce(max(value) FILTER (temp_c BETWEEN 20 AND 25), arg_min(value, (abs(temp_c - 22), pos))) AS v
    FROM f_measurement JOIN f_entity USING (entity) GROUP BY entity, property, name"""


def preferred(t):
    """Per entity and property: the largest room-temperature value, else the one nearest 22 C."""
    rt = F.max(F.when(c("temp_c").between(20, 25), c("value")))
    near = F.min_by("value", F.struct(F.abs(c("temp_c") - 22), c("pos")))
    return t.measurement.groupBy("entity", "property").agg(F.coalesce(rt, near).alias("v"))


def named(t):
    x = preferred(t).join(t.entity.select("entity", "name"), "entity")
    return x.withColumn("core", text.core_name(c("name")))


@query("preferred_value", "SELECT entity, property, v FROM f_pref")
def preferred_value(t):
    return preferred(t)


def rank_by(x, order, limit):
    """Best row per core name, then the first rows overall (a limit that is the feature)."""
    best = first_row(x, ["core"], [*order, c("entity")])
    w = W.orderBy(*order, c("entity"))
    return best.orderBy(*order, c("entity")).limit(limit).withColumn("rank", F.row_number().over(w))


@query("rank_property", """
    WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY core ORDER BY v DESC, entity) AS k FROM f_pref WHERE property = 'ys') WHERE k = 1)
    SELECT entity, name, v, rank FROM (SELECT *, row_number() OVER (ORDER BY v DESC, entity) AS rank FROM b) WHERE rank <= 5""")
def rank_property(t, prop: str = "ys", limit: int = 5):
    return rank_by(named(t).where(c("property") == prop), [F.desc("v")], limit).select("entity", "name", "v", "rank")


def near_target(x, target, tolerance_pct, limit):
    """Closest to a target; far rows are dropped only when enough rows are within the tolerance."""
    gap = F.round(F.abs(c("v") - target), 6)
    best = first_row(x.withColumn("gap", gap), ["core"], [c("gap"), c("entity")])
    inside = c("gap") / target * 100 <= tolerance_pct
    enough = best.agg((F.count_if(inside) >= limit).alias("enough"))
    kept = best.crossJoin(F.broadcast(enough)).where(~c("enough") | inside)
    w = W.orderBy("gap", "entity")
    return kept.orderBy("gap", "entity").limit(limit).withColumn("rank", F.row_number().over(w))


@query("nearest_target", """
    WITH b AS (SELECT * FROM (SELECT *, round(abs(v - 500), 6) AS gap, row_number() OVER (PARTITION BY core ORDER BY round(abs(v - 500), 6), entity) AS k FROM f_pref WHERE property = 'uts') WHERE k = 1)
    SELECT entity, v, gap, rank FROM (SELECT *, row_number() OVER (ORDER BY gap, entity) AS rank FROM b
      WHERE gap / 500 * 100 <= 20 OR (SELECT count(*) FROM b WHERE gap / 500 * 100 <= 20) < 3) WHERE rank <= 3""")
def nearest_target(t):
    x = near_target(named(t).where(c("property") == "uts"), F.lit(500.0), 20, 3)
    return x.select("entity", "v", "gap", "rank")


@query("similar_to_ref", """
    WITH r AS (SELECT v AS target, core AS rc FROM f_pref WHERE property = 'ys' ORDER BY name, entity LIMIT 1),
     b AS (SELECT * FROM (SELECT f.*, round(abs(v - target), 6) AS gap, row_number() OVER (PARTITION BY core ORDER BY round(abs(v - target), 6), entity) AS k FROM f_pref f, r WHERE property = 'ys' AND core <> rc) WHERE k = 1)
    SELECT entity, v, gap, rank FROM (SELECT *, row_number() OVER (ORDER BY gap, entity) AS rank FROM b) WHERE rank <= 3""")
def similar_to_ref(t):
    """Target taken from a named reference entity, which is itself excluded."""
    x = named(t).where(c("property") == "ys")
    ref = x.orderBy("name", "entity").limit(1).select(c("v").alias("target"), c("core").alias("rc"))
    y = x.crossJoin(F.broadcast(ref)).where(c("core") != c("rc")).withColumn("gap", F.round(F.abs(c("v") - c("target")), 6))
    return rank_by(y, [c("gap")], 3).select("entity", "v", "gap", "rank")


@query("distractors", """
    WITH q AS (SELECT entity, property, temp_c, value AS correct FROM f_measurement WHERE property = 'ys'),
     k AS (SELECT q.entity, q.temp_c, correct, m.value FROM q JOIN f_measurement m ON m.entity = q.entity AND m.property = 'ys' AND m.temp_c <> q.temp_c
       UNION ALL SELECT q.entity, q.temp_c, correct, m.value FROM q JOIN f_measurement m ON m.entity = q.entity AND m.property = 'uts' AND m.temp_c = q.temp_c),
     u AS (SELECT entity, temp_c, correct, round(value, 8) AS r, min(abs(value - correct)) AS gap, 0 AS pool FROM k WHERE abs(value - correct) > 0.005 * abs(correct) GROUP BY ALL),
     f AS (SELECT entity, temp_c, correct, round(correct * factor, 8) AS r, i::DOUBLE AS gap, 1 AS pool FROM q, (VALUES (1, 0.80), (2, 1.25), (3, 0.70), (4, 1.35), (5, 0.60), (6, 1.50)) p(i, factor)),
     a AS (SELECT * FROM u UNION ALL SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.entity = f.entity AND u.temp_c = f.temp_c AND u.r = f.r))
    SELECT entity, temp_c, round(r, 8) AS wrong, rank FROM (SELECT *, row_number() OVER (PARTITION BY entity, temp_c ORDER BY pool, gap, r) AS rank FROM a) WHERE rank <= 3""")
def distractors(t, n: int = 3, digits: int = 8):
    """Wrong values near the correct one: other temperatures, the other strength, then fixed factors."""
    m = t.measurement_set
    q = m.where(c("property") == "ys").select("entity", "temp_c", c("value").alias("correct"))
    other = m.select("entity", c("temp_c").alias("t2"), c("property").alias("p2"), "value")
    pool = q.join(other, "entity").where(
        ((c("p2") == "ys") & (c("t2") != c("temp_c"))) | ((c("p2") == "uts") & (c("t2") == c("temp_c"))))
    pool = pool.where(F.abs(c("value") - c("correct")) > 0.005 * F.abs("correct"))
    key = ["entity", "temp_c"]
    u = pool.groupBy(*key, "correct", F.round("value", digits).alias("r")).agg(F.min(F.abs(c("value") - c("correct"))).alias("gap")).withColumn("pool", F.lit(0))
    factors = F.posexplode(F.array(*[F.lit(x) for x in (0.80, 1.25, 0.70, 1.35, 0.60, 1.50)])).alias("i", "factor")
    f = q.select(*key, "correct", factors).select(*key, "correct", F.round(c("correct") * c("factor"), digits).alias("r"), (c("i") + 1.0).alias("gap"), F.lit(1).alias("pool"))
    f = f.join(u.select(*key, "r"), [*key, "r"], "left_anti")
    x = top_n(u.unionByName(f), key, [c("pool"), c("gap"), c("r")], n)
    return x.select(*key, c("r").alias("wrong"), "rank")


FIXTURE_SQL["f_rank_cfg"] = "SELECT * FROM (VALUES ('Cr', 10.0), ('Co', 10.0), ('Mo', 5.0), ('W', 3.0), ('Al', 4.0), ('Ti', 3.0), ('Fe', 5.0), ('Nb', 3.0)) g(component, lim)"
RANK_CFG = [("Cr", 10.0), ("Co", 10.0), ("Mo", 5.0), ("W", 3.0), ("Al", 4.0), ("Ti", 3.0), ("Fe", 5.0), ("Nb", 3.0)]


@query("filter_rank", """
    WITH x AS (SELECT g.component, p.property, p.entity, p.v FROM f_comp_long c JOIN f_rank_cfg g ON c.component = g.component AND amount > lim JOIN f_pref p USING (entity)),
     r AS (SELECT *, row_number() OVER (PARTITION BY component, property ORDER BY v DESC, entity) AS rank, count(*) OVER (PARTITION BY component, property) AS n FROM x)
    SELECT component, property, rank, entity, v FROM r WHERE rank <= 4 AND n >= 4""")
def filter_rank(t):
    """Among entities with more than x of a component, the best four per property."""
    cfg = const_table(t.spark, RANK_CFG, "component string, lim double")
    x = t.comp_long.join(F.broadcast(cfg), "component").where(c("amount") > c("lim")).select("entity", "component")
    x = x.join(preferred(t), "entity")
    keys = ["component", "property"]
    n = x.groupBy(*keys).agg(F.count("*").alias("n")).where(c("n") >= 4)
    return top_n(x, keys, [F.desc("v"), c("entity")], 4).join(n, keys).select(*keys, "rank", "entity", "v")


@query("dual_threshold", """
    WITH f AS (SELECT entity, max(v) FILTER (property = 'ys') > 400 AS a, max(v) FILTER (property = 'el') > 100 AS b FROM f_pref GROUP BY entity)
    SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a <> b) AS one, count(*) FILTER (NOT a AND NOT b) AS neither, min(entity) FILTER (a AND b) AS example FROM f WHERE a IS NOT NULL AND b IS NOT NULL""")
def dual_threshold(t):
    v = lambda p: F.max(F.when(c("property") == p, c("v")))
    f = preferred(t).groupBy("entity").agg((v("ys") > 400).alias("a"), (v("el") > 100).alias("b")).dropna()
    return f.agg(F.count_if(c("a") & c("b")).alias("both"), F.count_if(c("a") != c("b")).alias("one"), F.count_if(~c("a") & ~c("b")).alias("neither"),
                 F.min(F.when(c("a") & c("b"), c("entity"))).alias("example"))


@query("rank_at_temp", """
    SELECT property, temp_c, max(value) AS best, arg_max(entity, (value, -entity)) AS best_entity, min(value) AS worst, arg_min(entity, (value, entity)) AS worst_entity FROM f_measurement GROUP BY ALL""")
def rank_at_temp(t):
    return t.measurement_set.groupBy("property", "temp_c").agg(
        F.max("value").alias("best"), F.max_by("entity", F.struct(c("value"), -c("entity"))).alias("best_entity"),
        F.min("value").alias("worst"), F.min_by("entity", F.struct("value", "entity")).alias("worst_entity"))


@query("retention_rank", """
    SELECT property, entity, round(ht / rt, 8) AS retention, k AS rank, 'most' AS side FROM (SELECT *, row_number() OVER (PARTITION BY property ORDER BY round(ht / rt, 8) DESC, entity) AS k FROM f_ret) WHERE k <= 3
    UNION ALL SELECT property, entity, round(ht / rt, 8), k, 'least' FROM (SELECT *, row_number() OVER (PARTITION BY property ORDER BY round(ht / rt, 8), entity) AS k FROM f_ret) WHERE k <= 3""")
def retention_rank(t):
    from meltwise.plans.curation_queries import retention

    x = retention(t).select("property", "entity", rnd(c("ht") / c("rt"), 8).alias("retention"))
    side = lambda o, name: top_n(x, ["property"], [o, c("entity")], 3).withColumn("side", F.lit(name))
    return side(F.desc("retention"), "most").unionByName(side(c("retention"), "least"))


@query("trend", """
    SELECT entity, property, string_agg(temp_c || ':' || round(value, 0)::BIGINT, ' ' ORDER BY temp_c) AS line, round(arg_max(value, temp_c) / arg_min(value, temp_c), 8) AS kept
    FROM f_measurement GROUP BY ALL HAVING count(*) >= 3""")
def trend(t, least: int = 3):
    """Ordered series text and first-to-last retention for series with enough points."""
    pts = t.measurement_set.groupBy("entity", "property").agg(F.sort_array(F.collect_list(F.struct("temp_c", "value"))).alias("p")).where(F.size("p") >= least)
    line = F.array_join(F.transform("p", lambda x: F.concat(x["temp_c"].cast("string"), F.lit(":"), F.round(x["value"], 0).cast("long").cast("string"))), " ")
    return pts.select("entity", "property", line.alias("line"), rnd(F.element_at("p", -1)["value"] / F.element_at("p", 1)["value"], 8).alias("kept"))


@query("top_components", """
    SELECT entity, list(component ORDER BY round(amount, 9) DESC, component)[1:3] AS top FROM f_comp_long GROUP BY entity""")
def top_components(t, n: int = 3):
    entries = F.transform(F.map_entries("composition"), lambda e: F.struct((-F.round(e["value"], 9)).alias("a"), e["key"].alias("k")))
    return t.comp.select("entity", F.transform(F.slice(F.sort_array(entries), 1, n), lambda e: e["k"]).alias("top"))


@query("group_compare", """
    WITH g AS (SELECT entity, 'cobalt' AS grp FROM f_wide WHERE co > 5 UNION ALL SELECT entity, 'chromium' FROM f_wide WHERE cr > 5 UNION ALL SELECT entity, 'refractory' FROM f_wide WHERE mo + w > 5),
     s AS (SELECT grp, property, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS sd FROM g JOIN f_pref USING (entity) GROUP BY ALL HAVING count(*) >= 3)
    SELECT a.property, a.grp AS a, b.grp AS b, a.n AS n_a, b.n AS n_b, round(a.mean, 6) AS mean_a, round(a.sd, 6) AS sd_a, round(100 * (a.mean - b.mean) / b.mean, 5) + 0 AS higher_pct
    FROM s a JOIN s b ON a.property = b.property AND a.grp < b.grp""")
def group_compare(t):
    """Overlapping groups from a membership table; each pair of groups compared per property."""
    from meltwise.operators.common import part_of as p

    member = F.array_compact(F.array(F.when(p("Co") > 5, F.lit("cobalt")), F.when(p("Cr") > 5, F.lit("chromium")), F.when(p("Mo") + p("W") > 5, F.lit("refractory"))))
    g = t.comp.select("entity", F.explode(member).alias("grp")).join(preferred(t), "entity")
    s = g.groupBy("grp", "property").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("sd")).where(c("n") >= 3)
    a = s.select("property", c("grp").alias("a"), c("n").alias("n_a"), c("mean").alias("ma"), c("sd").alias("sa"))
    b = s.select("property", c("grp").alias("b"), c("n").alias("n_b"), c("mean").alias("mb"))
    return a.join(b, "property").where(c("a") < c("b")).select(
        "property", "a", "b", "n_a", "n_b", rnd(c("ma")).alias("mean_a"), rnd(c("sa")).alias("sd_a"), rnd(100 * (c("ma") - c("mb")) / c("mb"), 5).alias("higher_pct"))


@query("core_name", f"SELECT entity, {CORE} AS core FROM f_entity")
def core_name(t):
    return t.entity.select("entity", text.core_name(c("name")).alias("core"))


@query("fold_accents", "SELECT doc_id, translate(lower(text), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy') AS folded FROM documents")
def fold_accents(t):
    return t.documents.select("doc_id", text.fold_accents(c("text")).alias("folded"))


@query("strip_marks", "SELECT doc_id, lower(strip_accents(text)) AS folded FROM documents")
def strip_marks(t):
    return t.documents.select("doc_id", text.strip_marks(c("text")).alias("folded"))


@query("safe_local_name", r"""
    SELECT entity, CASE WHEN x = '' THEN '_empty' WHEN regexp_matches(x, '^[0-9]') THEN '_' || x ELSE x END AS local_name
    FROM (SELECT entity, regexp_replace(trim(CASE WHEN entity % 7 = 0 THEN ' ' WHEN entity % 7 = 1 THEN entity || name ELSE name END), '[^\pL\pN_.\-]', '_', 'g') AS x FROM f_entity)""")
def safe_local_name(t):
    name = F.when(c("entity") % 7 == 0, " ").when(c("entity") % 7 == 1, F.concat(c("entity").cast("string"), c("name"))).otherwise(c("name"))
    return t.entity.select("entity", text.identifier(name).alias("local_name"))


@query("property_synonym", """
    SELECT p_partkey, term, CASE """ + " ".join(f"WHEN contains(lower(term), '{k.replace(chr(39), chr(39) * 2)}') THEN '{v}'" for k, v in text.PROPERTY_TERMS) + """ ELSE lower(term) END AS property
    FROM (SELECT p_partkey, ['Tensile Strength', 'Yield point', 'E-Modulus', 'Ductility %', 'Strength class', 'Colour'][p_partkey % 6 + 1] AS term FROM part)""")
def property_synonym(t):
    terms = F.array(*[F.lit(x) for x in ("Tensile Strength", "Yield point", "E-Modulus", "Ductility %", "Strength class", "Colour")])
    x = t.part.select("p_partkey", F.element_at(terms, (c("p_partkey") % 6 + 1).cast("int")).alias("term"))
    return x.select("p_partkey", "term", text.property_of(c("term")).alias("property"))


FIXTURE_SQL["f_points"] = """
    SELECT entity, property, string_agg(printf('%.9f', CASE WHEN temp_c > 900 THEN value / 1000 ELSE value END) || CASE WHEN temp_c > 900 THEN ' GPa @ ' ELSE ' MPa @ ' END || temp_c || 'C', ', ' ORDER BY pos) AS txt
    FROM f_measurement GROUP BY ALL"""


def point_text(t):
    from meltwise.plans.validate_queries import series

    def show(x):
        gpa = x["temp_c"] > 900
        v = F.when(gpa, x["value"] / 1000).otherwise(x["value"])
        return F.concat(F.format_string("%.9f", v), F.when(gpa, " GPa @ ").otherwise(" MPa @ "), x["temp_c"].cast("string"), F.lit("C"))
    return series(t).select("entity", "property", F.array_join(F.transform("points", show), ", ").alias("txt"))


@query("format_points", "SELECT entity, property, txt FROM f_points")
def format_points(t):
    return point_text(t)


@query("parse_point_text", r"""
    SELECT entity, property, i AS pos, TRY_CAST(regexp_extract(x, '([0-9.]+)', 1) AS DOUBLE) * CASE WHEN contains(x, 'GPa') THEN 1000 ELSE 1 END AS value, TRY_CAST(regexp_extract(x, '@ ([0-9]+)C', 1) AS INTEGER) AS temp_c
    FROM (SELECT entity, property, unnest(string_split(txt, ', ')) AS x, generate_subscripts(string_split(txt, ', '), 1) AS i FROM f_points WHERE property IN ('ys', 'uts'))""")
def parse_point_text(t):
    x = point_text(t).where(c("property").isin("ys", "uts")).select("entity", "property", F.posexplode(F.split("txt", ", ")).alias("i", "x"))
    scale = F.when(F.contains("x", F.lit("GPa")), 1000).otherwise(1)
    return x.select("entity", "property", (c("i") + 1).cast("long").alias("pos"), (F.regexp_extract("x", r"([0-9.]+)", 1).try_cast("double") * scale).alias("value"),
                    F.regexp_extract("x", r"@ ([0-9]+)C", 1).try_cast("int").alias("temp_c"))


@query("slim_context", """
    SELECT entity, property, list(temp_c || '' ORDER BY pos)[1:2] AS kept FROM f_measurement WHERE temp_c BETWEEN 15 AND 30 OR abs(temp_c - 600) < 50 GROUP BY ALL""")
def slim_context(t, at: int = 600):
    """Room-temperature points and those within 50 degrees, the first two in list order."""
    from meltwise.plans.validate_queries import series

    near = F.filter("points", lambda x: x["temp_c"].between(15, 30) | (F.abs(x["temp_c"] - at) < 50))
    kept = F.transform(F.slice(near, 1, 2), lambda x: x["temp_c"].cast("string"))
    return series(t).select("entity", "property", kept.alias("kept")).where(F.size("kept") > 0)


@query("comp_summary", """
    SELECT entity, string_agg(component || ': ' || printf('%.9f', amount) || '%', ', ' ORDER BY component) AS summary FROM f_comp_long WHERE amount > 0 GROUP BY entity""")
def comp_summary(t):
    parts = F.sort_array(F.filter(F.map_entries("composition"), lambda e: e["value"] > 0))
    return t.comp.select("entity", F.array_join(F.transform(parts, lambda e: F.concat(e["key"], F.lit(": "), F.format_string("%.9f", e["value"]), F.lit("%"))), ", ").alias("summary"))


@query("entity_doc", """
    WITH c AS (SELECT entity, string_agg(component || ' ' || printf('%.9f', amount), ', ' ORDER BY round(amount, 9) DESC, component) AS comp FROM f_comp_long GROUP BY 1),
     s AS (SELECT entity, property, string_agg(printf('%.6f', value) || '@' || temp_c, ' ' ORDER BY temp_c, value) AS line FROM f_measurement GROUP BY ALL),
     p AS (SELECT entity, string_agg(property || ': ' || line, chr(10) ORDER BY property) AS props FROM s GROUP BY 1)
    SELECT entity, name || ' (' || route || ')' || chr(10) || comp || chr(10) || props AS doc FROM f_entity JOIN c USING (entity) JOIN p USING (entity)""")
def entity_doc(t):
    """Profile text: components by amount, then one line of grouped points per property."""
    entries = F.sort_array(F.transform(F.map_entries("composition"), lambda e: F.struct((-F.round(e["value"], 9)).alias("o"), e["key"].alias("k"), e["value"].alias("v"))))
    comp = F.array_join(F.transform(entries, lambda e: F.concat(e["k"], F.lit(" "), F.format_string("%.9f", e["v"]))), ", ")
    s = t.measurement_set.groupBy("entity", "property").agg(F.sort_array(F.collect_list(F.struct("temp_c", "value"))).alias("p"))
    line = F.array_join(F.transform("p", lambda x: F.concat(F.format_string("%.6f", x["value"]), F.lit("@"), x["temp_c"].cast("string"))), " ")
    p = s.groupBy("entity").agg(F.array_join(F.sort_array(F.collect_list(F.concat(c("property"), F.lit(": "), line))), "\n").alias("props"))
    x = t.entity.join(t.comp, "entity").join(p, "entity")
    return x.select("entity", F.concat(c("name"), F.lit(" ("), c("route"), F.lit(")\n"), comp, F.lit("\n"), c("props")).alias("doc"))


FIXTURE_SQL["f_choice"] = r"""
    WITH said AS (SELECT id, replace(upper(trim(response)), '*', '') AS u, regexp_extract_all(upper(trim(response)), '(?:\n[ \t]*|\*\*|\()*[\pL\pN]+\)?(?:[ \t]*\*\*)?') AS t FROM f_question),
     words AS (SELECT id, i, t[i] AS token, regexp_replace(t[i], '[^\pL\pN]', '', 'g') AS word FROM (SELECT id, t, unnest(range(1, len(t) + 1)) AS i FROM said)),
     near AS (SELECT *, word IN ('A', 'B', 'C', 'D') AS letter, coalesce(lag(word) OVER w = 'ANSWER', false) OR coalesce(lag(word, 2) OVER w = 'ANSWER', false) AS stated,
       regexp_matches(token, '\)(?:[ \t]*\*\*)?$') AND regexp_matches(token, '^\n|^\*\*|\*\*$') AS listed FROM words WINDOW w AS (PARTITION BY id ORDER BY i)),
     spoken AS (SELECT id, arg_min(word, (CASE WHEN stated THEN 0 WHEN i = 1 THEN 1 ELSE 2 END, i)) AS l FROM near WHERE letter AND (stated OR i = 1 OR listed) GROUP BY id),
     valued AS (SELECT id, arg_min(o, (p, o)) AS o FROM (SELECT id, unnest(['A', 'B', 'C', 'D']) AS o,
       unnest([instr(u, upper(x)) FOR x IN [option_a, option_b, option_c, option_d]]) AS p FROM said JOIN f_question USING (id)) WHERE p > 0 GROUP BY id)
    SELECT q.id, subtype, correct, coalesce(l, o) AS choice FROM f_question q LEFT JOIN spoken USING (id) LEFT JOIN valued USING (id)"""


def choices(t):
    opts = {k: c(f"option_{k.lower()}") for k in "ABCD"}
    return t.question.select("id", "subtype", "correct", text.extract_choice(c("response"), opts).alias("choice"))


@query("extract_choice", "SELECT id, choice FROM f_choice")
def extract_choice(t):
    return choices(t).select("id", "choice")


@query("accuracy_by", """
    SELECT CASE WHEN grouping(subtype) = 1 THEN 'ALL' ELSE subtype END AS subtype, count(*) AS total, count(*) FILTER (choice = correct) AS correct, count(*) FILTER (choice <> correct) AS incorrect,
      count(*) FILTER (choice IS NULL) AS unparseable, round(count(*) FILTER (choice = correct) / count(*), 8) AS accuracy FROM f_choice GROUP BY ROLLUP (subtype)""")
def accuracy_by(t):
    ok = F.count_if(c("choice") == c("correct"))
    return choices(t).rollup("subtype").agg(
        F.grouping("subtype").alias("g"), F.count("*").alias("total"), ok.alias("correct_n"), F.count_if(c("choice") != c("correct")).alias("incorrect"),
        F.count_if(c("choice").isNull()).alias("unparseable"), rnd(ok / F.count("*"), 8).alias("accuracy")
    ).select(F.when(c("g") == 1, "ALL").otherwise(c("subtype")).alias("subtype"), "total", c("correct_n").alias("correct"), "incorrect", "unparseable", "accuracy")


@query("parse_answer_json", r"""
    SELECT p_partkey, json_extract_string(j, '$.name') AS name, TRY_CAST(json_extract_string(j, '$.confidence') AS DOUBLE) AS confidence
    FROM (SELECT p_partkey, nullif(regexp_extract('Sure: {"name": "' || p_name || '", "confidence": ' || p_size / 50.0::DOUBLE || '} done', '\{[^}]*\}', 0), '') AS j FROM part)""")
def parse_answer_json(t):
    raw = F.concat(F.lit('Sure: {"name": "'), c("p_name"), F.lit('", "confidence": '), (c("p_size") / 50.0).cast("string"), F.lit("} done"))
    j = F.from_json(F.regexp_extract(raw, r"(\{[^}]*\})", 1), "name string, confidence double")
    return t.part.select("p_partkey", j.alias("j")).select("p_partkey", "j.name", "j.confidence")


@query("parse_training_msg", """
    SELECT entity, name, component, round(amount, 4) AS amount FROM f_comp_long JOIN f_entity USING (entity)""")
def parse_training_msg(t):
    """Entity and composition read back out of a rendered chat message."""
    x = t.comp.join(t.entity.select("entity", "name"), "entity")
    msg = x.select("entity", F.concat(F.lit("Predict for "), c("name"), F.lit(". Composition: "), F.to_json(F.transform_values("composition", lambda _, v: F.round(v, 4))), F.lit(" end")).alias("msg"))
    y = msg.select("entity", F.regexp_extract("msg", r"Predict for (.*?)\. Composition", 1).alias("name"), F.from_json(F.regexp_extract("msg", r"(\{.*\})", 1), "map<string,double>").alias("m"))
    return y.select("entity", "name", F.explode("m").alias("component", "amount"))


@query("surrogate_keys", """
    SELECT entity, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || ['8','9','a','b'][('0x' || substr(h, 17, 1))::INTEGER % 4 + 1] || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id
    FROM (SELECT entity, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('entity/' || name || '/' || entity)) AS h FROM f_entity)""")
def surrogate_keys(t):
    path = F.concat(F.lit("entity/"), c("name"), F.lit("/"), c("entity").cast("string"))
    return t.entity.select("entity", text.uuid5("6ba7b8109dad11d180b400c04fd430c8", path).alias("id"))


@query("cache_key", """
    SELECT md5(string_agg(component || '=' || printf('%.9f', amount), ',' ORDER BY component)) AS key, entity FROM f_comp_long GROUP BY entity""")
def cache_key(t):
    parts = F.transform(F.sort_array(F.map_entries("composition")), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%.9f", e["value"])))
    return t.comp.select(F.md5(F.array_join(parts, ",")).alias("key"), "entity")


@query("json_fields", """
    SELECT event_id, CAST(json_extract(coalesce(json_extract(env, '$.data'), env::JSON), '$.k') AS BIGINT) AS k
    FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '{"data": ' || props || '}' ELSE props END AS env FROM events)""")
def json_fields(t):
    """Unwrap an optional envelope key, then read the fields."""
    env = F.when(c("event_id") % 2 == 0, F.concat(F.lit('{"data": '), c("props"), F.lit("}"))).otherwise(c("props"))
    inner = F.coalesce(F.get_json_object(env, "$.data"), env)
    return t.events.select("event_id", F.from_json(inner, "k long")["k"].alias("k"))


@query("question_build", """
    WITH o AS (SELECT id, correct, unnest([option_a, option_b, option_c, option_d]) AS v, unnest(['A', 'B', 'C', 'D']) AS slot FROM f_question),
     d AS (SELECT id FROM o GROUP BY id HAVING count(DISTINCT v) = 4),
     s AS (SELECT id, v, slot = correct AS right_one, row_number() OVER (PARTITION BY id ORDER BY md5(id || '|' || v), v) AS k FROM o SEMI JOIN d USING (id))
    SELECT id, list(v ORDER BY k) AS options, max(['A', 'B', 'C', 'D'][k]) FILTER (right_one) AS answer FROM s GROUP BY id""")
def question_build(t):
    """Drop questions with equal options, then hash-shuffle the letters."""
    letters = "ABCD"
    opts = F.array(*[c(f"option_{x.lower()}") for x in letters])
    right = F.element_at(opts, F.array_position(F.array(*[F.lit(x) for x in letters]), c("correct")).cast("int"))
    q = t.question.select("id", opts.alias("o"), right.alias("right")).where(F.size(F.array_distinct("o")) == 4)
    keyed = F.sort_array(F.transform("o", lambda v: F.struct(F.md5(F.concat(c("id").cast("string"), F.lit("|"), v)).alias("h"), v.alias("v"))))
    q = q.select("id", "right", F.transform(keyed, lambda x: x["v"]).alias("options"))
    return q.select("id", "options", F.element_at(F.array(*[F.lit(x) for x in letters]), F.array_position("options", c("right")).cast("int")).alias("answer"))


@query("impact_class", """
    WITH w AS (SELECT question_id, question_id % 3 AS hop, bool_or(score >= 3) FILTER (system = 0) AS cb, bool_or(score >= 3) FILTER (system = 1) AS a, bool_or(score >= 3) FILTER (system = 2) AS b FROM f_answer WHERE criterion = 0 GROUP BY ALL)
    SELECT hop, CASE WHEN coalesce(cb, false) THEN CASE WHEN coalesce(a, false) AND coalesce(b, false) THEN 'both' ELSE 'helped' END WHEN coalesce(a, false) OR coalesce(b, false) THEN 'misled' ELSE 'none' END AS impact, count(*) AS n FROM w GROUP BY ALL""")
def impact_class(t):
    ok = lambda s: F.coalesce(F.bool_or(F.when(c("system") == s, c("score") >= 3)), F.lit(False))
    w = t.answer.where(c("criterion") == 0).groupBy("question_id").agg(ok(0).alias("cb"), ok(1).alias("a"), ok(2).alias("b"))
    impact = F.when(c("cb"), F.when(c("a") & c("b"), "both").otherwise("helped")).when(c("a") | c("b"), "misled").otherwise("none")
    return w.groupBy((c("question_id") % 3).alias("hop"), impact.alias("impact")).agg(F.count("*").alias("n"))


@query("panel_scores", """
    SELECT system, CASE WHEN grouping(criterion) = 1 THEN -1 ELSE criterion END AS criterion, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS sd, count(score) AS n FROM f_answer GROUP BY ROLLUP (system, criterion) HAVING grouping(system) = 0""")
def panel_scores(t):
    keys = [c("system"), c("criterion")]
    return t.answer.groupingSets([keys, keys[:1]], *keys).agg(
        F.grouping("criterion").alias("g"), rnd(F.avg("score")).alias("mean"), rnd(F.stddev_samp("score")).alias("sd"), F.count("score").alias("n")
    ).select("system", F.when(c("g") == 1, -1).otherwise(c("criterion")).alias("criterion"), "mean", "sd", "n")


FIXTURE_SQL["f_qavg"] = "SELECT question_id, system, coalesce(avg(score), 0) AS s FROM f_answer GROUP BY ALL"


@query("friedman", """
    WITH r AS (SELECT question_id, system, rank() OVER (PARTITION BY question_id ORDER BY s) + (count(*) OVER (PARTITION BY question_id, s) - 1) / 2.0 AS rk FROM f_qavg),
     k AS (SELECT system, sum(rk) AS t, count(*) AS n FROM r GROUP BY system),
     ties AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT question_id, s, count(*) AS c FROM f_qavg GROUP BY ALL))
    SELECT n, k, round(x, 5) AS chi2, round(exp(-x / 2), 8) AS p FROM (
      SELECT max(n) AS n, count(*) AS k, (12.0 / (max(n) * count(*) * (count(*) + 1)) * sum(t * t) - 3 * max(n) * (count(*) + 1)) / (1 - max(ties) / (max(n) * (power(count(*), 3) - count(*)))) AS x FROM k, ties)""")
def friedman(t):
    """Rank the systems inside each question, then the tie-corrected statistic and its chi-square tail (three systems: the SQL has the closed form)."""
    x = t.answer.groupBy("question_id", "system").agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("s"))
    w, tie = W.partitionBy("question_id").orderBy("s"), W.partitionBy("question_id", "s")
    r = x.select("system", "question_id", "s", (F.rank().over(w) + (F.count("*").over(tie) - 1) / 2.0).alias("rk"))
    k = r.groupBy("system").agg(F.sum("rk").alias("t"), F.count("*").alias("n"))
    ties = x.groupBy("question_id", "s").agg(F.count("*").alias("m")).agg(F.sum(c("m") * c("m") * c("m") - c("m")).alias("ties"))
    n, m = F.max("n"), F.count("*")
    raw = 12.0 / (n * m * (m + 1)) * F.sum(c("t") * c("t")) - 3 * n * (m + 1)
    x = k.crossJoin(F.broadcast(ties)).agg(n.alias("n"), m.alias("k"), (raw / (1 - F.max("ties") / (n * (m * m * m - m)))).alias("x"))
    return x.select("n", "k", rnd(c("x"), 5).alias("chi2"), rnd(statistics.chi2_tail(c("x"), c("k") - 1.0), 8).alias("p"))


@query("pairwise_signed_rank", """
    WITH p AS (SELECT a.system AS a, b.system AS b, round(a.s - b.s, 9) AS d FROM f_qavg a JOIN f_qavg b ON a.question_id = b.question_id AND a.system < b.system),
     r AS (SELECT a, b, d, rank() OVER (PARTITION BY a, b ORDER BY abs(d)) + (count(*) OVER (PARTITION BY a, b, abs(d)) - 1) / 2.0 AS rk FROM p WHERE d <> 0)
    SELECT a, b, count(*) AS n_nonzero, round(least(coalesce(sum(rk) FILTER (d > 0), 0), coalesce(sum(rk) FILTER (d < 0), 0)), 1) AS w FROM r GROUP BY a, b""")
def pairwise_signed_rank(t):
    x = t.answer.groupBy("question_id", "system").agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("s"))
    a = x.select("question_id", c("system").alias("a"), c("s").alias("sa"))
    b = x.select("question_id", c("system").alias("b"), c("s").alias("sb"))
    p = a.join(b, "question_id").where(c("a") < c("b")).withColumn("d", rnd(c("sa") - c("sb"), 9))
    return ranks.signed_rank(p, ["a", "b"], "d").select("a", "b", "n_nonzero", rnd(c("w"), 1).alias("w"))
