"""Projections, filters, classifiers and checks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from meltwise import constants as K
from meltwise.functions import classify
from meltwise.operators import validate as v
from meltwise.operators.common import const_table, map_total, part_of as p, rnd
from meltwise.operators.features import featurize
from meltwise.operators.metrics import sliced  # noqa: F401
from meltwise.plans.feature_queries import conditions, model_columns
from meltwise.plans.fixture_sql import FIXTURE_SQL
from meltwise.plans.registry import query

c = F.col
NUMBER = r"[-+]?\d*\.?\d+"


@query("parse_numeric", r"""
    SELECT l_orderkey, l_partkey, l_linenumber, l_shipmode AS cell, parsed FROM (SELECT l_orderkey, l_partkey, l_linenumber,
      'c' || l_quantity || CASE WHEN l_partkey % 3 = 0 THEN 'Hf' ELSE '-' || l_tax END AS l_shipmode,
      TRY_CAST(regexp_extract('c' || l_quantity || CASE WHEN l_partkey % 3 = 0 THEN 'Hf' ELSE '-' || l_tax END, '[-+]?\d*\.?\d+', 0) AS DOUBLE) AS parsed
    FROM lineitem)""")
def parse_numeric(t):
    """First signed number inside a messy cell."""
    cell = F.concat(F.lit("c"), c("l_quantity").cast("string"),
                    F.when(c("l_partkey") % 3 == 0, "Hf").otherwise(F.concat(F.lit("-"), c("l_tax").cast("string"))))
    return t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", cell.alias("cell")).withColumn(
        "parsed", F.regexp_extract("cell", f"({NUMBER})", 1).try_cast("double"))


@query("safe_cast", """
    SELECT event_id, TRY_CAST(s AS DOUBLE) AS num, CASE WHEN lower(trim(s)) IN ('true', '1', 'yes') THEN true
        WHEN s IS NULL THEN NULL ELSE false END AS flag
    FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN ' True ' WHEN 2 THEN 'n/a' END AS s FROM events)""")
def safe_cast(t):
    s = F.when(c("event_id") % 4 == 0, c("event_id").cast("string")).when(c("event_id") % 4 == 1, " True ").when(
        c("event_id") % 4 == 2, "n/a")
    return t.events.select("event_id", s.alias("s")).select(
        "event_id", c("s").try_cast("double").alias("num"),
        F.when(c("s").isNotNull(), F.lower(F.trim("s")).isin("true", "1", "yes")).alias("flag"))


def flatten_columns(schema: T.StructType, prefix: str = "", path: str = "", exclude=frozenset()) -> list:
    """Select list that flattens nested structs with underscores, skipping excluded names."""
    out = []
    for f in schema.fields:
        if f.name in exclude:
            continue
        name = f"{prefix}_{f.name}" if prefix else f.name
        full = f"{path}.{f.name}" if path else f.name
        if isinstance(f.dataType, T.StructType):
            out += flatten_columns(f.dataType, name, full, exclude)
        else:
            out.append(c(full).alias(name))
    return out


@query("flatten_struct", """
    SELECT o_orderkey AS id, o_custkey AS owner_key, c_mktsegment AS owner_market_segment, o_totalprice AS price_total
    FROM orders JOIN customer ON o_custkey = c_custkey""")
def flatten_struct(t):
    x = t.orders.join(t.customer, c("o_custkey") == c("c_custkey")).select(
        c("o_orderkey").alias("id"),
        F.struct(c("o_custkey").alias("key"), F.struct(c("c_mktsegment").alias("segment")).alias("market"),
                 c("c_name").alias("secret")).alias("owner"),
        F.struct(c("o_totalprice").alias("total")).alias("price"))
    return x.select(*flatten_columns(x.schema, exclude={"secret"}))


def series(t):
    """One array of (pos, temp_c, value) per entity and property, in list order."""
    point = F.struct("pos", "temp_c", "value")
    return t.measurement.groupBy("entity", "property").agg(F.sort_array(F.collect_list(point)).alias("points"))


@query("series_summary", """
    SELECT entity, property, count(*) AS n, string_agg(CAST(temp_c AS VARCHAR), ';' ORDER BY pos) AS temps,
      round(avg(value), 9) AS avg, min(value) AS min, max(value) AS max,
      arg_min(value, pos) FILTER (temp_c IN (20, 21, 25)) AS rt
    FROM f_measurement GROUP BY ALL""")
def series_summary(t):
    values = F.transform("points", lambda x: x["value"])
    rt = F.filter("points", lambda x: x["temp_c"].isin(20, 21, 25))
    return series(t).select(
        "entity", "property", F.size("points").cast("long").alias("n"),
        F.array_join(F.transform("points", lambda x: x["temp_c"].cast("string")), ";").alias("temps"),
        rnd(F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.size("points"), 9).alias("avg"),
        F.array_min(values).alias("min"), F.array_max(values).alias("max"), F.get(rt, F.lit(0))["value"].alias("rt"))


@query("closure_filter", """
    SELECT entity, round(sum(amount), 6) AS total, CASE WHEN sum(amount) < 90 THEN 'too low' WHEN sum(amount) > 110 THEN 'too high'
      ELSE 'ok' END AS reason FROM f_raw_long GROUP BY entity""")
def closure_filter(t):
    return t.comp_raw.select("entity", rnd(map_total()).alias("total"), v.closure_reason().alias("reason"))


@query("closure_warn", """
    SELECT entity, CASE WHEN s BETWEEN 99.5 AND 100.5 THEN 'ok' WHEN s < 90 OR s > 110 THEN 'reject' WHEN s < 95 THEN 'incomplete'
      WHEN s > 105 THEN 'excess' WHEN abs(s - 100) > 2 THEN 'off' ELSE 'close' END AS grade, n
    FROM (SELECT entity, round(sum(amount), 9) AS s, count(*) AS n FROM f_raw_long WHERE amount > 0 GROUP BY entity)""")
def closure_warn(t):
    x = t.comp_raw.select("entity", F.transform_values("composition", lambda _, a: a).alias("composition"))
    cleaned, grade = v.closure_grade()
    return x.select("entity", grade.alias("grade"), F.size(cleaned).cast("long").alias("n"))


@query("rt_complete", """
    SELECT entity, bool_or(property = 'ys') AND bool_or(property = 'uts') AS complete,
      arg_min(value, pos) FILTER (property = 'ys') AS ys, arg_min(value, pos) FILTER (property = 'uts') AS uts
    FROM f_measurement WHERE temp_c BETWEEN 15 AND 30 GROUP BY entity""")
def rt_complete(t):
    x = t.measurement.where(c("temp_c").between(15, 30))
    first = lambda n: F.min_by(F.when(c("property") == n, c("value")), F.when(c("property") == n, c("pos")))
    return x.groupBy("entity").agg(first("ys").alias("ys"), first("uts").alias("uts")).select(
        "entity", (c("ys").isNotNull() & c("uts").isNotNull()).alias("complete"), "ys", "uts")


@query("classify_curation", """
    SELECT entity, label, reason, strengthening, precipitate FROM (SELECT entity, CASE WHEN ni < 40 THEN 'standard' WHEN ni > 95 THEN 'pure_nickel'
        WHEN cu > 25 THEN 'nickel_copper' WHEN fe > 20 AND ni < 55 THEN 'iron_nickel'
        WHEN nb >= 3 AND al + ti < 3 AND nb / (al + ti + 0.01) >= 1 THEN 'in718_type' WHEN al + ti >= 2 THEN 'gamma_prime_strengthened'
        WHEN mo + w > 10 AND al + ti < 1.5 THEN 'solid_solution' WHEN al + ti >= 0.5 THEN 'low_gamma_prime' ELSE 'solid_solution' END AS label,
      CASE WHEN ni < 40 THEN 'low nickel' WHEN ni > 95 THEN 'pure nickel' WHEN cu > 25 THEN 'nickel-copper' WHEN fe > 20 AND ni < 55 THEN 'iron-nickel' END AS reason,
      FROM f_raw_wide) x JOIN (VALUES ('standard', 'unknown', NULL), ('pure_nickel', 'unknown', NULL), ('nickel_copper', 'unknown', NULL), ('iron_nickel', 'unknown', NULL),
       ('in718_type', 'precipitation', 'gamma_double_prime'), ('gamma_prime_strengthened', 'precipitation', 'gamma_prime'),
       ('solid_solution', 'solid_solution', NULL), ('low_gamma_prime', 'precipitation', 'gamma_prime')) l(label, strengthening, precipitate) USING (label)""")
def classify_curation(t):
    x = t.comp_raw.select("entity", classify.curation_class().alias("k"))
    return x.select("entity", "k.label", "k.reason", "k.strengthening", "k.precipitate")


@query("classify_split", """
    SELECT entity, CASE WHEN al + ti > 7 THEN 'single_crystal_type' WHEN nb >= 3 AND al + ti < 3 THEN 'gamma_double_prime'
      WHEN al + ti >= 3 THEN 'gamma_prime_high' WHEN al + ti >= 1.5 THEN 'gamma_prime_medium'
      WHEN mo + w > 10 THEN 'solid_solution' ELSE 'other' END AS class FROM f_wide""")
def classify_split(t):
    return t.comp.select("entity", classify.split_class().alias("class"))


FIXTURE_SQL["f_scope"] = """
    SELECT entity, name, route, CASE WHEN ni > 95 OR cu > 20 OR ni < 40 THEN 'other' WHEN al + ti < 2 THEN 'solid_solution'
      WHEN contains(name, '(SC)') THEN 'precip_sc_ds' ELSE 'precip_poly' END AS category,
      CASE WHEN ni > 95 THEN 'pure nickel' WHEN cu > 20 THEN 'nickel-copper' WHEN ni < 40 AND co > ni THEN 'cobalt base'
        WHEN ni < 40 THEN 'iron-nickel base' WHEN al + ti < 2 THEN 'low Al+Ti' WHEN al + ti >= 6 THEN 'high' ELSE 'standard' END AS reason, al
    FROM f_wide JOIN f_entity USING (entity)"""


@query("classify_scope", "SELECT entity, name, category, reason FROM f_scope")
def classify_scope(t):
    x = t.comp.join(t.entity, "entity").select("entity", "name", classify.scope_class(c("name")).alias("k"))
    return x.select("entity", "name", "k.category", "k.reason")


@query("classify_physics", "SELECT entity, route, alloy_class FROM f_class")
def classify_physics(t):
    return t.comp.join(t.entity, "entity").select("entity", "route", classify.physics_class(c("route")).alias("alloy_class"))


def feature_ranges(spark):
    return const_table(spark, K.FEATURE_RANGES, "feature string, lo double, hi double")


FIXTURE_SQL["f_violation"] = """
    SELECT entity, feature, value, lo, hi FROM (UNPIVOT (SELECT entity, density, gp, md_avg, mismatch FROM f_feat)
      ON density, gp, md_avg, mismatch INTO NAME feature VALUE value)
    JOIN (VALUES ('density', 7.0, 10.0), ('gp', 0.0, 85.0), ('md_avg', 0.70, 1.05), ('mismatch', -2.0, 2.0)) r(feature, lo, hi) USING (feature)
    WHERE value < lo OR value > hi"""


@query("range_check", "SELECT entity, feature, round(value, 6) + 0 AS value, lo::DOUBLE AS lo, hi::DOUBLE AS hi FROM f_violation")
def range_check(t):
    x = v.range_violations(t.features, feature_ranges(t.spark))
    return x.select("entity", "feature", rnd(c("value")).alias("value"), "lo", "hi")


FIXTURE_SQL["f_sweep"] = """
    WITH b AS (SELECT * FROM (VALUES ('ys', 50, 2000), ('uts', 50, 2500), ('el', 0, 80), ('em', 50, 350)) b(property, lo, hi))
    SELECT entity, temp_c, property, value, CASE WHEN value < 0 THEN 'negative' WHEN value = 0 AND property <> 'el' THEN 'zero' ELSE 'out_of_bounds' END AS "check"
      FROM f_measurement JOIN b USING (property) WHERE value < 0 OR (value = 0 AND property <> 'el') OR value < lo OR value > hi
    UNION ALL SELECT entity, temp_c, property, value, CASE WHEN value > 200 THEN 'elongation_impossible' ELSE 'elongation_impossible_cold' END
      FROM f_measurement WHERE property = 'el' AND (value > 200 OR (temp_c < 600 AND value > 100))
    UNION ALL SELECT a.entity, a.temp_c, 'ys', a.value, 'ys_above_uts' FROM f_measurement a JOIN f_measurement b ON a.entity = b.entity
      AND a.temp_c = b.temp_c AND a.property = 'ys' AND b.property = 'uts' WHERE a.value > b.value * 1.02::DOUBLE
    UNION ALL SELECT entity, NULL, NULL, sum(amount), 'composition_sum' FROM f_raw_long GROUP BY entity HAVING round(sum(amount), 9) NOT BETWEEN 95 AND 105"""


@query("sanity_sweep", """
    SELECT "check", CASE WHEN "check" IN ('out_of_bounds', 'composition_sum') THEN 'review' ELSE 'impossible' END AS verdict,
      count(*) AS n, count(DISTINCT entity) AS entities FROM f_sweep GROUP BY ALL""")
def sanity_sweep(t):
    raw = t.comp_raw
    x = v.sweep(t.measurement_set, raw)
    verdict = F.when(c("check").isin(*v.IMPOSSIBLE), "impossible").otherwise("review")
    return x.groupBy("check", verdict.alias("verdict")).agg(
        F.count("*").alias("n"), F.count_distinct("entity").alias("entities"))


FIXTURE_SQL["f_clean"] = """
    SELECT entity, temp_c, value, action, CASE WHEN action = 'cleared' THEN false WHEN action = 'ok' THEN true ELSE value >= 100 END AS keep
    FROM (SELECT *, CASE WHEN max(value) OVER e < 120 THEN 'cleared'
      WHEN max(value) OVER e >= 150 AND min(value) OVER e < 100 THEN 'mixed'
      WHEN min(CASE WHEN temp_c <= 30 THEN value END) OVER e < 120 AND max(CASE WHEN temp_c <= 30 THEN value END) OVER e >= 150 THEN 'mixed_rt'
      ELSE 'ok' END AS action FROM f_measurement WHERE property = 'em' WINDOW e AS (PARTITION BY entity))"""


@query("series_clean", "SELECT entity, temp_c, value, action FROM f_clean WHERE keep")
def series_clean(t):
    return v.clean_series(t.measurement_set).where("keep").select("entity", "temp_c", "value", "action")


@query("series_flags", "SELECT action, count(*) AS points, count(*) FILTER (NOT keep) AS removed, count(DISTINCT entity) AS series FROM f_clean GROUP BY 1")
def series_flags(t):
    return v.clean_series(t.measurement_set).groupBy("action").agg(
        F.count("*").alias("points"), F.count_if(~c("keep")).alias("removed"), F.count_distinct("entity").alias("series"))


def property_rows(t):
    """Model columns as a property set with features and density beside them."""
    ml = model_columns(t).select("entity", "temp_c", *[c(f"ml_{x}").alias(x) for x in K.PROPERTIES])
    return conditions(t).join(ml, ["entity", "temp_c"])


def zero(name):
    return F.coalesce(c(name), F.lit(0.0))


@query("bounds_errors", """
    SELECT entity, temp_c, list_filter([CASE WHEN ys < 0 THEN 'ys negative' END, CASE WHEN uts < 0 THEN 'uts negative' END,
      CASE WHEN ys > uts AND uts > 0 THEN 'ys above uts' END, CASE WHEN ys > 2000 THEN 'ys above limit' END, CASE WHEN uts > 2500 THEN 'uts above limit' END,
      CASE WHEN el < 0 THEN 'el negative' END, CASE WHEN el > 100 THEN 'el above 100' END, CASE WHEN em > 0 AND (em < 90 OR em > 300) THEN 'em impossible' END,
      CASE WHEN em BETWEEN 90 AND 300 AND (em < 100 OR em > 250) THEN 'em unusual' END,
      CASE WHEN density > 0 AND (density < 7 OR density > 10) THEN 'density out of range' END, CASE WHEN gp > 75 THEN 'gp above limit' END], lambda x : x IS NOT NULL) AS errors
    FROM (SELECT entity, temp_c, coalesce(ml_ys, 0) AS ys, coalesce(ml_uts, 0) AS uts, coalesce(ml_el, 0) AS el, coalesce(ml_em, 0) AS em, density, gp
      FROM f_cond JOIN f_ml USING (entity, temp_c))""")
def bounds_errors(t):
    return property_rows(t).select(
        "entity", "temp_c", v.bounds_errors(zero("ys"), zero("uts"), zero("el"), zero("em"), c("density"), c("gp")).alias("errors"))


FIXTURE_SQL["f_coher"] = """
    SELECT *, re + w + ta AS heavy, al + ti + ta AS frm, gpf AS sf0 FROM (
      SELECT f.*, coalesce(ml_ys, 0) AS ys, coalesce(ml_uts, 0) AS uts, coalesce(ml_el, 0) AS el, coalesce(ml_em, 0) AS em,
        1 + 0.0018 * greatest(0, t - 650) AS boost, CASE WHEN t <= 25 THEN 1.0 ELSE gpf END AS sf, vrh * em_factor AS expected,
        density + 0.5::DOUBLE AS density_in, gp * 0.5::DOUBLE AS gp_in
      FROM f_factor f JOIN f_ml USING (entity, temp_c))"""


@query("coherency_rules", """
    SELECT entity, temp_c, list_filter([CASE WHEN r1 THEN 'exceptional strength' END, CASE WHEN NOT r1 AND ys > 0 AND gp > 0 AND ys > 1200 * sf AND gp < 40 THEN 'high strength' END,
      CASE WHEN heavy > 0 AND abs(density_in - (8.2 + heavy / 100 * 5)) > 0.8 THEN 'density anomaly' END,
      CASE WHEN el > 25 * boost AND heavy > 10 THEN 'ductile with refractories' END, CASE WHEN el > 30 * boost AND re > 6 THEN 'ductile with rhenium' END,
      CASE WHEN em > 0 AND abs(em - expected) > 30 * em_factor THEN 'modulus mismatch' END,
      CASE WHEN em > 0 AND (em < greatest(90, expected - 30) OR em > expected + 30) AND frm < 10 THEN 'modulus unexplained' END,
      CASE WHEN lowr THEN 'low ratio' END, CASE WHEN ys > 0 AND uts > 0 AND NOT lowr AND uts / ys > 1 + (CASE WHEN index_wt < 2 THEN 2.5 ELSE 1.6 END - 1) * em_factor THEN 'high ratio' END,
      CASE WHEN gp_in > 0 AND frm > 0 AND abs(gp_in - gp) > 15 THEN 'fraction mismatch' END], lambda x : x IS NOT NULL) AS findings
    FROM (SELECT *, ys > 0 AND gp > 0 AND ys > 1400 * sf AND gp < 50 AS r1,
      coalesce(ys > 0 AND uts > 0 AND uts / ys < 1 + 0.05 * em_factor AND t <= 650, false) AS lowr FROM f_coher)""")
def coherency_rules(t):
    x = property_rows(t).withColumns({n: zero(n) for n in K.PROPERTIES}).withColumns(
        {"density_in": c("density") + 0.5, "gp_in": c("gp") * 0.5})
    return x.select("entity", "temp_c", v.coherency_rules().alias("findings"))


@query("penalty_score", """
    SELECT entity, names, len(names) * 5 + CASE tcp_risk WHEN 'Critical' THEN 30 WHEN 'Elevated' THEN 5 ELSE 0 END
        + CASE WHEN abs(mismatch) > 1.5 THEN 20 ELSE 0 END AS score,
      CASE WHEN len(names) * 5 + CASE tcp_risk WHEN 'Critical' THEN 30 WHEN 'Elevated' THEN 5 ELSE 0 END
        + CASE WHEN abs(mismatch) > 1.5 THEN 20 ELSE 0 END > 50 OR tcp_risk = 'Critical' THEN 'REJECT' ELSE 'PASS' END AS status
    FROM (SELECT *, list_filter([CASE WHEN gp < 5 AND sss_wt < 10 AND NOT contains(route, 'solid_solution') THEN 'Strengthening Balance' END, CASE WHEN abs(mismatch) > 0.8 THEN 'Coherency Warning' END,
      CASE WHEN tcp_risk = 'Critical' THEN 'TCP Risk - Critical' WHEN tcp_risk = 'Elevated' THEN 'TCP Risk - Elevated' WHEN tcp_risk = 'Moderate' THEN 'Phase Stability' END],
      lambda x : x IS NOT NULL) AS names FROM (SELECT f.*, CASE WHEN f.entity % 3 = 0 THEN 'solid_solution_' || e.route ELSE e.route END AS route FROM f_feat f JOIN f_entity e ON e.entity = f.entity))""")
def penalty_score(t):
    names, score = v.penalties()
    route = t.entity.select(c("entity").alias("_e"), F.when(c("entity") % 3 == 0, F.concat(F.lit("solid_solution_"), c("route"))).otherwise(c("route")).alias("route"))
    x = t.features.drop("route").join(route, c("entity") == c("_e")).select("entity", names.alias("names"), score.cast("long").alias("score"))
    critical = F.exists("names", lambda n: F.contains(n, F.lit("Critical")))
    return x.withColumn("status", F.when((c("score") > 50) | critical, "REJECT").otherwise("PASS"))


@query("quick_check", """
    SELECT entity, list_filter([CASE WHEN tcp_risk IN ('Critical', 'Elevated') THEN 'CRITICAL: phase stability' END, CASE WHEN tcp_risk = 'Moderate' THEN 'WARNING: phase stability' END,
        CASE WHEN abs(mismatch) > 0.8 THEN 'CRITICAL: mismatch' END, CASE WHEN abs(mismatch) > 0.5 AND abs(mismatch) <= 0.8 THEN 'WARNING: mismatch' END,
        CASE WHEN cr < 5 THEN 'CRITICAL: low Cr' END, CASE WHEN cr > 20 THEN 'CRITICAL: high Cr' END, CASE WHEN cr BETWEEN 18 AND 20 AND route = 'wrought' THEN 'WARNING: Cr for wrought' END,
        CASE WHEN route = 'wrought' AND gp > 50 THEN 'CRITICAL: fraction above wrought limit' END, CASE WHEN route = 'wrought' AND idx > 7 THEN 'WARNING: former index' END,
        CASE WHEN route = 'cast' AND gp > 65 THEN 'WARNING: fraction high for cast' END, CASE WHEN idx >= 2 AND idx < 3 THEN 'WARNING: low formers' END], lambda x : x IS NOT NULL) AS warnings,
      NOT (tcp_risk IN ('Critical', 'Elevated') OR abs(mismatch) > 0.8 OR cr < 5 OR cr > 20 OR (route = 'wrought' AND gp > 50)) AS valid
    FROM (SELECT f.*, route, k.cr, k.al + k.ti + k.ta + 0.35::DOUBLE * k.nb AS idx FROM f_feat f JOIN f_class k USING (entity))""")
def quick_check(t):
    x = featurize(t.comp.join(t.entity.select("entity", "route"), "entity"))
    x = x.select("entity", v.quick_warnings().alias("warnings"))
    return x.withColumn("valid", ~F.exists("warnings", lambda w: F.startswith(w, F.lit("CRITICAL"))))


FIXTURE_SQL["f_plaus"] = """
    SELECT entity, route, n_major, refractory, list_filter([CASE WHEN n_major > 8 THEN 'R1_element_count' END,
        CASE WHEN refractory > CASE WHEN route = 'wrought' THEN 16 ELSE 20 END THEN 'R2_refractory_budget' END,
        CASE WHEN cu > 0.5 OR mn > 1 OR si > 1 THEN 'R3_trace_elements' END,
        CASE WHEN al + ti + ta > CASE WHEN route = 'wrought' THEN 10 ELSE 14.5 END THEN 'R4_precipitate_formers' END], lambda x : x IS NOT NULL) AS failed
    FROM (SELECT k.*, mo + w + re + ta + nb AS refractory, n_major FROM f_class k
      JOIN (SELECT entity, count(*) FILTER (component <> 'Ni' AND amount > 1) AS n_major FROM f_comp_long GROUP BY 1) USING (entity))"""


@query("plausibility", "SELECT entity, route, failed, len(failed) = 0 AS passes, n_major, round(refractory, 6) AS refractory FROM f_plaus")
def plausibility(t):
    failed, majors, refractory = v.plausibility()
    x = t.comp.join(t.entity.select("entity", "route"), "entity")
    return x.select("entity", "route", failed.alias("failed"), (F.size(failed) == 0).alias("passes"),
                    majors.cast("long").alias("n_major"), rnd(refractory).alias("refractory"))


def design_targets(t):
    """Target rows derived from parts: one request per part with values from its price and size."""
    return t.part.select(
        c("p_partkey").alias("id"), (c("p_retailprice") * (c("p_partkey") % 4)).alias("ys"),
        (c("p_retailprice") * 1.5).alias("uts"), (c("p_size") * 1.0).alias("el"), (c("p_size") * 6.0).alias("em"),
        (4.0 + c("p_partkey") % 10).alias("density"), (c("p_partkey") % 90 * 1.0).alias("gp"),
        (c("p_partkey") % 25).alias("iterations"))


@query("design_request_check", """
    SELECT id, list_filter([CASE WHEN uts > 0 AND ys > 0 AND uts < ys THEN 'uts below ys' END, CASE WHEN ys > 0 AND ys < 100 THEN 'ys low' END, CASE WHEN ys > 3000 THEN 'ys high' END,
      CASE WHEN uts > 0 AND uts < 150 THEN 'uts low' END, CASE WHEN uts > 3500 THEN 'uts high' END, CASE WHEN el > 0 AND el < 0.1 THEN 'el low' END, CASE WHEN el > 100 THEN 'el high' END,
      CASE WHEN em > 0 AND em < 100 THEN 'em low' END, CASE WHEN em > 250 THEN 'em high' END, CASE WHEN density > 0 AND density < 5 THEN 'density low' END, CASE WHEN density > 12 THEN 'density high' END,
      CASE WHEN gp > 75 THEN 'gp high' END, CASE WHEN it < 1 THEN 'iterations low' END, CASE WHEN it > 20 THEN 'iterations high' END, CASE WHEN ys > 1500 AND el > 30 THEN 'strong and ductile' END], lambda x : x IS NOT NULL) AS errors
    FROM (SELECT p_partkey AS id, p_retailprice * (p_partkey % 4) AS ys, p_retailprice * 1.5 AS uts, p_size AS el, p_size * 6 AS em, 4 + p_partkey % 10 AS density, p_partkey % 90 AS gp, p_partkey % 25 AS it FROM part)""")
def design_request_check(t):
    return design_targets(t).select("id", v.design_request_errors().alias("errors"))


# The design target used by the success and miss reports.
TARGET = {"ys": 300.0, "uts": 400.0, "el": 10.0, "em": 100.0, "density": 8.6, "gp": 30.0}


def misses():
    """(type, severity, condition) of every way a result can miss the target."""
    tol = max(2.0, 0.2 * TARGET["gp"])
    return [
        ("tcp", "High", c("tcp_risk") == "Critical"), ("tcp", "Medium", c("tcp_risk") == "Elevated"),
        *[(f"target {n}", "Low", zero(n) < TARGET[n]) for n in K.PROPERTIES],
        ("target density", "Low", c("density") > TARGET["density"]),
        ("fraction below", "High", c("gp") < TARGET["gp"] - tol), ("fraction above", "High", c("gp") > TARGET["gp"] + tol),
    ]


FIXTURE_SQL["f_design"] = """
    SELECT c.entity, c.temp_c, tcp_risk, density, gp, coalesce(ml_ys, 0) AS ys, coalesce(ml_uts, 0) AS uts, coalesce(ml_el, 0) AS el, coalesce(ml_em, 0) AS em
    FROM f_cond c JOIN f_ml USING (entity, temp_c)"""


@query("success_predicate", """
    SELECT entity, temp_c, tcp_risk NOT IN ('Critical', 'Elevated') AND ys >= 300 AND uts >= 400 AND el >= 10 AND em >= 100
      AND density <= 8.6 AND gp BETWEEN 24 AND 36 AS success FROM f_design""")
def success_predicate(t):
    ok = F.lit(True)
    for _, _, cond in misses():
        ok = ok & ~cond
    return property_rows(t).select("entity", "temp_c", ok.alias("success"))


@query("miss_report", """
    SELECT type, severity, count(*) AS n FROM (
      SELECT 'tcp' AS type, CASE tcp_risk WHEN 'Critical' THEN 'High' ELSE 'Medium' END AS severity FROM f_design WHERE tcp_risk IN ('Critical', 'Elevated')
      UNION ALL SELECT 'target ys', 'Low' FROM f_design WHERE ys < 300 UNION ALL SELECT 'target uts', 'Low' FROM f_design WHERE uts < 400
      UNION ALL SELECT 'target el', 'Low' FROM f_design WHERE el < 10 UNION ALL SELECT 'target em', 'Low' FROM f_design WHERE em < 100
      UNION ALL SELECT 'target density', 'Low' FROM f_design WHERE density > 8.6
      UNION ALL SELECT 'fraction below', 'High' FROM f_design WHERE gp < 24 UNION ALL SELECT 'fraction above', 'High' FROM f_design WHERE gp > 36) GROUP BY ALL""")
def miss_report(t):
    issues = F.array_compact(F.array(*[
        F.when(cond, F.struct(F.lit(k).alias("type"), F.lit(s).alias("severity"))) for k, s, cond in misses()]))
    x = property_rows(t).select(F.explode(issues).alias("i"))
    return x.groupBy(c("i.type").alias("type"), c("i.severity").alias("severity")).agg(F.count("*").alias("n"))


@query("unit_fix", """
    SELECT entity, temp_c, CASE WHEN em > 500 THEN em / 1000 ELSE em END AS em, em > 500 AS fixed
    FROM (SELECT entity, temp_c, CASE WHEN entity % 5 = 0 THEN value * 1000 ELSE value END AS em FROM f_measurement WHERE property = 'em')""")
def unit_fix(t, threshold: float = 500.0):
    x = t.measurement_set.where(c("property") == "em").select(
        "entity", "temp_c", F.when(c("entity") % 5 == 0, c("value") * 1000).otherwise(c("value")).alias("em"))
    big = c("em") > threshold
    return x.select("entity", "temp_c", F.when(big, c("em") / 1000.0).otherwise(c("em")).alias("em"), big.alias("fixed"))


@query("degenerate_filter", """
    SELECT entity, temp_c FROM (SELECT entity, temp_c, max(abs(actual)) AS m FROM f_seed42 WHERE arm = 1 GROUP BY ALL) WHERE m > 0""")
def degenerate_filter(t):
    """Keep responses with at least one non-zero number among their properties."""
    x = t.pred.where((c("seed") == 42) & (c("arm") == 1)).groupBy("entity", "temp_c").pivot("property", K.PROPERTIES).agg(F.first("actual"))
    return x.where(F.greatest(*[F.abs(zero(n)) for n in K.PROPERTIES]) > 0).select("entity", "temp_c")


@query("physical_clip", """
    SELECT property, count(*) AS n, round(sum(greatest(lower, 20)), 3) AS lower_sum, round(sum(least(upper, hi)), 3) AS upper_sum,
      count(*) FILTER (greatest(lower, 20) <> lower OR least(upper, hi) <> upper) AS clipped,
      sum(CASE WHEN actual BETWEEN lower AND upper THEN 1 ELSE 0 END) - sum(CASE WHEN actual BETWEEN greatest(lower, 20) AND least(upper, hi) THEN 1 ELSE 0 END) AS coverage_change
    FROM f_interval JOIN (VALUES ('ys', 5000.0), ('uts', 5000.0), ('el', 600.0), ('em', 5000.0)) b(property, hi) USING (property) GROUP BY property""")
def physical_clip(t):
    """Intersect intervals with the declared domain and report how the coverage count changes."""
    dom = const_table(t.spark, [("ys", 20.0, 5000.0), ("uts", 20.0, 5000.0), ("el", 20.0, 600.0), ("em", 20.0, 5000.0)],
                      "property string, dlo double, dhi double")
    x = t.interval.join(F.broadcast(dom), "property").withColumns(
        {"lo": F.greatest("lower", "dlo"), "hi": F.least("upper", "dhi")})
    inside = lambda a, b: F.count_if(c("actual").between(c(a), c(b)))
    return x.groupBy("property").agg(
        F.count("*").alias("n"), rnd(F.sum("lo"), 3).alias("lower_sum"), rnd(F.sum("hi"), 3).alias("upper_sum"),
        F.count_if((c("lo") != c("lower")) | (c("hi") != c("upper"))).alias("clipped"),
        (inside("lower", "upper") - inside("lo", "hi")).alias("coverage_change"))


@query("key_normalise", """
    SELECT entity, temp_c, property AS key, value FROM f_measurement WHERE entity % 6 <> 5
    UNION ALL SELECT entity, temp_c, property, value FROM f_measurement WHERE entity % 6 = 5 AND property IN ('ys', 'uts')""")
def key_normalise(t):
    """Spelling variants to canonical names through a declared table; unknown names drop."""
    variant = F.create_map(*[F.lit(x) for k, vs in {
        "ys": "Yield_Strength", "uts": "UTS", "el": "Ductility", "em": "ElasticModulus"}.items() for x in (k, vs)])
    odd = (c("entity") % 6 == 5) & ~c("property").isin("ys", "uts")
    raw = t.measurement_set.select("entity", "temp_c", F.when(odd, "Hardness").otherwise(variant[c("property")]).alias("raw"),
                                   c("value").cast("string").alias("text"))
    keys = const_table(t.spark, list(K.PROPERTY_KEYS.items()), "raw string, key string")
    return raw.join(F.broadcast(keys), "raw").select("entity", "temp_c", "key", c("text").try_cast("double").alias("value"))


FIXTURE_SQL["f_filter"] = """
    SELECT * FROM (VALUES ('ys', 20, 300.0, '>'), ('uts', 20, 900.0, '<')) f(property, temp_c, lim, op)"""


@query("filter_multi", """
    SELECT m.entity, count(*) AS met FROM f_measurement m JOIN f_filter f ON m.property = f.property AND m.temp_c = f.temp_c
      AND ((op = '>' AND value > lim) OR (op = '<' AND value < lim)) GROUP BY m.entity HAVING count(*) = 2""")
def filter_multi(t):
    """Entities that meet every condition of a declared list (relational division)."""
    conds = [("ys", 20, 300.0, ">"), ("uts", 20, 900.0, "<")]
    table = const_table(t.spark, conds, "property string, temp_c int, lim double, op string")
    x = t.measurement_set.join(F.broadcast(table), ["property", "temp_c"])
    met = ((c("op") == ">") & (c("value") > c("lim"))) | ((c("op") == "<") & (c("value") < c("lim")))
    return x.where(met).groupBy("entity").agg(F.count("*").alias("met")).where(c("met") == len(conds))
