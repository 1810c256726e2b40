"""Correction, anchoring, calibration and design-candidate queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from meltwise import constants as K
from meltwise.functions.classify import physics_class
from meltwise.functions.thermal import strength_factor, compress_ratio
from meltwise.operators import candidates
from meltwise.operators import correct as cr
from meltwise.operators import predict
from meltwise.operators.checkpoints import cut
from meltwise.operators.common import const_table, map_total, rnd, top_n
from meltwise.operators.features import ELEMENTS, POSITION, constant_array, density_shifts, featurize
from meltwise.plans.feature_queries import conditions, model_columns
from meltwise.plans.fixture_sql import FIXTURE_SQL
from meltwise.plans.registry import query

c = F.col
ML = ("ml_ys", "ml_uts", "ml_el", "ml_em")

FIXTURE_SQL["f_work"] = """
    SELECT p.*, ml_ys, ml_uts, ml_el, ml_em FROM f_phys p JOIN f_ml USING (entity, temp_c)"""
FIXTURE_SQL["f_kg"] = """
    SELECT w.*, distance, kg_ys, kg_uts, kg_el, gp + ((w.entity % 25) - 12.3::DOUBLE) AS kg_gp,
      CASE w.entity % 3 WHEN 0 THEN 'wrought bar' WHEN 1 THEN 'cast' ELSE 'unknown' END AS kg_route
    FROM f_work w JOIN f_stratum USING (entity) JOIN (SELECT entity, temp_c, max(pred) FILTER (property = 'ys') AS kg_ys, max(pred) FILTER (property = 'uts') AS kg_uts,
      max(pred) FILTER (property = 'el') AS kg_el FROM f_pred WHERE arm = 1 AND seed = 42 GROUP BY ALL) k ON w.entity = k.entity AND w.temp_c = k.temp_c"""
FIXTURE_SQL["f_gate"] = """
    SELECT *, CASE WHEN NOT distance < CASE WHEN ok THEN 4.5 ELSE 3.0 END THEN 'distance' WHEN kg_route <> 'unknown' AND NOT ok THEN 'route'
        WHEN abs(gp - kg_gp) > 10 THEN 'fraction_class' ELSE '' END AS reject, 1 / (1 + exp((distance - 2.5) / 0.5)) AS kw
    FROM (SELECT *, contains(route, kg_route) OR contains(kg_route, route) AS ok FROM f_kg)"""


def work(t):
    """Featurised conditions with model columns and physics estimates."""
    return predict.physics_predict(conditions(t).join(model_columns(t), ["entity", "temp_c"]))


def with_neighbour(t):
    x = work(t).join(t.stratum.select("entity", "distance"), "entity")
    arm = t.pred.where((c("arm") == 1) & (c("seed") == 42)).groupBy("entity", "temp_c").pivot("property", ["ys", "uts", "el"]).agg(F.max("pred"))
    arm = arm.select("entity", "temp_c", *[c(p).alias(f"kg_{p}") for p in ("ys", "uts", "el")])
    route = F.when(c("entity") % 3 == 0, "wrought bar").when(c("entity") % 3 == 1, "cast").otherwise("unknown")
    return x.join(arm, ["entity", "temp_c"]).withColumns({"kg_gp": c("gp") + ((c("entity") % 25) - 12.3), "kg_route": route})


def correction_sql(limit, sss_cast, tight, skip):
    return f"""
    SELECT entity, temp_c, round(ml_ys, 8) AS ys, round(CASE WHEN high THEN ml_ys * lim ELSE fl END, 8) AS uts, round(CASE WHEN ml_el > cap THEN cap ELSE ml_el END, 8) AS el,
      round(CASE WHEN off THEN phys_em ELSE ml_em END, 8) AS em,
      list_filter([CASE WHEN low THEN 'UTS_FLOOR' END, CASE WHEN high THEN 'UTS_CAP' END, CASE WHEN ml_el > cap THEN 'EL_CAP' END, CASE WHEN ml_em > 0 AND {skip} THEN 'EM_SKIPPED' END,
        CASE WHEN off THEN 'EM_OVERRIDE' END], lambda x : x IS NOT NULL) AS notes
    FROM (SELECT *, ml_ys > 0 AND fl / ml_ys > lim + 1e-9 AS high FROM (SELECT *, ml_uts < ml_ys AS low, CASE WHEN ml_uts < ml_ys THEN ml_ys * 1.05::DOUBLE ELSE ml_uts END AS fl,
      CASE WHEN alloy_class = 'sss' THEN CASE WHEN route = 'wrought' THEN 2.4 ELSE {sss_cast} END WHEN route = 'wrought' THEN CASE WHEN gp > 40 THEN 1.45 ELSE 1.60 END
        ELSE 1.25 + gp / 100 * 0.2 END AS lim,
      CASE WHEN gp > 60 THEN CASE WHEN {tight} THEN 10.0 ELSE 18.0 END WHEN gp > 40 THEN CASE WHEN {tight} THEN 15.0 ELSE 25.0 END END AS cap,
      ml_em > 0 AND NOT {skip} AND abs(ml_em - phys_em) / phys_em > {limit} AS off FROM f_work))"""


def _corrections(t, profile):
    x = cr.corrections(work(t), ML, profile)
    return x.select("entity", "temp_c", rnd(c("cor_ys"), 8).alias("ys"), rnd(c("cor_uts"), 8).alias("uts"),
                    rnd(c("cor_el"), 8).alias("el"), rnd(c("cor_em"), 8).alias("em"), "notes")


@query("corrections", correction_sql(0.15, 1.7, "route = 'cast' AND alloy_class <> 'sc_ds'", "alloy_class = 'sc_ds'"))
def corrections(t):
    return _corrections(t, cr.PRODUCTION)


@query("corrections_legacy", correction_sql(0.20, 2.4, "false", "false"))
def corrections_legacy(t):
    return _corrections(t, cr.LEGACY)


@query("anchor_gate_blend", """
    SELECT entity, temp_c, reject, round(CASE WHEN reject = '' AND abs(ml_ys - kg_ys) * 100 / kg_ys > 15 THEN ml_ys * (1 - kw) + kg_ys * kw ELSE ml_ys END, 8) AS ys,
      round(CASE WHEN reject = '' AND abs(ml_uts - kg_uts) * 100 / kg_uts > 15 THEN ml_uts * (1 - kw) + kg_uts * kw ELSE ml_uts END, 8) AS uts FROM f_gate""")
def anchor_gate_blend(t):
    x = cr.anchor_blend(with_neighbour(t))
    return x.select("entity", "temp_c", "reject", rnd(c("anc_ys"), 8).alias("ys"), rnd(c("anc_uts"), 8).alias("uts"))


@query("calibration", """
    SELECT entity, temp_c, round(f_ys, 8) AS f_ys, round(ml_ys * f_ys, 9) AS ys, round(f_uts, 8) AS f_uts FROM (
      SELECT *, CASE WHEN distance < 4.5 THEN 1.0 ELSE 1 + bw * (f - 1) END AS f_ys, CASE WHEN distance < 4.5 THEN 1.0 ELSE 1 + bw * (f - 1) END AS f_uts
      FROM (SELECT *, (CASE WHEN route = 'wrought' THEN 0.90 ELSE 0.95 END) * (CASE WHEN alloy_class = 'sss' AND route = 'wrought' AND cr < 18 THEN 0.93 ELSE 1.0 END) AS f,
        CASE WHEN distance > 10 THEN 1.0 WHEN distance > 5 THEN 0.8 ELSE 0.5 END AS bw FROM f_kg))""")
def calibration(t):
    f = cr.calibration_factors()
    return with_neighbour(t).select(
        "entity", "temp_c", rnd(f["ys"], 8).alias("f_ys"), rnd(c("ml_ys") * f["ys"], 9).alias("ys"), rnd(f["uts"], 8).alias("f_uts"))


@query("interval_apply", """
    SELECT entity, temp_c, property, round(greatest(pred + lo, 0), 8) AS lower, round(CASE WHEN property = 'el' THEN least(pred + hi, 100) ELSE pred + hi END, 8) AS upper
    FROM f_seed42 JOIN (VALUES ('ys', -182.719, 190.153), ('uts', -217.685, 218.006), ('el', -19.173, 19.423), ('em', -38.125, 37.793)) o(property, lo, hi) USING (property) WHERE arm = 0""")
def interval_apply(t):
    offs = const_table(t.spark, K.INTERVAL_OFFSETS, "property string, lo double, hi double, pmin double, pmax double")
    x = t.pred.where((c("arm") == 0) & (c("seed") == 42)).join(F.broadcast(offs), "property")
    lower, upper = c("pred") + c("lo"), c("pred") + c("hi")
    return x.select("entity", "temp_c", "property", rnd(F.greatest(lower, c("pmin")), 8).alias("lower"), rnd(F.least(upper, c("pmax")), 8).alias("upper"))


FIXTURE_SQL["f_disc"] = """
    SELECT entity, temp_c, ml_ys > 0 AND abs(ml_ys - phys_ys) / greatest(ml_ys, phys_ys) * 100 > 30 OR (ml_uts > 0 AND abs(ml_uts - phys_uts) / greatest(ml_uts, phys_uts) * 100 > 30) AS hi,
      ml_ys > 0 AND abs(ml_ys - phys_ys) / greatest(ml_ys, phys_ys) * 100 > 20 AS ys20, ml_uts > 0 AND abs(ml_uts - phys_uts) / greatest(ml_uts, phys_uts) * 100 > 20 AS uts20 FROM f_work"""


@query("discrepancy", """
    SELECT entity, temp_c, CASE WHEN hi THEN 'high' WHEN ys20 OR uts20 THEN 'moderate' ELSE 'none' END AS severity,
      list_filter([CASE WHEN ys20 THEN 'ys' END, CASE WHEN uts20 THEN 'uts' END], lambda x : x IS NOT NULL) AS affected FROM f_disc""")
def discrepancy(t):
    severity, affected = cr.discrepancy()
    return work(t).select("entity", "temp_c", severity.alias("severity"), affected.alias("affected"))


@query("envelope_guard", """
    SELECT entity, temp_c, round(CASE WHEN v > 0 AND NOT v BETWEEN least(ml_ys, phys_ys) * 0.8 AND greatest(ml_ys, phys_ys) * 1.2 THEN ml_ys ELSE v END, 8) AS ys,
      v > 0 AND NOT v BETWEEN least(ml_ys, phys_ys) * 0.8 AND greatest(ml_ys, phys_ys) * 1.2 AS reverted
    FROM (SELECT *, ml_ys * (0.5 + (entity % 20) / 10.0::DOUBLE) AS v FROM f_work) WHERE ml_ys IS NOT NULL""")
def envelope_guard(t, tolerance: float = 0.2):
    x = work(t).where(c("ml_ys").isNotNull()).withColumn("v", c("ml_ys") * (0.5 + (c("entity") % 20) / 10.0))
    kept = cr.envelope(c("v"), [c("ml_ys"), c("phys_ys")], c("ml_ys"), tolerance)
    ok = c("v").between(F.least("ml_ys", "phys_ys") * (1 - tolerance), F.greatest("ml_ys", "phys_ys") * (1 + tolerance))
    return x.select("entity", "temp_c", rnd(kept, 8).alias("ys"), ((c("v") > 0) & ~ok).alias("reverted"))


@query("reconcile", """
    SELECT entity, temp_c, round(CASE WHEN corrected <> ml_ys AND abs(cur - ml_ys) / greatest(abs(ml_ys), 1) < 0.05 THEN corrected ELSE cur END, 8) AS ys,
      round(CASE WHEN alloy_class = 'gp' AND abs(ml_uts * (1 + 0.5 * (cur - ml_ys) / ml_ys) - uts_in) > 5 THEN ml_uts * (1 + 0.5 * (cur - ml_ys) / ml_ys) ELSE uts_in END, 8) AS uts,
      round(CASE WHEN alloy_class = 'gp' AND ml_el > 0 AND el_in < 0.8 * ml_el THEN 0.8 * ml_el ELSE el_in END, 8) AS el
    FROM (SELECT *, ml_ys * (1 + (entity % 5) / 50.0::DOUBLE) AS cur, ml_ys * 1.25::DOUBLE AS corrected, ml_uts * 1.3::DOUBLE AS uts_in, ml_el * (0.7 + (entity % 4) / 10.0::DOUBLE) AS el_in FROM f_work)
    WHERE ml_ys > 0 AND ml_uts > 0""")
def reconcile(t):
    """Documented but unapplied corrections, UTS damping to half the YS change, elongation floor of 80 %."""
    x = work(t).where((c("ml_ys") > 0) & (c("ml_uts") > 0)).withColumns({
        "cur": c("ml_ys") * (1 + (c("entity") % 5) / 50.0), "corrected": c("ml_ys") * 1.25,
        "uts_in": c("ml_uts") * 1.3, "el_in": c("ml_el") * (0.7 + (c("entity") % 4) / 10.0)})
    gp = c("alloy_class") == "gp"
    pending = (c("corrected") != c("ml_ys")) & (F.abs(c("cur") - c("ml_ys")) / F.greatest(F.abs("ml_ys"), F.lit(1.0)) < 0.05)
    damped = c("ml_uts") * (1 + 0.5 * (c("cur") - c("ml_ys")) / c("ml_ys"))
    floor = 0.8 * c("ml_el")
    return x.select(
        "entity", "temp_c", rnd(F.when(pending, c("corrected")).otherwise(c("cur")), 8).alias("ys"),
        rnd(F.when(gp & (F.abs(damped - c("uts_in")) > 5), damped).otherwise(c("uts_in")), 8).alias("uts"),
        rnd(F.when(gp & (c("ml_el") > 0) & (c("el_in") < floor), floor).otherwise(c("el_in")), 8).alias("el"))


def proposal_rows(t):
    t_c = c("temp_c").cast("double")
    sss = c("alloy_class") == "sss"
    x = with_neighbour(t)
    x = x.withColumns({
        "temp_factor": strength_factor(t_c, c("alloy_class"), c("gp")), "expected_ratio": c("phys_uts") / c("phys_ys")})
    return cr.proposals(x)


@query("proposals")
def proposals(t):
    """Every proposal of every row, counted by source and property, with the mean proposed value."""
    return proposal_rows(t).groupBy("source", "property", "confidence").agg(F.count("*").alias("n"), rnd(F.avg("proposed"), 4).alias("mean"))


@query("proposals_best")
def proposals_best(t):
    return cr.best_proposals(proposal_rows(t)).withColumn("proposed", rnd(c("proposed"), 3))


@query("proposal_modulus", """
    SELECT entity, temp_c, round(bw * ml_em + (1 - bw) * phys_em, 3) AS proposed, CASE WHEN alloy_class = 'sss' OR dev > 20 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence
    FROM (SELECT *, CASE WHEN alloy_class = 'sss' THEN 0.2 ELSE 0.3 END AS bw, abs(ml_em - phys_em) / phys_em * 100 AS dev FROM f_kg WHERE ml_em > 0) WHERE dev > 15""")
def proposal_modulus(t):
    return proposal_rows(t).where(c("source") == "modulus_blend").select("entity", "temp_c", rnd(c("proposed"), 3).alias("proposed"), "confidence")


@query("proposal_anchoring", """
    SELECT entity, temp_c, property, round(ml * (1 - kw) + kg * kw, 3) AS proposed, CASE WHEN distance < 1.5 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence
    FROM (SELECT entity, temp_c, reject, distance, kw, unnest(['ys', 'uts', 'el']) AS property, unnest([ml_ys, ml_uts, ml_el]) AS ml, unnest([kg_ys, kg_uts, kg_el]) AS kg FROM f_gate)
    WHERE reject = '' AND abs(ml - kg) / kg * 100 > 15""")
def proposal_anchoring(t):
    return proposal_rows(t).where(c("source") == "anchoring").select("entity", "temp_c", "property", rnd(c("proposed"), 3).alias("proposed"), "confidence")


@query("blend_sweep", """
    WITH g AS (SELECT m.m AS gm, c.c AS gc FROM (VALUES (2.0), (2.25), (2.5), (2.75), (3.0)) m(m), (VALUES (3.5), (4.5), (5.5)) c(c)),
     x AS (SELECT f.*, a.actual, g.gm, g.gc, CASE WHEN distance < CASE WHEN ok THEN g.gc ELSE 3.0 END AND NOT (kg_route <> 'unknown' AND NOT ok) AND abs(gp - kg_gp) <= 10
        AND abs(ml_ys - kg_ys) * 100 / kg_ys > 15 THEN ml_ys * (1 - 1 / (1 + exp((distance - g.gm) / 0.5))) + kg_ys / (1 + exp((distance - g.gm) / 0.5)) ELSE ml_ys END AS v
      FROM (SELECT *, contains(route, kg_route) OR contains(kg_route, route) AS ok FROM f_kg) f
      JOIN (SELECT entity, temp_c, actual FROM f_arms WHERE property = 'ys' AND actual <> 0) a USING (entity, temp_c), g)
    SELECT gm::DOUBLE AS midpoint, gc::DOUBLE AS cutoff, count(*) AS n, round(avg(abs(v - actual)), 6) AS mae,
      round(avg(abs(v - actual)) - (SELECT avg(abs(v - actual)) FROM x WHERE gm = 2.5 AND gc = 4.5), 6) + 0 AS delta FROM x GROUP BY gm, gc""")
def blend_sweep(t):
    """Replay gate and blend over 15 settings on rows harvested once, against the shipped setting."""
    grid = const_table(t.spark, [(m, k) for m in (2.0, 2.25, 2.5, 2.75, 3.0) for k in (3.5, 4.5, 5.5)], "midpoint double, cutoff double")
    truth = t.pred.where((c("arm") == 0) & (c("seed") == 42) & (c("property") == "ys") & (c("actual") != 0)).select("entity", "temp_c", "actual")
    x = with_neighbour(t).select("entity", "temp_c", "distance", "route", "kg_route", "gp", "kg_gp", *[f"ml_{p}" for p in ("ys", "uts", "el")], *[f"kg_{p}" for p in ("ys", "uts", "el")])
    x = x.join(truth, ["entity", "temp_c"]).join(F.broadcast(grid), F.lit(True))
    x = cr.anchor_blend(x, c("midpoint"), K.ANCHOR_SLOPE, c("cutoff"))
    g = x.groupBy("midpoint", "cutoff").agg(F.count("*").alias("n"), F.avg(F.abs(c("anc_ys") - c("actual"))).alias("mae"))
    base = g.where((c("midpoint") == 2.5) & (c("cutoff") == 4.5)).select(c("mae").alias("base"))
    return g.crossJoin(F.broadcast(base)).select("midpoint", "cutoff", "n", rnd(c("mae")).alias("mae"), rnd(c("mae") - c("base")).alias("delta"))


# Element bounds (wt%) of a design candidate.
BOUNDS = {
    "Ni": (40.0, 75.0), "Cr": (5.0, 25.0), "Co": (0.0, 25.0), "Mo": (0.0, 10.0), "W": (0.0, 12.0), "Al": (0.0, 7.0),
    "Ti": (0.0, 6.0), "Ta": (0.0, 12.0), "Nb": (0.0, 6.0), "Re": (0.0, 7.0), "Fe": (0.0, 20.0), "Hf": (0.0, 2.0),
    "C": (0.0, 0.3), "B": (0.0, 0.05), "Zr": (0.0, 0.3), "Ru": (0.0, 5.0), "V": (0.0, 3.0), "Mn": (0.0, 2.0),
    "Si": (0.0, 1.0), "Cu": (0.0, 3.0),
}


def balance(df):
    """Clamp parts to their bounds, let Ni balance to 100, rescale if still off, drop traces."""
    spec = lambda i: "map(" + ", ".join(f"'{e}', {b[i]}D" for e, b in BOUNDS.items()) + ")"
    clamp = f"greatest(coalesce(try_element_at({spec(0)}, k), 0D), least(coalesce(try_element_at({spec(1)}, k), 20D), v))"
    x = df.withColumn("_o", F.expr(f"transform_values(map_filter(composition, (k, v) -> k != 'Ni' AND v > 0.001D), (k, v) -> {clamp})"))
    x = x.withColumn("_s", F.expr("aggregate(map_values(_o), 0D, (a, v) -> a + v)"))
    x = x.withColumn("_ni", F.greatest(F.lit(40.0), F.least(F.lit(75.0), 100.0 - c("_s"))))
    x = x.withColumn("_scale", F.when(F.abs(c("_s") + c("_ni") - 100.0) > 0.1, 100.0 / (c("_s") + c("_ni"))).otherwise(1.0))
    whole = F.map_concat(c("_o"), F.create_map(F.lit("Ni"), c("_ni")))
    return x.withColumn("composition", F.map_filter(F.transform_values(whole, lambda _, v: v * c("_scale")), lambda _, v: v > 0.001)).drop("_o", "_s", "_ni", "_scale")


@query("balance", """
    WITH b AS (SELECT * FROM (VALUES """ + ", ".join(f"('{e}', {lo}, {hi})" for e, (lo, hi) in BOUNDS.items()) + """) b(component, lo, hi)),
     o AS (SELECT entity, component, greatest(coalesce(lo, 0), least(coalesce(hi, 20), amount))::DOUBLE AS v FROM f_comp_long LEFT JOIN b USING (component) WHERE component <> 'Ni' AND amount > 0.001),
     s AS (SELECT entity, sum(v) AS s, greatest(40.0, least(75.0, 100 - sum(v)))::DOUBLE AS ni FROM o GROUP BY entity),
     k AS (SELECT *, CASE WHEN abs(s + ni - 100) > 0.1 THEN 100 / (s + ni) ELSE 1 END AS scale FROM s)
    SELECT entity, component, round(v * scale, 6) AS amount FROM o JOIN k USING (entity) WHERE v * scale > 0.001 UNION ALL SELECT entity, 'Ni', round(ni * scale, 6) FROM k""")
def balance_query(t):
    return balance(t.comp).select("entity", F.explode("composition").alias("component", "a")).select("entity", "component", rnd(c("a")).alias("amount"))


@query("sensitivity", """
    WITH e AS (SELECT * FROM (VALUES ('Al'), ('Ti'), ('Mo'), ('W'), ('Ta'), ('Nb')) e(element)),
     d AS (SELECT entity, element, sign, greatest(0, coalesce((SELECT amount FROM f_comp_long c WHERE c.entity = x.entity AND c.component = element), 0) + sign * 0.5) AS new,
        coalesce((SELECT amount FROM f_comp_long c WHERE c.entity = x.entity AND c.component = element), 0) AS cur
      FROM (SELECT DISTINCT entity FROM f_comp_long) x, e, (VALUES (1), (-1)) s(sign)),
     r AS (SELECT d.entity, element, sign, new, sum(CASE WHEN component NOT IN (element, 'Ni') THEN amount / coalesce(rho, 8) ELSE 0 END) AS inv
      FROM d JOIN f_comp_long c ON c.entity = d.entity JOIN f_element USING (component) GROUP BY ALL),
     q AS (SELECT r.entity, r.element, r.sign, r.new, 100 / (inv + r.new / e2.rho + (55 + cur - r.new) / 8.9) AS density FROM r JOIN d ON r.entity = d.entity AND r.element = d.element AND r.sign = d.sign JOIN f_element e2 ON e2.component = r.element)
    SELECT a.entity, a.element, round((a.density - b.density) / (a.new - b.new), 6) + 0 AS slope FROM q a JOIN q b ON a.entity = b.entity AND a.element = b.element AND a.sign = 1 AND b.sign = -1""")
def sensitivity(t):
    """Central finite difference of the density per tunable element with the balance correction."""
    g = density_shifts(t.comp, ["Al", "Ti", "Mo", "W", "Ta", "Nb"], 0.5)
    return g.select("entity", "element", rnd((c("density_up") - c("density_down")) / (c("amount_up") - c("amount_down"))).alias("slope"))


@query("guard_flags", """
    SELECT entity, list_filter([CASE WHEN w0 AND al + ti + ta + 0.35::DOUBLE * nb < 2 AND al < 2 THEN 'Al to 3' END, CASE WHEN w0 AND al + ti + ta + 0.35::DOUBLE * nb < 2 AND ti < 1 THEN 'Ti to 2' END,
        CASE WHEN wr AND mo + w < 3 AND mo < 1 THEN 'Mo to 3' END, CASE WHEN wr AND mo + w < 3 AND w < 0.5 THEN 'W to 2' END,
        CASE WHEN wr AND cr >= 18 THEN 'Cr to 14' END, CASE WHEN wr AND cr < 8 THEN 'Cr to 12' END, CASE WHEN wr AND co < 15 THEN 'Co to 15' END, CASE WHEN wr AND mo > 4.5 THEN 'Mo capped' END,
        CASE WHEN wr AND w > 4 THEN 'W capped' END, CASE WHEN wr AND ta > 4 THEN 'Ta capped' END, CASE WHEN wr AND re > 2 THEN 'Re capped' END, CASE WHEN fe > 2 THEN 'Fe reduced' END], lambda x : x IS NOT NULL) AS fixes
    FROM (SELECT *, true AS w0, route = 'wrought' AS wr FROM f_class)""")
def guard_flags(t):
    """Hard rules a candidate breaks for a 900 MPa target, each with its one-step fix."""
    from meltwise.operators.common import part_of as p
    from meltwise.operators.validate import messages

    wr = c("route").isin(K.WROUGHT_ROUTES)
    idx, light = p("Al") + p("Ti") + p("Ta") + 0.35 * p("Nb"), p("Mo") + p("W") < 3
    x = t.comp.join(t.entity.select("entity", "route"), "entity")
    return x.select("entity", messages([
        ("Al to 3", (idx < 2) & (p("Al") < 2)), ("Ti to 2", (idx < 2) & (p("Ti") < 1)), ("Mo to 3", wr & light & (p("Mo") < 1)),
        ("W to 2", wr & light & (p("W") < 0.5)), ("Cr to 14", wr & (p("Cr") >= 18)), ("Cr to 12", wr & (p("Cr") < 8)), ("Co to 15", wr & (p("Co") < 15)),
        ("Mo capped", wr & (p("Mo") > 4.5)), ("W capped", wr & (p("W") > 4)), ("Ta capped", wr & (p("Ta") > 4)), ("Re capped", wr & (p("Re") > 2)),
        ("Fe reduced", p("Fe") > 2)]).alias("fixes"))


def _draw_sql(kind: str, *columns: str) -> str:
    return f"(('0x' || left(md5('{kind}:42:' || {" || ':' || ".join(columns)}), 12))::BIGINT / 281474976710656.0::DOUBLE)"


FIXTURE_SQL["f_bounds"] = "SELECT * FROM (VALUES " + ", ".join(f"('{e}', {lo}::DOUBLE, {hi}::DOUBLE)" for e, (lo, hi) in BOUNDS.items() if e != "Ni") + ") b(component, lo, hi)"
FIXTURE_SQL["f_model"] = """
    SELECT component, amount > 1.0 AS major, count(*) / (SELECT count(DISTINCT entity) FROM f_comp_long)::DOUBLE AS freq, min(amount) AS lo, max(amount) AS hi
    FROM f_comp_long WHERE component <> 'Ni' AND amount > 0 GROUP BY ALL"""
FIXTURE_SQL["f_sizes"] = """
    SELECT k, sum(m) OVER (ORDER BY k) - m AS before, sum(m) OVER (ORDER BY k) AS upto, sum(m) OVER () AS total
    FROM (SELECT k, count(*) AS m FROM (SELECT entity, count(*) FILTER (component <> 'Ni' AND amount > 1.0) AS k FROM f_comp_long GROUP BY entity) GROUP BY k)"""
FIXTURE_SQL["f_race"] = f"""
    SELECT id, component, lo, hi FROM (
      SELECT id, k, m.*, row_number() OVER (PARTITION BY id ORDER BY -ln(1 - {_draw_sql('race', 'id', 'component')}) / freq, component) AS r
      FROM (SELECT o_orderkey AS id, k FROM orders, f_sizes WHERE floor({_draw_sql('size', 'o_orderkey')} * total) >= before AND floor({_draw_sql('size', 'o_orderkey')} * total) < upto), f_model m WHERE major) WHERE r <= k"""
FIXTURE_SQL["f_drawn"] = f"""
    SELECT 'uniform' AS sampler, o_orderkey AS id, component, lo + (hi - lo) * {_draw_sql('uniform', 'o_orderkey', 'component')} AS amount FROM orders, f_bounds
    UNION ALL
    SELECT 'sparse', id, component, greatest(b.lo, least(b.hi, x.lo + (x.hi - x.lo) * {_draw_sql('amount', 'id', 'component')})) FROM (
      SELECT * FROM f_race UNION ALL
      SELECT o_orderkey, component, lo, hi FROM orders, f_model WHERE NOT major AND {_draw_sql('residual', 'o_orderkey', 'component')} < freq AND (o_orderkey, component) NOT IN (SELECT (id, component) FROM f_race)) x
    JOIN f_bounds b USING (component)"""


@query("candidate_generate", """
    WITH s AS (SELECT sampler, id, 100 - sum(amount) AS ni FROM f_drawn GROUP BY ALL HAVING 100 - sum(amount) BETWEEN %s AND %s)
    SELECT sampler, id AS entity, component, round(amount, 3) + 0 AS amount FROM f_drawn JOIN s USING (sampler, id) WHERE amount > 1e-9
    UNION ALL SELECT sampler, id, 'Ni', round(ni, 3) FROM s""" % BOUNDS["Ni"])
def candidate_generate(t):
    """One uniform and one sparsity-matched composition per order, where the balance stays within its bounds."""
    bounds = const_table(t.spark, [(e, *map(float, BOUNDS[e])) for e in BOUNDS if e != "Ni"], "component string, lo double, hi double")
    ids = t.orders.select(c("o_orderkey").alias("id"))
    comp = cut(t.comp)
    one = candidates.uniform(ids, bounds, BOUNDS["Ni"])
    two = candidates.sparse(ids, *candidates.fit(comp), bounds, BOUNDS["Ni"])
    row = lambda df, name: df.select(F.lit(name).alias("sampler"), c("id").alias("entity"), "component", rnd(c("amount"), 3).alias("amount"))
    return row(one, "uniform").unionByName(row(two, "sparse"))


@query("achievement", """
    SELECT entity, round(100 * max(v) FILTER (property = 'ys') / 300, 8) AS ys_pct, round(100 * max(v) FILTER (property = 'uts') / 400, 8) AS uts_pct,
      coalesce(string_agg(property, ', ' ORDER BY property) FILTER (v < 0.9::DOUBLE * goal), '') AS misses
    FROM (SELECT entity, property, max(value) AS v FROM f_measurement GROUP BY ALL) JOIN (VALUES ('ys', 300), ('uts', 400), ('el', 20), ('em', 150)) g(property, goal) USING (property) GROUP BY entity""")
def achievement(t):
    goals = const_table(t.spark, [("ys", 300.0), ("uts", 400.0), ("el", 20.0), ("em", 150.0)], "property string, goal double")
    x = t.measurement_set.groupBy("entity", "property").agg(F.max("value").alias("v")).join(F.broadcast(goals), "property")
    pct = lambda p, g: rnd(F.max(F.when(c("property") == p, c("v"))) * 100 / g, 8)
    return x.groupBy("entity").agg(pct("ys", 300).alias("ys_pct"), pct("uts", 400).alias("uts_pct"), F.array_join(F.sort_array(
        F.collect_list(F.when(c("v") < 0.9 * c("goal"), c("property")))), ", ").alias("misses"))


@query("drivers", """
    WITH p AS (SELECT entity, component, amount, (at_gp - at_g) / 100 * lat AS da, gp FROM f_phase WHERE component <> 'Ni' AND lat IS NOT NULL),
     x AS (SELECT p.entity, component, round(200 * da / (a_gp + a_g), 6) AS contribution FROM p JOIN (SELECT entity, a_g, a_gp FROM f_feat) f USING (entity) WHERE gp >= 1)
    SELECT entity, component, contribution, rank FROM (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY abs(contribution) DESC, component) AS rank FROM x WHERE abs(contribution) > 0.01) WHERE rank <= 3""")
def drivers(t, n: int = 3):
    """Largest per-component contributions to the mismatch."""
    f = featurize(t.comp, maps=True, least=0.0).where(c("gp") >= 1).select("entity", "a_gamma", "a_precipitate", "gamma_at", "precipitate_at", F.explode("composition").alias("component", "amount"))
    lat = const_table(t.spark, [(e, v) for e, v in K.LATTICE.items() if e in ELEMENTS and e != "Ni"], "component string, lat double")
    get = lambda m: F.coalesce(F.try_element_at(m, c("component")), F.lit(0.0))
    x = f.join(F.broadcast(lat), "component")
    da = (get("precipitate_at") - get("gamma_at")) / 100.0 * c("lat")
    x = x.select("entity", "component", rnd(200.0 * da / (c("a_gamma") + c("a_precipitate"))).alias("contribution")).where(F.abs("contribution") > 0.01)
    return top_n(x, ["entity"], [F.desc(F.abs("contribution")), c("component")], n)
