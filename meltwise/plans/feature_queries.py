"""Element constants, features and closed-form estimates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meltwise import constants as K
from meltwise.functions import thermal
from meltwise.functions.classify import axiom_class, axiom_tcp, physics_class, tcp_class
from meltwise.operators import features as feat
from meltwise.operators import predict
from meltwise.operators.common import const_table, rnd, rnd_even, rnd_even_sql
from meltwise.plans.registry import query

c = F.col


def element_table(spark):
    rows = [
        (e, K.ATOMIC_WEIGHT[e], K.MD.get(e), K.DENSITY.get(e), K.MODULUS.get(e), K.PARTITION.get(e),
         K.LATTICE.get(e), float(K.VALENCE[e]) if e in K.VALENCE else None)
        for e in K.ATOMIC_WEIGHT
    ]
    return const_table(
        spark, rows,
        "component string, a double, md double, rho double, modulus double, k double, lat double, vec double",
    )


@query("constants_join", """
    SELECT c.entity, c.component, a, md, coalesce(rho, 8.0) AS rho, coalesce(k, 1.0) AS k,
      coalesce(lat, 0.0) AS lat, coalesce(vec, 0.0) AS vec, round(amount / a, 8) AS moles
    FROM f_comp_long c LEFT JOIN f_element e ON c.component = e.component""")
def constants_join(t):
    joined = t.comp_long.join(F.broadcast(element_table(t.spark)), "component", "left")
    fill = lambda n, d: F.coalesce(c(n), F.lit(d)).alias(n)
    return joined.select(
        "entity", "component", "a", "md", fill("rho", 8.0), fill("k", 1.0), fill("lat", 0.0),
        fill("vec", 0.0), F.round(c("amount") / c("a"), 8).alias("moles"),
    )


@query("wt_to_at", "SELECT entity, component, round(at_pct, 6) AS at_pct FROM f_at")
def wt_to_at(t):
    """Long form: one window per entity over the exploded map."""
    x = t.comp_long.join(F.broadcast(element_table(t.spark)), "component").where(c("amount") > 0)
    share = c("amount") / c("a")
    return x.select(
        "entity", "component",
        F.round(share / F.sum(share).over(W.partitionBy("entity")) * 100, 6).alias("at_pct"),
    )


def _feature_query(name, *cols, digits=6):
    body = ", ".join(f"round({s}, {digits}) + 0 AS {n}" for n, s in cols)

    @query(name, f"SELECT entity, {body} FROM f_feat")
    def run(t):
        return t.features.select("entity", *[rnd(c(n), digits).alias(n) for n, _ in cols])

    return run


_feature_query("md_avg", ("md_avg", "md_avg"), ("md_gamma", "md_gamma"))
_feature_query("density", ("density", "density"))
_feature_query("vrh_modulus", ("vrh", "vrh"))
_feature_query("gp_fraction", ("gp", "gp"))
_feature_query("lattice_mismatch", ("a_gamma", "a_g"), ("a_precipitate", "a_gp"), ("mismatch", "mismatch"))
_feature_query("vec", ("vec_avg", "vec_avg"))
_feature_query("sss_coefficient", ("sss_coeff", "sss_coeff"))
_feature_query("precip_coeff", ("ppt", "ppt"))
_feature_query("creep_param", ("creep", "creep"))
_feature_query("oxidation_index", ("oxidation", "oxidation"))


@query("ratios_and_groups", """
    SELECT entity, round(mo + w + nb + ta + re, 6) AS sss_wt,
      round(mo + w + ta + re + nb + hf, 6) AS refractory_wt,
      round(al + ti + ta + nb, 6) AS formers_wt, round(al / (ti + 0.01), 5) AS al_ti_ratio,
      round(cr / (co + 0.01), 5) AS cr_co_ratio, round(cr / (ni + 0.01), 6) AS cr_ni_ratio,
      round(mo / (w + 0.01), 5) AS mo_w_ratio, round(al_at / (ti_at + 0.01), 5) AS al_ti_at_ratio,
      round(formers_at, 6) AS formers_at, round(al_at * ti_at, 5) AS al_ti_interaction,
      round(cr * al, 5) AS cr_al_interaction
    FROM f_wide JOIN (SELECT entity, al_at, ti_at, formers_at FROM f_feat) USING (entity)""")
def ratios_and_groups(t):
    digits = {"al_ti_ratio": 5, "cr_co_ratio": 5, "mo_w_ratio": 5, "al_ti_at_ratio": 5,
              "al_ti_interaction": 5, "cr_al_interaction": 5}
    names = ["sss_wt", "refractory_wt", "formers_wt", "al_ti_ratio", "cr_co_ratio", "cr_ni_ratio",
             "mo_w_ratio", "al_ti_at_ratio", "formers_at", "al_ti_interaction", "cr_al_interaction"]
    return t.features.select("entity", *[rnd(c(n), digits.get(n, 6)).alias(n) for n in names])


@query("partition_phases", """
    SELECT entity, component, round(at_g, 5) AS gamma_at, round(at_gp, 5) AS precipitate_at
    FROM f_phase WHERE at_g > 0.01 AND at_gp > 0.01""")
def partition_phases(t):
    f = feat.featurize(t.comp, maps=True)
    long = f.select("entity", "precipitate_at", F.explode("gamma_at").alias("component", "g"))
    other = F.try_element_at(c("precipitate_at"), c("component"))
    return long.where(other.isNotNull()).select(
        "entity", "component", rnd(c("g"), 5).alias("gamma_at"), rnd(other, 5).alias("precipitate_at")
    )


@query("featurize", """
    SELECT entity, round(gp, 6) AS gp, round(md_avg, 6) AS md_avg, round(md_gamma, 6) AS md_gamma,
      round(vec_avg, 6) AS vec_avg, round(mismatch, 6) + 0 AS mismatch, round(density, 6) AS density,
      round(vrh, 6) AS vrh, round(sss_coeff, 6) AS sss_coeff, round(ppt, 6) AS ppt,
      round(creep, 6) AS creep, round(oxidation, 6) AS oxidation, tcp_risk,
      CAST(n AS BIGINT) AS n_components
    FROM f_feat JOIN (SELECT entity, count(*) AS n FROM f_comp_long GROUP BY 1) USING (entity)""")
def featurize(t):
    names = ["gp", "md_avg", "md_gamma", "vec_avg", "mismatch", "density", "vrh", "sss_coeff", "ppt",
             "creep", "oxidation"]
    f = feat.featurize(t.comp, maps=True)
    return f.select("entity", *[rnd(c(n)).alias(n) for n in names], "tcp_risk",
                    F.size("atomic_percent").cast("long").alias("n_components"))


@query("tcp_risk", """
    SELECT tcp_risk, count(*) AS n, round(min(md_avg), 6) AS md_min, round(max(md_gamma), 6) AS mdg_max
    FROM f_feat GROUP BY 1""")
def tcp_risk(t):
    f = t.features.withColumn("tcp_risk", tcp_class(c("md_gamma"), c("md_avg")))
    return f.groupBy("tcp_risk").agg(
        F.count("*").alias("n"), rnd(F.min("md_avg")).alias("md_min"), rnd(F.max("md_gamma")).alias("mdg_max")
    )


@query("classify_axioms", """
    SELECT CASE WHEN formers_wt >= 2 THEN 'precipitate' ELSE 'solid_solution' END AS family,
      CASE WHEN md_avg >= 0.985 THEN 'Critical' WHEN md_avg >= 0.960 THEN 'Elevated'
        WHEN md_avg >= 0.940 THEN 'Moderate' ELSE 'Low' END AS risk,
      count(*) AS n, CAST(0 AS BIGINT) AS overlaps
    FROM f_feat GROUP BY 1, 2""")
def classify_axioms(t):
    """Class membership plus the disjointness check: how many rows satisfy two risk classes."""
    md = c("md_avg")
    members = sum_flags([md < 0.940, (md >= 0.940) & (md < 0.960), (md >= 0.960) & (md < 0.985), md >= 0.985])
    return (
        t.features.select(axiom_class(c("formers_wt")).alias("family"), axiom_tcp(md).alias("risk"),
                          members.alias("m"))
        .groupBy("family", "risk")
        .agg(F.count("*").alias("n"), F.count_if(c("m") != 1).alias("overlaps"))
    )


def sum_flags(flags):
    out = F.lit(0)
    for f in flags:
        out = out + F.when(f, 1).otherwise(0)
    return out


@query("temp_features", """
    SELECT entity, property, temp_c, round(t * t, 4) AS t_sq, round(t * t * t, 2) AS t_cube,
      round(ln(greatest(t + 273.15, 1.0)), 8) AS log_k, round(1.0 / greatest(t + 273.15, 1.0), 10) AS inv_k,
      round((t - 20) / 1080, 8) AS t_norm
    FROM (SELECT *, greatest(-270, least(1500, temp_c))::DOUBLE AS t FROM f_measurement)""")
def temp_features(t):
    x = thermal.temperature_features(c("temp_c"))
    digits = {"t_sq": 4, "t_cube": 2, "log_k": 8, "inv_k": 10, "t_norm": 8}
    return t.measurement_set.select(
        "entity", "property", "temp_c", *[rnd(x[n], d).alias(n) for n, d in digits.items()]
    )


@query("domain_features", """
    SELECT entity, round(coalesce(sum(at_pct) FILTER (component IN ('C', 'B', 'Hf', 'Zr')), 0), 6) AS grain_boundary_at,
      round(coalesce(sum(at_pct) FILTER (component IN ('Re', 'W', 'Mo')), 0), 6) AS ductility_reducer_at,
      round(coalesce(sum(at_pct) FILTER (component IN ('W', 'Re', 'Ta', 'Hf')), 0), 6) AS heavy_at,
      round(coalesce(sum(at_pct) FILTER (component IN ('Al', 'Ti')), 0), 6) AS light_at,
      round(max(mismatch * mismatch), 6) AS mismatch_sq, round(max(f.gp * density), 5) AS gp_modulus_contrib
    FROM f_phase p JOIN (SELECT entity, gp, mismatch, density FROM f_feat) f USING (entity) GROUP BY entity""")
def domain_features(t):
    names = ["grain_boundary_at", "ductility_reducer_at", "heavy_at", "light_at"]
    return t.features.select(
        "entity", *[rnd(c(n)).alias(n) for n in names],
        rnd(c("mismatch") * c("mismatch")).alias("mismatch_sq"),
        rnd(c("gp") * c("density"), 5).alias("gp_modulus_contrib"),
    )


def conditions(t):
    """Featurised entities with route and class, at every temperature they were measured."""
    temps = t.measurement_set.select("entity", "temp_c").distinct()
    ent = t.entity.select("entity", "route", "name")
    f = feat.featurize(t.comp.join(ent, "entity").withColumn("alloy_class", physics_class(c("route"))))
    return f.drop("composition").join(temps, "entity")


SSS_CURVE = """greatest(0.12::DOUBLE, CASE WHEN t <= 600 THEN 1 - 0.00055::DOUBLE * (t - 25)
    WHEN t <= 900 THEN (1 - 0.00055::DOUBLE * 575) * exp(-(t - 600) / 450.0::DOUBLE)
    ELSE (1 - 0.00055::DOUBLE * 575) * exp(-300 / 450.0::DOUBLE) * exp(-(t - 900) / 150.0::DOUBLE) END)"""
from meltwise.plans.fixture_sql import FIXTURE_SQL  # noqa: E402

FIXTURE_SQL["f_cond"] = """
    SELECT f.*, k.route, k.alloy_class, k.name, m.temp_c, m.temp_c::DOUBLE AS t, k.cr, k.al, k.ti, k.ta, k.nb, k.w,
      k.re, k.ru, k.c, k.al + k.ti + k.ta + 0.35::DOUBLE * k.nb AS index_wt
    FROM f_feat f JOIN f_class k USING (entity)
    JOIN (SELECT DISTINCT entity, temp_c FROM f_measurement) m USING (entity)"""
FIXTURE_SQL["f_factor"] = f"""
    SELECT *, CASE WHEN t <= 25 THEN 1.0::DOUBLE WHEN alloy_class = 'sss' THEN sssf
        WHEN alloy_class = 'sc_ds' THEN scf ELSE gpf END AS factor,
      greatest(0.5::DOUBLE, 1 - 0.00032::DOUBLE * greatest(0, t - 20)) AS em_factor
    FROM (SELECT *, greatest(
        CASE WHEN t <= knee THEN 1 - 0.0002::DOUBLE * (t - 25)
          WHEN t <= solvus THEN (1 - 0.0002::DOUBLE * (knee - 25)) * exp(-(t - knee) / 450.0::DOUBLE)
          ELSE (1 - 0.0002::DOUBLE * (knee - 25)) * exp(-(solvus - knee) / 450.0::DOUBLE) * exp(-(t - solvus) / tau2) END,
        greatest(0.3::DOUBLE, 1 - g / 100) * sssf, 0.02::DOUBLE) AS gpf,
      greatest(0.35::DOUBLE, CASE WHEN t <= 850 THEN 1 - 0.00006::DOUBLE * (t - 25)
          ELSE (1 - 0.00006::DOUBLE * 825) * exp(-(t - 850) / 250.0::DOUBLE) END) AS scf
      FROM (SELECT *, 700 + 8.0::DOUBLE * g AS solvus,
          greatest(500.0::DOUBLE, least(850.0::DOUBLE, 750 * least(1.0::DOUBLE, sqrt(g / 25)))) AS knee,
          66 * greatest(0.5::DOUBLE, least(3.0::DOUBLE, g / 25)) AS tau2, {SSS_CURVE} AS sssf
        FROM (SELECT *, greatest(2.0::DOUBLE, least(70.0::DOUBLE, gp)) AS g FROM f_cond)))"""
FIXTURE_SQL["f_phys"] = """
    SELECT *, rt * factor AS phys_ys,
      rt * factor * CASE WHEN alloy_class = 'sss' THEN
          CASE WHEN t > 500 THEN 1.3 + (sr - 1.3) * exp(-(t - 500) / 300) ELSE sr END
        WHEN t < 650 THEN gr WHEN t <= 800 THEN 1 + (gr - 1) * greatest(0.2, 1 - 0.003 * (t - 650))
        ELSE 1 + (gr - 1) * 0.55 * exp(-(t - 800) / 50) END AS phys_uts,
      CASE WHEN alloy_class = 'sss' THEN
          CASE WHEN t > 500 THEN least(65.0, se * exp(0.0019 * (t - 500))) ELSE se END
        WHEN t >= 650 THEN least(120.0, ge * (1 + 0.0018 * (t - 650))) ELSE ge END AS phys_el,
      vrh * em_factor AS phys_em, CASE WHEN alloy_class = 'sss' THEN 0 ELSE gp END AS phys_gp
    FROM (SELECT *, CASE WHEN alloy_class = 'sss' THEN sss_rt ELSE gp_rt END AS rt
      FROM (SELECT *, greatest(240.0, least(500.0, CASE WHEN route = 'cast' THEN (140 + potency_sum) * 0.68
            ELSE 160 + potency_sum END)) AS sss_rt,
        CASE WHEN route = 'wrought' THEN 170 + 12 * sss_wt + 28 * gp ELSE 120 + 12 * sss_wt + 10 * gp END
          + 100 * least(abs(mismatch), 0.5) AS gp_rt,
        (CASE WHEN route = 'cast' THEN 1.5 ELSE 2.0 END)::DOUBLE AS sr,
        CASE WHEN route = 'wrought' THEN CASE WHEN gp > 40 THEN 1.38 ELSE 1.40 END ELSE 1.15 + gp / 100 * 0.2 END AS gr,
        (CASE WHEN route = 'cast' THEN 10 ELSE 52 END)::DOUBLE AS se,
        CASE WHEN route = 'wrought' THEN greatest(10.0, 35 - 0.8 * gp) ELSE greatest(5.0, 20 - 0.8 * gp) END AS ge
      FROM f_factor))"""


@query("temp_factor", """
    SELECT entity, temp_c, alloy_class, round(factor, 8) AS factor FROM f_factor""")
def temp_factor(t):
    f = thermal.strength_factor(c("temp_c"), c("alloy_class"), c("gp"))
    return conditions(t).select("entity", "temp_c", "alloy_class", rnd(f, 8).alias("factor"))


@query("em_temp_factor", "SELECT entity, temp_c, round(em_factor, 8) AS em_factor, round(vrh * em_factor, 6) AS em FROM f_factor")
def em_temp_factor(t):
    f = thermal.modulus_factor(c("temp_c"))
    return conditions(t).select("entity", "temp_c", rnd(f, 8).alias("em_factor"), rnd(c("vrh") * f).alias("em"))


@query("ratio_compress", """
    SELECT entity, temp_c, round(CASE WHEN t < 650 THEN r WHEN t <= 800 THEN 1 + (r - 1) * greatest(0.2, 1 - 0.003 * (t - 650))
      ELSE 1 + (r - 1) * 0.55 * exp(-(t - 800) / 50) END, 8) AS ratio
    FROM (SELECT *, 1.15 + gp / 100 * 0.2 AS r FROM f_cond)""")
def ratio_compress(t):
    r = 1.15 + c("gp") / 100.0 * 0.2
    return conditions(t).select("entity", "temp_c", rnd(thermal.compress_ratio(r, c("temp_c")), 8).alias("ratio"))


@query("sss_strength", """
    SELECT DISTINCT entity, round(sss_rt, 6) AS sss_ys FROM f_phys""")
def sss_strength(t):
    x = feat.featurize(t.comp.join(t.entity.select("entity", "route"), "entity"))
    return x.select("entity", rnd(predict.sss_strength()).alias("sss_ys"))


@query("physics_predict", rnd_even_sql("""
    SELECT entity, temp_c, alloy_class, phys_ys, phys_uts, phys_el, phys_em, phys_gp FROM f_phys""", "entity, temp_c, alloy_class", ["phys_ys", "phys_uts", "phys_el", "phys_em", "phys_gp"]))
def physics_predict(t):
    return predict.physics_predict(conditions(t)).select(
        "entity", "temp_c", "alloy_class",
        *[rnd_even(c(f"phys_{p}")).alias(f"phys_{p}") for p in ("ys", "uts", "el", "em", "gp")],
    )


@query("screen_predict", rnd_even_sql("""
    SELECT entity, temp_c, ys AS scr_ys,
      ys * CASE WHEN t < 650 THEN r WHEN t <= 800 THEN 1 + (r - 1) * greatest(0.2, 1 - 0.003 * (t - 650))
        ELSE 1 + (r - 1) * 0.55 * exp(-(t - 800) / 50) END AS scr_uts,
      CASE WHEN alloy_class = 'sss' THEN 40 WHEN route = 'wrought' THEN greatest(10.0, 28 - 0.28 * gp)
        ELSE greatest(4.0, 18 - 0.25 * gp) END AS scr_el, phys_em AS scr_em
    FROM (SELECT *, rt * factor * 0.82 * CASE WHEN route = 'wrought' THEN 0.90 ELSE 0.95 END AS ys,
      CASE WHEN route = 'wrought' THEN CASE WHEN gp > 40 THEN 1.15 ELSE 1.40 END ELSE 1.10 + gp / 100 * 0.15 + 0.10 END AS r
      FROM f_phys)""", "entity, temp_c", ["scr_ys", "scr_uts", "scr_el", "scr_em"]))
def screen_predict(t):
    return predict.screen_predict(conditions(t)).select(
        "entity", "temp_c", *[rnd_even(c(f"scr_{p}")).alias(f"scr_{p}") for p in ("ys", "uts", "el", "em")]
    )


def model_columns(t):
    """Model output per (entity, temperature): arm 0, seed 42, one column per property."""
    arm = t.pred.where((c("arm") == 0) & (c("seed") == 42))
    return arm.groupBy("entity", "temp_c").pivot("property", K.PROPERTIES).agg(F.max("pred")).select(
        "entity", "temp_c", *[c(p).alias(f"ml_{p}") for p in K.PROPERTIES]
    )


FIXTURE_SQL["f_ml"] = """
    SELECT entity, temp_c, max(pred) FILTER (property = 'ys') AS ml_ys, max(pred) FILTER (property = 'uts') AS ml_uts,
      max(pred) FILTER (property = 'el') AS ml_el, max(pred) FILTER (property = 'em') AS ml_em
    FROM f_pred WHERE arm = 0 AND seed = 42 GROUP BY 1, 2"""


@query("blended_predict", rnd_even_sql("""
    SELECT entity, temp_c, ys AS bl_ys, ys * CASE WHEN t < 650 THEN r
        WHEN t <= 800 THEN 1 + (r - 1) * greatest(0.2, 1 - 0.003 * (t - 650))
        ELSE 1 + (r - 1) * 0.55 * exp(-(t - 800) / 50) END AS bl_uts,
      CASE WHEN alloy_class = 'sss' THEN ml_el ELSE 0.5 * ml_el + 0.5 * CASE WHEN route = 'wrought'
        THEN greatest(10.0, 28 - 0.28 * gp) ELSE greatest(4.0, 18 - 0.25 * gp) END END AS bl_el,
      0.3 * ml_em + 0.7 * phys_em AS bl_em
    FROM (SELECT *, greatest(1.0, least(1.8, CASE WHEN ml_ys > 0 THEN ml_uts / ml_ys
        WHEN alloy_class = 'sss' THEN 1.5 ELSE 1.4 END)) AS r,
      CASE WHEN alloy_class = 'sss' THEN 0.3 * ml_ys + 0.7 * sss_rt * factor
        ELSE 0.2 * ml_ys + 0.8 * (CASE WHEN route = 'wrought' THEN 520 + 13 * gp ELSE 400 + 10 * gp END)
          * CASE WHEN t <= 25 THEN 1.0 ELSE gpf END END AS ys
      FROM f_phys JOIN f_ml USING (entity, temp_c))""", "entity, temp_c", ["bl_ys", "bl_uts", "bl_el", "bl_em"]))
def blended_predict(t):
    x = conditions(t).join(model_columns(t), ["entity", "temp_c"])
    return predict.blended_predict(x).select(
        "entity", "temp_c", *[rnd_even(c(f"bl_{p}")).alias(f"bl_{p}") for p in ("ys", "uts", "el", "em")]
    )
