"""Scoring of prediction runs: error suites, strata, seeds, intervals and comparisons."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meltwise import constants as K
from meltwise.functions.buckets import bin_of, temperature_regime
from meltwise.functions.classify import physics_class
from meltwise.functions.statistics import t_two_sided
from meltwise.operators import metrics as m
from meltwise.operators import ranks
from meltwise.operators.checkpoints import cut
from meltwise.operators.common import const_table, first_row, rnd, top_n
from meltwise.plans.fixture_sql import FIXTURE_SQL
from meltwise.plans.registry import query

c = F.col
KEY = ["entity", "temp_c", "property"]

FIXTURE_SQL["f_seed42"] = "SELECT * FROM f_pred WHERE seed = 42"
FIXTURE_SQL["f_common"] = """
    SELECT p.* FROM f_pred p SEMI JOIN (
      SELECT entity, temp_c, property FROM f_pred GROUP BY ALL HAVING count(DISTINCT arm) = 3) k
    USING (entity, temp_c, property)"""
FIXTURE_SQL["f_arms"] = """
    SELECT entity, temp_c, property, max(actual) AS actual, max(pred) FILTER (arm = 0) AS p0,
      max(pred) FILTER (arm = 1) AS p1, max(pred) FILTER (arm = 2) AS p2
    FROM f_pred WHERE seed = 42 GROUP BY ALL"""
R2 = """CASE WHEN count(*) >= 2 AND min(actual) <> max(actual)
    THEN round(1 - sum((actual - pred) * (actual - pred)) / (var_pop(actual) * count(*)), 6) END"""


def seed42(t):
    return t.pred.where(c("seed") == 42)


def arms_wide(t):
    """One row per key, seed 42, with a prediction column per arm."""
    x = seed42(t)
    p = lambda a: F.max(F.when(c("arm") == a, c("pred"))).alias(f"p{a}")
    return x.groupBy(*KEY).agg(F.max("actual").alias("actual"), p(0), p(1), p(2))


def all_label(column):
    return F.when(F.grouping(column) == 1, "ALL").otherwise(c(column)).alias(column)


SUITE = [("r2", 6), ("mae", 6), ("rmse", 6), ("mape", 6), ("within_10", 6), ("within_15", 6), ("within_20", 6),
         ("within_25", 6), ("bias", 6), ("std_error", 6), ("mean_actual", 6), ("mean_pred", 6)]
SUITE_SQL = f"""count(*) AS n, {R2} AS r2, round(avg(abs(pred - actual)), 6) AS mae,
  round(sqrt(avg((pred - actual) * (pred - actual))), 6) AS rmse,
  round(avg(abs((pred - actual) / actual) * 100), 6) AS mape,
  """ + ", ".join(f"round(count(*) FILTER (abs((pred - actual) / actual) * 100.0::DOUBLE <= {k}) * 100.0::DOUBLE / count(*), 6) AS within_{k}"
                  for k in (10, 15, 20, 25)) + """,
  round(avg(pred - actual), 6) + 0 AS bias, round(stddev_pop(pred - actual), 6) AS std_error,
  round(avg(actual), 6) AS mean_actual, round(avg(pred), 6) AS mean_pred"""


@query("error_suite", f"""
    SELECT arm, property, {SUITE_SQL} FROM f_pred WHERE actual <> 0 GROUP BY arm, property HAVING count(*) >= 2""")
def error_suite(t):
    s = m.error_suite(t.pred, ["arm", "property"])
    return s.select("arm", "property", "n", *[rnd(c(n), d).alias(n) for n, d in SUITE])


@query("error_suite_slices", f"""
    SELECT property, CASE WHEN grouping(conf) = 1 THEN 'ALL' ELSE conf END AS conf,
      CASE WHEN grouping(route) = 1 THEN 'ALL' ELSE route END AS route,
      count(*) AS n, {R2} AS r2, round(avg(abs(pred - actual)), 6) AS mae,
      round(avg(abs((pred - actual) / actual) * 100), 6) AS mape
    FROM f_pred JOIN f_entity USING (entity) WHERE actual <> 0
    GROUP BY GROUPING SETS ((property), (property, conf), (property, route)) HAVING count(*) >= 2""")
def error_suite_slices(t):
    x = t.pred.where(m.scorable()).join(t.entity.select("entity", "conf", "route"), "entity")
    keys = [c("property"), c("conf"), c("route")]
    s = x.groupingSets([[keys[0]], keys[:2], [keys[0], keys[2]]], *keys).agg(
        F.grouping("conf").alias("gc"), F.grouping("route").alias("gr"),
        F.count("*").alias("n"), rnd(m.r2()).alias("r2"), rnd(m.mae()).alias("mae"),
        rnd(F.avg(F.abs((c("pred") - c("actual")) / c("actual")) * 100)).alias("mape"),
    )
    return s.where(c("n") >= 2).select(
        "property", F.when(c("gc") == 1, "ALL").otherwise(c("conf")).alias("conf"),
        F.when(c("gr") == 1, "ALL").otherwise(c("route")).alias("route"), "n", "r2", "mae", "mape",
    )


@query("metric_mae_r2", f"""
    SELECT arm, seed, property, count(*) AS n, round(avg(abs(pred - actual)), 6) AS mae, {R2} AS r2
    FROM f_pred WHERE actual <> 0 GROUP BY ALL""")
def metric_mae_r2(t):
    return t.pred.where(m.scorable()).groupBy("arm", "seed", "property").agg(
        F.count("*").alias("n"), rnd(m.mae()).alias("mae"), rnd(m.r2()).alias("r2"))


@query("common_rows", """
    SELECT arm, seed, property, count(*) AS n, count(DISTINCT entity) AS entities,
      round(sum(pred), 3) AS pred_sum FROM f_common GROUP BY ALL""")
def common_rows(t):
    x = m.common_rows(t.pred, "arm", KEY).groupBy("arm", "seed", "property", "entity").agg(F.count("*").alias("n"), F.sum("pred").alias("s"))
    return x.groupBy("arm", "seed", "property").agg(
        F.sum("n").alias("n"), F.count("*").alias("entities"), rnd(F.sum("s"), 3).alias("pred_sum"))


@query("headline_score", f"""
    SELECT arm, property, count(*) AS n, round(avg(abs(pred - actual)), 6) AS mae, {R2} AS r2
    FROM f_common WHERE seed = 42 GROUP BY ALL""")
def headline_score(t):
    x = m.common_rows(t.pred, "arm", KEY).where(c("seed") == 42).where(m.scorable(nonzero=False))
    return x.groupBy("arm", "property").agg(
        F.count("*").alias("n"), rnd(m.mae()).alias("mae"), rnd(m.r2()).alias("r2"))


@query("stratified", f"""
    SELECT arm, property, CASE WHEN grouping(stratum) = 1 THEN 'ALL' ELSE stratum END AS stratum,
      count(*) AS n, round(avg(abs(pred - actual)), 6) AS mae, {R2} AS r2
    FROM f_common JOIN f_stratum USING (entity) WHERE actual <> 0
    GROUP BY GROUPING SETS ((arm, property, stratum), (arm, property))""")
def stratified(t):
    x = m.common_rows(t.pred, "arm", KEY).where(m.scorable())
    x = x.join(t.stratum.select("entity", "stratum").hint("shuffle_hash"), "entity")
    keys = [c("arm"), c("property"), c("stratum")]
    return x.groupingSets([keys, keys[:2]], *keys).agg(
        F.grouping("stratum").alias("g"), F.count("*").alias("n"), rnd(m.mae()).alias("mae"),
        rnd(m.r2()).alias("r2"),
    ).select("arm", "property", F.when(c("g") == 1, "ALL").otherwise(c("stratum")).alias("stratum"),
             "n", "mae", "r2")


@query("seed_mean_sd", f"""
    SELECT arm, property, round(avg(mae), 6) AS mae, round(stddev_samp(mae), 6) AS mae_sd,
      round(avg(r2), 6) AS r2, max(n) AS n, count(*) AS n_seeds
    FROM (SELECT arm, property, seed, avg(abs(pred - actual)) AS mae, count(*) AS n,
      1 - sum((actual - pred) * (actual - pred)) / (var_pop(actual) * count(*)) AS r2
      FROM f_pred WHERE actual <> 0 GROUP BY ALL) GROUP BY arm, property""")
def seed_mean_sd(t):
    s = m.two_level_seed(t.pred, ["arm", "property"])
    return s.select("arm", "property", *[rnd(c(n)).alias(n) for n in ("mae", "mae_sd", "r2")], "n", "n_seeds")


@query("seed_ensemble", """
    SELECT arm, entity, temp_c, property, max(actual) AS actual, round(avg(pred), 8) AS pred,
      count(pred) AS n_seeds FROM f_pred GROUP BY arm, entity, temp_c, property""")
def seed_ensemble(t):
    return m.seed_ensemble(t.pred, ["arm", *KEY]).withColumn("pred", rnd(c("pred"), 8))


@query("campaign_compare", """
    WITH s AS (SELECT arm, seed, property, avg(abs(pred - actual)) AS mae FROM f_common WHERE actual <> 0
        GROUP BY ALL),
      a AS (SELECT arm, property, avg(mae) AS m, stddev_samp(mae) AS sd, min(mae) AS lo, max(mae) AS hi,
        count(*) AS n FROM s GROUP BY ALL)
    SELECT x.property, round(x.m, 6) AS mean_a, round(y.m, 6) AS mean_b, round(x.sd, 6) AS sd_a,
      round(y.sd, 6) AS sd_b, round(y.m - x.m, 6) + 0 AS delta,
      round(sqrt(x.sd * x.sd / x.n + y.sd * y.sd / y.n), 6) AS se,
      (x.hi < y.lo OR y.hi < x.lo) AS disjoint,
      round((y.m - x.m) / sqrt(x.sd * x.sd / x.n + y.sd * y.sd / y.n), 4) + 0 AS welch_t
    FROM a x JOIN a y ON x.property = y.property AND x.arm = 0 AND y.arm = 2""")
def campaign_compare(t):
    """Arms 0 and 2 over the seeds: means, spread, disjoint ranges and Welch's t."""
    s = m.common_rows(t.pred, "arm", KEY).where(m.scorable() & c("arm").isin(0, 2))
    s = s.groupBy("arm", "seed", "property").agg(m.mae().alias("mae"))
    pick = lambda f, a: f(F.when(c("arm") == a, c("mae")))
    stats = {}
    for label, a in (("a", 0), ("b", 2)):
        stats |= {f"mean_{label}": pick(F.avg, a), f"sd_{label}": pick(F.stddev_samp, a),
                  f"lo_{label}": pick(F.min, a), f"hi_{label}": pick(F.max, a), f"n_{label}": pick(F.count, a)}
    g = s.groupBy("property").agg(*[v.alias(k) for k, v in stats.items()])
    se = F.sqrt(c("sd_a") * c("sd_a") / c("n_a") + c("sd_b") * c("sd_b") / c("n_b"))
    delta = c("mean_b") - c("mean_a")
    return g.select(
        "property", *[rnd(c(n)).alias(n) for n in ("mean_a", "mean_b", "sd_a", "sd_b")],
        rnd(delta).alias("delta"), rnd(se).alias("se"),
        ((c("hi_a") < c("lo_b")) | (c("hi_b") < c("lo_a"))).alias("disjoint"), rnd(delta / se, 4).alias("welch_t"),
    )


@query("welch", """
    WITH g AS (SELECT property, count(*) FILTER (arm = 0) AS n_a, count(*) FILTER (arm = 1) AS n_b,
      avg(abs(pred - actual)) FILTER (arm = 0) AS m_a, avg(abs(pred - actual)) FILTER (arm = 1) AS m_b,
      var_samp(abs(pred - actual)) FILTER (arm = 0) AS v_a, var_samp(abs(pred - actual)) FILTER (arm = 1) AS v_b
      FROM f_pred WHERE actual <> 0 GROUP BY property),
     w AS (SELECT property, n_a, n_b, (m_b - m_a) / sqrt(v_a / n_a + v_b / n_b) AS t, pow(v_a / n_a + v_b / n_b, 2) / (pow(v_a / n_a, 2) / (n_a - 1) + pow(v_b / n_b, 2) / (n_b - 1)) AS df FROM g),
     s AS (SELECT property, n_a, n_b, t, df, sum(CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(lgamma((df + 1) / 2) - lgamma(df / 2) - (df + 1) / 2 * ln(1 + pow(abs(t) * i / 4000, 2) / df)) / sqrt(df * pi())) * abs(t) / 12000 AS half
      FROM w, range(4001) r(i) GROUP BY property, n_a, n_b, t, df)
    SELECT property, n_a, n_b, round(t, 4) + 0 AS t, round(df, 3) AS df, round(greatest(0, 1 - 2 * half), 6) + 0 AS p FROM s""")
def welch(t):
    e = F.abs(c("pred") - c("actual"))
    of = lambda f, a: f(F.when(c("arm") == a, e))
    g = t.pred.where(m.scorable()).groupBy("property").agg(
        *[of(f, a).alias(f"{n}_{l}") for l, a in (("a", 0), ("b", 1))
          for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    va, vb = c("v_a") / c("n_a"), c("v_b") / c("n_b")
    x = g.select(
        "property", "n_a", "n_b", ((c("m_b") - c("m_a")) / F.sqrt(va + vb)).alias("t"),
        (F.pow(va + vb, 2) / (va * va / (c("n_a") - 1) + vb * vb / (c("n_b") - 1))).alias("df"))
    x = cut(x.withColumn("p", t_two_sided(c("t"), c("df"))))
    return x.select("property", "n_a", "n_b", rnd(c("t"), 4).alias("t"), rnd(c("df"), 3).alias("df"), rnd(c("p")).alias("p"))


@query("median_ape", """
    SELECT arm, property, round(quantile_cont(abs((pred - actual) / actual), 0.5) * 100, 4) AS median_ape,
      round(avg((pred - actual) / actual) * 100, 6) + 0 AS bias_pct
    FROM f_pred WHERE actual <> 0 GROUP BY ALL""")
def median_ape(t):
    x = t.pred.where(m.scorable()).withColumn("rel", (c("pred") - c("actual")) / c("actual"))
    q = m.exact_quantiles(x.withColumn("ape", F.abs("rel")), ["arm", "property"], "ape", [0.5])
    b = x.groupBy("arm", "property").agg(rnd(F.avg("rel") * 100).alias("bias_pct"))
    return q.select("arm", "property", rnd(c("q500") * 100, 4).alias("median_ape")).join(b, ["arm", "property"])


@query("win_rate", """
    SELECT property, count(*) AS n, round(avg(CASE WHEN abs(p0 - actual) < abs(p2 - actual) THEN 1
      WHEN abs(p0 - actual) = abs(p2 - actual) THEN 0.5 ELSE 0 END) * 100, 6) AS win_rate
    FROM f_arms WHERE actual <> 0 AND p0 IS NOT NULL AND p2 IS NOT NULL GROUP BY property""")
def win_rate(t):
    x = m.paired_errors(seed42(t), KEY, 0, 2)
    score = F.when(c("err_a") < c("err_b"), 1.0).when(c("err_a") == c("err_b"), 0.5).otherwise(0.0)
    return x.groupBy("property").agg(F.count("*").alias("n"), rnd(F.avg(score) * 100).alias("win_rate"))


@query("paired_errors", """
    SELECT entity, temp_c, property, actual, round(abs(p0 - actual), 8) AS err_a, round(abs(p2 - actual), 8) AS err_b
    FROM f_arms WHERE actual <> 0 AND p0 IS NOT NULL AND p2 IS NOT NULL""")
def paired_errors(t):
    x = m.paired_errors(seed42(t), KEY, 0, 2)
    return x.select(*KEY, "actual", rnd(c("err_a"), 8).alias("err_a"), rnd(c("err_b"), 8).alias("err_b"))


@query("align_arms", """
    SELECT a.*, stratum, (SELECT count(*) FROM f_arms x WHERE x.entity NOT IN (SELECT entity FROM f_stratum)) AS unmatched
    FROM (SELECT entity, temp_c, property, actual, round(p0, 8) AS p0, round(p1, 8) AS p1, round(p2, 8) AS p2 FROM f_arms) a
    LEFT JOIN f_stratum s USING (entity)""")
def align_arms(t):
    """Base rows with every arm beside them; ``unmatched`` counts rows without a stratum."""
    x = arms_wide(t)
    s = t.stratum.select("entity", "stratum")
    missing = x.join(s, "entity", "left_anti").agg(F.count("*").alias("unmatched"))
    return x.join(s, "entity", "left").crossJoin(F.broadcast(missing)).select(
        *KEY, "actual", *[rnd(c(p), 8).alias(p) for p in ("p0", "p1", "p2")], "stratum", "unmatched")


FIXTURE_SQL["f_armscore"] = """
    SELECT arm, property, avg(abs(pred - actual)) AS mae, avg(pred - actual) AS bias FROM f_common
    WHERE actual <> 0 GROUP BY ALL"""


@query("best_per_property", """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY property ORDER BY round(mae, 6), arm) AS k FROM f_armscore),
     b AS (SELECT property, arm, row_number() OVER (PARTITION BY property ORDER BY round(abs(bias), 6), arm) AS k FROM f_armscore)
    SELECT r.property, r.arm AS best, round(r.mae, 6) AS mae, r2.arm AS runner_up, round(r2.mae, 6) AS runner_up_mae,
      b.arm AS least_biased
    FROM r JOIN r r2 ON r.property = r2.property AND r.k = 1 AND r2.k = 2 JOIN b ON b.property = r.property AND b.k = 1""")
def best_per_property(t):
    s = m.common_rows(t.pred, "arm", KEY).where(m.scorable()).groupBy("arm", "property").agg(
        rnd(m.mae()).alias("mae"), rnd(F.abs(F.avg(c("pred") - c("actual")))).alias("bias"))
    best = top_n(s, ["property"], [c("mae"), c("arm")], 2)
    at = lambda k, col: F.max(F.when(c("rank") == k, c(col)))
    g = best.groupBy("property").agg(at(1, "arm").alias("best"), at(1, "mae").alias("mae"),
                                     at(2, "arm").alias("runner_up"), at(2, "mae").alias("runner_up_mae"))
    b = s.groupBy("property").agg(F.min_by("arm", F.struct("bias", "arm")).alias("least_biased"))
    return g.join(b, "property")


def covered():
    return c("actual").between(c("lower"), c("upper"))


def intervals(t):
    x = t.interval.join(t.stratum.select("entity", "stratum"), "entity")
    return x.select("*", (c("upper") - c("lower")).alias("width"), covered().alias("covered"))


@query("coverage", """
    SELECT property, CASE WHEN grouping(stratum) = 1 THEN 'ALL' ELSE stratum END AS stratum, count(*) AS n_rows,
      round(avg(CASE WHEN actual BETWEEN lower AND upper THEN 1 ELSE 0 END), 6) AS coverage,
      round(quantile_cont(upper - lower, 0.5), 8) AS median_width,
      round(quantile_cont(least(upper, 500) - greatest(lower, 0), 0.5), 8) AS median_clipped,
      round(quantile_cont(CASE WHEN actual <> 0 THEN (upper - lower) / abs(actual) END, 0.5), 5) AS median_rel_width,
      round(avg(abs(pred - actual)), 6) AS mae,
      round(avg(CASE WHEN actual BETWEEN lower AND upper THEN 1 ELSE 0 END) - 0.9, 6) + 0 AS gap
    FROM f_interval JOIN f_stratum USING (entity)
    GROUP BY GROUPING SETS ((property, stratum), (property))""")
def coverage(t):
    """Coverage and width per stratum and overall; both scopes are exploded so one pass serves them."""
    x = intervals(t).select("*", F.explode(F.array(c("stratum"), F.lit("ALL"))).alias("scope"))
    x = x.select("property", "scope", "actual", "pred", "covered", "width",
                 (F.least(c("upper"), F.lit(500.0)) - F.greatest(c("lower"), F.lit(0.0))).alias("clipped"),
                 F.when(c("actual") != 0, c("width") / F.abs("actual")).alias("rel"))
    keys = ["property", "scope"]
    g = x.groupBy(*keys).agg(
        F.count("*").alias("n_rows"), F.avg(F.when(c("covered"), 1.0).otherwise(0.0)).alias("coverage"),
        rnd(m.mae()).alias("mae"))
    for col, name, d in (("width", "median_width", 8), ("clipped", "median_clipped", 8), ("rel", "median_rel_width", 5)):
        g = g.join(m.exact_quantiles(x, keys, col, [0.5]).select(*keys, rnd(c("q500"), d).alias(name)), keys)
    return g.select("property", c("scope").alias("stratum"), "n_rows", rnd(c("coverage")).alias("coverage"),
                    "median_width", "median_clipped", "median_rel_width", "mae", rnd(c("coverage") - 0.9).alias("gap"))


@query("coverage_bands", """
    SELECT property, CASE WHEN temp_c < 400 THEN 'low' WHEN temp_c < 800 THEN 'mid' ELSE 'high' END AS band,
      count(*) AS n_scored, round(avg(CASE WHEN actual BETWEEN lower AND upper THEN 1 ELSE 0 END), 6) AS coverage
    FROM f_interval GROUP BY ALL HAVING count(*) >= 5""")
def coverage_bands(t):
    band = bin_of(c("temp_c"), [("low", -1000, 400), ("mid", 400, 800), ("high", 800, None)])
    g = t.interval.groupBy("property", band.alias("band")).agg(
        F.count("*").alias("n_scored"), rnd(F.avg(F.when(covered(), 1.0).otherwise(0.0))).alias("coverage"))
    return g.where(c("n_scored") >= 5)


@query("miss_concentration", """
    WITH x AS (SELECT stratum, entity, count(*) AS m FROM f_interval JOIN f_stratum USING (entity)
        WHERE NOT (actual BETWEEN lower AND upper) GROUP BY ALL),
      r AS (SELECT *, sum(m) OVER (PARTITION BY stratum) AS total,
        row_number() OVER (PARTITION BY stratum ORDER BY m DESC, entity) AS k FROM x)
    SELECT stratum, entity AS top_entity, m AS top_misses, CAST(total AS BIGINT) AS misses,
      round(m / total, 6) AS share, m / total >= 0.30 AS flagged FROM r WHERE k = 1 AND total >= 5""")
def miss_concentration(t):
    per = intervals(t).where(~c("covered")).groupBy("stratum", "entity").agg(F.count("*").alias("n"))
    g = per.groupBy("stratum").agg(
        F.max_by("entity", F.struct(c("n"), -c("entity"))).alias("top_entity"),
        F.max("n").alias("top_misses"), F.sum("n").alias("misses"))
    share = c("top_misses") / c("misses")
    return g.where(c("misses") >= 5).select("*", rnd(share).alias("share"), (share >= 0.30).alias("flagged"))


@query("width_vs_error", """
    SELECT property, stratum, count(*) AS n, round(quantile_cont((upper - lower) / 2, 0.5), 9) AS half_width,
      round(quantile_cont(abs(actual - pred), 0.5), 9) AS resid_median,
      round(quantile_cont(abs(actual - pred), 0.9), 9) AS resid_p90, round(max(abs(actual - pred)), 9) AS resid_max
    FROM f_interval JOIN f_stratum USING (entity) GROUP BY ALL""")
def width_vs_error(t):
    keys = ["property", "stratum"]
    x = intervals(t).select(*keys, (c("width") / 2).alias("half"), F.abs(c("actual") - c("pred")).alias("resid"))
    g = x.groupBy(*keys).agg(F.count("*").alias("n"), rnd(F.max("resid"), 9).alias("resid_max"))
    h = m.exact_quantiles(x, keys, "half", [0.5]).select(*keys, rnd(c("q500"), 9).alias("half_width"))
    r = m.exact_quantiles(x, keys, "resid", [0.5, 0.9]).select(
        *keys, rnd(c("q500"), 9).alias("resid_median"), rnd(c("q900"), 9).alias("resid_p90"))
    return g.join(h, keys).join(r, keys)


@query("offsets_calibrate", """
    WITH o AS (SELECT property, quantile_cont(lower - pred, 0.5) AS lo, quantile_cont(upper - pred, 0.5) AS hi,
        min(upper - lower) AS wmin, max(upper - lower) AS wmax FROM f_interval GROUP BY 1)
    SELECT property, round(max(lo), 9) AS lower_offset, round(max(hi), 9) AS upper_offset, round(max(wmin), 9) AS width_min,
      round(max(wmax), 9) AS width_max, count(*) AS n,
      round(avg(CASE WHEN i.actual BETWEEN lower AND upper THEN 1 ELSE 0 END), 6) AS cover_own,
      round(avg(CASE WHEN i.actual BETWEEN p1 + lower - pred AND p1 + upper - pred THEN 1 ELSE 0 END), 6) AS cover_row,
      round(avg(CASE WHEN i.actual BETWEEN p1 + lo AND p1 + hi THEN 1 ELSE 0 END), 6) AS cover_constant
    FROM f_interval i JOIN f_arms a USING (entity, temp_c, property) JOIN o USING (property) GROUP BY property""")
def offsets_calibrate(t):
    """Median offsets per property, and coverage re-scored around another arm's centre."""
    x = t.interval.select(*KEY, "actual", "pred", "lower", "upper",
                          (c("lower") - c("pred")).alias("off_lo"), (c("upper") - c("pred")).alias("off_hi"))
    # One row a property: broadcast, so that no task gets all rows of a property.
    lo = F.broadcast(m.exact_quantiles(x, ["property"], "off_lo", [0.5], few=True).select("property", c("q500").alias("lo")))
    hi = F.broadcast(m.exact_quantiles(x, ["property"], "off_hi", [0.5], few=True).select("property", c("q500").alias("hi")))
    centre = t.pred.where((c("seed") == 42) & (c("arm") == 1)).select(*KEY, c("pred").alias("p1"))
    y = x.join(centre, KEY).join(lo, "property").join(hi, "property")
    rate = lambda l, h: rnd(F.avg(F.when(c("actual").between(l, h), 1.0).otherwise(0.0)))
    return y.groupBy("property").agg(
        rnd(F.max("lo"), 9).alias("lower_offset"), rnd(F.max("hi"), 9).alias("upper_offset"),
        rnd(F.min(c("upper") - c("lower")), 9).alias("width_min"), rnd(F.max(c("upper") - c("lower")), 9).alias("width_max"),
        F.count("*").alias("n"), rate(c("lower"), c("upper")).alias("cover_own"),
        rate(c("p1") + c("off_lo"), c("p1") + c("off_hi")).alias("cover_row"),
        rate(c("p1") + c("lo"), c("p1") + c("hi")).alias("cover_constant"))


@query("crosstab", """
    SELECT CASE WHEN grouping(stratum) = 1 THEN 'TOTAL' ELSE stratum END AS stratum,
      count(*) FILTER (conf = 'HIGH') AS high, count(*) FILTER (conf = 'LOW') AS low,
      count(*) FILTER (conf = 'MEDIUM') AS medium, count(*) FILTER (conf = 'UNKNOWN') AS unknown, count(*) AS total
    FROM f_entity JOIN f_stratum USING (entity) GROUP BY ROLLUP (stratum)""")
def crosstab(t):
    x = t.entity.join(t.stratum, "entity")
    cells = [F.count_if(c("conf") == v).alias(v.lower()) for v in ("HIGH", "LOW", "MEDIUM", "UNKNOWN")]
    return x.rollup("stratum").agg(F.grouping("stratum").alias("g"), *cells, F.count("*").alias("total")).select(
        F.when(c("g") == 1, "TOTAL").otherwise(c("stratum")).alias("stratum"), "high", "low", "medium", "unknown", "total")


@query("near_far_gap", """
    SELECT *, round(100 * (mae_near - mae_far) / mae_far, 4) + 0 AS gap_pct FROM (
      SELECT CASE WHEN grouping(conf) = 1 THEN 'ALL' ELSE conf END AS scope, property,
        count(*) FILTER (stratum = 'NEAR') AS n_near, round(avg(abs(pred - actual)) FILTER (stratum = 'NEAR'), 6) AS mae_near,
        count(*) FILTER (stratum = 'FAR') AS n_far, round(avg(abs(pred - actual)) FILTER (stratum = 'FAR'), 6) AS mae_far
      FROM f_pred JOIN f_stratum USING (entity) JOIN f_entity USING (entity) WHERE arm = 0 AND seed = 42 AND actual <> 0
      GROUP BY GROUPING SETS ((property), (property, conf))) WHERE n_near > 0 AND n_far > 0""")
def near_far_gap(t):
    x = t.pred.where((c("arm") == 0) & (c("seed") == 42)).where(m.scorable())
    x = x.join(t.stratum.select("entity", "stratum"), "entity").join(t.entity.select("entity", "conf"), "entity")
    e = F.abs(c("pred") - c("actual"))
    of = lambda s: F.when(c("stratum") == s, e)
    keys = [c("property"), c("conf")]
    g = x.groupingSets([keys[:1], keys], *keys).agg(
        F.grouping("conf").alias("g"), F.count(of("NEAR")).alias("n_near"), rnd(F.avg(of("NEAR"))).alias("mae_near"),
        F.count(of("FAR")).alias("n_far"), rnd(F.avg(of("FAR"))).alias("mae_far"))
    return g.where((c("n_near") > 0) & (c("n_far") > 0)).select(
        F.when(c("g") == 1, "ALL").otherwise(c("conf")).alias("scope"), "property", "n_near", "mae_near", "n_far",
        "mae_far", rnd(100 * (c("mae_near") - c("mae_far")) / c("mae_far"), 4).alias("gap_pct"))


@query("entity_mean_error", """
    SELECT property, count(*) AS n_entities, round(avg(ea), 6) AS mean_a, round(avg(eb), 6) AS mean_b,
      count(*) FILTER (ea < eb) AS a_better
    FROM (SELECT property, entity, round(avg(abs(p0 - actual)), 9) AS ea, round(avg(abs(p2 - actual)), 9) AS eb FROM f_arms
      WHERE actual <> 0 AND p2 IS NOT NULL GROUP BY ALL) GROUP BY property""")
def entity_mean_error(t):
    per = m.paired_errors(seed42(t), KEY, 0, 2).groupBy("property", "entity").agg(
        rnd(F.avg("err_a"), 9).alias("ea"), rnd(F.avg("err_b"), 9).alias("eb"))
    return per.groupBy("property").agg(
        F.count("*").alias("n_entities"), rnd(F.avg("ea")).alias("mean_a"), rnd(F.avg("eb")).alias("mean_b"),
        F.count_if(c("ea") < c("eb")).alias("a_better"))


@query("relative_change", """
    SELECT property, stratum, count(*) AS n, round(100 * (avg(abs(p1 - actual)) - avg(abs(p0 - actual))) / avg(abs(p0 - actual)), 6) + 0 AS change_pct
    FROM f_arms JOIN f_stratum USING (entity) WHERE actual <> 0 AND p0 IS NOT NULL AND p1 IS NOT NULL GROUP BY ALL""")
def relative_change(t):
    x = m.paired_errors(seed42(t), KEY, 0, 1).join(t.stratum.select("entity", "stratum"), "entity")
    return x.groupBy("property", "stratum").agg(
        F.count("*").alias("n"),
        rnd(100 * (F.avg("err_b") - F.avg("err_a")) / F.avg("err_a")).alias("change_pct"))


def entity_sums(t):
    x = m.paired_errors(seed42(t), KEY, 0, 1)
    return x.groupBy("property", "entity").agg(F.sum("err_b").alias("s_new"), F.sum("err_a").alias("s_ref"))


FIXTURE_SQL["f_esum"] = """
    SELECT property, entity, sum(abs(p1 - actual)) AS s_new, sum(abs(p0 - actual)) AS s_ref FROM f_arms
    WHERE actual <> 0 AND p0 IS NOT NULL AND p1 IS NOT NULL GROUP BY ALL"""


def _mix_sql(column: str, source: str) -> str:
    """The bootstrap's 32-bit mixing of ``column``, step by step."""
    rest = f"* EXCLUDE ({column})"
    shift = lambda n, x: f"SELECT {rest}, xor({column}, {column} >> {n}) AS {column} FROM ({x})"
    times = lambda k, x: f"SELECT {rest}, ({column} * {k}::UBIGINT) & 4294967295::UBIGINT AS {column} FROM ({x})"
    return shift(16, times(0xC2B2AE35, shift(13, times(0x85EBCA6B, shift(16, source)))))


FIXTURE_SQL["f_numbered"] = """
    SELECT *, (row_number() OVER (PARTITION BY property ORDER BY entity) - 1)::BIGINT AS idx, count(*) OVER (PARTITION BY property) AS n FROM f_esum"""
FIXTURE_SQL["f_picks"] = _mix_sql("h", "SELECT i, i::UBIGINT AS h FROM range((SELECT max(n) FROM f_numbered)) r(i)")
FIXTURE_SQL["f_draws"] = _mix_sql("k", "SELECT d, ((d + 1540483477) & 4294967295)::UBIGINT AS k FROM range(10000) r(d)")


@query("cluster_bootstrap", f"""
    WITH s AS (SELECT property, count(*) AS n, sum(s_new) AS tn, sum(s_ref) AS tr FROM f_esum GROUP BY property),
     b AS (SELECT p.property, d, sum(s_new) AS bn, sum(s_ref) AS br FROM (
        SELECT property, d, ((x * n::UBIGINT) >> 32)::BIGINT AS idx FROM ({_mix_sql('x', 'SELECT property, n, d, xor(h, k) AS x FROM s, f_draws, f_picks WHERE i < n')})) p
        JOIN f_numbered e ON e.property = p.property AND e.idx = p.idx GROUP BY p.property, d),
     r AS (SELECT property, 100 * (bn - br) / br AS ch FROM b)
    SELECT property, max(n) AS n_entities, round(max(100 * (tn - tr) / tr), 6) + 0 AS point, round(quantile_cont(ch, 0.025), 6) + 0 AS lo, round(quantile_cont(ch, 0.975), 6) + 0 AS hi,
      round(avg(CASE WHEN ch >= 0 THEN 1.0 ELSE 0.0 END), 6) AS p_ge0 FROM r JOIN s USING (property) GROUP BY property""")
def cluster_bootstrap(t):
    """10,000 draws of as many entities as a property has, with replacement; the SQL repeats every pick."""
    b = m.cluster_bootstrap(entity_sums(t), ["property"])
    return b.select("property", "n_entities", *[rnd(c(n)).alias(n) for n in ("point", "lo", "hi", "p_ge0")])


@query("bootstrap_point", """
    SELECT property, count(*) AS n_entities, round(100 * (sum(s_new) - sum(s_ref)) / sum(s_ref), 6) + 0 AS point
    FROM f_esum GROUP BY property""")
def bootstrap_point(t):
    return entity_sums(t).groupBy("property").agg(
        F.count("*").alias("n_entities"),
        rnd(100 * (F.sum("s_new") - F.sum("s_ref")) / F.sum("s_ref")).alias("point"))


@query("leave_one_out", """
    WITH x AS (SELECT *, sum(s_new) OVER (PARTITION BY property) AS tn, sum(s_ref) OVER (PARTITION BY property) AS tr FROM f_esum),
     y AS (SELECT property, entity, 100 * (tn - tr) / tr AS point, 100 * (tn - s_new - tr + s_ref) / (tr - s_ref) AS w FROM x)
    SELECT property, round(max(point), 6) + 0 AS point, round(min(w), 6) + 0 AS loo_min, round(max(w), 6) + 0 AS loo_max FROM y GROUP BY 1""")
def leave_one_out(t):
    x = m.leave_one_out(entity_sums(t), ["property"])
    return x.select("property", *[rnd(c(n)).alias(n) for n in ("point", "loo_min", "loo_max")])


@query("moved_rows", """
    WITH d AS (SELECT entity, stratum, abs(p1 - actual) - abs(p0 - actual) AS d, abs(p1 - p0) > 1e-6 AS moved
        FROM f_arms JOIN f_stratum USING (entity) WHERE actual <> 0 AND property = 'ys'),
     e AS (SELECT entity, stratum, count(*) AS n, round(sum(d), 6) AS ch FROM d WHERE moved GROUP BY ALL)
    SELECT stratum, CAST(sum(n) AS BIGINT) AS rows_moved, count(*) AS entities_moved, round(sum(ch), 6) + 0 AS net_change,
      round(min(ch), 6) AS best_entity_change FROM e GROUP BY stratum""")
def moved_rows(t):
    x = arms_wide(t).where((c("property") == "ys") & (c("actual") != 0) & (F.abs(c("p1") - c("p0")) > 1e-6))
    x = x.join(t.stratum.select("entity", "stratum"), "entity")
    d = F.abs(c("p1") - c("actual")) - F.abs(c("p0") - c("actual"))
    e = x.groupBy("entity", "stratum").agg(F.count("*").alias("n"), rnd(F.sum(d)).alias("ch"))
    return e.groupBy("stratum").agg(
        F.sum("n").alias("rows_moved"), F.count("*").alias("entities_moved"), rnd(F.sum("ch"), 6).alias("net_change"),
        rnd(F.min("ch"), 6).alias("best_entity_change"))


@query("contribution", """
    WITH d AS (SELECT property, entity, round(s_new - s_ref, 6) AS d FROM f_esum),
     r AS (SELECT *, row_number() OVER (PARTITION BY property ORDER BY abs(d) DESC, entity) AS rank,
       sum(d) OVER (PARTITION BY property) AS net FROM d)
    SELECT property, rank, entity, d, round(d / net, 4) + 0 AS share, round(net - (SELECT sum(d) FROM r x WHERE x.property = r.property AND x.rank <= 3), 3) + 0 AS net_without_top3
    FROM r WHERE rank <= 6""")
def contribution(t):
    d = entity_sums(t).select("property", "entity", rnd(c("s_new") - c("s_ref")).alias("d"))
    top = top_n(d, ["property"], [F.desc(F.abs("d")), c("entity")], 6)
    net = d.groupBy("property").agg(F.sum("d").alias("net"))
    top3 = top.where(c("rank") <= 3).groupBy("property").agg(F.sum("d").alias("t3"))
    return top.join(net, "property").join(top3, "property").select(
        "property", "rank", "entity", "d", rnd(c("d") / c("net"), 4).alias("share"),
        rnd(c("net") - c("t3"), 3).alias("net_without_top3"))


def entity_class(t):
    x = t.comp.join(t.entity.select("entity", "route"), "entity")
    return x.select("entity", physics_class(c("route")).alias("alloy_class"))


@query("within_class", """
    SELECT stratum, alloy_class, property, count(*) AS n, count(DISTINCT entity) AS entities,
      round(avg(abs(p0 - actual)), 6) AS mae_0, round(avg(abs(p1 - actual)), 6) AS mae_1, round(avg(abs(p2 - actual)), 6) AS mae_2
    FROM f_arms JOIN f_stratum USING (entity) JOIN f_class USING (entity) WHERE actual <> 0 AND p2 IS NOT NULL
    GROUP BY ALL""")
def within_class(t):
    x = arms_wide(t).where((c("actual") != 0) & c("p2").isNotNull())
    x = x.join(t.stratum.select("entity", "stratum"), "entity").join(entity_class(t), "entity")
    return x.groupBy("stratum", "alloy_class", "property").agg(
        F.count("*").alias("n"), F.count_distinct("entity").alias("entities"),
        *[rnd(F.avg(F.abs(c(f"p{a}") - c("actual")))).alias(f"mae_{a}") for a in range(3)])


@query("boundary_sweep", """
    SELECT lo, hi, property, count(*) AS n, round(avg(abs(p0 - actual)), 6) AS mae_0,
      round(100 * (avg(abs(p1 - actual)) - avg(abs(p0 - actual))) / avg(abs(p0 - actual)), 6) + 0 AS change_pct
    FROM f_arms JOIN f_stratum USING (entity),
      (SELECT 1.5::DOUBLE + 0.25::DOUBLE * i AS lo, 4.0::DOUBLE + 0.25::DOUBLE * j AS hi FROM range(5) a(i), range(5) b(j)) g
    WHERE actual <> 0 AND distance >= lo AND distance < hi GROUP BY ALL""")
def boundary_sweep(t):
    """Band limits as a 25-row grid. Errors are summed per distance first, so the grid multiplies
    distances and not rows."""
    x = m.paired_errors(seed42(t), KEY, 0, 1).join(t.stratum.select("entity", "distance"), "entity")
    per = x.groupBy("property", "distance").agg(
        F.count("*").alias("n"), F.sum("err_a").alias("sa"), F.sum("err_b").alias("sb"))
    steps = [(1.5 + 0.25 * i, 4.0 + 0.25 * j) for i in range(5) for j in range(5)]
    grid = const_table(t.spark, steps, "lo double, hi double")
    y = per.join(F.broadcast(grid), (c("distance") >= c("lo")) & (c("distance") < c("hi")))
    return y.groupBy("lo", "hi", "property").agg(
        F.sum("n").alias("n"), rnd(F.sum("sa") / F.sum("n")).alias("mae_0"),
        rnd(100 * (F.sum("sb") - F.sum("sa")) / F.sum("sa")).alias("change_pct"))


@query("with_without", """
    WITH x AS (SELECT property, entity % 300 AS name_id, abs(p0 - actual) AS e FROM f_arms WHERE actual <> 0)
    SELECT property, count(*) AS n, round(avg(e), 6) AS mae_all, round(avg(e) FILTER (name_id <> 7), 6) AS mae_without,
      round(avg(e) FILTER (name_id <> 7) - avg(e), 6) + 0 AS delta,
      round(100 * (avg(e) FILTER (name_id <> 7) - avg(e)) / avg(e), 6) + 0 AS delta_pct FROM x GROUP BY property""")
def with_without(t):
    """The metric with and without one named group, from one conditional aggregate."""
    e = F.abs(c("p0") - c("actual"))
    rest = F.avg(F.when(c("entity") % 300 != 7, e))
    return arms_wide(t).where(c("actual") != 0).groupBy("property").agg(
        F.count("*").alias("n"), rnd(F.avg(e)).alias("mae_all"), rnd(rest).alias("mae_without"),
        rnd(rest - F.avg(e)).alias("delta"), rnd(100 * (rest - F.avg(e)) / F.avg(e)).alias("delta_pct"))


@query("drift", """
    WITH v AS (SELECT property, arm, round(pred, 0) AS v, count(*) AS n FROM f_seed42 WHERE arm IN (0, 2) GROUP BY ALL),
     top AS (SELECT property, max(n) AS top, sum(n) AS total FROM v WHERE arm = 2 GROUP BY 1),
     d AS (SELECT property, count(DISTINCT v) FILTER (arm = 0) AS distinct_old, count(DISTINCT v) FILTER (arm = 2) AS distinct_new FROM v GROUP BY 1)
    SELECT property, count(p0) AS rows_old, count(p2) AS rows_new, any_value(distinct_old) AS distinct_old,
      any_value(distinct_new) AS distinct_new, count(*) FILTER (p0 IS NOT NULL AND p2 IS NOT NULL AND actual <> 0) AS n_common,
      round(avg(abs(p2 - actual)) FILTER (p0 IS NOT NULL AND actual <> 0) / avg(abs(p0 - actual)) FILTER (p2 IS NOT NULL AND actual <> 0), 6) AS mae_ratio,
      round(any_value(top.top) / any_value(top.total), 6) AS modal_share
    FROM f_arms JOIN d USING (property) JOIN top USING (property) GROUP BY property""")
def drift(t):
    x = arms_wide(t)
    both = c("p0").isNotNull() & c("p2").isNotNull() & (c("actual") != 0)
    err = lambda p: F.avg(F.when(both, F.abs(c(p) - c("actual"))))
    g = x.groupBy("property").agg(
        F.count("p0").alias("rows_old"), F.count("p2").alias("rows_new"), F.count_if(both).alias("n_common"),
        rnd(err("p2") / err("p0")).alias("mae_ratio"))
    values = t.pred.where((c("seed") == 42) & c("arm").isin(0, 2)).groupBy(
        "property", "arm", F.round("pred", 0).alias("v")).agg(F.count("*").alias("n"))
    new = c("arm") == 2
    d = values.groupBy("property").agg(
        F.count_if(~new).alias("distinct_old"), F.count_if(new).alias("distinct_new"),
        rnd(F.max(F.when(new, c("n"))) / F.sum(F.when(new, c("n")))).alias("modal_share"))
    return g.join(d, "property")


@query("source_mechanism", """
    WITH x AS (SELECT entity, actual, p0, p1, p2, abs(p1 - p0) / greatest(abs(p0), 1e-9) > 0.02 AS wide FROM f_arms
       WHERE property = 'ys' AND actual <> 0 AND p2 IS NOT NULL)
    SELECT alloy_class, count(*) AS n, count(DISTINCT entity) AS entities, round(avg(abs(p0 - actual)), 6) AS mae_a,
      round(avg(abs(p1 - actual)), 6) AS mae_b, round(avg(abs(p2 - actual)), 6) AS mae_mix,
      round(avg(least(abs(p0 - actual), abs(p1 - actual))), 6) AS mae_oracle, count(*) FILTER (wide) AS n_spread,
      round(quantile_cont(CASE WHEN wide THEN round((p2 - p0) / (p1 - p0), 9) END, 0.5), 6) + 0 AS median_t,
      round(avg(CASE WHEN abs(p2 - p1) < abs(p2 - p0) THEN 1 ELSE 0 END) FILTER (wide), 6) AS nearer_b,
      round(avg(CASE WHEN (abs(p2 - p1) < abs(p2 - p0)) = (abs(p1 - actual) < abs(p0 - actual)) THEN 1 ELSE 0 END) FILTER (wide), 6) AS agree,
      round(avg(abs(CASE WHEN alloy_class = 'sss' THEN p1 ELSE p2 END - actual)), 6) AS mae_routed
    FROM x JOIN f_class USING (entity) GROUP BY alloy_class""")
def source_mechanism(t):
    """Where a mixed arm sits between two sources, and what routing or an oracle would score."""
    x = arms_wide(t).where((c("property") == "ys") & (c("actual") != 0) & c("p2").isNotNull()).join(entity_class(t), "entity")
    e = lambda p: F.abs(c(p) - c("actual"))
    wide = F.abs(c("p1") - c("p0")) / F.greatest(F.abs("p0"), F.lit(1e-9)) > 0.02
    nearer = F.abs(c("p2") - c("p1")) < F.abs(c("p2") - c("p0"))
    rate = lambda cond: rnd(F.avg(F.when(c("wide"), F.when(cond, 1.0).otherwise(0.0))))
    x = x.withColumn("wide", wide).withColumn(
        "pos_t", F.when(wide, rnd((c("p2") - c("p0")) / (c("p1") - c("p0")), 9)))
    g = x.groupBy("alloy_class").agg(
        F.count("*").alias("n"), F.count_distinct("entity").alias("entities"), rnd(F.avg(e("p0"))).alias("mae_a"),
        rnd(F.avg(e("p1"))).alias("mae_b"), rnd(F.avg(e("p2"))).alias("mae_mix"),
        rnd(F.avg(F.least(e("p0"), e("p1")))).alias("mae_oracle"), F.count_if("wide").alias("n_spread"),
        rate(nearer).alias("nearer_b"), rate(nearer == (e("p1") < e("p0"))).alias("agree"),
        rnd(F.avg(F.abs(F.when(c("alloy_class") == "sss", c("p1")).otherwise(c("p2")) - c("actual")))).alias("mae_routed"))
    q = m.exact_quantiles(x, ["alloy_class"], "pos_t", [0.5]).select("alloy_class", rnd(c("q500")).alias("median_t"))
    return g.join(q, "alloy_class", "left")


@query("sample_weight", """
    SELECT entity, temp_c, property, round(1 / sqrt(count(*) OVER (PARTITION BY entity)), 8) AS weight FROM f_measurement""")
def sample_weight(t):
    """Row counts per entity are aggregated and joined, so a hot entity is not one window task."""
    n = t.measurement_set.groupBy("entity").agg(F.count("*").alias("k"))
    return t.measurement_set.join(n, "entity").select(*KEY, rnd(1.0 / F.sqrt("k"), 8).alias("weight"))


@query("bucketise", """
    SELECT stratum, CASE WHEN temp_c < 100 THEN 'room' WHEN temp_c <= 700 THEN 'intermediate' ELSE 'high' END AS regime,
      CASE WHEN temp_c < 300 THEN '20-300' WHEN temp_c < 700 THEN '300-700' WHEN temp_c < 900 THEN '700-900' ELSE '900+' END AS band,
      count(*) AS n FROM f_measurement JOIN f_stratum USING (entity) GROUP BY ALL""")
def bucketise(t):
    band = bin_of(c("temp_c"), [("20-300", -1e3, 300), ("300-700", 300, 700), ("700-900", 700, 900), ("900+", 900, None)])
    return t.measurement_set.join(t.stratum, "entity").groupBy(
        "stratum", temperature_regime(c("temp_c")).alias("regime"), band.alias("band")).agg(F.count("*").alias("n"))


@query("wilcoxon", """
    WITH d AS (SELECT property, round(abs(b - actual) - abs(a - actual), 9) AS d FROM (
        SELECT entity, temp_c, property, max(actual) AS actual, avg(pred) FILTER (arm = 0) AS a, avg(pred) FILTER (arm = 1) AS b FROM f_pred GROUP BY ALL) WHERE actual <> 0 AND a IS NOT NULL AND b IS NOT NULL),
     mid AS (SELECT property, median(d) AS mid FROM d GROUP BY property),
     r AS (SELECT property, d, rank() OVER (PARTITION BY property ORDER BY abs(d))
        + (count(*) OVER (PARTITION BY property, abs(d)) - 1) / 2.0 AS rk FROM d WHERE d <> 0),
     w AS (SELECT property, count(*) AS n, least(sum(rk) FILTER (d > 0), sum(rk) FILTER (d < 0)) AS w,
        count(*) FILTER (d < 0) AS wins, count(*) FILTER (d > 0) AS losses FROM r GROUP BY property),
     ties AS (SELECT property, sum(k * k * k - k) AS ties FROM (SELECT property, abs(d) AS a, count(*)::DOUBLE AS k FROM r GROUP BY ALL) GROUP BY property),
     z AS (SELECT *, abs((w - n * (n + 1) / 4.0) / sqrt(n::DOUBLE * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0)) / sqrt(2.0) AS x FROM w JOIN ties USING (property)),
     u AS (SELECT *, 1.0 / (1.0 + 0.3275911 * x) AS u FROM z)
    SELECT property, n AS n_nonzero, round(w, 1) AS w, wins, losses, round(mid, 8) + 0 AS median_delta,
      round(least(1.0, u * (0.254829592 + u * (-0.284496736 + u * (1.421413741 + u * (-1.453152027 + u * 1.061405429)))) * exp(-x * x)), 6) + 0 AS p FROM u JOIN mid USING (property)""")
def wilcoxon(t):
    """Signed ranks of the error differences of the mean predictions over all seeds, with the median difference."""
    x = cut(m.paired_errors(t.pred, KEY, 0, 1).select("property", rnd(c("err_b") - c("err_a"), 9).alias("d")))
    mid = m.exact_quantiles(x, ["property"], "d", [0.5]).select("property", rnd(c("q500"), 8).alias("median_delta"))
    s = ranks.signed_rank(x, ["property"], "d").join(mid, "property")
    return s.select("property", "n_nonzero", rnd(c("w"), 1).alias("w"), "wins", "losses", "median_delta", rnd(c("p")).alias("p"))


@query("spearman", """
    WITH x AS (SELECT property, p0, p1, rank() OVER (PARTITION BY property ORDER BY p0) + (count(*) OVER (PARTITION BY property, p0) - 1) / 2.0 AS ra,
        rank() OVER (PARTITION BY property ORDER BY p1) + (count(*) OVER (PARTITION BY property, p1) - 1) / 2.0 AS rb FROM f_arms)
    SELECT property, round(corr(ra, rb), 6) AS rho FROM x GROUP BY property""")
def spearman(t):
    x = arms_wide(t).select(*KEY, "p0", "p1")
    x = ranks.average_ranks(x, ["property"], "p0", "ra")
    x = ranks.average_ranks(x, ["property"], "p1", "rb")
    return x.groupBy("property").agg(rnd(F.corr("ra", "rb")).alias("rho"))


@query("worst_n", """
    WITH x AS (SELECT entity, temp_c, property, round(abs((pred - actual) / actual) * 100, 4) AS pct
        FROM f_pred WHERE arm = 0 AND seed = 42 AND actual <> 0),
     r AS (SELECT *, row_number() OVER (PARTITION BY property ORDER BY pct DESC, entity, temp_c) AS rank FROM x),
     o AS (SELECT *, row_number() OVER (ORDER BY pct DESC, entity, temp_c, property) AS k FROM x)
    SELECT 'property' AS scope, rank, entity, temp_c, property, pct FROM r WHERE rank <= 5
    UNION ALL SELECT 'overall', k, entity, temp_c, property, pct FROM o WHERE k <= 10""")
def worst_n(t, n: int = 5):
    x = t.pred.where((c("arm") == 0) & (c("seed") == 42) & (c("actual") != 0)).select(
        *KEY, rnd(F.abs((c("pred") - c("actual")) / c("actual")) * 100, 4).alias("pct"))
    per = top_n(x, ["property"], [F.desc("pct"), c("entity"), c("temp_c")], n)
    overall = x.orderBy(F.desc("pct"), "entity", "temp_c", "property").limit(2 * n).withColumn(
        "rank", F.row_number().over(W.orderBy(F.desc("pct"), "entity", "temp_c", "property")))
    cols = ["rank", *KEY, "pct"]
    return per.select(F.lit("property").alias("scope"), *cols).unionByName(
        overall.select(F.lit("overall").alias("scope"), *cols))


@query("equal_size_strata", """
    WITH n AS (SELECT count(*) FILTER (stratum = 'NEAR') AS near, count(*) FILTER (stratum = 'MID') AS mid FROM f_stratum),
     x AS (SELECT s.entity, stratum, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS k FROM f_stratum s JOIN orders ON o_orderkey = entity),
     y AS (SELECT stratum, CASE WHEN k <= near THEN 'NEAR' WHEN k <= near + mid THEN 'MID' ELSE 'FAR' END AS by_rank FROM x, n)
    SELECT stratum, by_rank, count(*) AS n FROM y GROUP BY ALL""")
def equal_size_strata(t):
    """Cut another metric by rank into the sizes of the production strata and cross-tabulate."""
    size = t.stratum.agg(F.count_if(c("stratum") == "NEAR").alias("near"), F.count_if(c("stratum") == "MID").alias("mid"))
    x = t.stratum.join(t.orders.select(c("o_orderkey").alias("entity"), "o_totalprice"), "entity")
    r = ranks.row_ranks(x, [], "o_totalprice", "entity", "k").crossJoin(F.broadcast(size))
    cut = F.when(c("k") <= c("near"), "NEAR").when(c("k") <= c("near") + c("mid"), "MID").otherwise("FAR")
    return r.groupBy("stratum", cut.alias("by_rank")).agg(F.count("*").alias("n"))


@query("benchmark_band", """
    SELECT arm, property, count(*) AS n, round(avg(abs(pred - actual)), 6) AS mae,
      round(avg(CASE WHEN sign(pred - 300) = sign(actual - 300) THEN 1 ELSE 0 END), 6) AS sign_accuracy,
      count(*) FILTER (abs(pred - actual) <= 0.10::DOUBLE * actual) AS in_band, count(*) FILTER (abs(pred) > 800) AS exposed,
      round(max(abs(pred)), 8) AS max_abs
    FROM f_pred WHERE seed = 42 AND actual <> 0 GROUP BY ALL""")
def benchmark_band(t):
    """Estimates against a reference value with a tolerance band, per variant (arm)."""
    e = F.abs(c("pred") - c("actual"))
    return seed42(t).where(c("actual") != 0).groupBy("arm", "property").agg(
        F.count("*").alias("n"), rnd(F.avg(e)).alias("mae"),
        rnd(F.avg(F.when(F.signum(c("pred") - 300) == F.signum(c("actual") - 300), 1.0).otherwise(0.0))).alias("sign_accuracy"),
        F.count_if(e <= 0.10 * c("actual")).alias("in_band"), F.count_if(F.abs("pred") > 800).alias("exposed"),
        rnd(F.max(F.abs("pred")), 8).alias("max_abs"))


@query("usage_sums", """
    SELECT kind, count(*) AS n, round(sum(TRY_CAST(json_extract_string(payload, '$.k') AS DOUBLE)), 3) AS tokens,
      round(avg(CASE WHEN status = 'failed' THEN 1 ELSE 0 END), 6) AS failure_rate FROM f_job GROUP BY kind""")
def usage_sums(t):
    tokens = F.get_json_object("payload", "$.k").try_cast("double")
    return t.job.groupBy("kind").agg(
        F.count("*").alias("n"), rnd(F.sum(tokens), 3).alias("tokens"),
        rnd(F.avg(F.when(c("status") == "failed", 1.0).otherwise(0.0))).alias("failure_rate"))


@query("claims_check", """
    WITH d AS (SELECT 'mae_' || arm || '_' || property AS claim, arm, avg(abs(pred - actual)) AS derived FROM f_pred WHERE actual <> 0 GROUP BY arm, property),
     x AS (SELECT claim, derived, round(round(derived, 2) + CASE WHEN arm = 1 THEN 0.03 ELSE 0 END, 2) AS declared FROM d)
    SELECT claim, declared, round(derived, 6) AS derived, abs(declared - derived) <= 0.0051 AS holds FROM x""")
def claims_check(t):
    """Declared numbers (here: two-decimal print-outs, those of arm 1 off by 0.03) re-derived and compared at a tolerance."""
    d = t.pred.where(m.scorable()).groupBy("arm", "property").agg(m.mae().alias("x")).select(
        F.concat(F.lit("mae_"), c("arm").cast("string"), F.lit("_"), c("property")).alias("claim"), c("x").alias("derived"))
    off = F.when(c("claim").startswith("mae_1_"), 0.03).otherwise(0.0)
    declared = d.select("claim", F.round(F.round("derived", 2) + off, 2).alias("declared"))
    return d.join(declared, "claim").select(
        "claim", "declared", rnd(c("derived")).alias("derived"),
        (F.abs(c("declared") - c("derived")) <= 0.0051).alias("holds"))
