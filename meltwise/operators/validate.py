"""Row checks that return reasons, violations or cleaned values instead of raising."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meltwise import constants as K
from meltwise.functions.classify import is_wrought
from meltwise.functions.thermal import modulus_factor, strength_factor
from meltwise.operators.common import map_total, part_of as p, rnd

c = F.col


def messages(rules: list[tuple[str, Column]]) -> Column:
    """Names of the rules that fire, in order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]))


def first_rule(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    out = None
    for name, cond in rules:
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(otherwise)


def closure_reason() -> Column:
    total = map_total()
    return first_rule(
        [("too low", total < 90), ("too high", total > 110),
         ("missing Ni", ~F.map_contains_key("composition", F.lit("Ni")))], "ok")


def closure_grade() -> tuple[Column, Column]:
    """Cleaned map (positive parts, three decimals unless the total is near 100) and a grade."""
    kept = F.map_filter("composition", lambda _, v: v > 0)
    total = F.aggregate(F.map_values(kept), F.lit(0.0), lambda a, v: a + v)
    near = total.between(99.5, 100.5)
    cleaned = F.when(near, kept).otherwise(F.transform_values(kept, lambda _, v: F.round(v, 3)))
    grade = first_rule(
        [("empty", F.size(kept) == 0), ("ok", near), ("reject", (total < 90) | (total > 110)),
         ("incomplete", total < 95), ("excess", total > 105), ("off", F.abs(total - 100) > 2)], "close")
    return cleaned, grade


def range_violations(features: DataFrame, ranges: DataFrame) -> DataFrame:
    """One row per feature outside its declared range. ``ranges`` is (feature, lo, hi)."""
    names = [n for n, _, _ in K.FEATURE_RANGES]
    long = features.select("entity", *names).unpivot("entity", names, "feature", "value")
    return long.join(F.broadcast(ranges), "feature").where(~c("value").between(c("lo"), c("hi")))


def sweep(measurements: DataFrame, compositions: DataFrame) -> DataFrame:
    """Findings of the record sweep: entity, temp_c, check, property, value."""
    lo = hi = F.lit(None).cast("double")
    for prop, (a, b) in K.SWEEP_BOUNDS.items():
        lo = F.when(c("property") == prop, a).otherwise(lo)
        hi = F.when(c("property") == prop, b).otherwise(hi)
    kind = (
        F.when(c("value") < 0, "negative")
        .when((c("value") == 0) & (c("property") != "el"), "zero")
        .when(~c("value").between(lo, hi), "out_of_bounds")
    )
    elong = F.when(c("property") == "el", F.when(c("value") > 200, "elongation_impossible").when(
        (c("temp_c") < 600) & (c("value") > 100), "elongation_impossible_cold"))
    point = measurements.select(
        "entity", "temp_c", "property", "value", F.explode(F.array_compact(F.array(kind, elong))).alias("check")
    )
    of = lambda name: F.max(F.when(c("property") == name, c("value")))
    crossed = (
        measurements.where(c("property").isin("ys", "uts")).groupBy("entity", "temp_c")
        .agg(of("ys").alias("ys"), of("uts").alias("uts"))
        .where((c("ys") > 0) & (c("uts") > 0) & (c("ys") > c("uts") * 1.02))
        .select("entity", "temp_c", F.lit("ys").alias("property"), c("ys").alias("value"),
                F.lit("ys_above_uts").alias("check"))
    )
    total = map_total()
    closure = compositions.where(~total.between(95.0, 105.0)).select(
        "entity", F.lit(None).cast("int").alias("temp_c"), F.lit(None).cast("string").alias("property"),
        total.alias("value"), F.lit("composition_sum").alias("check"))
    return point.unionByName(crossed).unionByName(closure)


IMPOSSIBLE = ["negative", "zero", "ys_above_uts", "elongation_impossible", "elongation_impossible_cold"]


def clean_series(measurements: DataFrame, prop: str = "em") -> DataFrame:
    """Per entity the series flags decide, per point whether it stays; returns kept points and action."""
    x = measurements.where(c("property") == prop)
    any_of = lambda cond: F.max(F.when(cond, 1).otherwise(0)) == 1
    v, rt = c("value"), c("temp_c") <= 30
    flags = x.groupBy("entity").agg(
        any_of(v >= 150).alias("high"), any_of(v < 100).alias("low"), any_of(v >= 120).alias("above"),
        any_of(rt & (v < 120)).alias("rt_low"), any_of(rt & (v >= 150)).alias("rt_high"),
    )
    action = first_rule(
        [("cleared", ~c("high") & ~c("above")), ("mixed", c("high") & c("low")),
         ("mixed_rt", c("rt_low") & c("rt_high"))], "ok")
    keep = F.when(c("action") == "cleared", False).when(c("action") == "ok", True).otherwise(v >= 100)
    return x.join(flags.select("entity", action.alias("action")), "entity").withColumn("keep", keep)


def bounds_errors(ys, uts, el, em, density, gp) -> Column:
    return messages([
        ("ys negative", ys < 0), ("uts negative", uts < 0), ("ys above uts", (ys > uts) & (uts > 0)),
        ("ys above limit", ys > 2000), ("uts above limit", uts > 2500), ("el negative", el < 0),
        ("el above 100", el > 100), ("em impossible", (em > 0) & ((em < 90) | (em > 300))),
        ("em unusual", (em > 0) & (((em >= 90) & (em < 100)) | ((em > 250) & (em <= 300)))),
        ("density out of range", (density > 0) & ((density < 7.0) | (density > 10.0))),
        ("gp above limit", gp > 75),
    ])


def coherency_rules() -> Column:
    """Cross-column rules over ys, uts, el, em, density, gp and the feature columns at temp_c."""
    t = c("temp_c").cast("double")
    em_f = modulus_factor(t)
    st_f = strength_factor(t, F.lit("gp"), c("gp"))
    boost = 1.0 + 0.0018 * F.greatest(F.lit(0.0), t - 650)
    heavy = c("re_wt") + c("w_wt") + c("ta_wt")
    formers = c("al_wt") + c("ti_wt") + c("ta_wt")
    ys, uts, el, em = c("ys"), c("uts"), c("el"), c("em")
    both = (ys > 0) & (c("gp") > 0)
    high = both & (ys > 1400 * st_f) & (c("gp") < 50)
    mid = both & ~high & (ys > 1200 * st_f) & (c("gp") < 40)
    expected = c("vrh") * em_f
    ratio = F.try_divide(uts, ys)
    pair = (ys > 0) & (uts > 0)
    top = 1.0 + (F.when(c("index_wt") < 2, 2.5).otherwise(1.6) - 1.0) * em_f
    low_ratio = pair & (ratio < 1.0 + 0.05 * em_f) & (t <= 650)
    outside = ~em.between(F.greatest(F.lit(90.0), expected - 30), expected + 30)
    return messages([
        ("exceptional strength", high), ("high strength", mid),
        ("density anomaly", (heavy > 0) & (F.abs(c("density_in") - (8.2 + heavy / 100 * 5)) > 0.8)),
        ("ductile with refractories", (el > 25 * boost) & (heavy > 10)),
        ("ductile with rhenium", (el > 30 * boost) & (c("re_wt") > 6)),
        ("modulus mismatch", (em > 0) & (F.abs(em - expected) > 30 * em_f)),
        ("modulus unexplained", (em > 0) & outside & (formers < 10)),
        ("low ratio", low_ratio), ("high ratio", pair & ~low_ratio & (ratio > top)),
        ("fraction mismatch", (c("gp_in") > 0) & (formers > 0) & (F.abs(c("gp_in") - c("gp")) > 15)),
    ])


def penalties() -> tuple[Column, Column]:
    """Penalty names and score from the metallurgical metrics."""
    names = messages([
        ("Strengthening Balance", (c("gp") < 5) & (c("sss_wt") < 10) & ~F.contains(F.coalesce("route", F.lit("")), F.lit("solid_solution"))),
        ("Coherency Warning", F.abs(c("mismatch")) > 0.8),
        ("TCP Risk - Critical", c("tcp_risk") == "Critical"),
        ("TCP Risk - Elevated", c("tcp_risk") == "Elevated"),
        ("Phase Stability", c("tcp_risk") == "Moderate"),
    ])
    extra = (
        F.when(c("tcp_risk") == "Critical", 30).when(c("tcp_risk") == "Elevated", 5).otherwise(0)
        + F.when(F.abs(c("mismatch")) > 1.5, 20).otherwise(0)
    )
    return names, F.size(names) * 5 + extra


def plausibility() -> tuple[Column, Column, Column]:
    """Failed manufacturability rules, number of majors and refractory sum."""
    wrought = F.contains(F.lower("route"), F.lit("wrought")) | F.contains(F.lower("route"), F.lit("forged"))
    majors = F.size(F.map_filter("composition", lambda k, v: (k != "Ni") & (v > 1.0)))
    refractory = p("Mo") + p("W") + p("Re") + p("Ta") + p("Nb")
    formers = p("Al") + p("Ti") + p("Ta")
    failed = messages([
        ("R1_element_count", majors > 8),
        ("R2_refractory_budget", refractory > F.when(wrought, 16.0).otherwise(20.0)),
        ("R3_trace_elements", (p("Cu") > 0.5) | (p("Mn") > 1.0) | (p("Si") > 1.0)),
        ("R4_precipitate_formers", formers > F.when(wrought, 10.0).otherwise(14.5)),
    ])
    return failed, majors, refractory


def design_request_errors() -> Column:
    """Range and conflict checks of a target row ys, uts, el, em, density, gp, iterations."""
    span = lambda n, lo, hi: [(f"{n} low", (c(n) > 0) & (c(n) < lo)), (f"{n} high", c(n) > hi)]
    return messages([
        ("uts below ys", (c("uts") > 0) & (c("ys") > 0) & (c("uts") < c("ys"))),
        *span("ys", 100, 3000), *span("uts", 150, 3500), *span("el", 0.1, 100), *span("em", 100, 250),
        *span("density", 5.0, 12.0), ("gp high", c("gp") > 75),
        ("iterations low", c("iterations") < 1), ("iterations high", c("iterations") > 20),
        ("strong and ductile", (c("ys") > 1500) & (c("el") > 30)),
    ])


def quick_warnings() -> Column:
    """Screening warnings, prefixed by severity."""
    t, cr, m = c("tcp_risk"), c("cr_wt"), F.abs(c("mismatch"))
    wrought = c("route") == "wrought"
    return messages([
        ("CRITICAL: phase stability", t.isin("Critical", "Elevated")), ("WARNING: phase stability", t == "Moderate"),
        ("CRITICAL: mismatch", m > 0.8), ("WARNING: mismatch", (m > 0.5) & (m <= 0.8)),
        ("CRITICAL: low Cr", cr < 5), ("CRITICAL: high Cr", cr > 20),
        ("WARNING: Cr for wrought", (cr >= 18) & (cr <= 20) & wrought),
        ("CRITICAL: fraction above wrought limit", wrought & (c("gp") > 50)),
        ("WARNING: former index", wrought & (c("index_wt") > 7)),
        ("WARNING: fraction high for cast", (c("route") == "cast") & (c("gp") > 65)),
        ("WARNING: low formers", (c("index_wt") >= 2) & (c("index_wt") < 3)),
    ])
