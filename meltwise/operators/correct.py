"""Rule corrections, neighbour anchoring, calibration, intervals and proposals as column plans.

Rows carry ml_ys, ml_uts, ml_el, ml_em, the feature columns, route, alloy_class and temp_c; anchoring
also reads distance, kg_ys, kg_uts, kg_el, kg_gp and kg_route.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meltwise import constants as K
from meltwise.functions.classify import is_wrought
from meltwise.functions.routes import compatible, mismatch
from meltwise.functions.thermal import compress_ratio, modulus_factor, strength_factor
from meltwise.operators.predict import empirical_elongation, empirical_strength, route_param

c = F.col

# The delivered profile and the published older profile.
PRODUCTION = {"em_limit": 0.15, "route_aware": True, "skip_sc_ds": True}
LEGACY = {"em_limit": 0.20, "route_aware": False, "skip_sc_ds": False}


def ratio_ceiling(profile: dict) -> Column:
    wrought = is_wrought(c("route"))
    sss = F.when(wrought, 2.4).otherwise(1.7) if profile["route_aware"] else F.lit(2.4)
    return (
        F.when(c("alloy_class") == "sss", sss)
        .when(wrought, F.when(c("gp") > 40, 1.45).otherwise(1.60))
        .otherwise(1.15 + c("gp") / 100.0 * 0.2 + 0.10))


def elongation_cap(profile: dict) -> Column:
    tight = ~is_wrought(c("route")) & (c("alloy_class") != "sc_ds") if profile["route_aware"] else F.lit(False)
    return F.when(c("gp") > 60, F.when(tight, 10.0).otherwise(18.0)).when(
        c("gp") > 40, F.when(tight, 15.0).otherwise(25.0))


def corrections(df: DataFrame, cols: tuple[str, str, str, str], profile: dict = PRODUCTION) -> DataFrame:
    """UTS floor, ratio ceiling, elongation cap and modulus override, with the list of rules that fired.

    Adds cor_ys, cor_uts, cor_el, cor_em and notes; applying it to its own output changes nothing.
    """
    ys, uts, el, em = (c(n) for n in cols)
    low = (ys > 0) & (uts < ys)
    floored = F.when(low, ys * 1.05).otherwise(uts)
    limit = ratio_ceiling(profile)
    high = (ys > 0) & (floored / ys > limit + 1e-9)
    cap = elongation_cap(profile)
    long = (el > 0) & cap.isNotNull() & (el > cap)
    target = c("vrh") * modulus_factor(c("temp_c"))
    skip = (c("alloy_class") == "sc_ds") if profile["skip_sc_ds"] else F.lit(False)
    off = (em > 0) & ~skip & (target > 0) & (F.abs(em - target) / target > profile["em_limit"])
    fired = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), name)
    return df.withColumns({
        "cor_ys": ys,
        "cor_uts": F.when(high, ys * limit).otherwise(floored),
        "cor_el": F.when(long, cap).otherwise(el),
        "cor_em": F.when(off, target).otherwise(em),
        "notes": F.array_compact(F.array(
            fired(low, "UTS_FLOOR"), fired(high, "UTS_CAP"), fired(long, "EL_CAP"),
            fired((em > 0) & skip, "EM_SKIPPED"), fired(off, "EM_OVERRIDE"))),
    })


def anchor_weight(distance: Column, midpoint=K.ANCHOR_MIDPOINT, slope=K.ANCHOR_SLOPE) -> Column:
    return 1.0 / (1.0 + F.exp((distance - midpoint) / slope))


def anchor_reject(cutoff=K.ANCHOR_MAX) -> Column:
    """Reason a neighbour may not calibrate the row; empty when it may."""
    limit = F.when(compatible(c("route"), c("kg_route")), cutoff).otherwise(K.ANCHOR_MAX_INCOMPATIBLE)
    return (
        F.when(c("distance").isNull(), "no_match").when(~(c("distance") < limit), "distance")
        .when(mismatch(c("route"), c("kg_route")), "route")
        .when(F.abs(c("gp") - c("kg_gp")) > K.ANCHOR_MAX_GP_DIFF, "fraction_class").otherwise(""))


def anchor_blend(df: DataFrame, midpoint=K.ANCHOR_MIDPOINT, slope=K.ANCHOR_SLOPE, cutoff=K.ANCHOR_MAX) -> DataFrame:
    """Add reject and anc_ys, anc_uts, anc_el: the weighted blend where allowed and far enough apart."""
    df = df.withColumn("reject", anchor_reject(cutoff))
    w = anchor_weight(c("distance"), midpoint, slope)
    out = {}
    for p in ("ys", "uts", "el"):
        ml, kg = c(f"ml_{p}"), c(f"kg_{p}")
        apart = F.try_divide(F.abs(ml - kg) * 100.0, kg) > K.ANCHOR_MIN_DIVERGENCE_PCT
        out[f"anc_{p}"] = F.when((c("reject") == "") & apart, ml * (1.0 - w) + kg * w).otherwise(ml)
    return df.withColumns(out)


def calibration_factors() -> dict[str, Column]:
    """Route factors blended by neighbour distance; 1.0 inside the anchoring range."""
    d = c("distance")
    low_cr = (c("alloy_class") == "sss") & is_wrought(c("route")) & (c("cr_wt") < 18.0)
    weight = F.when(d > 10, 1.0).when(d > 5, 0.8).otherwise(0.5)
    out = {}
    for p, extra in (("ys", True), ("uts", True), ("el", False)):
        f = route_param(f"cal_{p}")
        f = F.when(low_cr, f * 0.93).otherwise(f) if extra else f
        out[p] = F.when(d < K.ANCHOR_MAX, 1.0).otherwise(1.0 + weight * (f - 1.0))
    out["em"] = F.lit(1.0)
    return out


def discrepancy() -> tuple[Column, Column]:
    """Severity and affected properties from the model-against-physics difference."""
    diff = lambda p: F.abs(c(f"ml_{p}") - c(f"phys_{p}")) / F.greatest(c(f"ml_{p}"), c(f"phys_{p}")) * 100
    valid = lambda p: (c(f"ml_{p}") > 0) & (c(f"phys_{p}") > 0)
    high = [valid(p) & (diff(p) > 30) for p in ("ys", "uts")]
    mid = [valid(p) & (diff(p) > 20) for p in ("ys", "uts")]
    severity = F.when(high[0] | high[1], "high").when(mid[0] | mid[1], "moderate").otherwise("none")
    affected = F.array_compact(F.array(F.when(mid[0], F.lit("ys")), F.when(mid[1], F.lit("uts"))))
    return severity, affected


def envelope(value: Column, anchors: list[Column], fallback: Column, tolerance: float) -> Column:
    """The value, or the first anchor when it lies outside the anchors' range by more than the tolerance."""
    ok = value.between(F.least(*anchors) * (1 - tolerance), F.greatest(*anchors) * (1 + tolerance))
    return F.when((value > 0) & ~ok, fallback).otherwise(value)


def proposals(df: DataFrame) -> DataFrame:
    """All correction proposals of a row, exploded: property, proposed, confidence, source."""
    t = c("temp_c").cast("double")
    sss, sc, wrought = c("alloy_class") == "sss", c("alloy_class") == "sc_ds", is_wrought(c("route"))
    ys, uts, el, em, gp = c("ml_ys"), c("ml_uts"), c("ml_el"), c("ml_em"), c("gp")
    has_kg = c("kg_ys").isNotNull()
    pos = lambda x: F.coalesce(x > 0, F.lit(False))

    # Solid-solution rows: physics-heavy blend, UTS from it, elongation by route.
    dev = F.abs(ys - c("phys_ys")) / c("phys_ys") * 100
    s_on = sss & pos(ys) & pos(c("phys_ys")) & (dev > 20)
    s_ys = 0.3 * ys + 0.7 * c("phys_ys")
    s_conf = F.when(dev > 40, "HIGH").otherwise("MEDIUM")
    s_uts = s_ys * compress_ratio(F.when(wrought, 2.0).otherwise(1.5), t)
    cast = c("route") == "cast"
    el_lo, el_hi = F.when(cast, 5.0).otherwise(28.0), F.when(cast, 20.0).otherwise(65.0)
    el_out = (el < el_lo) | (el > el_hi)
    el_dev = F.abs(el - c("phys_el")) / c("phys_el") * 100
    s_el_on = sss & pos(el) & pos(c("phys_el"))

    # High-fraction rows: empirical strength with severity-dependent weight.
    high = (c("alloy_class") == "gp") & (gp > 25) & (c("index_wt") > 4.0)
    f_gp = strength_factor(t, c("alloy_class"), gp)
    lo = F.when(wrought, 470 + 11 * gp).otherwise(350 + 8 * gp) * f_gp
    hi = F.when(wrought, 570 + 15 * gp).otherwise(450 + 12 * gp) * f_gp
    h_on = high & pos(ys) & (ys < lo)
    sev = (lo - ys) / lo
    w = F.when(sev > 0.30, 0.05).when(sev > 0.15, 0.10).otherwise(0.20)
    h_ys = F.least(w * ys + (1.0 - w) * empirical_strength() * f_gp, hi)
    base = 1.15 + gp / 100 * 0.2
    r_def = F.when(wrought, F.when(gp > 40, 1.38).otherwise(1.40)).otherwise(base)
    r_min = F.when(wrought, F.when(gp > 40, 1.25).otherwise(1.15)).otherwise(1.08)
    r_max = F.when(wrought, F.when(gp > 40, 1.45).otherwise(1.60)).otherwise(base + 0.15)
    h_uts = h_ys * compress_ratio(F.when((uts / ys).between(r_min, r_max), uts / ys).otherwise(r_def), t)
    h_el_max = F.when(wrought, 20.0).otherwise(12.0)

    # Single-crystal rows without a very close neighbour.
    c_gate = sc & ((c("distance") > 2.0) | ~has_kg)
    f_sc = strength_factor(t, F.lit("sc_ds"), gp)
    c_lo, c_hi = (510 + 5 * gp) * f_sc, (610 + 7 * gp) * f_sc
    c_sev = (c_lo - ys) / c_lo
    c_on = c_gate & pos(ys) & (c_sev > 0.10)
    c_w = F.when(c_sev > 0.25, 0.02).otherwise(0.05)
    c_ys = F.least(c_w * ys + (1.0 - c_w) * (560 + 6 * gp) * f_sc, c_hi)
    c_fit = (c("phys_uts") / c_ys).between(1.03, 1.30)
    c_uts = F.when(c_fit, c("phys_uts")).otherwise(c_ys * 1.12)

    df = df.withColumns({
        "_s_on": F.coalesce(s_on, F.lit(False)), "_h_on": F.coalesce(h_on, F.lit(False)),
        "_c_on": F.coalesce(c_on, F.lit(False)), "_s_ys": s_ys, "_h_ys": h_ys, "_c_ys": c_ys,
        "_s_uts": s_uts, "_h_uts": h_uts, "_c_uts": c_uts})
    eff_ys = F.when(c("_s_on"), c("_s_ys")).when(c("_h_on"), c("_h_ys")).when(c("_c_on"), c("_c_ys")).otherwise(ys)
    eff_uts = F.when(pos(uts), F.when(c("_s_on"), c("_s_uts")).when(c("_h_on"), c("_h_uts")).when(c("_c_on"), c("_c_uts")).otherwise(uts))
    df = df.withColumns({"_ey": eff_ys, "_eu": eff_uts})

    expected = c("expected_ratio")
    q_min = F.when(sss, F.when(cast, 1.3).otherwise(1.6)).when(sc, 1.03).when(wrought, F.when(gp > 40, 1.25).otherwise(1.15)).otherwise(1.08)
    q_max = F.when(sss, F.when(cast, 1.7).otherwise(2.4)).when(sc, 1.30).when(wrought, F.when(gp > 40, 1.45).otherwise(1.60)).otherwise(base + 0.10)
    hot = (t >= 650) & ~sss & ~sc
    q_exp = F.when(sss, F.when(cast, 1.5).otherwise(2.0)).when(sc, 1.12).when(wrought & (gp > 40) & ~hot, 1.38).otherwise(expected)
    q_min, q_max = (F.when(hot, compress_ratio(x, t)).otherwise(x) for x in (q_min, q_max))
    ratio = c("_eu") / c("_ey")
    target = F.greatest(q_min, F.least(q_max, q_exp))
    q_on = pos(c("_ey")) & pos(c("_eu")) & ((ratio < q_min) | (ratio > q_max))

    em_dev = F.abs(em - c("phys_em")) / c("phys_em") * 100
    em_w = F.when(sss, 0.20).otherwise(0.30)
    allowed = (anchor_reject() == "") & c("distance").isNotNull()
    kg_w = anchor_weight(c("distance"))
    kg_conf = F.when(c("distance") < 1.5, "HIGH").otherwise("MEDIUM")
    tight = ~wrought & ~sc
    cap60, cap40 = F.when(tight, 10.0).otherwise(18.0), F.when(tight, 15.0).otherwise(25.0)

    def item(cond, prop, value, conf, source):
        conf = F.lit(conf) if isinstance(conf, str) else conf
        return F.when(F.coalesce(cond, F.lit(False)), F.struct(
            F.lit(prop).alias("property"), value.alias("proposed"), conf.alias("confidence"), F.lit(source).alias("source")))

    items = [
        item(c("_s_on"), "ys", c("_s_ys"), s_conf, "sss_physics"),
        item(c("_s_on") & pos(uts), "uts", c("_s_uts"), s_conf, "sss_physics"),
        item(s_el_on & el_out, "el", c("phys_el"), F.when(F.abs(el - c("phys_el")) > 20, "HIGH").otherwise("MEDIUM"), "sss_ductility"),
        item(s_el_on & ~el_out & (el_dev > 30), "el", 0.35 * el + 0.65 * c("phys_el"), F.when(el_dev > 40, "HIGH").otherwise("MEDIUM"), "sss_ductility_blend"),
        item(c("_h_on"), "ys", c("_h_ys"), "HIGH", "high_fraction"),
        item(c("_h_on") & pos(uts), "uts", c("_h_uts"), "HIGH", "high_fraction"),
        item(c("_h_on") & (el > h_el_max), "el", F.least(empirical_elongation(), h_el_max), "MEDIUM", "high_fraction"),
        item(c("_c_on"), "ys", c("_c_ys"), "HIGH", "sc_ds_empirical"),
        item(c("_c_on") & pos(uts), "uts", c("_c_uts"), F.when(c_fit, "HIGH").otherwise("MEDIUM"), "sc_ds_ratio"),
        item(c_gate & (el > 15.0), "el", F.least(F.greatest(F.lit(3.0), 22 - 0.15 * gp), F.lit(15.0)), "MEDIUM", "sc_ds_empirical"),
        item(q_on, "uts", c("_ey") * target, F.when(F.abs(ratio - target) > 0.3, "HIGH").otherwise("MEDIUM"), "ratio"),
        item((t > 650) & ~sss & (c("temp_factor") < 0.9) & (ys > c("phys_ys") * 1.3), "ys", c("phys_ys"), "MEDIUM", "temperature"),
        *[item(allowed & (F.abs(c(f"ml_{p}") - c(f"kg_{p}")) / c(f"kg_{p}") * 100 > K.ANCHOR_MIN_DIVERGENCE_PCT), p,
               c(f"ml_{p}") * (1 - kg_w) + c(f"kg_{p}") * kg_w, kg_conf, "anchoring") for p in ("ys", "uts", "el")],
        item((gp > 60) & (el > cap60), "el", cap60, "HIGH", "elongation_bounds"),
        item((gp > 40) & (el > cap40) & ~((gp > 60) & (el > cap60)), "el", cap40, "MEDIUM", "elongation_bounds"),
        item((em > 0) & (em_dev > 15), "em", em_w * em + (1 - em_w) * c("phys_em"), F.when(sss | (em_dev > 20), "HIGH").otherwise("MEDIUM"), "modulus_blend"),
        item(pos(ys) & (c("distance") >= K.ANCHOR_MAX), "ys", ys * route_param("cal_ys"), "LOW", "calibration"),
    ]
    return df.select("entity", "temp_c", F.posexplode(F.array_compact(F.array(*items))).alias("pos", "p")).select(
        "entity", "temp_c", "pos", "p.property", "p.proposed", "p.confidence", "p.source")


def best_proposals(props: DataFrame) -> DataFrame:
    """Best per property by (confidence, source priority); on a tie the first listed wins."""
    conf = F.when(c("confidence") == "HIGH", 3).when(c("confidence") == "MEDIUM", 2).otherwise(1)
    source = F.when(c("source") == "anchoring", 2).when(c("source") == "calibration", 0).otherwise(1)
    pick = F.max_by(F.struct("proposed", "confidence", "source"), F.struct(conf, source, -c("pos")))
    return props.groupBy("entity", "temp_c", "property").agg(pick.alias("b")).select(
        "entity", "temp_c", "property", "b.proposed", "b.confidence", "b.source")
