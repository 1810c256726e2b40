"""Closed-form property estimates per (entity, temperature) over featurised compositions.

Inputs carry the columns of ``featurize`` plus ``route``, ``alloy_class`` and ``temp_c``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meltwise import constants as K
from meltwise.functions.classify import is_wrought
from meltwise.functions.thermal import compress_ratio, modulus_factor, strength_factor

c = F.col


def route_param(name: str, route: Column | None = None) -> Column:
    route = c("route") if route is None else route
    return F.when(is_wrought(route), K.ROUTE["wrought"][name]).otherwise(K.ROUTE["cast"][name])


def sss_strength() -> Column:
    """Base plus potency sum plus grain term, reduced for castings, clamped."""
    s = K.SSS
    grain = F.when(c("route") == "wrought", s["hp_wrought"]).otherwise(s["hp_cast"])
    raw = s["sigma_base"] + c("potency_sum") + grain
    raw = F.when(c("route") == "cast", raw * s["cast_reduction"]).otherwise(raw)
    return F.greatest(F.lit(s["ys_min"]), F.least(F.lit(s["ys_max"]), raw))


def precipitate_strength() -> Column:
    boost = F.least(F.abs(c("mismatch")), F.lit(0.5)) * 100.0
    return (
        route_param("base") + route_param("hp") + route_param("sss") * c("sss_wt")
        + route_param("coeff_gp") * c("gp") + boost
    )


def physics_predict(df: DataFrame, el_cap: float = 120.0) -> DataFrame:
    """Add phys_ys, phys_uts, phys_el, phys_em and phys_gp."""
    t = c("temp_c").cast("double")
    sss = c("alloy_class") == "sss"
    cast = c("route") == "cast"
    factor = strength_factor(t, c("alloy_class"), c("gp"))
    ys = F.when(sss, sss_strength()).otherwise(precipitate_strength()) * factor

    s = K.SSS
    base = F.when(cast, s["ratio_cast"]).otherwise(s["ratio_wrought"])
    sss_ratio = F.when(t > 500, 1.3 + (base - 1.3) * F.exp(-(t - 500) / 300.0)).otherwise(base)
    gp_ratio = compress_ratio(
        F.when(is_wrought(c("route")), F.when(c("gp") > 40, 1.38).otherwise(1.40))
        .otherwise(1.15 + c("gp") / 100.0 * 0.2),
        t,
    )
    sss_el = F.when(cast, s["el_cast"]).otherwise(s["el_wrought"])
    sss_el = F.when(
        t > s["el_t"], F.least(F.lit(65.0), sss_el * F.exp(s["el_rate"] * (t - s["el_t"])))
    ).otherwise(sss_el)
    gp_el = F.greatest(route_param("el_min"), route_param("ductility") - 0.8 * c("gp"))
    gp_el = F.when(
        t >= 650, F.least(F.lit(el_cap), gp_el * (1.0 + K.GP["el_rate"] * (t - 650)))
    ).otherwise(gp_el)
    return df.withColumn("phys_ys", ys).withColumns({
        "phys_uts": c("phys_ys") * F.when(sss, sss_ratio).otherwise(gp_ratio),
        "phys_el": F.when(sss, sss_el).otherwise(gp_el),
        "phys_em": c("vrh") * modulus_factor(t),
        "phys_gp": F.when(sss, 0.0).otherwise(c("gp")),
    })


def empirical_strength() -> Column:
    return F.when(is_wrought(c("route")), 520 + 13 * c("gp")).otherwise(400 + 10 * c("gp"))


def empirical_elongation() -> Column:
    return F.when(is_wrought(c("route")), F.greatest(F.lit(10.0), 28 - 0.28 * c("gp"))).otherwise(
        F.greatest(F.lit(4.0), 18 - 0.25 * c("gp"))
    )


def screen_predict(df: DataFrame) -> DataFrame:
    """Discounted estimates used for screening: scr_ys, scr_uts, scr_el, scr_em."""
    t = c("temp_c").cast("double")
    sss = c("alloy_class") == "sss"
    rt = F.when(sss, sss_strength()).otherwise(precipitate_strength())
    ys = rt * route_param("cal_ys") * 0.82 * strength_factor(t, c("alloy_class"), c("gp"))
    ratio = F.when(is_wrought(c("route")), F.when(c("gp") > 40, 1.15).otherwise(1.40)).otherwise(
        1.10 + c("gp") / 100 * 0.15 + 0.10
    )
    return df.withColumn("scr_ys", ys).withColumns({
        "scr_uts": c("scr_ys") * compress_ratio(ratio, t),
        "scr_el": F.when(sss, 40.0).otherwise(empirical_elongation()),
        "scr_em": c("vrh") * modulus_factor(t),
    })


def blended_predict(df: DataFrame) -> DataFrame:
    """Blend model columns ml_ys, ml_uts, ml_el, ml_em with the empirical laws by class."""
    t = c("temp_c").cast("double")
    sss = c("alloy_class") == "sss"
    family = F.when(sss, "sss").otherwise("gp")
    law = F.when(sss, sss_strength()).otherwise(empirical_strength()) * strength_factor(t, family, c("gp"))
    ys = F.when(sss, 0.30 * c("ml_ys") + 0.70 * law).otherwise(0.20 * c("ml_ys") + 0.80 * law)
    default = F.when(sss, 1.5).otherwise(1.4)
    ratio = F.when(c("ml_ys") > 0, c("ml_uts") / c("ml_ys")).otherwise(default)
    ratio = compress_ratio(F.greatest(F.lit(1.0), F.least(ratio, F.lit(1.8))), t)
    return df.withColumn("bl_ys", ys).withColumns({
        "bl_uts": c("bl_ys") * ratio,
        "bl_el": F.when(sss, c("ml_el")).otherwise(0.5 * c("ml_el") + 0.5 * empirical_elongation()),
        "bl_em": 0.30 * c("ml_em") + 0.70 * c("vrh") * modulus_factor(t),
    })
