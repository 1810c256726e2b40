"""Temperature laws as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meltwise import constants as K


def _sss_curve(t: Column) -> Column:
    s = K.SSS
    at1 = 1.0 - s["slow"] * (s["t1"] - 25.0)
    middle = at1 * F.exp(-(t - s["t1"]) / s["tau1"])
    end = at1 * F.exp(F.lit(-(s["t2"] - s["t1"]) / s["tau1"])) * F.exp(-(t - s["t2"]) / s["tau2"])
    curve = (
        F.when(t <= s["t1"], 1.0 - s["slow"] * (t - 25.0)).when(t <= s["t2"], middle).otherwise(end)
    )
    return F.greatest(curve, F.lit(s["floor"]))


def _sc_ds_curve(t: Column) -> Column:
    s = K.SC_DS
    knee = 1.0 - s["linear"] * (s["t1"] - 25.0)
    curve = F.when(t <= s["t1"], 1.0 - s["linear"] * (t - 25.0)).otherwise(
        knee * F.exp(-(t - s["t1"]) / s["tau"])
    )
    return F.greatest(curve, F.lit(s["floor"]))


def _gp_curve(t: Column, gp_pct: Column) -> Column:
    g = K.GP
    gp = F.greatest(F.lit(2.0), F.least(F.lit(70.0), gp_pct))
    solvus = g["solvus_base"] + g["solvus_per_pct"] * gp
    knee = F.greatest(
        F.lit(500.0),
        F.least(F.lit(850.0), g["stage1"] * F.least(F.lit(1.0), F.sqrt(gp / g["ref"]))),
    )
    tau2 = g["tau2"] * F.greatest(F.lit(0.5), F.least(F.lit(3.0), gp / g["ref"]))
    at_knee = 1.0 - g["linear"] * (knee - 25.0)
    curve = (
        F.when(t <= knee, 1.0 - g["linear"] * (t - 25.0))
        .when(t <= solvus, at_knee * F.exp(-(t - knee) / g["tau1"]))
        .otherwise(at_knee * F.exp(-(solvus - knee) / g["tau1"]) * F.exp(-(t - solvus) / tau2))
    )
    floor = F.greatest(F.lit(0.3), 1.0 - gp / 100.0) * _sss_curve(t)
    return F.greatest(curve, floor, F.lit(g["floor"]))


def strength_factor(t: Column, alloy_class: Column, gp_pct: Column) -> Column:
    """Share of room-temperature strength kept at ``t`` for the three families."""
    t = t.cast("double")
    return (
        F.when(t <= 25, 1.0)
        .when(alloy_class == "sss", _sss_curve(t))
        .when(alloy_class == "sc_ds", _sc_ds_curve(t))
        .otherwise(_gp_curve(t, gp_pct))
    )


def modulus_factor(t: Column) -> Column:
    drop = K.EM_DECAY * F.greatest(F.lit(0.0), t - K.EM_BASE_T)
    return F.greatest(F.lit(K.EM_FLOOR), 1.0 - drop)


def compress_ratio(ratio: Column, t: Column) -> Column:
    """Two-stage compression of the UTS/YS ratio towards 1 above 650 C."""
    stage = lambda x: 1.0 + (ratio - 1.0) * F.greatest(F.lit(0.2), 1.0 - 0.003 * x)
    return (
        F.when(t < 650, ratio)
        .when(t <= 800, stage(t - 650))
        .otherwise(1.0 + (stage(F.lit(150.0)) - 1.0) * F.exp(-(t - 800) / 50.0))
    )


def temperature_features(t: Column) -> dict[str, Column]:
    """Polynomial, logarithmic and inverse terms of the clipped temperature."""
    c = F.greatest(F.lit(-270.0), F.least(F.lit(1500.0), t.cast("double")))
    kelvin = F.greatest(c + 273.15, F.lit(1.0))
    return {
        "t_c": c, "t_sq": c * c, "t_cube": c * c * c, "log_k": F.log(kelvin),
        "inv_k": 1.0 / kelvin, "t_norm": (c - 20.0) / 1080.0,
    }
