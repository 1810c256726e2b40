"""Class rules over a composition map, as ordered CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meltwise import constants as K
from meltwise.operators.common import part_of as p


def tcp_class(md_gamma: Column, md_avg: Column) -> Column:
    """Four levels on bulk Md; a matrix Md above the boost limit raises the level by one."""
    level = (
        F.when(md_avg > K.TCP_CRITICAL, 3).when(md_avg > K.TCP_ELEVATED, 2)
        .when(md_avg > K.TCP_MODERATE, 1).otherwise(0)
    )
    raised = F.least(level + F.when(md_gamma > K.TCP_MATRIX_BOOST, 1).otherwise(0), F.lit(3))
    return F.element_at(F.array(*[F.lit(x) for x in K.TCP_LEVELS]), raised + 1)


def tcp_rank(risk: Column) -> Column:
    return F.array_position(F.array(*[F.lit(x) for x in K.TCP_LEVELS]), risk) - 1


def former_index() -> Column:
    return p("Al") + p("Ti") + p("Ta") + 0.35 * p("Nb")


def is_sss() -> Column:
    return former_index() < K.SSS["former_max"]


def is_wrought(route: Column) -> Column:
    return route.isin(K.WROUGHT_ROUTES)


def is_sc_ds(route: Column) -> Column:
    """Single crystal or directionally solidified by composition; never for wrought routes."""
    ta_w = p("Ta") + p("W")
    rhenium = (p("Re") >= 2.0) | ((p("Ru") >= 1.0) & (p("Re") >= 1.0)) | ((ta_w >= 10.0) & (p("Re") >= 1.0))
    low_carbon = (p("C") < 0.06) & (
        ((ta_w >= 11.0) & (p("Ta") >= 5.0)) | (p("Ta") >= 10.0) | ((ta_w >= 12.0) & (p("W") >= 8.0))
    )
    return ~is_wrought(route) & (rhenium | low_carbon)


def physics_class(route: Column) -> Column:
    return F.when(is_sss(), "sss").when(is_sc_ds(route), "sc_ds").otherwise("gp")


def curation_class() -> Column:
    """(is_superalloy, strengthening, precipitate, reason, class) by ordered rules."""
    ni, cu, fe, nb = p("Ni"), p("Cu"), p("Fe"), p("Nb")
    al_ti, mo_w = p("Al") + p("Ti"), p("Mo") + p("W")

    def verdict(keep, strengthening, precipitate, reason, label):
        text = lambda v: F.lit(v).cast("string")
        return F.struct(
            F.lit(keep).alias("is_superalloy"), text(strengthening).alias("strengthening"),
            text(precipitate).alias("precipitate"), text(reason).alias("reason"),
            text(label).alias("label"),
        )

    return (
        F.when(ni < 40, verdict(False, "unknown", None, "low nickel", "standard"))
        .when(ni > 95, verdict(False, "unknown", None, "pure nickel", "pure_nickel"))
        .when(cu > 25, verdict(False, "unknown", None, "nickel-copper", "nickel_copper"))
        .when((fe > 20) & (ni < 55), verdict(False, "unknown", None, "iron-nickel", "iron_nickel"))
        .when((nb >= 3.0) & (al_ti < 3.0) & (nb / (al_ti + 0.01) >= 1.0),
              verdict(True, "precipitation", "gamma_double_prime", None, "in718_type"))
        .when(al_ti >= 2.0, verdict(True, "precipitation", "gamma_prime", None, "gamma_prime_strengthened"))
        .when((mo_w > 10) & (al_ti < 1.5), verdict(True, "solid_solution", None, None, "solid_solution"))
        .when(al_ti >= 0.5, verdict(True, "precipitation", "gamma_prime", None, "low_gamma_prime"))
        .otherwise(verdict(True, "solid_solution", None, None, "solid_solution"))
    )


def split_class() -> Column:
    al_ti = p("Al") + p("Ti")
    return (
        F.when(al_ti > 7, "single_crystal_type")
        .when((p("Nb") >= 3.0) & (al_ti < 3.0), "gamma_double_prime")
        .when(al_ti >= 3.0, "gamma_prime_high")
        .when(al_ti >= 1.5, "gamma_prime_medium")
        .when(p("Mo") + p("W") > 10, "solid_solution")
        .otherwise("other")
    )


# Name tokens that mark single-crystal or directionally solidified products.
NAME_TOKENS = ["(SC)", "(DS)", "CMSX", "PWA 14", "PWA*14", "Rene N", "RENÉ* N",
               "TMS-", "DD5", "DD6", "DD9", "DD98", "RR30"]


def scope_class(name: Column, tokens: list[str] = NAME_TOKENS) -> Column:
    """(category, reason) from the name tokens and Al+Ti."""
    ni, al_ti = p("Ni"), p("Al") + p("Ti")
    named = F.exists(F.array(*[F.lit(t) for t in tokens]), lambda t: F.contains(name, t))
    pair = lambda c, r: F.struct(F.lit(c).alias("category"), F.lit(r).alias("reason"))
    return (
        F.when(ni > 95, pair("other", "pure nickel"))
        .when(p("Cu") > 20, pair("other", "nickel-copper"))
        .when((ni < 40) & (p("Co") > ni), pair("other", "cobalt base"))
        .when(ni < 40, pair("other", "iron-nickel base"))
        .when(al_ti < 2, pair("solid_solution", "low Al+Ti"))
        .when(named & (al_ti >= 6), pair("precip_sc_ds", "high"))
        .when(named, pair("precip_sc_ds", "standard"))
        .when(al_ti >= 6, pair("precip_poly", "high"))
        .otherwise(pair("precip_poly", "standard"))
    )


def axiom_class(formers_wt: Column) -> Column:
    return F.when(formers_wt >= 2.0, "precipitate").otherwise("solid_solution")


def axiom_tcp(md_avg: Column) -> Column:
    return (
        F.when(md_avg >= K.TCP_CRITICAL, "Critical").when(md_avg >= K.TCP_ELEVATED, "Elevated")
        .when(md_avg >= K.TCP_MODERATE, "Moderate").otherwise("Low")
    )
