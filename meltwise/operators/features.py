"""Physics features of a composition table.

Input is one row per entity with ``composition MAP<STRING, DOUBLE>`` in weight percent. The map is
turned once into an array over the declared element vocabulary, and tasks work the features out for blocks of
compositions, a column of numbers at a time: no shuffle, and the work is embarrassingly parallel in the compositions.
"""

from __future__ import annotations

import math
from decimal import ROUND_HALF_EVEN, Decimal

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meltwise import constants as K
from meltwise.functions.classify import tcp_class

c = F.col
ELEMENTS = list(K.ATOMIC_WEIGHT)
POSITION = {e: i for i, e in enumerate(ELEMENTS)}


def constant_array(table: dict, default: float = 0.0) -> str:
    """SQL text of the constants in vocabulary order."""
    return "array(" + ", ".join(f"{float(table.get(e, default))!r}D" for e in ELEMENTS) + ")"


def dot(array: str, table: dict, default: float = 0.0) -> str:
    """SQL text of sum(array[i] * constant[i])."""
    consts = constant_array(table, default)
    return f"aggregate(zip_with({array}, {consts}, (x, k) -> x * k), 0D, (s, x) -> s + x)"


def pick(array: str, names: list[str]) -> str:
    return "(" + " + ".join(f"{array}[{POSITION[e]}]" for e in names) + ")"


def _sum(array: str) -> str:
    return f"aggregate({array}, 0D, (s, x) -> s + x)"


def atomic_shares(df: DataFrame, rounded: bool = False) -> DataFrame:
    """Add ``_w`` (wt%) and ``_at`` (at%) arrays over the vocabulary.

    Only known elements with a positive amount count. ``rounded`` cuts the shares to two decimals
    before anything uses them.
    """
    names = "array(" + ", ".join(f"'{e}'" for e in ELEMENTS) + ")"
    share = "coalesce(try_divide(x, _n), 0D) * 100"
    share = f"bround({share}, 2)" if rounded else share
    return (
        df.selectExpr("*", f"transform({names}, e -> coalesce(try_element_at(composition, e), 0D)) AS _w")
        .selectExpr("*", f"zip_with(_w, {constant_array(K.ATOMIC_WEIGHT)}, (x, a) -> greatest(x, 0D) / a) AS _m")
        .selectExpr("*", f"{_sum('_m')} AS _n")
        .selectExpr("*", f"transform(_m, x -> {share}) AS _at")
        .drop("_m", "_n")
    )


def _dot(x: np.ndarray, table: dict, default: float = 0.0) -> np.ndarray:
    """Sum of x times the element constants, added up in vocabulary order."""
    out = np.zeros(len(x))
    for i, e in enumerate(ELEMENTS):
        out += x[:, i] * float(table.get(e, default))
    return out


def _half_even(x: np.ndarray, digits: int) -> np.ndarray:
    """Decimal rounding of the printed values, ties to even, as ``bround``."""
    unit = Decimal(1).scaleb(-digits)
    one = lambda v: float(Decimal(repr(v)).quantize(unit, ROUND_HALF_EVEN)) if math.isfinite(v) else v
    return np.array([one(v) for v in x.ravel().tolist()], float).reshape(x.shape)


def _or(x: np.ndarray, default: float) -> np.ndarray:
    return np.where(np.isnan(x), default, x)


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, NaN (null) where b is zero."""
    return np.divide(a, b, out=np.full(np.broadcast_shapes(a.shape, b.shape), np.nan), where=b != 0)


def _density(w: np.ndarray, wt: np.ndarray) -> np.ndarray:
    rho = {e: 1.0 / K.DENSITY.get(e, K.DEFAULT_DENSITY) for e in ELEMENTS}
    return _or(_ratio(wt, _dot(w, rho) + (wt - _dot(w, {}, 1.0)) / K.DEFAULT_DENSITY), K.DEFAULT_DENSITY)


def _modulus(w: np.ndarray) -> np.ndarray:
    """Mean of the arithmetic and harmonic mixing bounds over the listed elements."""
    weight = _dot(w, {e: 1.0 for e in K.MODULUS})
    inverse = _dot(w, {e: 1.0 / m for e, m in K.MODULUS.items()})
    return _or((_ratio(_dot(w, K.MODULUS), weight) + _ratio(weight, inverse)) / 2, K.DEFAULT_MODULUS)


def _features(w: np.ndarray, wt: np.ndarray, rounded: bool) -> dict[str, np.ndarray]:
    """Every feature of a block of compositions: one column of ``w`` per element, ``wt`` the totals."""
    of = lambda x, *names: sum((x[:, POSITION[e]] for e in names[1:]), x[:, POSITION[names[0]]])
    m = np.maximum(w, 0.0) / np.array([K.ATOMIC_WEIGHT[e] for e in ELEMENTS])
    at = _or(_ratio(m, _dot(m, {}, 1.0)[:, None]), 0.0) * 100
    at = _half_even(at, 2) if rounded else at
    formers = sum((v * at[:, POSITION[e]] for e, v in K.FORMER_WEIGHT.items()), 0.0)
    soluble = sum((v * at[:, POSITION[e]] for e, v in K.SOLUBILITY.items()), 0.0)
    excess = np.maximum(0.0, formers - (K.SOLUBILITY_BASE + soluble))
    gp = np.maximum(0.0, np.minimum(85.0, 6.0 * np.minimum(excess, at[:, POSITION["Ni"]] / 3.6)))
    gp = _half_even(gp, 1) if rounded else gp
    f = np.maximum(0.01, np.minimum(0.9, gp / 100))[:, None]
    k = np.array([K.PARTITION.get(e, 1.0) for e in ELEMENTS])
    g = at / (f * k + (1 - f))
    p = g * k
    tg, tp = _dot(g, {}, 1.0), _dot(p, {}, 1.0)
    radius = K.RADIUS["Ni"]
    strengthen = np.zeros(len(w))
    for e, v in K.SSS_COEFF.items():
        strengthen += np.power(_ratio(g[:, POSITION[e]], tg), 0.67) * ((abs(K.RADIUS.get(e, radius) - radius) / radius) ** 1.3 * v)
    cr, al, ti = (w[:, POSITION[e]] for e in ("Cr", "Al", "Ti"))
    oxide = cr + al
    return {
        "gp": gp,
        "md_avg": _dot(at, K.MD) / 100,
        "md_gamma": _ratio(_dot(g, K.MD), tg),
        "vec_avg": _dot(at, K.VALENCE) / 100,
        "a_gamma": K.LATTICE_NI + _or(_ratio(_dot(g, K.LATTICE), tg), 0.0),
        "a_precipitate": K.LATTICE_NI + _or(_ratio(_dot(p, K.LATTICE), tp), 0.0),
        "density": _density(w, wt),
        "sss_coeff": _or(strengthen, 0.0),
        "vrh": _modulus(w),
        "potency_sum": _dot(w, K.POTENCY),
        "ppt": np.sqrt(gp / 100) * of(at, "Al", "Ti") / 100 * 10,
        "creep": 2 * of(at, "Re") + 1.5 * of(at, "Ru") + of(at, "W"),
        "oxidation": np.where(oxide < 1, 0.0, _ratio(cr, oxide) * (np.minimum(cr, 15.0) + np.minimum(al, 8.0))),
        "sss_wt": of(w, "Mo", "W", "Nb", "Ta", "Re"),
        "refractory_wt": of(w, "Mo", "W", "Ta", "Re", "Nb", "Hf"),
        "formers_wt": of(w, "Al", "Ti", "Ta", "Nb"),
        "formers_at": of(at, "Al", "Ti", "Ta", "Nb"),
        "al_ti_ratio": al / (ti + 0.01),
        "cr_co_ratio": cr / (of(w, "Co") + 0.01),
        "cr_ni_ratio": cr / (of(w, "Ni") + 0.01),
        "mo_w_ratio": of(w, "Mo") / (of(w, "W") + 0.01),
        "al_ti_at_ratio": of(at, "Al") / (of(at, "Ti") + 0.01),
        "al_ti_interaction": of(at, "Al") * of(at, "Ti"),
        "cr_al_interaction": cr * al,
        "grain_boundary_at": of(at, "C", "B", "Hf", "Zr"),
        "ductility_reducer_at": of(at, "Re", "W", "Mo"),
        "heavy_at": of(at, "W", "Re", "Ta", "Hf"),
        "light_at": of(at, "Al", "Ti"),
        "index_wt": al + ti + of(w, "Ta") + 0.35 * of(w, "Nb"),
        **{f"{e.lower()}_wt": of(w, e) for e in ("Al", "Ti", "Ta", "W", "Re", "Cr", "Nb", "Mo", "Co")},
        "_at": at, "_g": _ratio(g, tg[:, None]) * 100, "_p": _ratio(p, tp[:, None]) * 100,
    }


SHARES = {"_at": "atomic_percent", "_g": "gamma_at", "_p": "precipitate_at"}
FIELDS = [n for n in _features(np.zeros((0, len(ELEMENTS))), np.zeros(0), False) if n not in SHARES]


def _amounts() -> tuple[Column, Column]:
    """Amounts in vocabulary order, and the total of all amounts, listed or not."""
    names = "array(" + ", ".join(f"'{e}'" for e in ELEMENTS) + ")"
    return F.expr(f"transform({names}, e -> coalesce(try_element_at(composition, e), 0D))"), F.expr(_sum("map_values(composition)"))


def density_shifts(df: DataFrame, names: list[str], step: float) -> DataFrame:
    """One row per composition and named element: its amount up and down by the step (not below zero) and the densities there,
    Ni taking the balance: (..., element, amount_up, amount_down, density_up, density_down)."""
    parts = ["amount_up", "amount_down", "density_up", "density_down"]

    @F.pandas_udf("struct<" + ", ".join(f"{n}:array<double>" for n in parts) + ">")
    def shifts(w: pd.Series, wt: pd.Series) -> pd.DataFrame:
        block = np.stack(w.to_numpy()) if len(w) else np.zeros((0, len(ELEMENTS)))
        total, ni = wt.to_numpy(float), POSITION["Ni"]
        out = {n: np.zeros((len(block), len(names))) for n in parts}
        for j, e in enumerate(names):
            for side, sign in (("up", 1), ("down", -1)):
                x, i = block.copy(), POSITION[e]
                x[:, i] = np.maximum(0.0, block[:, i] + sign * step)
                rest = total - block[:, ni] - block[:, i]
                x[:, ni] = 100.0 - rest - x[:, i]
                out[f"amount_{side}"][:, j] = x[:, i]
                out[f"density_{side}"][:, j] = _density(x, rest + x[:, i] + x[:, ni])
        return pd.DataFrame({n: list(v) for n, v in out.items()})

    each = F.posexplode(F.array(*[F.lit(e) for e in names])).alias("_i", "element")
    x = df.withColumn("_s", shifts(*_amounts())).select(*df.columns, "_s", each)
    return x.select(*df.columns, "element", *[F.get(f"_s.{n}", c("_i")).alias(n) for n in parts])


def featurize(df: DataFrame, rounded: bool = False, maps: bool = False, least: float = 0.01) -> DataFrame:
    """One row of features per input row; keeps the input's other columns.

    ``maps`` adds the atomic percent and the two phase compositions as maps, the latter of shares above ``least``
    percent. ``rounded`` cuts atomic shares to two decimals and the fraction to one before they are used.
    """
    extra = list(SHARES) if maps else []
    types = [*(f"{n} double" for n in FIELDS), *(f"{n} array<double>" for n in extra)]

    @F.pandas_udf("struct<" + ", ".join(x.replace(" ", ":", 1) for x in types) + ">")
    def features(w: pd.Series, wt: pd.Series) -> pd.DataFrame:
        block = np.stack(w.to_numpy()) if len(w) else np.zeros((0, len(ELEMENTS)))
        out = _features(block, wt.to_numpy(float), rounded)
        return pd.DataFrame({n: list(out[n]) if n in SHARES else out[n] for n in [*FIELDS, *extra]})

    features = features.asNondeterministic()  # else a filter on a feature works them all out twice
    out = df.withColumn("_feat", features(*_amounts())).select(*df.columns, "_feat.*")
    names = F.array(*[F.lit(e) for e in ELEMENTS])
    for n in extra:
        above = 0.0 if n == "_at" else least
        out = out.withColumn(SHARES[n], F.map_filter(F.map_from_arrays(names, c(n)), lambda _, v: v > above)).drop(n)  # noqa: B023
    return out.withColumns({
        "mismatch": 200.0 * (c("a_precipitate") - c("a_gamma")) / (c("a_precipitate") + c("a_gamma")),
        "tcp_risk": tcp_class(c("md_gamma"), c("md_avg")),
    })
