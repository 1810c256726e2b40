"""Tail probabilities as column expressions: incomplete gamma and beta functions by series and continued fractions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lanczos coefficients for g = 7.
LANCZOS = [
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
]
STEPS = 1000  # terms at most; a value that has settled is left as it is
TINY, SETTLED = 1e-300, 1e-15


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x of 0.5 or more."""
    series = F.lit(LANCZOS[0])
    for i, k in enumerate(LANCZOS[1:]):
        series = series + k / (x + i)
    t = x + 6.5
    return 0.9189385332046727 + (x - 0.5) * F.log(t) - t + F.log(series)


def _bound(value: Column, use) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _nonzero(x: Column) -> Column:
    return F.when(F.abs(x) < TINY, F.lit(TINY)).otherwise(x)


def _fraction(first: Column, term) -> Column:
    """A continued fraction by Lentz's method; ``term(i, state)`` gives the i-th pair (numerator, denominator).

    ``first`` is the leading denominator.
    """
    start = F.struct(_nonzero(first).alias("f"), _nonzero(first).alias("c"), F.lit(0.0).alias("d"), F.lit(False).alias("done"))

    def step(s: Column, i: Column) -> Column:
        a, b = term(i.cast("double"))
        d = 1.0 / _nonzero(b + a * s["d"])
        c = _nonzero(b + a / s["c"])
        delta = c * d
        return F.when(s["done"], s).otherwise(F.struct((s["f"] * delta).alias("f"), c.alias("c"), d.alias("d"), (F.abs(delta - 1.0) < SETTLED).alias("done")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)["f"]


def gamma_tail(a: Column, x: Column) -> Column:
    """Upper regularised incomplete gamma function Q(a, x)."""
    weight = F.exp(a * F.log(x) - x - log_gamma(a))
    start = F.struct((1.0 / a).alias("t"), (1.0 / a).alias("s"))
    grow = lambda s, n: _bound(s["t"] * x / (a + n), lambda t: F.struct(t.alias("t"), (s["s"] + t).alias("s")))
    low = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, grow)["s"] * weight
    high = weight / _fraction(x + 1.0 - a, lambda i: (-i * (i - a), x + 2.0 * i + 1.0 - a))
    return F.when(x <= 0, 1.0).when(x < a + 1.0, 1.0 - low).otherwise(high)


def _beta_fraction(a: Column, b: Column, x: Column) -> Column:
    def term(i: Column) -> tuple[Column, Column]:
        m = F.floor(i / 2.0)
        even = m * (b - m) * x / ((a + 2.0 * m - 1.0) * (a + 2.0 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 2.0 * m + 1.0))
        return F.when(i % 2.0 == 0, even).otherwise(odd), F.lit(1.0)

    weight = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1.0 - x)) / a
    return weight / _fraction(F.lit(1.0), term)


def beta_share(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta function I_x(a, b)."""
    direct = x < (a + 1.0) / (a + b + 2.0)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(direct, _beta_fraction(a, b, x)).otherwise(1.0 - _beta_fraction(b, a, 1.0 - x))


def chi2_tail(x: Column, df: Column) -> Column:
    """Probability of a chi-square value of ``x`` or more."""
    return gamma_tail(df / 2.0, x / 2.0)


def t_two_sided(t: Column, df: Column) -> Column:
    """Probability of a t value as far from 0 as ``t`` or farther."""
    return beta_share(df / 2.0, F.lit(0.5), df / (df + t * t))
