"""Half-open bins as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from meltwise import constants as K


def bin_of(value: Column, bins: list[tuple[str, float, float | None]]) -> Column:
    """Label of the half-open bin [lo, hi); an open top bin has hi = None."""
    out = None
    for label, lo, hi in bins:
        cond = value >= lo if hi is None else (value >= lo) & (value < hi)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def stratum_of(distance: Column) -> Column:
    return bin_of(distance, K.STRATA)


def temperature_regime(temp_c: Column) -> Column:
    """Room below 100, intermediate up to and including 700, high above."""
    return F.when(temp_c < 100, "room").when(temp_c <= 700, "intermediate").otherwise("high")
