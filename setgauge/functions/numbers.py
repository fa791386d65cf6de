"""Small numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(value: Column, digits: int = 6) -> Column:
    """Round for comparison; the added zero turns -0.0 into 0.0."""
    return F.round(value.cast("double"), digits) + F.lit(0.0)


def half_point(value: Column) -> Column:
    """Nearest half point, halves going to the even neighbour."""
    return F.bround(value * 2) / 2


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(value, F.lit(high)), F.lit(low))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def snap(value: Column, bits: int = 30) -> Column:
    """Nearest multiple of 2**-bits, so that rounding noise decides no comparison.

    Doubles of 2**(52 - bits) and more have no finer digits and stay as they are.
    """
    scale = float(2**bits)
    return F.when(F.abs(value) >= float(2 ** (52 - bits)), value).otherwise(F.floor(value * scale + 0.5) / scale)
