"""Null-safe arithmetic. Missing is NULL everywhere; NaN never survives ingest."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import STD_FLOOR


def col_of(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def clean(value) -> Column:
    """NaN and infinities become NULL."""
    c = col_of(value).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def ratio(numerator, denominator) -> Column:
    """Division that gives NULL on a zero or missing denominator."""
    return F.try_divide(col_of(numerator), F.nullif(col_of(denominator), F.lit(0.0)))


def nonzero_std(value) -> Column:
    """A spread that is zero up to rounding counts as missing."""
    c = col_of(value)
    return F.when(c >= STD_FLOOR, c)


def half_up(value, digits: int) -> Column:
    """``F.round`` of a double, without its detour over a decimal string wherever the value is no near tie.

    The nearest integer to the scaled value, divided by an exact power of ten, is the double next to that decimal, which is what
    ``F.round`` gives. Near ties (the scaled value is off by less than its last bits), huge and missing values go to ``F.round``.
    """
    c, power = col_of(value), F.lit(float(10 ** digits))
    scaled = c * power
    whole = F.rint(scaled)
    clear = F.abs(scaled - whole) + F.abs(scaled) * F.lit(2.0 ** -50) < 0.49
    return F.when(clear, whole / power).otherwise(F.round(c, digits))


def stable(value, digits: int = 10) -> Column:
    """Round a value before it is ranked, so that sums taken in another order rank the same."""
    return half_up(value, digits) + F.lit(0.0)
