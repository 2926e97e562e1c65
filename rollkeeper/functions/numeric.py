"""Confidence arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLITTER = 134217729.0  # 2**27 + 1, Dekker's constant for an exact product


def round2(value: Column) -> Column:
    """Round a non-negative double to 2 places, half to even on its exact binary value.

    ``round``/``bround`` decide ties on the shortest decimal text, which differs
    from the IEEE value (0.575 is below the tie). Here ``err`` is the exact error
    of ``value * 200``, so the side of the tie is known. The value is used many
    times, so pass a plain column.
    """
    v = value.cast("double")
    p = v * F.lit(200.0)
    hi = (F.lit(_SPLITTER) * v) - ((F.lit(_SPLITTER) * v) - v)
    err = (hi * F.lit(200.0) - p) + ((v - hi) * F.lit(200.0))
    n = F.floor(p)
    half = F.floor(p / F.lit(2.0))
    k = (
        F.when(n % 2 == 0, half)
        .when((p > n) | (err > 0), half + 1)
        .when(err < 0, half)
        .otherwise(half + half % 2)
    )
    return k / F.lit(100.0)


def clamp01(value: Column) -> Column:
    return F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))


def blended_confidence(mark_confidence: Column, row_confidence: Column) -> Column:
    """Three parts mark rule, one part reading confidence, kept inside [0.40, 0.99].

    Unrounded: put it in a column, then apply ``round2``.
    """
    mixed = mark_confidence * F.lit(0.75) + row_confidence * F.lit(0.25)
    return F.least(F.greatest(mixed, F.lit(0.40)), F.lit(0.99))


def confidence_band(value: Column) -> Column:
    return F.when(value >= 0.90, "HIGH").when(value >= 0.70, "MEDIUM").otherwise("LOW")


def percent(value: Column) -> Column:
    """Whole percent, halves up; a missing value shows as 0."""
    return F.floor(F.coalesce(value, F.lit(0.0)) * F.lit(100.0) + F.lit(0.5)).cast("bigint")
