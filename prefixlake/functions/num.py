"""Numeric column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(c: Column) -> Column:
    """Round to an integer with halves going towards plus infinity."""
    return F.floor(c + F.lit(0.5))


def round3(c: Column) -> Column:
    """Three decimals, halves towards plus infinity (not Spark's decimal ``round``)."""
    return F.floor(c * F.lit(1000.0) + F.lit(0.5)) / F.lit(1000.0)


def clamp01(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c))
