"""Rounding of published numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(x: Column) -> Column:
    return F.round(x.cast("double"), 6)


def r6_signed(x: Column) -> Column:
    """As r6, but what rounds to zero from below is -0.0, as in SQL engines that round in floating point."""
    x = x.cast("double")
    return F.when((x < 0) & (r6(x) == 0), F.lit(-0.0)).otherwise(r6(x))
