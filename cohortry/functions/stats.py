"""Column expressions for shares and intervals, used after aggregation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Normal quantiles by interval level.
LEVEL_Z = {0.8: 1.2816, 0.95: 1.96}


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, null where the whole is zero."""
    return F.try_divide(part * F.lit(100.0), whole)


def wilson(successes: Column, n: Column, z: float = LEVEL_Z[0.95]) -> tuple[Column, Column]:
    """Lower and upper Wilson score bound as proportions in [0, 1]; null for n = 0.

    For no success the lower bound is 0 and for nothing but successes the upper is 1: what the formula gives without rounding.
    """
    z2 = z * z
    p = F.try_divide(successes.cast("double"), n)
    scale = F.lit(1.0) + F.try_divide(F.lit(z2), n)
    centre = (p + F.try_divide(F.lit(z2 / 2), n)) / scale
    spread = F.try_divide(p * (F.lit(1.0) - p), n) + F.try_divide(F.lit(z2 / 4), n * n.cast("double"))
    half = F.sqrt(spread) * z / scale
    low = F.when(n > 0, F.when(successes == 0, 0.0).otherwise(F.greatest(F.lit(0.0), centre - half)))
    high = F.when(n > 0, F.when(successes == n, 1.0).otherwise(F.least(F.lit(1.0), centre + half)))
    return low, high


def finite(value: Column) -> Column:
    """The value, or null for NaN and the infinities."""
    value = value.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
