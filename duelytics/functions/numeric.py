"""Rounding shared by every metric."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Twenty digits before the point and eighteen behind it: every kWh a double holds to its last digit.
EXACT = "decimal(38,18)"


def round_even(x: Column, digits: int) -> Column:
    """Round a double to `digits` decimals, exact halves to the even neighbour.

    Adding zero turns -0.0 into 0.0.
    """
    scale = F.lit(float(10**digits))
    return F.rint(x.cast("double") * scale) / scale + F.lit(0.0)


def or_zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0))


def exact_sum(x: Column) -> Column:
    """Sum that does not depend on the order of the rows, so retried tasks give the same bits."""
    return F.sum(x.cast(EXACT))
