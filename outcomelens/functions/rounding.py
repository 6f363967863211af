"""Rounding that gives the same doubles as the engines whose published tables we match.

Spark's ``round(x, 2)`` on a double rounds the decimal text (1.005 -> 1.01). SQL engines and numpy
scale, round to a whole number and scale back (1.005 -> 1.0). They differ only in how a half is
rounded: SQL away from zero, numpy to the even neighbour.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_away(x: Column, dp: int) -> Column:
    """SQL ``ROUND(x, dp)`` on doubles."""
    scale = float(10**dp)
    return F.round(x.cast("double") * scale, 0) / scale


def round_half_even(x: Column, dp: int) -> Column:
    """numpy / pandas ``round(dp)`` on doubles."""
    scale = float(10**dp)
    return F.rint(x.cast("double") * scale) / scale


def rate_pct(flag: Column, dp: int = 2) -> Column:
    """Share of true flags in percent, as an aggregate; rows with a NULL flag do not count."""
    return round_half_away(F.lit(100.0) * F.avg(flag.cast("int")), dp)
