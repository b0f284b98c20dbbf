"""Rounding with one definition on every engine."""
from pyspark.sql import Column, functions as F


def half_even(col, digits: int) -> Column:
    """Scale, round half to even, unscale: the rounding of numeric Python arrays."""
    p = float(10 ** digits)
    return F.rint(col * F.lit(p)) / F.lit(p)
