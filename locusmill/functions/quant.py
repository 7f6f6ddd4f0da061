"""Quantised doubles: one rounding rule that other engines reproduce bit for bit."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def q6(x: Column) -> Column:
    """floor(x * 1e6 + 0.5) / 1e6 as double; null and NaN become null."""
    scaled = x.cast("double") * F.lit(1e6) + F.lit(0.5)
    return F.when(~F.isnan(x.cast("double")), F.floor(scaled).cast("double") / F.lit(1e6))


def q20(x: Column) -> Column:
    """Rounded to multiples of 2 ** -20: for values that are often a half at the sixth decimal."""
    return F.floor(x * F.lit(1048576.0) + F.lit(0.5)).cast("double") / F.lit(1048576.0)


def pow2_parts(x: Column) -> tuple[Column, Column]:
    """Mantissa (rounded to six decimals) and whole exponent of 2 ** x: relative rounding, so no size of x overflows it."""
    whole = F.floor(x.cast("double")).cast("double")
    return q6(F.pow(F.lit(2.0), x.cast("double") - whole)), whole
