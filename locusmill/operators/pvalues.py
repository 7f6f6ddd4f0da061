"""p-values of the tests' statistics from their series and tails, for one-row results."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def kolmogorov(d: float, n_a: int, n_b: int) -> float:
    """Asymptotic two-sample p of the largest distance ``d``."""
    if not n_a or not n_b:
        return math.nan
    t = d * math.sqrt(n_a * n_b / (n_a + n_b))
    if t < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * t * t) for k in range(1, 101))))


def wilcoxon(w_plus: float, n: int, greater: bool = False) -> float:
    """Normal approximation for the signed-rank sum of ``n`` differences."""
    if n == 0:
        return math.nan
    z = (w_plus - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return 0.5 * math.erfc(z / math.sqrt(2)) if greater else normal_two_sided(z)


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, by modified Lentz steps."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def correlation(r: float, n: int) -> float:
    """Two-sided p of a (rank) correlation of ``n`` pairs, by Student's t."""
    if n < 3 or math.isnan(r):
        return math.nan
    if abs(r) >= 1:
        return 0.0
    t2 = r * r * (n - 2) / (1 - r * r)
    return incomplete_beta((n - 2) / 2, 0.5, (n - 2) / (n - 2 + t2))


def correlation_p(r: Column, n: Column) -> Column:
    """``correlation`` of a column; meant for a row per test, not for data rows. Null where it has no value."""
    def p(a: float | None, b: int | None) -> float | None:
        out = math.nan if a is None or b is None else correlation(a, b)
        return None if math.isnan(out) else out

    return F.udf(p, "double")(r, n)


def kolmogorov_p(d: Column, n_a: Column, n_b: Column, terms: int = 100) -> Column:
    """The same series as ``kolmogorov``, as a column."""
    t = d * F.sqrt(n_a * n_b / (n_a + n_b))
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * t * t))
    return F.when((n_a > 0) & (n_b > 0), F.when(t < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series))))


# Coefficients of Chebyshev's approximation of the complementary error function (relative error below 1.2e-7).
ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def normal_two_sided_p(z: Column) -> Column:
    """Two-sided p of a normal z, as a column."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.5 * x)
    out = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        out = out * t + c
    return t * F.exp(-x * x + out)


def wilcoxon_z(w_plus: Column, n: Column) -> Column:
    """Normal approximation of the signed-rank sum; null without differences."""
    return F.when(n > 0, (w_plus - n * (n + 1) / 4.0) / F.sqrt(n * (n + 1.0) * (2.0 * n + 1.0) / 24.0))
