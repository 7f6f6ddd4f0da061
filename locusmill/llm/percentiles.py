"""Exact percentiles by bisection over groups.

Each group and column keeps the value intervals in which its target ranks lie. A pass counts, for every
interval, the rows below its midpoints (several at once), picks the stretch that holds each
target rank, and narrows it to the smallest and largest value seen there. It ends when every interval
is one value, so the error is 0. The midpoints halve, again and again, the interval's 64-bit image (the order-keeping
whole number of a double), so with ``FANOUT`` of them no input takes more than 13 passes; ``EVEN`` more lie evenly among the
values, which ends sooner on smooth data. The counts are partial aggregates on the map side and add up over
partitions and over days: ``stretch_counts`` of single days may be summed and narrowed alike.

The percentile p of n values is the smallest value with at least ceil(p * n) values at or below it.

Defined results: null and NaN are no values; infinities are values like any other; a group
without a value has no row; a null group key is a group of its own; ties are resolved exactly; -0.0 is 0.0; an
empty table has no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusmill.session import broadcast_if_small, cut

FANOUT, EVEN = 32, 16


def long_values(df: DataFrame, group: str, columns: Sequence[str], *keep: str) -> DataFrame:
    """One row per group and value: ``keep``, grp, col, v."""
    cells = [F.struct(F.lit(c).alias("col"), (F.col(c).cast("double") + 0.0).alias("v")) for c in columns]
    return (
        df.select(*keep, F.col(group).cast("string").alias("grp"), F.explode(F.array(*cells)).alias("cell"))
        .select(*keep, "grp", F.col("cell.col").alias("col"), F.col("cell.v").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    )


def image(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the doubles."""
    i = x.view(np.int64)
    return (i ^ ((i >> 63) & np.int64(2**63 - 1))).view(np.uint64) ^ np.uint64(2**63)


def unimage(u: np.ndarray) -> np.ndarray:
    i = (u ^ np.uint64(2**63)).view(np.int64)
    return (i ^ ((i >> 63) & np.int64(2**63 - 1))).view(np.float64)


def midpoints(lo: np.ndarray, hi: np.ndarray, fanout: int = FANOUT, even: int = EVEN) -> np.ndarray:
    """For each interval ``fanout`` - 1 midpoints of its image and ``even`` of its values, in order; all above lo and up to hi."""
    a, k = image(lo), np.arange(1, fanout, dtype=np.uint64)
    width, n = image(hi) - a, np.uint64(fanout)
    cuts = unimage(a[:, None] + (width // n)[:, None] * k + ((width % n)[:, None] * k + n - np.uint64(1)) // n)
    share = np.arange(1, even + 1) / (even + 1)
    top = np.finfo(float).max
    flat = np.clip(lo, -top, top)[:, None] * (1 - share) + np.clip(hi, -top, top)[:, None] * share
    return np.sort(np.hstack([cuts, np.clip(flat, lo[:, None], hi[:, None])]), axis=1)


def _below(v: Column, cuts: Column, a: int, b: int) -> Column:
    """Number of cuts at or below v, known to be from a up to b: a tree of comparisons."""
    if a == b:
        return F.lit(a)
    m = (a + b) // 2
    return F.when(v < F.get(cuts, F.lit(m)), _below(v, cuts, a, m)).otherwise(_below(v, cuts, m + 1, b))


def stretch_counts(values: DataFrame, intervals: DataFrame, *by: str, fanout: int = FANOUT) -> DataFrame:
    """Rows per stretch of each open interval: ``by``, grp, col, lo, hi, stretch, n, least, most."""

    @F.pandas_udf("array<double>")
    def cuts(lo: pd.Series, hi: pd.Series) -> pd.Series:
        return pd.Series(list(midpoints(lo.to_numpy(dtype=float), hi.to_numpy(dtype=float), fanout)))

    spans = intervals.where("lo < hi").select("grp", "col", "lo", "hi").distinct().withColumn("cuts", cuts("lo", "hi")).groupBy("grp", "col").agg(F.collect_list(F.struct("lo", "hi", "cuts")).alias("spans"))
    held = values.alias("x").join(
        broadcast_if_small(spans).alias("s"), F.col("x.grp").eqNullSafe(F.col("s.grp")) & (F.col("x.col") == F.col("s.col"))
    ).select(*[F.col(f"x.{b}") for b in by], "x.grp", "x.col", "x.v", F.explode(F.filter("s.spans", lambda s: (s["lo"] <= F.col("x.v")) & (F.col("x.v") <= s["hi"]))).alias("span"))
    stretch = _below(F.col("v"), F.col("span.cuts"), 0, fanout - 1 + EVEN)
    return held.groupBy(*by, "grp", "col", F.col("span.lo").alias("lo"), F.col("span.hi").alias("hi"), stretch.alias("stretch")).agg(
        F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")
    )


def combine(counts: DataFrame) -> DataFrame:
    """Counts of single days or partitions, summed."""
    return counts.groupBy("grp", "col", "lo", "hi", "stretch").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))


def narrow(intervals: DataFrame, counts: DataFrame) -> DataFrame:
    """The open intervals cut down to the stretch that holds their rank; closed ones stay."""
    w = Window.partitionBy("grp", "col", "lo", "hi").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    c = counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).alias("c")
    i = intervals.where("lo < hi").alias("i")
    hit = (
        F.col("i.grp").eqNullSafe(F.col("c.grp")) & (F.col("i.col") == F.col("c.col")) & (F.col("i.lo") == F.col("c.lo")) & (F.col("i.hi") == F.col("c.hi"))
    )
    inside = i.join(c, hit).where((F.col("i.seek") > F.col("c.before")) & (F.col("i.seek") <= F.col("c.before") + F.col("c.n")))
    return inside.select(
        "i.grp", "i.col", "i.p", "i.total", "i.rank", (F.col("i.seek") - F.col("c.before")).alias("seek"), F.col("c.least").alias("lo"), F.col("c.most").alias("hi")
    ).unionByName(intervals.where("lo >= hi"))


def start(values: DataFrame, probs: Sequence[float]) -> DataFrame:
    """First intervals: the smallest to the largest value of each group, with the target ranks."""
    whole = values.groupBy("grp", "col").agg(F.count("*").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    rank = F.greatest(F.lit(1), F.ceil(F.round(F.col("p") * F.col("total"), 6))).cast("long")
    return whole.withColumn("p", F.explode(F.array(*[F.lit(float(p)) for p in probs]))).select(
        "grp", "col", "p", "total", rank.alias("rank"), rank.alias("seek"), "lo", "hi"
    )


def percentiles(values: DataFrame, probs: Sequence[float], fanout: int = FANOUT) -> DataFrame:
    """grp, col, p, total, rank, v. Runs one job per pass and keeps only the intervals between them."""
    intervals = cut(start(values, probs))
    while not intervals.where("lo < hi").isEmpty():
        intervals = cut(narrow(intervals, combine(stretch_counts(values, intervals, fanout=fanout))), after=intervals)
    return intervals.select("grp", "col", "p", "total", "rank", F.col("lo").alias("v"))


def day_ranks(values: DataFrame, answers: DataFrame, day: str) -> DataFrame:
    """Rows below and at each answer by day; summed over days they prove its rank."""
    a = broadcast_if_small(answers.select("grp", "col", "p", F.col("v").alias("answer"))).alias("a")
    joined = values.alias("x").join(a, F.col("x.grp").eqNullSafe(F.col("a.grp")) & (F.col("x.col") == F.col("a.col")))
    return joined.groupBy(f"x.{day}", "x.grp", "x.col", "a.p", "a.answer").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("x.v") < F.col("a.answer"), 1)).alias("below"), F.count(F.when(F.col("x.v") == F.col("a.answer"), 1)).alias("at")
    )
