"""Bootstrap and permutation inference. Draws come from arithmetic on keys, so they depend on neither
partitions nor engine, and nothing is brought to the driver.

A bootstrap weighs each row by a Poisson draw for each repetition; statistics are aggregates (means) or
exact percentiles over ranges (medians) by repetition. Permutations number the rows of each repetition by
their draws. One way holds at every size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusmill.operators.controls import drawn, key_number
from locusmill.operators.ranges import numbered, summarised
from locusmill.session import broadcast_if_small, cut

C = F.col
TOP = 2147483647  # draws lie below


def cutoffs(mean: float = 1.0, most: int = 11) -> list[int]:
    """Draws at or above the k-th cutoff weigh at least k + 1: the Poisson distribution on the scale of the draws."""
    out, total, term = [], 0.0, math.exp(-mean)
    for k in range(1, most + 1):
        total += term
        out.append(round(total * TOP))
        term *= mean / k
    return out


def poisson(draw: Column) -> Column:
    """Poisson draw with mean 1 from a draw of ``controls.drawn``."""
    return sum(((draw >= c).cast("int") for c in cutoffs()), F.lit(0))


def _repeated(df: DataFrame, reps: int, first: int = 1) -> DataFrame:
    return df.withColumn("rep", F.explode(F.sequence(F.lit(first), F.lit(reps))))


def bootstrap(df: DataFrame, values: Sequence[str], key: str, stat: str = "median", reps: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """One row: each value's statistic (median or mean) with a percentile interval. The same draw of rows
    serves all values, so differences between them may be compared. Rows with a null don't count."""
    kept = cut(df.dropna(subset=list(values)).select(key_number(C(key)).alias("__k"), *[C(v).cast("double").alias(v) for v in values]))
    drawn_ = _repeated(kept, reps).withColumn("__draw", drawn(seed, C("__k"), C("rep"))).withColumn("__w", poisson(C("__draw"))).drop("__draw")
    a = (1 - level) / 2
    if stat == "median":
        point = summarised(kept, [], {v: (C(v), 0.5) for v in values})
        draws = summarised(drawn_, ["rep"], {v: (C(v), 0.5) for v in values}, weight=C("__w"))
    else:
        point = kept.agg(*[F.avg(v).alias(v) for v in values])
        draws = drawn_.groupBy("rep").agg(*[F.try_divide(F.sum(C(v) * C("__w")), F.sum("__w")).alias(v) for v in values])
    edges = draws.agg(*[c for v in values for c in (F.percentile(v, a).alias(f"{v}_lo"), F.percentile(v, 1 - a).alias(f"{v}_hi"))])  # a row per repetition
    return point.join(F.broadcast(edges), F.lit(True))


def cluster_bootstrap(df: DataFrame, line: str, cluster: str, y: str, x: str, reps: int = 400, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Slope through the origin per line, with an interval from drawing whole clusters.

    Works on one row of sums per line and cluster, so rows are read once.
    """
    s = df.dropna(subset=[y, x]).groupBy(line, cluster).agg(F.sum(C(x) * C(y)).alias("xy"), F.sum(C(x) * C(x)).alias("xx"))
    w = _repeated(s.withColumn("__k", key_number(C(cluster))), reps, 0).withColumn("__draw", drawn(seed, C("__k"), C("rep"))).withColumn("w", F.when(C("rep") == 0, 1).otherwise(poisson(C("__draw"))))
    draws = w.groupBy(line, "rep").agg(F.try_divide(F.sum(C("w") * C("xy")), F.sum(C("w") * C("xx"))).alias("slope"))
    a = (1 - level) / 2
    return draws.groupBy(line).agg(
        F.max(F.when(C("rep") == 0, C("slope"))).alias("slope"), F.percentile(F.when(C("rep") > 0, C("slope")), a).alias("lo"), F.percentile(F.when(C("rep") > 0, C("slope")), 1 - a).alias("hi")
    )


def strata_bootstrap(df: DataFrame, stratum: str, value: str, reps: int = 1000, seed: int = 42, level: float = 0.95) -> DataFrame:
    """Mean of stratum means with an interval from drawing the strata."""
    means = df.groupBy(stratum).agg(F.avg(value).alias("mean"))
    return bootstrap(means, ["mean"], stratum, "mean", reps, seed, level)


def permutation_medians(a: DataFrame, b: DataFrame, value: str, key: str, reps: int = 1000, seed: int = 42) -> DataFrame:
    """One-sided permutation test of median(a) - median(b): difference, p (share of draws at or above), n_a, n_b.

    Each repetition orders the pooled rows by their draws and gives the first n_a to arm a. Without rows in an arm the
    difference and p are null.
    """
    pooled = cut(a.select(key, value, F.lit(1).alias("arm")).union(b.select(key, value, F.lit(0))).dropna().select((key_number(C(key)) * 2 + C("arm")).alias("k"), C(value).cast("double").alias("v"), "arm"))
    sizes = pooled.agg(F.coalesce(F.sum("arm"), F.lit(0)).alias("n_a"), F.coalesce(F.sum(1 - C("arm")), F.lit(0)).alias("n_b"))
    pick = lambda side: F.max(F.when(C("arm") == side, C("m")))
    seen = summarised(pooled, ["arm"], {"m": (C("v"), 0.5)}).agg((pick(1) - pick(0)).alias("difference"))
    ordered = numbered(_repeated(pooled, reps).withColumn("draw", drawn(seed, C("k"), C("rep")) * 536870912 + C("k")), ["rep"], "draw", "at")
    dealt = ordered.join(F.broadcast(sizes), F.lit(True)).select("rep", "v", (C("at") < C("n_a")).cast("int").alias("arm"))
    draws = summarised(dealt, ["rep", "arm"], {"m": (C("v"), 0.5)}).groupBy("rep").agg((pick(1) - pick(0)).alias("x"))
    hits = draws.join(F.broadcast(seen), F.lit(True)).agg(F.avg((C("x") >= C("difference")).cast("int")).alias("p"))
    return seen.join(F.broadcast(hits), F.lit(True)).join(F.broadcast(sizes), F.lit(True))


def permutation_genes(df: DataFrame, by: str, key: str, y: str, x: str, contribution: str, reps: int = 400, seed: int = 42, block_rows: int = 20_000) -> DataFrame:
    """Per group: drop = abs(r(y, x)) - abs(r(y - contribution, x)) and p = (1 + draws at or above) / (1 + reps).

    Contributions are permuted within blocks of at most about ``block_rows`` rows of a group, which is a
    valid permutation under the null and keeps each task bounded; a block yields sums per repetition,
    which add up over the blocks of a group.
    """
    kept = df.dropna(subset=[by, y, x, contribution]).select(by, key, C(y).cast("double").alias("y"), C(x).cast("double").alias("x"), C(contribution).cast("double").alias("c"))
    sizes = kept.groupBy(by).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("parts"))
    blocked = kept.join(broadcast_if_small(sizes), by).withColumn("block", F.pmod(F.xxhash64(C(key)), C("parts")).cast("int"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        y_, x_, c_ = (pdf[k].to_numpy() for k in "yxc")
        rng = np.random.default_rng([seed, int(pdf["block"].iloc[0]), abs(hash_of(str(pdf[by].iloc[0])))])
        out = np.empty((reps + 1, 2))
        for i in range(reps + 1):
            p = c_ if i == 0 else rng.permutation(c_)
            out[i] = p @ x_, p @ y_
        return pd.DataFrame({
            by: [pdf[by].iloc[0]], "n": [len(pdf)], "sy": [y_.sum()], "sx": [x_.sum()], "sc": [c_.sum()], "yy": [y_ @ y_], "xx": [x_ @ x_], "cc": [c_ @ c_], "xy": [x_ @ y_],
            "cx": [out[:, 0].tolist()], "cy": [out[:, 1].tolist()],
        })

    types = dict(df.dtypes)
    schema = f"{by} {types[by]}, n long, sy double, sx double, sc double, yy double, xx double, cc double, xy double, cx array<double>, cy array<double>"
    sums = blocked.groupBy(by, "block").applyInPandas(draw, schema)
    per = sums.select("*", F.posexplode(F.arrays_zip("cx", "cy")).alias("rep", "z")).groupBy(by, "rep").agg(
        *[F.sum(k).alias(k) for k in ("n", "sy", "sx", "sc", "yy", "xx", "cc", "xy")], F.sum("z.cx").alias("cx"), F.sum("z.cy").alias("cy")
    )
    n = C("n")
    vx = C("xx") - C("sx") * C("sx") / n
    r0 = F.try_divide(C("xy") - C("sx") * C("sy") / n, F.sqrt(vx * (C("yy") - C("sy") * C("sy") / n)))
    sd = C("sy") - C("sc")
    vd = C("yy") - 2 * C("cy") + C("cc") - sd * sd / n
    r1 = F.try_divide(C("xy") - C("cx") - C("sx") * sd / n, F.sqrt(vx * F.greatest(vd, F.lit(0.0))))
    drops = per.select(by, "rep", "n", (F.abs(r0) - F.abs(r1)).alias("drop"))
    seen = drops.where("rep = 0").select(by, C("n").alias("rows"), C("drop").alias("seen"))
    hits = drops.where("rep > 0").join(broadcast_if_small(seen), by).groupBy(by).agg(
        F.max("rows").alias("n"), F.max("seen").alias("drop"), ((1 + F.count(F.when(C("drop") >= C("seen"), 1))) / (1 + F.count("*"))).alias("p")
    )
    return hits


def hash_of(text: str) -> int:
    """Small stable number of a text."""
    out = 7
    for ch in text:
        out = (out * 31 + ord(ch)) % 2147483647
    return out


def posterior_difference(df: DataFrame, key: str, hits_a: str, total_a: str, hits_b: str, total_b: str, draws: int = 4000, seed: int = 42) -> DataFrame:
    """key, probability that the rate of a is above that of b, and the mean difference, by beta draws per row."""

    @F.pandas_udf("p double, difference double")
    def drawn(k: pd.Series, ha: pd.Series, ta: pd.Series, hb: pd.Series, tb: pd.Series) -> pd.DataFrame:
        out = []
        for name, *v in zip(k, ha, ta, hb, tb):
            rng = np.random.default_rng([seed, hash_of(str(name))])
            d = rng.beta(1 + v[0], 1 + v[1] - v[0], draws) - rng.beta(1 + v[2], 1 + v[3] - v[2], draws)
            out.append((float((d > 0).mean()), float(d.mean())))
        return pd.DataFrame(out, columns=["p", "difference"])

    return df.withColumn("__d", drawn(C(key).cast("string"), hits_a, total_a, hits_b, total_b)).select(key, "__d.*")
