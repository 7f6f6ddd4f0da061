"""Aggregates, correlations, closed-form models, ranks and tests, all as Spark aggregates and windows.

Correlations and regressions come from centred moments in one pass. A division that has no value gives
null instead of an error. Sums of squares of centred values run over partial aggregates, so a hot group
is combined on the map side.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusmill.operators.ranges import average_rank, cumulated, joined, median, numbered, summarised, value_range
from locusmill.session import broadcast_if_small, cut

C = F.col


def both(a: Column, b: Column, x: Column) -> Column:
    """``x`` where neither a nor b is null."""
    return F.when(a.isNotNull() & b.isNotNull(), x)


def pearson(a: Column, b: Column) -> Column:
    """Pearson correlation over rows with both values; null for a constant column."""
    return F.try_divide(F.covar_samp(a, b), F.stddev_samp(both(a, b, a)) * F.stddev_samp(both(a, b, b)))


def spearman(df: DataFrame, by: Sequence[str], a: str, b: str) -> DataFrame:
    """rho and n per group."""
    kept = df.where(C(a).isNotNull() & C(b).isNotNull()).select(*by, a, b)
    ranked = average_rank(average_rank(kept, by, a, "__ra"), by, b, "__rb")
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), pearson(C("__ra"), C("__rb")).alias("rho"))


def delta_abs_corr(df: DataFrame, by: Sequence[str], x: str, y: str, corrected: str, least: int = 10) -> DataFrame:
    """n, r0, r1 and delta = abs(r0) - abs(r1) of groups with at least ``least`` complete rows and both correlations."""
    kept = df.where(C(x).isNotNull() & C(y).isNotNull() & C(corrected).isNotNull())
    r = kept.groupBy(*by).agg(F.count("*").alias("n"), pearson(C(y), C(x)).alias("r0"), pearson(C(corrected), C(x)).alias("r1"))
    return r.where((C("n") >= least) & C("r0").isNotNull() & C("r1").isNotNull()).withColumn("delta", F.abs("r0") - F.abs("r1"))


def mad(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Median absolute deviation per group plus 1e-9."""
    off = joined(df, broadcast_if_small(median(df, by, value, "__m")), by).select(*by, F.abs(C(value) - C("__m")).alias("__d"))
    return median(off, by, "__d", "mad").withColumn("mad", C("mad") + F.lit(1e-9))


def at_least(df: DataFrame, by: Sequence[str], n: int) -> DataFrame:
    """Rows of groups with at least ``n`` rows."""
    big = df.groupBy(*by).agg(F.count("*").alias("__n")).where(C("__n") >= n).drop("__n")
    return df.join(broadcast_if_small(big), list(by), "left_semi")


def moments(y: Column, xs: Sequence[Column]) -> dict[str, Column]:
    """Centred moments of response and features."""
    out = {"n": F.count("*"), "my": F.avg(y), "syy": F.covar_samp(y, y)}
    for i, a in enumerate(xs):
        out |= {f"m{i}": F.avg(a), f"sy{i}": F.covar_samp(y, a)}
        out |= {f"s{i}{j}": F.covar_samp(a, xs[j]) for j in range(i, len(xs))}
    return out


def _det(m: list[list[Column]]) -> Column:
    if len(m) == 1:
        return m[0][0]
    if len(m) == 2:
        return m[0][0] * m[1][1] - m[0][1] * m[1][0]
    out = F.lit(0.0)
    for j, head in enumerate(m[0]):
        minor = [[r[k] for k in range(len(m)) if k != j] for r in m[1:]]
        out = out + (F.lit(1.0) if j % 2 == 0 else F.lit(-1.0)) * head * _det(minor)
    return out


def ols(df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str], least: int = 2, intercept: bool = True) -> DataFrame:
    """Least squares per group by Cramer's rule on moments, for up to three features: n, intercept, coef_<x>, r2, rmse.

    A singular group has null coefficients; r2 of a constant response is null.
    """
    kept = df.dropna(subset=[y, *xs])
    k = len(xs)
    if intercept:
        m = kept.groupBy(*by).agg(*[c.alias(n) for n, c in moments(C(y), [C(x) for x in xs]).items()])
    else:
        sums = {"n": F.count("*"), "my": F.lit(0.0), "syy": F.sum(C(y) * C(y))}
        for i, a in enumerate(xs):
            sums |= {f"m{i}": F.lit(0.0), f"sy{i}": F.sum(C(y) * C(a))} | {f"s{i}{j}": F.sum(C(a) * C(xs[j])) for j in range(i, k)}
        m = kept.groupBy(*by).agg(*[F.max(c).alias(n) if n[0] == "m" else c.alias(n) for n, c in sums.items()])
    m = m.where(C("n") >= least)
    s = [[C(f"s{min(i, j)}{max(i, j)}") for j in range(k)] for i in range(k)]
    det = _det(s)
    scale = F.lit(1.0)
    for i in range(k):
        scale = scale * s[i][i]
    sound = F.abs(det) > F.lit(1e-9) * F.abs(scale)
    coef = []
    for i in range(k):
        swapped = [[C(f"sy{r}") if c == i else s[r][c] for c in range(k)] for r in range(k)]
        coef.append(F.when(sound, F.try_divide(_det(swapped), det)))
    m = m.withColumns({f"coef_{x}": c for x, c in zip(xs, coef)})
    explained, at = F.lit(0.0), C("my")
    for i, x in enumerate(xs):
        explained = explained + C(f"coef_{x}") * C(f"sy{i}")
        at = at - C(f"coef_{x}") * C(f"m{i}")
    freedom = (C("n") - 1) if intercept else F.lit(1)
    rest = F.greatest(F.lit(0.0), C("syy") - explained)
    return m.select(
        *by, "n", *([at.alias("intercept")] if intercept else []), *[f"coef_{x}" for x in xs],
        F.when(C("syy") > 0, F.try_divide(explained, C("syy"))).alias("r2"), F.when(explained.isNotNull(), F.sqrt(rest * freedom / C("n"))).alias("rmse"),
    )


def partial_corr(df: DataFrame, by: Sequence[str], a: str, b: str, given: str) -> DataFrame:
    """Correlation of a and b with one covariate taken out, in closed form."""
    kept = df.dropna(subset=[a, b, given])
    r = kept.groupBy(*by).agg(F.count("*").alias("n"), pearson(C(a), C(b)).alias("ab"), pearson(C(a), C(given)).alias("ag"), pearson(C(b), C(given)).alias("bg"))
    bottom = F.sqrt((1 - C("ag") * C("ag")) * (1 - C("bg") * C("bg")))
    return r.select(*by, "n", F.try_divide(C("ab") - C("ag") * C("bg"), bottom).alias("r"))


def cell_residuals(df: DataFrame, by: Sequence[str], cells: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Residuals ``<value>_resid`` on flags that exclude one another: the fit is the mean of each cell of flags."""
    means = df.groupBy(*by, *cells).agg(*[F.avg(v).alias(f"__{v}") for v in values])
    out = df.join(broadcast_if_small(means), [*by, *cells])
    return out.withColumns({f"{v}_resid": C(v) - C(f"__{v}") for v in values}).drop(*[f"__{v}" for v in values])


def orthogonal(df: DataFrame, by: Sequence[str], on: str, values: Sequence[str]) -> DataFrame:
    """Residuals ``<value>_resid`` of each value on one feature, per group."""
    fit = df.groupBy(*by).agg(*[f(C(v), C(on)).alias(f"__{n}_{v}") for v in values for n, f in (("k", F.regr_slope), ("c", F.regr_intercept))])
    out = df.join(broadcast_if_small(fit), list(by))
    return out.withColumns({f"{v}_resid": C(v) - (C(f"__k_{v}") * C(on) + C(f"__c_{v}")) for v in values}).drop(*[f"__{n}_{v}" for v in values for n in "kc"])


def vif(df: DataFrame, by: Sequence[str], xs: Sequence[str]) -> DataFrame:
    """Variance inflation of three features from their correlations; infinite at R2 of 0.99 and more."""
    pairs = [(i, j) for i in range(3) for j in range(i + 1, 3)]
    r = df.dropna(subset=list(xs)).groupBy(*by).agg(*[pearson(C(xs[i]), C(xs[j])).alias(f"r{i}{j}") for i, j in pairs])
    g = lambda i, j: C(f"r{min(i, j)}{max(i, j)}")
    out = []
    for i in range(3):
        j, k = [x for x in range(3) if x != i]
        r2 = F.try_divide(g(i, j) * g(i, j) + g(i, k) * g(i, k) - 2 * g(i, j) * g(i, k) * g(j, k), 1 - g(j, k) * g(j, k))
        out.append(F.when(r2 >= 0.99, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), 1 - r2)).alias(f"vif_{xs[i]}"))
    return r.select(*by, *out)


def zscore(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Adds ``<value>_std``; 0 where the group has no spread."""
    s = df.groupBy(*by).agg(F.avg(value).alias("__m"), F.stddev_samp(value).alias("__s"))
    return df.join(broadcast_if_small(s), list(by)).withColumn(f"{value}_std", F.when(C("__s") > 0, (C(value) - C("__m")) / C("__s")).otherwise(F.lit(0.0))).drop("__m", "__s")


def roll(df: DataFrame, by: Sequence[str], order: str, value: str, shift: Callable[[Column], Column]) -> DataFrame:
    """Adds ``rolled``: the value ``shift`` (of the group's size) places before in the circle of the group's rows.

    Groups of one row or without spread are left out.
    """
    r = cut(numbered(df, by, order, "__i"))
    sizes = r.groupBy(*by).agg(F.count("*").alias("__n"), F.stddev_samp(value).alias("__sd")).where("__n > 1 and __sd >= 1e-9").drop("__sd")
    r = joined(r, broadcast_if_small(sizes), by)
    r = r.withColumn("__from", F.pmod(C("__i") - shift(C("__n")) + C("__n"), C("__n")))
    source = r.select(*by, C("__i").alias("__from"), C(value).alias("rolled"))
    return joined(r, source, [*by, "__from"]).drop("__i", "__n", "__from")


def bins(x: Column, edges: Column) -> Column:
    """Index of the bin (right closed, the first closed on both sides) among sorted distinct edges, else null."""
    inside = (x >= edges[0]) & (x <= F.element_at(edges, -1))
    return F.when(inside, F.greatest(F.lit(0), F.size(F.filter(edges, lambda e: e < x)) - 1))


def quantile_edges(df: DataFrame, value: str, parts: int) -> DataFrame:
    """One row with the distinct percentile edges of the whole table, quantised."""
    at = summarised(df, [], {"at": (C(value), [i / parts for i in range(parts + 1)])})
    return at.select(F.array_distinct(F.transform("at", lambda v: F.floor(v * 1e6 + 0.5).cast("double") / 1e6)).alias("edges"))


def auroc(df: DataFrame, label: str, score: str) -> DataFrame:
    """Area under the ROC curve from average ranks (ties count a half), in one row."""
    ranked = average_rank(df.where(C(label).isNotNull() & C(score).isNotNull()), [], score, "__r")
    pos, n = F.sum(C(label)), F.count("*")
    return ranked.agg(F.try_divide(F.sum(C("__r") * C(label)) - pos * (pos + 1) / 2, pos * (n - pos)).alias("auroc"))


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Mean precision at the positives, tied scores taken together, in one row."""
    kept = df.where(C(label).isNotNull() & C(score).isNotNull()).withColumn("__neg", -C(score))
    tied = cut(kept.groupBy("__neg").agg(F.count("*").alias("__n"), F.sum(label).alias("__p")))
    seen = cumulated(tied, "__neg", "__n").withColumnRenamed("__before", "__nb")
    seen = cumulated(seen, "__neg", "__p")
    precision = (C("__before") + C("__p")) / (C("__nb") + C("__n"))
    return seen.agg(F.try_divide(F.sum(C("__p") * precision), F.sum("__p")).alias("ap"))


def ks_statistic(df: DataFrame, arm: str, value: str) -> DataFrame:
    """Largest distance of the two arms' distribution functions; ``arm`` is 0 or 1. One row."""
    kept = df.where(C(value).isNotNull())
    counts = cut(kept.groupBy(value).agg(F.sum(1 - C(arm)).alias("__a"), F.sum(C(arm)).alias("__b")))
    total = counts.agg(F.sum("__a").alias("na"), F.sum("__b").alias("nb"))
    c = cumulated(counts, value, "__a").withColumnRenamed("__before", "__ca")
    c = cumulated(c, value, "__b")
    gap = F.abs((C("__ca") + C("__a")) / C("na") - (C("__before") + C("__b")) / C("nb"))
    return c.join(F.broadcast(total), F.lit(True)).agg(F.max(gap).alias("d"), F.max("na").alias("n_a"), F.max("nb").alias("n_b"))


def wilcoxon(df: DataFrame, difference: str) -> DataFrame:
    """Signed-rank sums of the nonzero differences: w_plus, w_minus, n. One row."""
    kept = df.where(C(difference).isNotNull() & (C(difference) != 0)).withColumn("__abs", F.abs(difference))
    ranked = average_rank(kept, [], "__abs", "__r")
    side = lambda s: F.coalesce(F.sum(F.when(C(difference) * s > 0, C("__r"))), F.lit(0.0))
    return ranked.agg(side(1).alias("w_plus"), side(-1).alias("w_minus"), F.count("*").alias("n"))


def benjamini_hochberg(df: DataFrame, p: str, name: str = "q") -> DataFrame:
    """Adds the false discovery rate of each p-value: the smallest p * n / rank at or above it, at most 1.

    Works on distinct p-values; the running minimum inside a range continues with the ranges behind it.
    """
    kept = df.where(C(p).isNotNull())
    counts = cut(kept.groupBy(p).agg(F.count("*").alias("__n")))
    total = counts.agg(F.sum("__n").alias("__m"))
    r = cumulated(counts, p, "__n").join(F.broadcast(total), F.lit(True)).withColumn("__q", C(p) * C("__m") / (C("__before") + C("__n")))
    ranged = r.withColumn("__part", value_range(counts, p))
    least = ranged.groupBy("__part").agg(F.min("__q").alias("__min"))
    behind = least.select("__part", F.min("__min").over(Window.orderBy("__part").rowsBetween(1, Window.unboundedFollowing)).alias("__later"))
    w = Window.partitionBy("__part").orderBy(p).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    table = ranged.join(F.broadcast(behind), "__part").select(p, F.least(F.lit(1.0), F.min("__q").over(w), "__later").alias(name))
    return kept.join(table, p)


def beta_shrinkage(df: DataFrame, hits: str, total: str) -> DataFrame:
    """Adds ``shrunk``: rates drawn to a beta prior fitted by moments over all rows; the raw rate if there is no prior."""
    rate = C(hits) / C(total)
    g = df.where(C(total) > 0).agg(F.avg(rate).alias("__m"), F.var_samp(rate).alias("__v"))
    k = F.try_divide(C("__m") * (1 - C("__m")), C("__v")) - 1
    out = df.where(C(total) > 0).join(F.broadcast(g), F.lit(True)).withColumn("__k", k)
    shrunk = (C(hits) + C("__k") * C("__m")) / (C(total) + C("__k"))
    return out.withColumn("shrunk", F.when(C("__k") > 0, shrunk).otherwise(rate)).drop("__m", "__v", "__k")
