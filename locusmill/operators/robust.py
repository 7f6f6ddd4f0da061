"""Robust, quantile and elastic-net fits per group.

A group of up to ``most`` rows is fitted in one task, after one shuffle of the columns needed. Larger groups are fitted
by passes of Spark aggregates: every pass is one map-side combined aggregation of weighted moments, so
a group of any size is fitted without being gathered anywhere, and between the passes only the coefficients (a row
per group) are kept. Both ways take the same steps until no coefficient moves (tests compare them).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusmill.operators.stats import _det
from locusmill.session import broadcast_if_small, cut

C = F.col
MOST = 1_000_000  # largest group that is fitted in one task: 32 MB at three features


def _weighted_fit(rows: DataFrame, by: Sequence[str], y: str, xs: Sequence[str], w: Column, ridge: Sequence[Column], extra: dict[str, Column]) -> DataFrame:
    """Weighted ridge least squares with free intercept: intercept and coef_<x>, with further aggregates.

    ``ridge``: penalty of each coefficient, a column of the group (or a literal) in units of the summed weights.
    """
    k = len(xs)
    r = rows.withColumn("__w", w)
    agg = {"n": F.count("*"), "sw": F.sum("__w"), "sy": F.sum(C("__w") * C(y))}
    for i, a in enumerate(xs):
        agg |= {f"s{i}": F.sum(C("__w") * C(a)), f"p{i}": F.sum(C("__w") * C(a) * C(y)), f"__r{i}": F.max(ridge[i])}
        agg |= {f"q{i}{j}": F.sum(C("__w") * C(a) * C(xs[j])) for j in range(i, k)}
    m = r.groupBy(*by).agg(*[c.alias(n) for n, c in (agg | extra).items()])
    cov = {f"c{i}{j}": C(f"q{i}{j}") - C(f"s{i}") * C(f"s{j}") / C("sw") + (C(f"__r{i}") if i == j else F.lit(0.0)) for i in range(k) for j in range(i, k)}
    m = m.withColumns(cov | {f"u{i}": C(f"p{i}") - C(f"s{i}") * C("sy") / C("sw") for i in range(k)})
    s = [[C(f"c{min(i, j)}{max(i, j)}") for j in range(k)] for i in range(k)]
    m = m.withColumns({"__det": _det(s)} | {f"__d{i}": _det([[C(f"u{r_}") if c == i else s[r_][c] for c in range(k)] for r_ in range(k)]) for i in range(k)})
    m = m.withColumns({f"coef_{x}": F.try_divide(C(f"__d{i}"), C("__det")) for i, x in enumerate(xs)})
    at = C("sy") / C("sw")
    for i, x in enumerate(xs):
        at = at - C(f"coef_{x}") * C(f"s{i}") / C("sw")
    return m.select(*by, "n", at.alias("intercept"), *[f"coef_{x}" for x in xs], *extra)


def _residual(y: str, xs: Sequence[str]) -> Column:
    out = C(y) - C("intercept")
    for x in xs:
        out = out - C(f"coef_{x}") * C(x)
    return out


def _passes(rows: DataFrame, by: Sequence[str], xs: Sequence[str], first: DataFrame, step: Callable[[int, DataFrame], DataFrame], rounds: int, tolerance: float) -> DataFrame:
    """Fits until no coefficient of any group moves by more than ``tolerance`` (of 1 plus its size), at most ``rounds`` times. Adds ``converged``."""
    names = ["intercept", *[f"coef_{x}" for x in xs]]
    fit = cut(first.withColumn("converged", F.lit(False)))
    side = F.broadcast if broadcast_if_small(fit) is not fit else (lambda x: x)  # groups don't grow from pass to pass
    for i in range(rounds):
        old = fit.select(*[C(b).alias(f"__k_{b}") for b in by], *[C(c).alias(f"__was_{c}") for c in names])
        new = step(i, rows.join(side(fit.drop("n", "converged")), list(by)))
        new = new.join(side(old), [new[b] == old[f"__k_{b}"] for b in by]).drop(*[f"__k_{b}" for b in by])
        still = reduce(Column.__and__, [F.coalesce(F.abs(C(c) - C(f"__was_{c}")) <= tolerance * (1 + F.abs(c)), F.lit(True)) for c in names])
        fit = cut(new.withColumn("converged", still).drop(*[f"__was_{c}" for c in names]), after=fit)
        if i and fit.where(~C("converged")).isEmpty():
            break
    return fit


def _solved(x: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: np.ndarray) -> np.ndarray:
    """Weighted ridge least squares with free intercept, first; NaN for a singular system."""
    sw = w.sum()
    mx, my = (w @ x) / sw, (w @ y) / sw
    s = (x * w[:, None]).T @ x - sw * np.outer(mx, mx) + np.diag(ridge)
    u = (x * w[:, None]).T @ y - sw * mx * my
    try:
        coef = np.linalg.solve(s, u)
    except np.linalg.LinAlgError:
        coef = np.full(len(u), np.nan)
    return np.append(my - mx @ coef, coef)


def _iterated(x: np.ndarray, y: np.ndarray, step: Callable[[int, np.ndarray, float], tuple[np.ndarray, float]], rounds: int, tolerance: float) -> tuple[np.ndarray, float, bool]:
    """Coefficients, scale, and whether they stand still."""
    beta, scale = _solved(x, y, np.ones(len(y)), np.zeros(x.shape[1])), max(float(y.std()), 1e-6)
    for i in range(rounds):
        new, scale = step(i, beta, scale)
        still = bool((~(np.abs(new - beta) > tolerance * (1 + np.abs(new)))).all())
        beta = new
        if i and still:
            return beta, scale, True
    return beta, scale, False


def _gathered(rows: DataFrame, by: Sequence[str], y: str, xs: Sequence[str], step_of: Callable, rounds: int, tolerance: float, scaled: bool) -> DataFrame:
    """Fits of bounded groups, each in one task. ``step_of``: the step for the rows of a group."""
    names = ["intercept", *[f"coef_{x}" for x in xs]]

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, v = pdf[list(xs)].to_numpy(dtype=float), pdf[y].to_numpy(dtype=float)
        beta, scale, still = _iterated(x, v, step_of(x, v), rounds, tolerance)
        held = {n: [None if np.isnan(b) else float(b)] for n, b in zip(names, beta)}
        return pd.DataFrame({b: [pdf[b].iloc[0]] for b in by} | held | ({"scale": [scale]} if scaled else {}) | {"converged": [still]})

    types = dict(rows.dtypes)
    schema = ", ".join([*[f"{b} {types[b]}" for b in by], *[f"{n} double" for n in names], *(["scale double"] if scaled else []), "converged boolean"])
    return rows.groupBy(*by).applyInPandas(fit, schema)


def _both_ways(df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str], least: int, most: int, first: Callable[[DataFrame], DataFrame], step: Callable, step_of: Callable, rounds: int, tolerance: float, scaled: bool) -> DataFrame:
    rows = df.dropna(subset=[*by, y, *xs]).select(*by, C(y).cast("double").alias(y), *[C(x).cast("double").alias(x) for x in xs])
    sizes = cut(rows.groupBy(*by).agg(F.count("*").alias("n")))
    side = lambda rule: rows.join(broadcast_if_small(sizes.where(rule).select(*by)), list(by), "left_semi")
    fit = _gathered(side((C("n") >= least) & (C("n") <= most)), by, y, xs, step_of, rounds, tolerance, scaled)
    large = (C("n") >= least) & (C("n") > most)
    if not sizes.where(large).isEmpty():
        held = cut(side(large))
        passed = _passes(held, by, xs, first(held), step, rounds, tolerance)
        fit = fit.unionByName(passed.select(*fit.columns))
    return sizes.join(fit, list(by), "left")


def huber(df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str], epsilon: float = 1.35, alpha: float = 1e-4, least: int = 20, rounds: int = 60, tolerance: float = 1e-6, most: int = MOST) -> DataFrame:
    """Huber regression with joint scale: n, intercept, coef_<x>, scale per group, and whether it converged; null for groups below ``least``. Rows without a group fall away.

    Minimises the summed scale plus the scaled Huber loss of the residuals plus ``alpha`` times the squared
    coefficients, by reweighting: residuals beyond ``epsilon`` scales weigh less in proportion, and the
    scale follows from its own optimum condition. Rows with a null in response or features don't count. For passes the
    columns needed are written once.
    """
    def first(rows: DataFrame) -> DataFrame:
        fit = _weighted_fit(rows, by, y, xs, F.lit(1.0), [F.lit(0.0)] * len(xs), {"spread": F.stddev_pop(y)})
        return fit.withColumn("scale", F.greatest(C("spread"), F.lit(1e-6))).drop("spread")

    def step(i: int, joined: DataFrame) -> DataFrame:
        joined = joined.withColumn("__e", _residual(y, xs))
        out = F.abs("__e") > epsilon * C("scale")
        w = F.when(out, epsilon * C("scale") / F.abs("__e")).otherwise(F.lit(1.0))
        extra = {"__in": F.sum(F.when(out, 0.0).otherwise(C("__e") * C("__e"))), "__out": F.count(F.when(out, 1)), "__old": F.max("scale")}
        new = _weighted_fit(joined, by, y, xs, w, [alpha * C("scale")] * len(xs), extra)
        free = C("n") - C("__out") * epsilon * epsilon
        scale = F.when(free > 0, F.greatest(F.lit(1e-9), F.sqrt(C("__in") / free))).otherwise(C("__old"))
        return new.withColumn("scale", scale).drop("__in", "__out", "__old")

    def step_of(x: np.ndarray, v: np.ndarray) -> Callable:
        def one(i: int, beta: np.ndarray, scale: float) -> tuple[np.ndarray, float]:
            e = v - beta[0] - x @ beta[1:]
            size = np.abs(e)
            out = size > epsilon * scale
            new = _solved(x, v, np.where(out, epsilon * scale / np.where(out, size, 1.0), 1.0), np.full(x.shape[1], alpha * scale))
            free = len(v) - out.sum() * epsilon * epsilon
            return new, max(1e-9, float(np.sqrt((e[~out] @ e[~out]) / free))) if free > 0 else scale

        return one

    return _both_ways(df, by, y, xs, least, most, first, step, step_of, rounds, tolerance, True)


def quantile(df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str], tau: float = 0.5, alpha: float = 0.0, least: int = 20, rounds: int = 60, tolerance: float = 1e-5, most: int = MOST) -> DataFrame:
    """Quantile regression with an L1 penalty ``alpha`` on the coefficients: n, intercept, coef_<x>, converged per group.

    Both absolute values are majorised by parabolas at the last fit, which turns each pass into a weighted
    ridge fit; the floor of the parabolas shrinks from pass to pass.
    """
    def first(rows: DataFrame) -> DataFrame:
        return _weighted_fit(rows, by, y, xs, F.lit(1.0), [F.lit(0.0)] * len(xs), {}).withColumn("rows", C("n"))

    def step(i: int, joined: DataFrame) -> DataFrame:
        floor = max(1e-6, 0.1 * 0.6**i)
        joined = joined.withColumn("__e", _residual(y, xs))
        w = F.when(C("__e") >= 0, F.lit(tau)).otherwise(F.lit(1 - tau)) / F.greatest(F.abs("__e"), F.lit(floor))
        ridge = [alpha * C("rows") / F.greatest(F.abs(f"coef_{x}"), F.lit(floor)) for x in xs]
        return _weighted_fit(joined, by, y, xs, w, ridge, {}).withColumn("rows", C("n"))

    def step_of(x: np.ndarray, v: np.ndarray) -> Callable:
        def one(i: int, beta: np.ndarray, scale: float) -> tuple[np.ndarray, float]:
            floor = max(1e-6, 0.1 * 0.6**i)
            e = v - beta[0] - x @ beta[1:]
            w = np.where(e >= 0, tau, 1 - tau) / np.maximum(np.abs(e), floor)
            return _solved(x, v, w, alpha * len(v) / np.maximum(np.abs(beta[1:]), floor)), scale

        return one

    return _both_ways(df, by, y, xs, least, most, first, step, step_of, rounds, tolerance, False)


def elastic_net(df: DataFrame, by: Sequence[str], y: str, xs: Sequence[str], fold: Column, folds: int = 5, ratio: float = 0.5, path: int = 50, least: int = 50) -> DataFrame:
    """Elastic net on standardised features, penalty chosen by cross-validation: n, penalty, intercept, coef_<x>.

    The data are read once: moments per group and fold. All fits, and the errors on the folds left out,
    follow from those moments, so the Python side sees ``folds`` rows per group.
    """
    rows = df.dropna(subset=[y, *xs]).withColumn("__f", F.pmod(fold, F.lit(folds)).cast("int"))
    cols = [y, *xs]
    agg = [F.count("*").alias("n")] + [F.sum(C(a).cast("double")).alias(f"s{i}") for i, a in enumerate(cols)]
    agg += [F.sum(C(cols[i]).cast("double") * C(cols[j])).alias(f"q{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    m = rows.groupBy(*by, "__f").agg(*agg)
    k = len(xs)

    def moments_of(part: pd.DataFrame) -> tuple[float, np.ndarray, np.ndarray]:
        n = float(part["n"].sum())
        s = np.array([part[f"s{i}"].sum() for i in range(k + 1)])
        q = np.array([[part[f"q{min(i, j)}_{max(i, j)}"].sum() for j in range(k + 1)] for i in range(k + 1)])
        return n, s, q

    def descend(g: np.ndarray, c: np.ndarray, lam: float, b: np.ndarray) -> np.ndarray:
        for _ in range(1000):
            old = b.copy()
            for i in range(k):
                r = c[i] - g[i] @ b + g[i, i] * b[i]
                b[i] = np.sign(r) * max(abs(r) - lam * ratio, 0) / (g[i, i] + lam * (1 - ratio)) if g[i, i] > 0 else 0.0
            if np.abs(b - old).max() < 1e-9:
                break
        return b

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        n, s, q = moments_of(pdf)
        head = {b: [pdf[b].iloc[0]] for b in by} | {"n": [int(n)]}
        blank = {"penalty": [None], "intercept": [None]} | {f"coef_{x}": [None] for x in xs}
        mean = s / n
        cov = q / n - np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov), 0))[1:]
        if n < least or pdf["__f"].nunique() < 2 or not (sd > 0).any():
            return pd.DataFrame(head | blank)
        scale = np.where(sd > 0, sd, 1.0)

        def standard(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return cov[1:, 1:] / np.outer(scale, scale), cov[1:, 0] / scale

        g, c = standard(cov)
        top = np.abs(c).max() / max(ratio, 1e-3)
        lams = top * np.logspace(0, -3, path) if top > 0 else np.zeros(1)
        error = np.zeros(len(lams))
        for f in sorted(pdf["__f"].unique()):
            nt, st, qt = moments_of(pdf[pdf["__f"] != f])
            nv, sv, qv = moments_of(pdf[pdf["__f"] == f])
            mt = st / nt
            gt, ct = standard(qt / nt - np.outer(mt, mt))
            b = np.zeros(k)
            for i, lam in enumerate(lams):
                b = descend(gt, ct, lam, b)
                w = np.concatenate([[1.0], -b / scale])
                a = mt[0] - mt[1:] @ (b / scale)
                error[i] += w @ qv @ w - 2 * a * (w @ sv) + nv * a * a
        lam = lams[int(np.argmin(error))]
        b = descend(g, c, lam, np.zeros(k)) / scale
        return pd.DataFrame(head | {"penalty": [float(lam)], "intercept": [float(mean[0] - mean[1:] @ b)]} | {f"coef_{x}": [float(v)] for x, v in zip(xs, b)})

    types = dict(df.dtypes)
    schema = ", ".join([*[f"{b} {types[b]}" for b in by], "n long", "penalty double", "intercept double", *[f"coef_{x} double" for x in xs]])
    return m.groupBy(*by).applyInPandas(solve, schema)

