"""Iterative fits and resampling over the given tables. Fits have no SQL (tests compare them with numpy); draws are arithmetic, so SQL states the resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusmill.functions import scalars as S
from locusmill.operators import resample, robust
from locusmill.operators.resample import cutoffs
from locusmill.plans import views
from locusmill.plans.composite_queries import _DK, K, _arms, _control_delta, _prevalences
from locusmill.plans.registry import drawn_sql, q, query
from locusmill.plans.stat_queries import _DELTA, XS, O, _delta, quant
from locusmill.session import cut

C = F.col
COEFS = ("intercept", "coef_cn", "coef_near", "coef_far")


@query()
def huber_fit(s, d):
    return quant(robust.huber(views.observations(s, d), ["gene"], "y", list(XS)), *COEFS, "scale")


@query()
def huber_kernel(s, d):
    """The response of a gene on its copies and the kernel of its breakpoint distance."""
    o = views.observations(s, d).withColumn("prox", S.kernels(C("dist"))["prox_exp_100k"])
    return quant(robust.huber(o, ["gene"], "y", ["cn", "prox"], least=10), "intercept", "coef_cn", "coef_prox", "scale")


@query()
def huber_nested(s, d):
    """Nested windows and the inverse distance (in units of 1e-5)."""
    o = views.observations(s, d).withColumns({"w1": (C("dist") <= 100_000).cast("int"), "w2": (C("dist") <= 1_000_000).cast("int"), "inv": F.lit(1e5) / (C("dist") + 1000)})
    return quant(robust.huber(o, ["gene"], "y", ["cn", "w1", "w2", "inv"], least=20), "intercept", "coef_cn", "coef_w1", "coef_w2", "coef_inv", "scale")


@query()
def quantile_fit(s, d):
    return quant(robust.quantile(views.observations(s, d), ["gene"], "y", list(XS), alpha=0.0), *COEFS)


@query()
def quantile_ridge(s, d):
    """With the penalty on absolute coefficients."""
    return quant(robust.quantile(views.observations(s, d), ["gene"], "y", list(XS), alpha=0.01), *COEFS)


@query()
def enet_fit(s, d):
    return quant(robust.elastic_net(views.observations(s, d), ["gene"], "y", list(XS), C("id")), "penalty", *COEFS)


@query()
def robust_slope(s, d):
    x = _delta(s, d).join(_prevalences(s, d), "gene").select(F.lit(1).alias("all"), C("delta"), C("p_true"), C("n").cast("double").alias("n_rows"))
    return quant(robust.huber(x, ["all"], "delta", ["p_true", "n_rows"], least=5).drop("all"), "intercept", "coef_p_true", "coef_n_rows", "scale")


def _weight(key: str, seed: int = 42) -> str:
    draw = drawn_sql(seed, key, "rep")
    return "(" + " + ".join(f"CAST({draw} >= {c} AS INT)" for c in cutoffs()) + ")"


def _number(c: str) -> str:
    return f"CAST('0x' || substr(md5(CAST({c} AS VARCHAR)), 1, 7) AS BIGINT)"


def _boot_sql(frm: str, values: dict[str, str], stat: str, reps: int = 1000) -> str:
    """frm: rows with kx (the key's number) and the values."""
    drawn = f"bw AS (SELECT *, {_weight('kx')} AS w FROM ({frm}), (SELECT unnest(range(1, {reps + 1})) AS rep))"
    if stat == "median":
        per = "br AS (SELECT rep, " + ", ".join(f"median({v}) AS {v}" for v in values) + " FROM (SELECT *, unnest(range(w)) FROM bw) GROUP BY rep)"
    else:
        per = "br AS (SELECT rep, " + ", ".join(f"CASE WHEN sum(w) > 0 THEN sum({v} * w) / sum(w) END AS {v}" for v in values) + " FROM bw GROUP BY rep)"
    point = ", ".join(f"(SELECT {q(('median' if stat == 'median' else 'avg') + f'({v})')} FROM ({frm})) AS {n}" for v, n in values.items())
    return f"{drawn}, {per} SELECT {point}, " + ", ".join(f"{q(f'quantile_cont({v}, 0.025)')} AS {n}_lo, {q(f'quantile_cont({v}, 0.975)')} AS {n}_hi" for v, n in values.items()) + " FROM br"


def _interval(df, *names):
    return quant(df, *[c for n in names for c in (n, f"{n}_lo", f"{n}_hi")])


@query(f"{O}, {_DELTA}, {_boot_sql(f'SELECT {_number("gene")} AS kx, delta FROM dl', {'delta': 'delta'}, 'median')}")
def boot_median(s, d):
    return _interval(resample.bootstrap(_delta(s, d), ["delta"], "gene", "median", 1000), "delta")


@query(f"{O}, {_DELTA}, {_boot_sql(f'SELECT {_number("gene")} AS kx, CAST(floor(delta * 1e6 + 0.5) > 0 AS DOUBLE) AS positive FROM dl', {'positive': 'positive'}, 'mean')}")
def boot_mean(s, d):
    x = _delta(s, d).withColumn("positive", (F.floor(C("delta") * 1e6 + 0.5) > 0).cast("double"))
    return _interval(resample.bootstrap(x, ["positive"], "gene", "mean", 1000), "positive")


@query(f"{K}, {_DELTA}, {_DK}, {_boot_sql(f'SELECT {_number("gene")} AS kx, delta, dk FROM dl JOIN dk USING (gene)', {'delta': 'delta', 'dk': 'dk'}, 'median')}")
def boot_paired(s, d):
    return _interval(resample.bootstrap(_arms(s, d), ["delta", "dk"], "gene", "median", 1000), "delta", "dk")


@query(f"{O}, {_boot_sql(f'SELECT {_number("lineage")} AS kx, avg(y) AS mean FROM obs WHERE lineage IS NOT NULL GROUP BY lineage', {'mean': 'mean'}, 'mean')}")
def boot_strata(s, d):
    return _interval(resample.strata_bootstrap(views.observations(s, d).where("lineage is not null"), "lineage", "y", 1000), "mean")


@query(f"""{O}, sx AS (SELECT lineage, {_number('gene')} AS kx, sum(cn * y) AS xy, sum(cn * cn) AS xx FROM obs WHERE lineage IS NOT NULL GROUP BY lineage, gene),
rx AS (SELECT lineage, rep, sum(w * xy) / sum(w * xx) AS slope FROM (SELECT *, CASE WHEN rep = 0 THEN 1 ELSE {_weight('kx')} END AS w FROM sx, (SELECT unnest(range(0, 401)) AS rep)) GROUP BY lineage, rep HAVING sum(w * xx) > 0)
SELECT lineage, {q('max(slope) FILTER (rep = 0)')} AS slope, {q('quantile_cont(slope, 0.025) FILTER (rep > 0)')} AS lo, {q('quantile_cont(slope, 0.975) FILTER (rep > 0)')} AS hi FROM rx GROUP BY lineage""")
def boot_cluster(s, d):
    return quant(resample.cluster_bootstrap(views.observations(s, d).where("lineage is not null"), "lineage", "gene", "y", "cn"), "slope", "lo", "hi")


@query(f"""{K}, {_DELTA}, {_DK}, pp AS (SELECT {_number('gene')} * 2 + 1 AS k, delta AS v, 1 AS arm FROM dl UNION ALL SELECT {_number('gene')} * 2, dk, 0 FROM dk), nn AS (SELECT count(*) FILTER (arm = 1) AS n_a, count(*) FILTER (arm = 0) AS n_b FROM pp),
se AS (SELECT median(v) FILTER (arm = 1) - median(v) FILTER (arm = 0) AS difference FROM pp),
od AS (SELECT rep, v, row_number() OVER (PARTITION BY rep ORDER BY {drawn_sql(42, 'k', 'rep')} * 536870912 + k) AS i FROM pp, (SELECT unnest(range(1, 1001)) AS rep)),
dr AS (SELECT rep, median(v) FILTER (i <= n_a) - median(v) FILTER (i > n_a) AS x FROM od, nn GROUP BY rep)
SELECT (SELECT {q('difference')} FROM se) AS difference, avg(CAST(x >= (SELECT difference FROM se) AS INT)) AS p, (SELECT n_a FROM nn) AS n_a, (SELECT n_b FROM nn) AS n_b FROM dr""")
def perm_median(s, d):
    o = cut(views.controlled(s, d))
    b = _control_delta(s, d, o).select("gene", C("dk").alias("delta"))
    return quant(resample.permutation_medians(_delta(s, d).select("gene", "delta"), b, "delta", "gene"), "difference")


@query()
def perm_gene(s, d):
    o = views.observations(s, d).withColumn("c", C("y") - C("yc"))
    return quant(resample.permutation_genes(o, "gene", "id", "y", "cn", "c"), "drop", "p")


@query()
def eb_posterior(s, d):
    c = views.corrected(s, d).where("y is not null and yc is not null").groupBy("gene").agg(
        F.count(F.when(C("y") < 0, 1)).alias("ha"), F.count("*").alias("ta"), F.count(F.when(C("yc") < 0, 1)).alias("hb"), F.count("*").alias("tb")
    )
    return quant(resample.posterior_difference(c, "gene", "ha", "ta", "hb", "tb"), "p", "difference")
