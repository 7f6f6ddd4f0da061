"""Aggregates, windows, correlations, models and tests over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusmill.functions import scalars as S
from locusmill.functions.quant import q6
from locusmill.functions.quant import q20 as b20
from locusmill.operators import clean, pvalues, stats
from locusmill.operators.controls import drawn, key_number
from locusmill.operators.ranges import cumulated, joined, median, summarised
from locusmill.session import broadcast_if_small, cut
from locusmill.plans import views
from locusmill.plans.registry import drawn_sql, q, q20, query
from locusmill.sources.tables import table

C = F.col
O = f"WITH {views.OBS_SQL}"  # noqa: E741
D = f"WITH {views.CORR_SQL}"


def nn(x: str) -> str:
    return f"(CASE WHEN isnan({x}) OR isinf({x}) THEN NULL ELSE {x} END)"


def corr(a: str, b: str) -> str:
    return nn(f"corr({a}, {b})")


def quant(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: q6(C(c)) for c in columns})


@query("SELECT gene, count(*) AS n, count(DISTINCT cell_line) AS cells, count(*) FILTER (dependency IS NULL) AS missing FROM dependency GROUP BY gene")
def agg_counts(s, d):
    return table(s, d, "dependency").groupBy("gene").agg(F.count("*").alias("n"), F.countDistinct("cell_line").alias("cells"), F.count(F.when(C("dependency").isNull(), 1)).alias("missing"))


@query(f"{D} SELECT gene, {q20('median(y)')} AS med, {q20('quantile_cont(y, 0.025)')} AS lo, {q20('quantile_cont(y, 0.975)')} AS hi FROM dc GROUP BY gene")
def quantiles(s, d):
    x = summarised(views.corrected(s, d), ["gene"], {"med": (C("y"), 0.5), "p": (C("y"), [0.025, 0.975])})
    return x.select("gene", b20(C("med")).alias("med"), b20(C("p")[0]).alias("lo"), b20(C("p")[1]).alias("hi"))


@query(f"{D} SELECT gene, {q20('var_samp(y)')} AS v, {q20('stddev_samp(y)')} AS s FROM dc GROUP BY gene")
def variance(s, d):
    return views.corrected(s, d).groupBy("gene").agg(b20(F.var_samp("y")).alias("v"), b20(F.stddev_samp("y")).alias("s"))


@query(f"{D}, m AS (SELECT gene, median(y) AS m FROM dc GROUP BY gene) SELECT gene, {q('median(abs(y - m)) + 1e-9')} AS mad FROM dc JOIN m USING (gene) GROUP BY gene")
def mad(s, d):
    return quant(stats.mad(views.corrected(s, d), ["gene"], "y"), "mad")


@query(f"""SELECT gene, cell_line, {q('avg(cn)')} AS cn, max(prox_exp_100k) AS k100, max(prox_exp_250k) AS k250, min(bp_dist) AS bp_dist, max(prox_any_100k) AS any100
FROM design GROUP BY gene, cell_line""")
def chrom_rollup(s, d):
    x = table(s, d, "design").groupBy("gene", "cell_line").agg(F.avg("cn").alias("cn"), F.max("prox_exp_100k").alias("k100"), F.max("prox_exp_250k").alias("k250"), F.min("bp_dist").alias("bp_dist"), F.max("prox_any_100k").alias("any100"))
    return quant(x, "cn")


@query(f"WITH {views.SEGMENTS_SQL} SELECT cell, {q('sum(CASE WHEN abs(cn - 2) > 0.3 THEN e - s ELSE 0 END) / sum(e - s)')} AS fga FROM seg GROUP BY cell")
def fga(s, d):
    length = C("e") - C("s")
    return views.segments(s, d).groupBy("cell").agg(q6(F.try_divide(F.sum(F.when(F.abs(C("cn") - 2) > 0.3, length).otherwise(0)), F.sum(length))).alias("fga"))


@query("SELECT source, count(*) AS n FROM cnv GROUP BY source ORDER BY n DESC, source LIMIT 10")
def top_counts(s, d):
    return table(s, d, "cnv").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(10)


@query(f"SELECT source, {q('avg(CAST(cn IS NULL AS INT))')} AS missing FROM design GROUP BY source")
def missing_fraction(s, d):
    return table(s, d, "design").groupBy("source").agg(q6(F.avg(C("cn").isNull().cast("int"))).alias("missing"))


@query(f"{D} SELECT gene, {q('coalesce(median(y - yc) FILTER (abs(contrib) > 0.05), 0)')} AS drop_active FROM dc GROUP BY gene")
def conditional_median(s, d):
    x = median(views.corrected(s, d), ["gene"], F.when(F.abs("contrib") > 0.05, C("y") - C("yc")))
    return x.select("gene", q6(F.coalesce("median", F.lit(0.0))).alias("drop_active"))


@query(f"{O} SELECT gene, count(*) AS n, {q(corr('y', 'cn'))} AS r FROM obs GROUP BY gene HAVING count(*) >= 3")
def corr_by_group(s, d):
    return views.observations(s, d).groupBy("gene").agg(F.count("*").alias("n"), q6(stats.pearson(C("y"), C("cn"))).alias("r")).where("n >= 3")


def delta_sql(name: str, yc: str, frm: str = "obs", by: str = "gene") -> str:
    return f"{name} AS (SELECT {by}, n, r0, r1, abs(r0) - abs(r1) AS delta FROM (SELECT {by}, count(*) AS n, {corr('y', 'cn')} AS r0, {corr(yc, 'cn')} AS r1 FROM {frm} GROUP BY {by}) WHERE n >= 10 AND r0 IS NOT NULL AND r1 IS NOT NULL)"


_DELTA = delta_sql("dl", "yc")


def _delta(s, d):
    return stats.delta_abs_corr(views.observations(s, d), ["gene"], "cn", "y", "yc")


@query(f"{O}, {_DELTA} SELECT gene, n, {q('r0')} AS r0, {q('r1')} AS r1, {q('delta')} AS delta FROM dl")
def delta_abs_corr(s, d):
    return quant(_delta(s, d), "r0", "r1", "delta")


_RANK = "rank() OVER (PARTITION BY gene ORDER BY {0}) + (count(*) OVER (PARTITION BY gene, {0}) - 1) / 2.0"


@query(f"{O} SELECT gene, count(*) AS n, {q(corr('ra', 'rb'))} AS rho FROM (SELECT gene, {_RANK.format('y')} AS ra, {_RANK.format('cn')} AS rb FROM obs) GROUP BY gene HAVING count(*) >= 3")
def spearman(s, d):
    return quant(stats.spearman(views.observations(s, d), ["gene"], "y", "cn").where("n >= 3"), "rho")


@query(f"SELECT {', '.join(f'{q(corr(chr(99)+chr(110), k))} AS {k}' for k in S.DECAYS)} FROM design")
def corr_vector(s, d):
    return table(s, d, "design").agg(*[q6(stats.pearson(C("cn"), C(k))).alias(k) for k in S.DECAYS])


@query(f"SELECT count(cn) AS n, {q('avg(cn)')} AS mean, {q('stddev_samp(cn)')} AS sd, min(cn) AS lo, median(cn) AS med, max(cn) AS hi FROM design")
def describe(s, d):
    return summarised(table(s, d, "design"), [], {"med": (C("cn"), 0.5)}, n=F.count("cn"), mean=q6(F.avg("cn")), sd=q6(F.stddev_samp("cn")), lo=F.min("cn"), hi=F.max("cn"))


@query(f"SELECT gene, count(DISTINCT cell_line) AS n_cells, count(*) FILTER (bp_dist <= 250000) AS within_w, {q('count(*) FILTER (bp_dist <= 250000) / count(*)')} AS frac_w FROM design GROUP BY gene")
def gene_prox_rates(s, d):
    w = F.count(F.when(C("bp_dist") <= 250_000, 1))
    return table(s, d, "design").groupBy("gene").agg(F.countDistinct("cell_line").alias("n_cells"), w.alias("within_w"), q6(w / F.count("*")).alias("frac_w"))


@query(f"{O}, l AS (SELECT gene, lineage, count(*) AS n, abs({corr('y', 'cn')}) - abs({corr('yc', 'cn')}) AS delta FROM obs GROUP BY gene, lineage) SELECT gene, count(*) FILTER (n >= 5 AND floor(delta * 1e6 + 0.5) > 0) AS breadth FROM l GROUP BY gene")
def lineage_breadth(s, d):
    x = views.observations(s, d).groupBy("gene", "lineage").agg(F.count("*").alias("n"), (F.abs(stats.pearson(C("y"), C("cn"))) - F.abs(stats.pearson(C("yc"), C("cn")))).alias("delta"))
    return x.groupBy("gene").agg(F.count(F.when((C("n") >= 5) & (q6(C("delta")) > 0), 1)).alias("breadth"))


@query(f"{O}, z AS (SELECT gene, avg(cn) AS m, stddev_samp(cn) AS s FROM obs GROUP BY gene) SELECT id, {q('CASE WHEN s > 0 THEN (cn - m) / s ELSE 0 END')} AS cn_std FROM obs JOIN z USING (gene)")
def zscore(s, d):
    return stats.zscore(views.observations(s, d), ["gene"], "cn").select("id", q6(C("cn_std")).alias("cn_std"))


@query(f"""WITH r AS (SELECT design_id, cell_line, bp_dist, row_number() OVER (PARTITION BY cell_line ORDER BY design_id) - 1 AS i, count(*) OVER (PARTITION BY cell_line) AS n, stddev_samp(bp_dist) OVER (PARTITION BY cell_line) AS sd FROM design WHERE cell_line IS NOT NULL),
k AS (SELECT *, 1 + {drawn_sql(5, "CAST('0x' || substr(md5(cell_line), 1, 7) AS BIGINT)")} % greatest(1, n - 1) AS shift FROM r WHERE n > 1 AND sd >= 1e-9) SELECT a.design_id, b.bp_dist AS rolled FROM k a JOIN k b ON a.cell_line = b.cell_line AND b.i = (a.i - a.shift + a.n) % a.n""")
def roll(s, d):
    """Each cell's distances turned by a drawn number of places; cells with one row or without spread are left out."""
    t = table(s, d, "design").where("cell_line is not null").select("design_id", "cell_line", "bp_dist")
    return stats.roll(t, ["cell_line"], "design_id", "bp_dist", lambda n: 1 + F.pmod(drawn(5, key_number(C("cell_line"))), F.greatest(F.lit(1), n - 1))).select("design_id", "rolled")


@query(f"{O}, m AS (SELECT gene, median(cn) AS m FROM obs GROUP BY gene) SELECT id, {q('cn - m')} AS centred FROM obs JOIN m USING (gene)")
def center(s, d):
    o = views.observations(s, d)
    return o.join(broadcast_if_small(median(o, ["gene"], "cn", "m")), "gene").select("id", q6(C("cn") - C("m")).alias("centred"))


_GENE_AGG = f"g AS (SELECT gene, {q('avg(y)')} AS a, {q('avg(abs(contrib))')} AS b FROM dc GROUP BY gene HAVING count(y) >= 5)"


def _gene_agg(s, d):
    g = views.corrected(s, d).groupBy("gene").agg(F.count("y").alias("n"), q6(F.avg("y")).alias("a"), q6(F.avg(F.abs("contrib"))).alias("b"))
    return g.where("n >= 5").drop("n")


_AVG = "rank() OVER (ORDER BY {0} NULLS LAST) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@query(f"{D}, {_GENE_AGG} SELECT gene, 0.5::DOUBLE * ra + 0.5::DOUBLE * rb AS score FROM (SELECT gene, {_AVG.format('a')} AS ra, {_AVG.format('b')} AS rb FROM g WHERE a IS NOT NULL AND b IS NOT NULL)")
def rank_score(s, d):
    g = _gene_agg(s, d).where("a is not null and b is not null")
    r = stats.average_rank(stats.average_rank(g, [], "a", "ra"), [], "b", "rb")
    return r.select("gene", (0.5 * C("ra") + 0.5 * C("rb")).alias("score"))


_EDGES = "ed AS (SELECT list_sort(list_distinct(list_transform(quantile_cont({v}, [{at}]), lambda x: floor(x * 1e6 + 0.5) / 1e6))) AS edges FROM {t})"
_TENTHS = ", ".join(str(i / 10) for i in range(11))
_BIN = "CASE WHEN {v} >= edges[1] AND {v} <= edges[-1] THEN greatest(0, len(list_filter(edges, lambda e: e < {v})) - 1) END"


@query(f"{D}, {_GENE_AGG}, {_EDGES.format(v='a', at=_TENTHS, t='g')} SELECT gene, CAST({_BIN.format(v='a')} AS INT) AS bin FROM g, ed")
def qcut(s, d):
    g = _gene_agg(s, d)
    return g.join(F.broadcast(stats.quantile_edges(g, "a", 10)), F.lit(True)).select("gene", stats.bins(C("a"), C("edges")).alias("bin"))


@query(f"{D}, {_GENE_AGG}, {_EDGES.format(v='a', at=_TENTHS, t='g')} SELECT gene, CAST({_BIN.format(v='b')} AS INT) AS bin FROM g, ed")
def cut_edges(s, d):
    g = _gene_agg(s, d)
    return g.join(F.broadcast(stats.quantile_edges(g, "a", 10)), F.lit(True)).select("gene", stats.bins(C("b"), C("edges")).alias("bin"))


@query(f"{D}, {_GENE_AGG}, t AS (SELECT quantile_cont(a, 0.25) AS q1, quantile_cont(a, 0.5) AS q2, quantile_cont(a, 0.75) AS q3, quantile_cont(a, 0.33) AS t1, quantile_cont(a, 0.67) AS t2 FROM g) SELECT gene, CASE WHEN a <= q1 THEN 'Q1' WHEN a <= q2 THEN 'Q2' WHEN a <= q3 THEN 'Q3' ELSE 'Q4' END AS quartile, CASE WHEN a <= t1 THEN 'low' WHEN a <= t2 THEN 'mid' ELSE 'high' END AS tertile FROM g, t WHERE a IS NOT NULL")
def quartile_bin(s, d):
    g = _gene_agg(s, d).where("a is not null")
    t = g.agg(F.percentile("a", F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75, 0.33, 0.67)])).alias("t"))
    q4 = F.when(C("a") <= C("t")[0], "Q1").when(C("a") <= C("t")[1], "Q2").when(C("a") <= C("t")[2], "Q3").otherwise("Q4")
    t3 = F.when(C("a") <= C("t")[3], "low").when(C("a") <= C("t")[4], "mid").otherwise("high")
    return g.join(F.broadcast(t), F.lit(True)).select("gene", q4.alias("quartile"), t3.alias("tertile"))




@query(f"""{D}, {_GENE_AGG}, {_EDGES.format(v='a', at='0.0, 0.2, 0.4, 0.6, 0.8, 1.0', t='g')}, eb AS (SELECT list_sort(list_distinct(list_transform(quantile_cont(b, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]), lambda x: floor(x * 1e6 + 0.5) / 1e6))) AS edges FROM g),
c AS (SELECT gene, {_BIN.format(v='a').replace('edges', 'ed.edges')} AS i, {_BIN.format(v='b').replace('edges', 'eb.edges')} AS j FROM g, ed, eb)
SELECT gene, CAST(i AS INT) AS i, CAST(j AS INT) AS j FROM (SELECT *, row_number() OVER (PARTITION BY i, j ORDER BY md5(gene)) AS k FROM c WHERE i IS NOT NULL AND j IS NOT NULL) WHERE k <= 5 ORDER BY k, i, j LIMIT 100""")
def stratified_sample(s, d):
    g = _gene_agg(s, d)
    a, b = (stats.quantile_edges(g, v, 5).withColumnRenamed("edges", f"e{v}") for v in ("a", "b"))
    c = g.join(F.broadcast(a), F.lit(True)).join(F.broadcast(b), F.lit(True)).select("gene", stats.bins(C("a"), C("ea")).alias("i"), stats.bins(C("b"), C("eb")).alias("j"))
    k = F.row_number().over(Window.partitionBy("i", "j").orderBy(F.md5("gene")))
    return c.where("i is not null and j is not null").withColumn("k", k).where("k <= 5").orderBy("k", "i", "j").limit(100).drop("k")


@query(f"{D}, {_GENE_AGG} SELECT gene, a, b FROM g ORDER BY b DESC NULLS LAST, a, gene")
def multi_sort(s, d):
    return _gene_agg(s, d).orderBy(F.desc_nulls_last("b"), "a", "gene")


@query(f"{D}, {_GENE_AGG} SELECT gene, b FROM g ORDER BY b DESC NULLS LAST, gene LIMIT 50")
def topk(s, d):
    return _gene_agg(s, d).select("gene", "b").orderBy(F.desc_nulls_last("b"), "gene").limit(50)


@query(f"{D}, {_GENE_AGG} SELECT gene FROM (SELECT gene, row_number() OVER (ORDER BY b DESC NULLS LAST, gene) AS i, count(*) OVER () AS n FROM g) WHERE i <= greatest(10, CAST(floor(n * 0.1) AS INT))")
def top_fraction(s, d):
    return top_share(_gene_agg(s, d), "b", "gene", 0.1, 10).select("gene")


def top_share(df: DataFrame, value: str, key: str, share: float, least: int) -> DataFrame:
    """The rows with the largest values: ``share`` of all, at least ``least``; ties by key."""
    kept = cut(df.withColumn("__down", F.coalesce(-C(value), F.lit(float("inf")))))
    take = max(least, int(kept.count() * share))
    before = cumulated(kept.groupBy("__down").agg(F.count("*").alias("__n")), "__down", "__n").where(C("__before") < take)
    inside = joined(kept, broadcast_if_small(before), ["__down"])
    place = F.row_number().over(Window.partitionBy("__down").orderBy(key))  # among the rows that tie at the edge
    whole = inside.where(C("__before") + C("__n") <= take)
    return whole.unionByName(inside.where(C("__before") + C("__n") > take).withColumn("__at", place).where(C("__at") <= take - C("__before")).drop("__at")).drop("__down", "__n", "__before")


@query("SELECT source, arg_min(cn, struct_pack(a := abs(cn - 2), b := design_id)) AS closest FROM design WHERE cn IS NOT NULL GROUP BY source")
def argmin(s, d):
    return table(s, d, "design").where("cn is not null").groupBy("source").agg(F.min_by("cn", F.struct(F.abs(C("cn") - 2), "design_id")).alias("closest"))


@query(f"{D}, {_GENE_AGG}, h AS (SELECT count(*) FILTER (b > 10) AS n FROM g) SELECT gene FROM (SELECT gene, b, row_number() OVER (ORDER BY b DESC NULLS LAST, gene) AS i, n FROM g, h) WHERE CASE WHEN n >= 20 THEN b > 10 ELSE i <= 20 END")
def select_fallback(s, d):
    g = _gene_agg(s, d)
    above = g.where("b > 10")
    return (above if above.limit(20).count() >= 20 else g.orderBy(F.desc_nulls_last("b"), "gene").limit(20)).select("gene")


@query("SELECT design_id FROM design ORDER BY (design_id * 2654435761 + 97) % 1000003, design_id LIMIT 500")
def seeded_sample(s, d):
    return table(s, d, "design").select("design_id").orderBy((C("design_id") * 2654435761 + 97) % 1000003, "design_id").limit(500)




def moments_sql(y: str, xs: tuple[str, ...], by: str = "gene", frm: str = "obs", name: str = "m") -> str:
    v = (y, *xs)
    pairs = [(a, b) for i, a in enumerate(v) for b in v[i:]]
    return f"{name} AS (SELECT {by}, count(*) AS n, " + ", ".join(f"avg({a}) AS m_{a}" for a in v) + ", " + ", ".join(f"covar_pop({a}, {b}) AS s_{a}_{b}" for a, b in pairs) + f" FROM {frm} GROUP BY {by})"


def _sound(det: str, scale: str, x: str) -> str:
    return f"CASE WHEN abs({det}) > 1e-9 * abs({scale}) THEN ({x}) / ({det}) END"


def fit3_sql(y: str, a: str, b: str, c: str, least: int = 20, by: str = "gene", name: str = "f", frm: str = "m") -> str:
    """Least squares on three features by Cramer's rule from the moments: b0 to b3, ex (explained), s_y_y."""
    s = lambda u, v: f"s_{u}_{v}" if (y, a, b, c).index(u) <= (y, a, b, c).index(v) else f"s_{v}_{u}"
    det3 = lambda p, q_, r: f"({p[0]} * ({q_[1]} * {r[2]} - {q_[2]} * {r[1]}) - {p[1]} * ({q_[0]} * {r[2]} - {q_[2]} * {r[0]}) + {p[2]} * ({q_[0]} * {r[1]} - {q_[1]} * {r[0]}))"
    m = [[s(u, v) for v in (a, b, c)] for u in (a, b, c)]
    det, scale = det3(*m), f"{s(a, a)} * {s(b, b)} * {s(c, c)}"
    coef = [_sound(det, scale, det3(*[[s(y, (a, b, c)[i]) if j == k else m[i][j] for j in range(3)] for i in range(3)])) for k in range(3)]
    return (
        f"{name} AS (SELECT *, m_{y} - b1 * m_{a} - b2 * m_{b} - b3 * m_{c} AS b0, b1 * {s(y, a)} + b2 * {s(y, b)} + b3 * {s(y, c)} AS ex FROM (SELECT *, {coef[0]} AS b1, {coef[1]} AS b2, {coef[2]} AS b3 FROM {frm} WHERE n >= {least}))"
    )


XS = ("cn", "near", "far")
_M3, _FIT3 = moments_sql("y", XS), fit3_sql("y", *XS)


@query(f"{O} SELECT gene, {q('regr_slope(y, cn)')} AS coef_cn, {q('regr_intercept(y, cn)')} AS intercept, {q('CASE WHEN var_pop(y) > 0 THEN regr_r2(y, cn) END')} AS r2 FROM obs GROUP BY gene HAVING count(*) >= 3")
def ols1(s, d):
    return quant(stats.ols(views.observations(s, d), ["gene"], "y", ["cn"], least=3), "coef_cn", "intercept", "r2").select("gene", "coef_cn", "intercept", "r2")


_S2 = "s_cn_cn * s_near_near - s_cn_near * s_cn_near"


@query(f"""{O}, {_M3} SELECT gene, {q(_sound(_S2, 's_cn_cn * s_near_near', 's_y_cn * s_near_near - s_y_near * s_cn_near'))} AS coef_cn,
{q(_sound(_S2, 's_cn_cn * s_near_near', 's_cn_cn * s_y_near - s_cn_near * s_y_cn'))} AS coef_near FROM m WHERE n >= 10""")
def ols2(s, d):
    return quant(stats.ols(views.observations(s, d), ["gene"], "y", ["cn", "near"], least=10), "coef_cn", "coef_near").select("gene", "coef_cn", "coef_near")


def _fit3(s, d, o=None):
    return stats.ols(views.observations(s, d) if o is None else o, ["gene"], "y", list(XS), least=20)


@query(f"{O}, {_M3}, {_FIT3} SELECT gene, n, {q('b0')} AS intercept, {q('b1')} AS coef_cn, {q('b2')} AS coef_near, {q('b3')} AS coef_far FROM f")
def ols3(s, d):
    return quant(_fit3(s, d).drop("r2", "rmse"), "intercept", "coef_cn", "coef_near", "coef_far")


@query(f"{O}, {_M3}, {_FIT3} SELECT gene, {q('ex / s_y_y')} AS r2, {q('CASE WHEN ex IS NOT NULL THEN sqrt(greatest(0, s_y_y - ex)) END')} AS rmse FROM f")
def fit_quality(s, d):
    return quant(_fit3(s, d).select("gene", "r2", "rmse"), "r2", "rmse")


@query(f"{O}, k AS (SELECT gene, regr_slope(near, cn) AS kn, regr_intercept(near, cn) AS cn0, regr_slope(far, cn) AS kf, regr_intercept(far, cn) AS cf0 FROM obs GROUP BY gene) SELECT id, {q('near - (kn * cn + cn0)')} AS near_resid, {q('far - (kf * cn + cf0)')} AS far_resid FROM obs JOIN k USING (gene)")
def orthogonalize(s, d):
    return quant(stats.orthogonal(views.observations(s, d), ["gene"], "cn", ["near", "far"]).select("id", "near_resid", "far_resid"), "near_resid", "far_resid")


_VIF = lambda a, b, c: f"CASE WHEN NOT isnan({a}) AND NOT isnan({b}) AND NOT isnan({c}) AND abs(1 - {c} * {c}) > 0 THEN CASE WHEN ({a} * {a} + {b} * {b} - 2 * {a} * {b} * {c}) / (1 - {c} * {c}) >= 0.99 THEN 'inf'::DOUBLE ELSE 1 / (1 - ({a} * {a} + {b} * {b} - 2 * {a} * {b} * {c}) / (1 - {c} * {c})) END END"


@query(f"{O}, r AS (SELECT gene, corr(cn, near) AS a, corr(cn, far) AS b, corr(near, far) AS c FROM obs GROUP BY gene HAVING count(*) >= 20) SELECT gene, {q(_VIF('a', 'b', 'c'))} AS vif_cn, {q(_VIF('a', 'c', 'b'))} AS vif_near, {q(_VIF('b', 'c', 'a'))} AS vif_far FROM r")
def vif(s, d):
    o = views.observations(s, d)
    x = stats.vif(stats.at_least(o, ["gene"], 20), ["gene"], list(XS))
    return x.select("gene", *[F.when(C(c) == float("inf"), C(c)).otherwise(q6(C(c))).alias(c) for c in ("vif_cn", "vif_near", "vif_far")])


@query(f"{O}, {moments_sql('y', XS, 'lineage')}, {fit3_sql('y', *XS, 30, 'lineage')} SELECT lineage AS line, n, {q('b1')} AS coef_cn, {q('b2')} AS coef_near, {q('b3')} AS coef_far FROM f WHERE lineage IS NOT NULL")
def line_ols(s, d):
    x = stats.ols(views.observations(s, d).where("lineage is not null"), ["lineage"], "y", list(XS), least=30)
    return quant(x.select(C("lineage").alias("line"), "n", "coef_cn", "coef_near", "coef_far"), "coef_cn", "coef_near", "coef_far")


_NI = "SELECT {k}, count(*) AS n, sum(cn * cn) AS a, sum(cn * near) AS b, sum(near * near) AS c, sum(y * cn) AS u, sum(y * near) AS v FROM obs {w} GROUP BY {k}"
_NI1, _NI2 = _sound("a * c - b * b", "a * c", "u * c - v * b"), _sound("a * c - b * b", "a * c", "a * v - b * u")


@query(f"{O}, x AS ({_NI.format(k='lineage', w='WHERE lineage IS NOT NULL')}) SELECT lineage AS line, n, {q(_NI1)} AS coef_cn, {q(_NI2)} AS coef_near FROM x WHERE n >= 30")
def line_ols_noint(s, d):
    x = stats.ols(views.observations(s, d).where("lineage is not null"), ["lineage"], "y", ["cn", "near"], least=30, intercept=False)
    return quant(x.select(C("lineage").alias("line"), "n", "coef_cn", "coef_near"), "coef_cn", "coef_near")


@query(f"{O}, r AS (SELECT gene, corr(y, cn) AS ab, corr(y, dist) AS ag, corr(cn, dist) AS bg FROM obs GROUP BY gene HAVING count(*) >= 10) SELECT gene, {q(nn('(ab - ag * bg) / sqrt((1 - ag * ag) * (1 - bg * bg))'))} AS r FROM r")
def partial_corr1(s, d):
    return quant(stats.partial_corr(views.observations(s, d), ["gene"], "y", "cn", "dist").where("n >= 10").select("gene", "r"), "r")


@query(f"""{O}, c AS (SELECT gene, near, far, avg(y) AS my, avg(yc) AS myc, avg(cn) AS mcn FROM obs GROUP BY gene, near, far),
e AS (SELECT gene, y - my AS ey, yc - myc AS eyc, cn - mcn AS ecn FROM obs JOIN c USING (gene, near, far))
SELECT gene, {q(f"abs({corr('ey', 'ecn')}) - abs({corr('eyc', 'ecn')})")} AS delta FROM e GROUP BY gene HAVING count(*) >= 10 AND {corr('ey', 'ecn')} IS NOT NULL AND {corr('eyc', 'ecn')} IS NOT NULL""")
def partial_delta(s, d):
    r = stats.cell_residuals(views.observations(s, d), ["gene"], ["near", "far"], ["y", "yc", "cn"])
    return quant(stats.delta_abs_corr(r, ["gene"], "cn_resid", "y_resid", "yc_resid").select("gene", "delta"), "delta")


_LABEL = "gl AS (SELECT gene, CAST(hash_ % 3 = 0 AS INT) AS lab, my, myc FROM (SELECT gene, length(gene) AS hash_, median(y) AS my, median(yc) AS myc FROM dc GROUP BY gene) WHERE my IS NOT NULL AND myc IS NOT NULL)"


def _labelled(s, d):
    g = summarised(views.corrected(s, d), ["gene"], {"my": (C("y"), 0.5), "myc": (C("yc"), 0.5)}).where("my is not null and myc is not null")
    return g.withColumn("lab", (F.length("gene") % 3 == 0).cast("int"))


_AUC = "sum(CASE WHEN p.{0} > n.{0} THEN 1.0 WHEN p.{0} = n.{0} THEN 0.5 ELSE 0 END) / count(*)"


@query(f"{D}, {_LABEL} SELECT {q(_AUC.format('my'))} AS auroc, {q(_AUC.format('myc'))} AS auroc_corrected, {q(_AUC.format('myc') + ' - ' + _AUC.format('my'))} AS delta FROM gl p JOIN gl n ON p.lab = 1 AND n.lab = 0")
def auroc(s, d):
    """Of the response before and after correction."""
    g = cut(_labelled(s, d))
    x = stats.auroc(g, "lab", "my").join(F.broadcast(stats.auroc(g, "lab", "myc").withColumnRenamed("auroc", "auroc_corrected")), F.lit(True))
    return quant(x.withColumn("delta", C("auroc_corrected") - C("auroc")), "auroc", "auroc_corrected", "delta")


@query(f"{D}, {_LABEL}, t AS (SELECT my, count(*) AS n, sum(lab) AS p FROM gl GROUP BY my), c AS (SELECT p, sum(p) OVER w / sum(n) OVER w AS prec FROM t WINDOW w AS (ORDER BY my DESC)) SELECT {q('sum(p * prec) / sum(p)')} AS ap FROM c")
def auprc(s, d):
    return quant(stats.average_precision(_labelled(s, d), "lab", "my"), "ap")


_HALF = "hf AS (SELECT * FROM gl WHERE abs(my) <= (SELECT quantile_cont(abs(my), 0.5) FROM gl))"


@query(f"""{D}, {_LABEL}, {_HALF}, t AS (SELECT my, count(*) AS n, sum(lab) AS p FROM hf GROUP BY my), c AS (SELECT p, sum(p) OVER w / sum(n) OVER w AS prec FROM t WINDOW w AS (ORDER BY my DESC))
SELECT (SELECT {q(_AUC.format('my'))} FROM hf p JOIN hf n ON p.lab = 1 AND n.lab = 0) AS auroc, {q('sum(p * prec) / sum(p)')} AS ap FROM c""")
def auroc_bottom(s, d):
    """Both measures among the half of the genes with the smallest response."""
    g = cut(clean.lowest_share(cut(_labelled(s, d).withColumn("size", F.abs("my"))), "size", 0.5))
    return quant(stats.auroc(g, "lab", "my").join(F.broadcast(stats.average_precision(g, "lab", "my")), F.lit(True)), "auroc", "ap")


_ARMS = f"ar AS (SELECT 0 AS arm, abs(y) AS v FROM dc WHERE y IS NOT NULL UNION ALL SELECT 1, abs(yc) FROM dc WHERE yc IS NOT NULL)"


_KS_P = "CASE WHEN t < 0.2 THEN 1.0 ELSE least(1.0, greatest(0.0, list_sum(list_transform(range(1, 101), lambda k: CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END * exp(-2.0 * k * k * t * t))))) END"


@query(f"""{D}, {_ARMS}, t AS (SELECT v, sum(1 - arm) AS a, sum(arm) AS b FROM ar GROUP BY v), z AS (SELECT sum(a) OVER w / sum(a) OVER () AS fa, sum(b) OVER w / sum(b) OVER () AS fb FROM t WINDOW w AS (ORDER BY v)),
x AS (SELECT max(abs(fa - fb)) AS d, (SELECT count(*) FROM ar WHERE arm = 0) AS n_a, (SELECT count(*) FROM ar WHERE arm = 1) AS n_b FROM z), y AS (SELECT *, d * sqrt(n_a * n_b / (n_a + n_b)) AS t FROM x)
SELECT {q('d')} AS d, n_a, n_b, {q(_KS_P)} AS p FROM y""")
def ks_stat(s, d):
    c = views.corrected(s, d)
    arms = c.select(F.lit(0).alias("arm"), F.abs("y").alias("v")).union(c.select(F.lit(1), F.abs("yc")))
    x = stats.ks_statistic(arms, "arm", "v")
    return quant(x.withColumn("p", pvalues.kolmogorov_p(C("d"), C("n_a"), C("n_b"))), "d", "p")


def _erfc_sql(x: str) -> str:
    """Two-sided normal p of z, the twin of pvalues.normal_two_sided_p."""
    u, poly = f"(abs({x}) / sqrt(2.0))", str(pvalues.ERFC[-1])
    r = f"(1.0 / (1.0 + 0.5 * {u}))"
    for c in reversed(pvalues.ERFC[:-1]):
        poly = f"({poly} * {r} + {c}::DOUBLE)"
    return f"({r} * exp(-{u} * {u} + {poly}))"


@query(f"""{D}, w AS (SELECT floor((y - yc) * 1e5 + 0.5) AS x FROM dc WHERE y IS NOT NULL AND yc IS NOT NULL), k AS (SELECT x, rank() OVER (ORDER BY abs(x)) + (count(*) OVER (PARTITION BY abs(x)) - 1) / 2.0 AS r FROM w WHERE x <> 0),
s AS (SELECT CAST(sum(CASE WHEN x > 0 THEN r ELSE 0 END) AS DOUBLE) AS w_plus, CAST(sum(CASE WHEN x < 0 THEN r ELSE 0 END) AS DOUBLE) AS w_minus, count(*) AS n FROM k),
z AS (SELECT *, CASE WHEN n > 0 THEN (w_plus - n * (n + 1) / 4.0::DOUBLE) / sqrt(n * (n + 1.0::DOUBLE) * (2.0::DOUBLE * n + 1.0::DOUBLE) / 24.0::DOUBLE) END AS z FROM s)
SELECT w_plus, w_minus, n, {q('z')} AS z, {q(_erfc_sql('z'))} AS p, {q(f"CASE WHEN z > 0 THEN {_erfc_sql('z')} / 2 ELSE 1 - {_erfc_sql('z')} / 2 END")} AS p_greater FROM z""")
def wilcoxon(s, d):
    x = views.corrected(s, d).select(F.floor((C("y") - C("yc")) * 1e5 + 0.5).cast("double").alias("x"))
    w = stats.wilcoxon(x, "x").withColumn("z", pvalues.wilcoxon_z(C("w_plus"), C("n"))).withColumn("p", pvalues.normal_two_sided_p(C("z")))
    return quant(w.withColumn("p_greater", F.when(C("z") > 0, C("p") / 2).otherwise(1 - C("p") / 2)), "z", "p", "p_greater")


# p of a gene: the mean of its differences against their standard error, two-sided normal
_PZ = "CASE WHEN stddev_samp(y - yc) > 0 THEN avg(y - yc) / (stddev_samp(y - yc) / sqrt(count(y - yc))) END"
_P = f"pz AS (SELECT gene, {_PZ} AS z FROM dc GROUP BY gene HAVING count(y - yc) >= 5), pv AS (SELECT gene, {q(_erfc_sql('z'))} AS p FROM pz WHERE z IS NOT NULL)"


def _gene_p(s, d):
    x = C("y") - C("yc")
    g = views.corrected(s, d).groupBy("gene").agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("sd")).where("n >= 5 and sd > 0")
    return g.select("gene", q6(pvalues.normal_two_sided_p(C("m") / (C("sd") / F.sqrt("n")))).alias("p"))


@query(f"{D}, {_P}, r AS (SELECT gene, p, p * count(*) OVER () / rank_ AS x FROM (SELECT gene, p, count(*) OVER (ORDER BY p) AS rank_ FROM pv)) SELECT gene, p, {q('least(1.0, min(x) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))')} AS q FROM r")
def bh_fdr(s, d):
    return quant(stats.benjamini_hochberg(_gene_p(s, d), "p").select("gene", "p", "q"), "q")


_HITS = "ht AS (SELECT gene, count(*) FILTER (y < yc) AS h, count(*) AS t FROM dc WHERE y IS NOT NULL AND yc IS NOT NULL GROUP BY gene)"


@query(f"{D}, {_HITS}, g AS (SELECT avg(h / t) AS m, var_samp(h / t) AS v FROM ht), k AS (SELECT m, m * (1 - m) / v - 1 AS k FROM g) SELECT gene, {q('CASE WHEN k > 0 THEN (h + k * m) / (t + k) ELSE h / t END')} AS shrunk FROM ht, k")
def eb_shrink(s, d):
    c = views.corrected(s, d).where("y is not null and yc is not null").groupBy("gene").agg(F.count(F.when(C("y") < C("yc"), 1)).alias("h"), F.count("*").alias("t"))
    return quant(stats.beta_shrinkage(c, "h", "t").select("gene", "shrunk"), "shrunk")
