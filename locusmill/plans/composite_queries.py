"""Negative controls and the composites of the analysis over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusmill.functions import scalars as S
from locusmill.functions.quant import q6
from locusmill.operators import clean, controls, pvalues, stats
from locusmill.plans import views
from locusmill.operators.ranges import median, summarised
from locusmill.plans.registry import drawn_sql as _drawn
from locusmill.plans.registry import q, query
from locusmill.plans.stat_queries import _DELTA, _FIT3, _LABEL, _M3, _P, D, O, XS, _delta, _fit3, _gene_p, _labelled, corr, delta_sql, nn, fit3_sql, moments_sql, quant, top_share
from locusmill.session import broadcast_if_small, cut
from locusmill.sources.tables import table

C = F.col
_B = f"WITH {views.SEGMENTS_SQL}, {views.BREAKS_SQL}"
_SIZES = "sz AS (SELECT * FROM (VALUES " + ", ".join(f"('{k}', {v})" for k, v in S.CHROMOSOMES.items()) + ") t(chrom, size))"


_CELL = "length(cell)"
_CH = "length(chrom)"


@query(f"{_B}, {_SIZES} SELECT cell, chrom, (pos + {_drawn(7, _CELL, _CH)} % size) % size AS pos FROM bp JOIN sz USING (chrom)")
def rotate(s, d):
    b = views.breaks(s, d).where(C("chrom").isin(*S.CHROMOSOMES))
    return controls.rotate(b, "pos", controls.size_of(C("chrom"), S.CHROMOSOMES), 7, F.length("cell"), F.length("chrom"))


@query(f"""WITH {views.SEGMENTS_SQL}, {_SIZES}, m AS (SELECT seg_id, e - s AS l, ((s + e) // 2 + {_drawn(8, _CELL, _CH)} % size) % size AS mid, size FROM seg JOIN sz USING (chrom))
SELECT seg_id, greatest(0, least(size - l, mid - l // 2)) AS s, greatest(0, least(size - l, mid - l // 2)) + l AS e FROM m""")
def rotate_segments(s, d):
    x = views.segments(s, d).where(C("chrom").isin(*S.CHROMOSOMES))
    return controls.rotate_interval(x, "s", "e", controls.size_of(C("chrom"), S.CHROMOSOMES), 8, F.length("cell"), F.length("chrom")).select("seg_id", "s", "e")


@query(f"""WITH {views.SEGMENTS_SQL}, {_SIZES}, u AS (SELECT seg_id, {_drawn(9, 'seg_id')} % size AS a, {_drawn(19, 'seg_id')} % size AS b FROM seg JOIN sz USING (chrom)) SELECT seg_id, least(a, b) AS s, greatest(a, b) AS e FROM u""")
def uniform_shuffle(s, d):
    """Both borders of a segment anywhere on its chromosome, each drawn alone."""
    x = views.segments(s, d).where(C("chrom").isin(*S.CHROMOSOMES))
    size = controls.size_of(C("chrom"), S.CHROMOSOMES)
    a, b = (F.pmod(controls.drawn(i, C("seg_id")), size) for i in (9, 19))
    return x.select("seg_id", F.least(a, b).alias("s"), F.greatest(a, b).alias("e"))


@query(f"WITH {views.SEGMENTS_SQL}, {_SIZES} SELECT seg_id, chrom, {_drawn(10, 'seg_id', _CH)} % greatest(1, size - (e - s)) AS s FROM seg JOIN sz USING (chrom)")
def within_shuffle(s, d):
    x = views.segments(s, d).where(C("chrom").isin(*S.CHROMOSOMES))
    return controls.scatter(x, "s", "e", controls.size_of(C("chrom"), S.CHROMOSOMES), 10, C("seg_id"), F.length("chrom")).select("seg_id", "chrom", "s")


def _cumulative() -> str:
    at, rows = 0, []
    for k, v in S.CHROMOSOMES.items():
        rows.append(f"('{k}', {at}, {at + v})")
        at += v
    return "cu AS (SELECT * FROM (VALUES " + ", ".join(rows) + ") t(chrom, a, b))"


_TOTAL = sum(S.CHROMOSOMES.values())


@query(f"WITH {views.SEGMENTS_SQL}, {_cumulative()}, x AS (SELECT seg_id, ({_drawn(11, 'seg_id')} * 1048573 + {_drawn(12, 'seg_id')}) % {_TOTAL} AS x FROM seg) SELECT seg_id, cu.chrom, x - a AS s FROM x JOIN cu ON x >= a AND x < b")
def across_shuffle(s, d):
    x = views.segments(s, d).select("seg_id", "chrom", "s")
    return controls.scatter_across(x, "chrom", "s", S.CHROMOSOMES, 11, C("seg_id"))


@query(f"WITH {views.SEGMENTS_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY cell, chrom ORDER BY seg_id) AS i, row_number() OVER (PARTITION BY cell, chrom ORDER BY {_drawn(13, 'seg_id')} * 2097152 + seg_id % 2097152) AS j FROM seg) SELECT a.seg_id, a.cn, b.s AS permuted_s, b.e AS permuted_e FROM a JOIN a b ON a.cell = b.cell AND a.chrom = b.chrom AND a.i = b.j")
def permute(s, d):
    """The places of a cell's segments on a chromosome dealt out anew; copies stay with their segment."""
    return controls.permute(views.segments(s, d), ["cell", "chrom"], "seg_id", ["s", "e"], 13).select("seg_id", "cn", "permuted_s", "permuted_e")


_PERM = "a AS (SELECT design_id, cell_line, bp_dist, row_number() OVER (PARTITION BY cell_line ORDER BY design_id) AS i, row_number() OVER (PARTITION BY cell_line ORDER BY " + _drawn(14, 'design_id') + " * 2097152 + design_id % 2097152) AS j FROM design WHERE cell_line IS NOT NULL)"


@query(f"WITH {_PERM} SELECT a.design_id, b.bp_dist AS permuted FROM a JOIN a b ON a.cell_line = b.cell_line AND a.i = b.j")
def permute_dist(s, d):
    t = table(s, d, "design").where("cell_line is not null").select("design_id", "cell_line", "bp_dist")
    return controls.permute(t, ["cell_line"], "design_id", ["bp_dist"], 14).select("design_id", C("permuted_bp_dist").alias("permuted"))


@query(f"WITH {_PERM} SELECT a.design_id, {q('exp(-b.bp_dist / 100000.0)')} AS prox_exp_100k, floor(1e12 / (b.bp_dist + 1000) + 0.5) / 1e12 AS prox_inv FROM a JOIN a b ON a.cell_line = b.cell_line AND a.i = b.j")
def shuffled_kernels(s, d):
    x = permute_dist(s, d)
    return x.select("design_id", q6(S.kernels(C("permuted"))["prox_exp_100k"]).alias("prox_exp_100k"), (F.floor(F.lit(1e12) / (C("permuted") + 1000) + 0.5).cast("double") / F.lit(1e12)).alias("prox_inv"))


_ACT = "ac AS (SELECT gene, avg(CAST(near + far > 0 AS INT)) AS active FROM obs GROUP BY gene)"


def _active(s, d):
    return views.observations(s, d).groupBy("gene").agg(F.avg((C("near") + C("far") > 0).cast("int")).alias("active"))


_SIGN = "floor(delta * 1e6 + 0.5) > 0"


def _positive(c: str = "delta"):
    return q6(C(c)) > 0


@query(f"{O}, {_DELTA}, {_ACT} SELECT {q(f'avg(CAST(active >= 0.10 AND {_SIGN} AS INT))')} AS directional, count(*) AS n FROM dl JOIN ac USING (gene)")
def directional(s, d):
    x = _delta(s, d).join(_active(s, d), "gene")
    return x.agg(q6(F.avg(((C("active") >= 0.10) & _positive()).cast("int"))).alias("directional"), F.count("*").alias("n"))


@query(f"{D} SELECT {q('median(x)')} AS median, {q('quantile_cont(x, 0.9)')} AS p90, {q('quantile_cont(x, 0.99)')} AS p99, count(*) AS n FROM (SELECT gene, max(abs(contrib)) AS x FROM dc GROUP BY gene) WHERE x IS NOT NULL")
def effect_size(s, d):
    g = views.corrected(s, d).groupBy("gene").agg(F.max(F.abs("contrib")).alias("x")).where("x is not null")
    return g.agg(q6(F.median("x")).alias("median"), q6(F.percentile("x", 0.9)).alias("p90"), q6(F.percentile("x", 0.99)).alias("p99"), F.count("*").alias("n"))


K = f"WITH {views.CONTROL_SQL}"
_TWO = "tw AS (SELECT gene, avg(near) AS p_true, avg(neark) AS p_ctrl FROM obs GROUP BY gene)"


def _prevalences(s, d):
    return views.controlled(s, d).groupBy("gene").agg(F.avg("near").alias("p_true"), F.avg("neark").alias("p_ctrl"))


@query(f"{K}, {_TWO} SELECT gene FROM tw WHERE abs(p_true - p_ctrl) <= 0.02 + 1e-12")
def prevalence_match(s, d):
    return _prevalences(s, d).where(F.abs(C("p_true") - C("p_ctrl")) <= 0.02 + 1e-12).select("gene")


@query(f"""{K}, {_DELTA}, {_TWO}, ed AS (SELECT list_sort(list_distinct(list_transform(quantile_cont(p_true, [0.0, 0.25, 0.5, 0.75, 1.0]), lambda x: floor(x * 1e6 + 0.5) / 1e6))) AS edges FROM tw),
b AS (SELECT gene, CASE WHEN p_true >= edges[1] AND p_true <= edges[-1] THEN greatest(0, len(list_filter(edges, lambda e: e < p_true)) - 1) END AS bin FROM tw, ed)
SELECT {q('avg(f)')} AS matched, count(*) AS bins FROM (SELECT bin, avg(CAST({_SIGN} AS INT)) AS f FROM dl JOIN b USING (gene) WHERE bin IS NOT NULL GROUP BY bin)""")
def prev_matched(s, d):
    p = _prevalences(s, d)
    b = p.join(F.broadcast(stats.quantile_edges(p, "p_true", 4)), F.lit(True)).select("gene", stats.bins(C("p_true"), C("edges")).alias("bin"))
    per_bin = _delta(s, d).join(b.where("bin is not null"), "gene").groupBy("bin").agg(F.avg(_positive().cast("int")).alias("f"))
    return per_bin.agg(q6(F.avg("f")).alias("matched"), F.count("*").alias("bins"))


@query(f"{D}, g AS (SELECT gene, median(contrib) AS c, median(y - yc) AS e FROM dc GROUP BY gene), t AS (SELECT quantile_cont(c, 1 / 3.0) AS a, quantile_cont(c, 2 / 3.0) AS b FROM g) SELECT tertile, {q('avg(CAST(e > 0 AS INT))')} AS positive, count(*) AS n FROM (SELECT CASE WHEN c <= a THEN 0 WHEN c <= b THEN 1 ELSE 2 END AS tertile, e FROM g, t WHERE c IS NOT NULL AND e IS NOT NULL) GROUP BY tertile")
def tertile_sign(s, d):
    g = cut(summarised(views.corrected(s, d), ["gene"], {"c": (C("contrib"), 0.5), "e": (C("y") - C("yc"), 0.5)}))
    t = g.agg(F.percentile("c", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("t"))
    k = F.when(C("c") <= C("t")[0], 0).when(C("c") <= C("t")[1], 1).otherwise(2)
    x = g.where("c is not null and e is not null").join(F.broadcast(t), F.lit(True)).select(k.alias("tertile"), "e")
    return x.groupBy("tertile").agg(q6(F.avg((C("e") > 0).cast("int"))).alias("positive"), F.count("*").alias("n"))


@query(f"""{D}, g AS (SELECT gene, max(abs(contrib)) AS c, floor(median(y - yc) * 1e6 + 0.5) AS e FROM dc GROUP BY gene), k AS (SELECT rank() OVER (ORDER BY c) + (count(*) OVER (PARTITION BY c) - 1) / 2.0 AS rc,
rank() OVER (ORDER BY e) + (count(*) OVER (PARTITION BY e) - 1) / 2.0 AS re FROM g WHERE c IS NOT NULL AND e IS NOT NULL) SELECT {q('corr(rc, re)')} AS rho, count(*) AS n FROM k""")
def coef_effect(s, d):
    return _ranked_effects(s, d).agg(q6(stats.pearson(C("rc"), C("re"))).alias("rho"), F.count("*").alias("n"))


def _ranked_effects(s, d):
    g = summarised(views.corrected(s, d), ["gene"], {"m": (C("y") - C("yc"), 0.5)}, c=F.max(F.abs("contrib")))
    g = cut(g.select("gene", "c", F.floor(C("m") * 1e6 + 0.5).cast("double").alias("e")).where("c is not null and e is not null"))
    return stats.average_rank(stats.average_rank(g, [], "c", "rc"), [], "e", "re")


@query()
def coef_effect_p(s, d):
    """The rank correlation with its two-sided p by Student's t (tests check it against known values)."""
    r = _ranked_effects(s, d).agg(stats.pearson(C("rc"), C("re")).alias("rho"), F.count("*").alias("n"))
    return r.select(q6(C("rho")).alias("rho"), "n", pvalues.correlation_p(C("rho"), C("n")).alias("p"))


# The control arm: distances dealt out anew, windows and fit made again, and the response corrected by that fit.
XK = ("cn", "neark", "fark")
_DK = (
    f"{moments_sql('y', XK, name='mk')}, {fit3_sql('y', *XK, name='fk', frm='mk')}, ok AS (SELECT obs.*, coalesce(y - (fk.b2 * neark + fk.b3 * fark), y) AS yk FROM obs JOIN fk USING (gene)), "
    + delta_sql("dkk", "yk", "ok") + ", dk AS (SELECT gene, delta AS dk FROM dkk)"
)


def _control_delta(s, d, o=None):
    o = cut(views.controlled(s, d)) if o is None else o
    f = stats.ols(o, ["gene"], "y", list(XK), least=20).select("gene", "coef_neark", "coef_fark")
    yk = F.coalesce(C("y") - (C("coef_neark") * C("neark") + C("coef_fark") * C("fark")), C("y"))
    return stats.delta_abs_corr(o.join(broadcast_if_small(f), "gene").withColumn("yk", yk), ["gene"], "cn", "y", "yk").select("gene", C("delta").alias("dk"))


def _arms(s, d):
    """gene, n, r0, r1, delta of the observations with dk of the control arm; the observations are written once."""
    o = cut(views.controlled(s, d))
    return stats.delta_abs_corr(o, ["gene"], "cn", "y", "yc").join(_control_delta(s, d, o), "gene")


@query(f"{K}, {_DELTA}, {_DK}, x AS (SELECT delta - dk AS x FROM dl JOIN dk USING (gene)) SELECT {q('avg(x)')} AS mean, {q('median(x)')} AS median, {q('quantile_cont(x, 0.25)')} AS q25, {q('quantile_cont(x, 0.75)')} AS q75, count(*) AS n FROM x")
def excess(s, d):
    x = _arms(s, d).select((C("delta") - C("dk")).alias("x"))
    p = F.percentile("x", F.array(F.lit(0.25), F.lit(0.75)))
    return x.agg(q6(F.avg("x")).alias("mean"), q6(F.median("x")).alias("median"), q6(p[0]).alias("q25"), q6(p[1]).alias("q75"), F.count("*").alias("n"))


@query(f"{D}, m AS (SELECT 'contrib' AS metric, gene, abs(contrib) AS a, abs(pred) AS b FROM dc UNION ALL SELECT 'dependency', gene, abs(y), abs(yc) FROM dc), g AS (SELECT metric, gene, median(a) - median(b) AS x FROM m GROUP BY metric, gene) SELECT metric, {q('avg(x)')} AS mean, {q('median(x)')} AS median, count(x) AS n FROM g GROUP BY metric")
def excess_table(s, d):
    c = views.corrected(s, d)
    m = c.select(F.explode(F.array(F.struct(F.lit("contrib").alias("metric"), F.abs("contrib").alias("a"), F.abs("pred").alias("b")), F.struct(F.lit("dependency").alias("metric"), F.abs("y").alias("a"), F.abs("yc").alias("b")))).alias("m"), "gene")
    g = summarised(m.select("m.*", "gene"), ["metric", "gene"], {"ma": (C("a"), 0.5), "mb": (C("b"), 0.5)}).select("metric", "gene", (C("ma") - C("mb")).alias("x"))
    return g.groupBy("metric").agg(q6(F.avg("x")).alias("mean"), q6(F.median("x")).alias("median"), F.count("x").alias("n"))


_RK = "rank() OVER (ORDER BY {0} DESC) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0"


@query(f"""{K}, {_DELTA}, {_DK}, x AS (SELECT gene, {q('delta - dk')} AS ex, {q('delta')} AS delta, abs(r0) >= 0.3 AS strong FROM dl JOIN dk USING (gene))
SELECT gene, CAST(ex > 0 AS INT) AS above, CAST(strong AS INT) AS strong, 2.0::DOUBLE * ({_RK.format('ex')}) + ({_RK.format('delta')}) AS score FROM x""")
def candidate_flags(s, d):
    """Flags, and the rank score of candidates: twice the rank of the excess and the rank of the drop, the largest first."""
    x = _arms(s, d).select("gene", q6(C("delta") - C("dk")).alias("ex"), q6(C("delta")).alias("delta"), (F.abs("r0") >= 0.3).cast("int").alias("strong"))
    x = cut(x.withColumns({"e": -C("ex"), "f": -C("delta")}))
    r = stats.average_rank(stats.average_rank(x, [], "e", "re"), [], "f", "rf")
    return r.select("gene", (C("ex") > 0).cast("int").alias("above"), "strong", (2.0 * C("re") + C("rf")).alias("score"))


@query(f"{O}, {_DELTA}, t AS (SELECT quantile_cont(abs(r0), 0.25) AS a, quantile_cont(abs(r0), 0.5) AS b, quantile_cont(abs(r0), 0.75) AS c FROM dl) SELECT quartile, {q('median(delta)')} AS delta, count(*) AS n FROM (SELECT delta, CASE WHEN abs(r0) <= a THEN 'Q1' WHEN abs(r0) <= b THEN 'Q2' WHEN abs(r0) <= c THEN 'Q3' ELSE 'Q4' END AS quartile FROM dl, t) GROUP BY quartile")
def strat_by_quartile(s, d):
    x = _delta(s, d).withColumn("base", F.abs("r0"))
    t = x.agg(F.percentile("base", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("t"))
    k = F.when(C("base") <= C("t")[0], "Q1").when(C("base") <= C("t")[1], "Q2").when(C("base") <= C("t")[2], "Q3").otherwise("Q4")
    return x.join(F.broadcast(t), F.lit(True)).groupBy(k.alias("quartile")).agg(q6(F.median("delta")).alias("delta"), F.count("*").alias("n"))


@query(f"{D} SELECT {q('quantile_cont(abs(contrib), 0.9)')} AS p90, {q('quantile_cont(abs(contrib), 0.99)')} AS p99, max(abs(contrib)) AS top FROM dc")
def tail_stats(s, d):
    x = summarised(views.corrected(s, d), [], {"p": (F.abs("contrib"), [0.9, 0.99])}, top=F.max(F.abs("contrib")))
    return x.select(q6(C("p")[0]).alias("p90"), q6(C("p")[1]).alias("p99"), "top")


@query(f"{D}, {_LABEL}, u AS (SELECT 'all' AS subset, * FROM gl UNION ALL SELECT CASE WHEN lab = 1 THEN 'labelled' ELSE 'other' END, * FROM gl) SELECT subset, {q('median(myc) - median(my)')} AS shift, count(*) AS n FROM u GROUP BY subset")
def subset_shift(s, d):
    g = _labelled(s, d)
    u = g.withColumn("subset", F.explode(F.array(F.lit("all"), F.when(C("lab") == 1, "labelled").otherwise("other"))))
    return u.groupBy("subset").agg(q6(F.median("myc") - F.median("my")).alias("shift"), F.count("*").alias("n"))


@query(f"{K}, {_DELTA}, {_DK}, x AS (SELECT median(delta) AS t, median(dk) AS k, avg(CAST({_SIGN} AS INT)) AS f FROM dl JOIN dk USING (gene)) SELECT t > k AS beats_control, f >= 0.5 AS mostly_positive, t > 0.01 AS above_floor, CAST(t > k AS INT) + CAST(f >= 0.5 AS INT) + CAST(t > 0.01 AS INT) AS passed FROM x")
def scoreboard(s, d):
    x = _arms(s, d).agg(F.median("delta").alias("t"), F.median("dk").alias("k"), F.avg(_positive().cast("int")).alias("f"))
    rules = {"beats_control": C("t") > C("k"), "mostly_positive": C("f") >= 0.5, "above_floor": C("t") > 0.01}
    out = x.select(*[c.alias(k) for k, c in rules.items()])
    return out.withColumn("passed", sum((C(k).cast("int") for k in rules), F.lit(0)))


_OK = f"{moments_sql('y', XK, name='mk')}, {fit3_sql('y', *XK, name='fk', frm='mk')}, ok AS (SELECT obs.*, coalesce(y - (fk.b2 * neark + fk.b3 * fark), y) AS yk FROM obs JOIN fk USING (gene))"
_TESTS = {"whole": "true", "held_out": "id % 5 > 0", "cn_neutral": "cn BETWEEN 1.5 AND 2.5"}


@query(f"""{K}, {_OK}, te AS ({' UNION ALL '.join(f"SELECT '{k}' AS test, * FROM ok WHERE {v}" for k, v in _TESTS.items())}), {delta_sql('dt', 'yc', 'te', 'test, gene')}, {delta_sql('du', 'yk', 'te', 'test, gene')},
ma AS (SELECT gene, median(y) AS m FROM ok GROUP BY gene), mb AS (SELECT gene, median(abs(y - m)) + 1e-9 AS mad FROM ok JOIN ma USING (gene) GROUP BY gene),
jo AS (SELECT test, gene, dt.delta AS t, du.delta AS k FROM dt JOIN du USING (test, gene) UNION ALL SELECT 'scaled', gene, dt.delta / mad, du.delta / mad FROM dt JOIN du USING (test, gene) JOIN mb USING (gene) WHERE test = 'whole')
SELECT test, count(*) AS genes, {q('median(t)')} AS observed, {q('median(k)')} AS control, {q('median(t)')} > {q('median(k)')} AS passed FROM jo GROUP BY test""")
def falsification_scoreboard(s, d):
    """Drop of the correlation against the control arm: on all rows, on held-out rows, on rows of neutral copies, and in units of the gene's deviation."""
    o = cut(views.controlled(s, d))
    f = stats.ols(o, ["gene"], "y", list(XK), least=20).select("gene", "coef_neark", "coef_fark")
    yk = F.coalesce(C("y") - (C("coef_neark") * C("neark") + C("coef_fark") * C("fark")), C("y"))
    ok = cut(o.join(broadcast_if_small(f), "gene").select("gene", "id", "cn", "y", "yc", yk.alias("yk")))
    te = ok.withColumn("test", F.explode(F.array(*[F.when(F.expr(v), k) for k, v in _TESTS.items()]))).where("test is not null")
    t, k = (stats.delta_abs_corr(te, ["test", "gene"], "cn", "y", v).select("test", "gene", C("delta").alias(n)) for v, n in (("yc", "t"), ("yk", "k")))
    both = cut(t.join(k, ["test", "gene"]))
    scaled = both.where("test = 'whole'").join(stats.mad(ok, ["gene"], "y"), "gene").select(F.lit("scaled").alias("test"), "gene", (C("t") / C("mad")).alias("t"), (C("k") / C("mad")).alias("k"))
    x = both.unionByName(scaled).groupBy("test").agg(F.count("*").alias("genes"), q6(F.median("t")).alias("observed"), q6(F.median("k")).alias("control"))
    return x.withColumn("passed", C("observed") > C("control"))


@query(f"{O}, {_DELTA}, m AS (SELECT gene, median(y) AS m FROM obs GROUP BY gene), a AS (SELECT gene, median(abs(y - m)) + 1e-9 AS mad FROM obs JOIN m USING (gene) GROUP BY gene) SELECT gene, {q('delta / mad')} AS scaled FROM dl JOIN a USING (gene)")
def scaled_drop(s, d):
    m = stats.mad(views.observations(s, d), ["gene"], "y")
    return quant(_delta(s, d).join(m, "gene").select("gene", (C("delta") / C("mad")).alias("scaled")), "scaled")


@query(f"{K}, {_TWO} SELECT gene FROM (SELECT gene, row_number() OVER (ORDER BY floor(p_true * 1e6 + 0.5) DESC, gene) AS i, count(*) OVER () AS n FROM tw) WHERE i <= greatest(20, CAST(floor(n * 0.1) AS INT))")
def unstable_set(s, d):
    p = _prevalences(s, d).select("gene", q6(C("p_true")).alias("p"))
    return top_share(p, "p", "gene", 0.1, 20).select("gene")


_LINE = "SELECT lineage AS line, gene, count(*) AS n, avg(CAST(near > 0 AS INT)) AS act FROM obs WHERE lineage IS NOT NULL GROUP BY 1, 2"


@query(f"{O}, {_DELTA}, l AS ({_LINE}) SELECT line, count(*) AS genes, count(*) FILTER (act > 0 AND {_SIGN}) AS directional FROM l JOIN dl USING (gene) GROUP BY line")
def line_directional(s, d):
    l = views.observations(s, d).where("lineage is not null").groupBy(C("lineage").alias("line"), "gene").agg(F.avg((C("near") > 0).cast("int")).alias("act"))
    x = l.join(_delta(s, d).select("gene", "delta"), "gene")
    return x.groupBy("line").agg(F.count("*").alias("genes"), F.count(F.when((C("act") > 0) & _positive(), 1)).alias("directional"))


_TRIM = "tr AS (SELECT o.*, o.lineage AS line FROM obs o JOIN (SELECT lineage, quantile_cont(cn, 0.1) AS lo, quantile_cont(cn, 0.9) AS hi FROM obs GROUP BY lineage) USING (lineage) WHERE cn BETWEEN lo AND hi)"
_LR = "rank() OVER (PARTITION BY line ORDER BY {0}) + (count(*) OVER (PARTITION BY line, {0}) - 1) / 2.0"


@query(f"{O}, {_TRIM}, k AS (SELECT line, {_LR.format('y')} AS a, {_LR.format('yc')} AS b, {_LR.format('cn')} AS c FROM tr) SELECT line, {q('abs(corr(a, c)) - abs(corr(b, c))')} AS delta FROM k GROUP BY line")
def line_corr_delta(s, d):
    o = cut(views.observations(s, d).where("lineage is not null").withColumn("line", C("lineage")))
    t = clean.trimmed(o, "line", "cn", 0.1, 0.9)
    a, b = (stats.spearman(t, ["line"], v, "cn").select("line", C("rho").alias(v)) for v in ("y", "yc"))
    return a.join(b, "line").select("line", q6(F.abs("y") - F.abs("yc")).alias("delta"))


@query(f"WITH {views.SEGMENTS_SQL}, f AS (SELECT cell, sum(CASE WHEN abs(cn - 2) > 0.3 THEN e - s ELSE 0 END) / sum(e - s) AS fga, count(*) AS n FROM seg GROUP BY cell) SELECT CASE WHEN count(fga) >= 10 THEN {q(corr('fga', 'n'))} END AS r, count(*) AS cells FROM f")
def instability(s, d):
    length = C("e") - C("s")
    f = views.segments(s, d).groupBy("cell").agg(F.try_divide(F.sum(F.when(F.abs(C("cn") - 2) > 0.3, length).otherwise(0)), F.sum(length)).alias("fga"), F.count("*").cast("double").alias("n"))
    return f.agg(F.when(F.count("fga") >= 10, q6(stats.pearson(C("fga"), C("n")))).alias("r"), F.count("*").alias("cells"))


@query(f"""{O}, {views.CORR_SQL}, g AS (SELECT gene, count(*) AS n, {q('median(y - yc)')} AS drop_, {q('coalesce(median(abs(contrib)) FILTER (abs(contrib) > 0.05), 0)')} AS act FROM dc GROUP BY gene),
l AS (SELECT gene, lineage, count(*) AS n, abs({corr('y', 'cn')}) - abs({corr('yc', 'cn')}) AS delta FROM obs GROUP BY gene, lineage), b AS (SELECT gene, count(*) FILTER (n >= 3 AND floor(delta * 1e6 + 0.5) > 0) AS breadth FROM l GROUP BY gene),
r AS (SELECT gene, drop_ AS drop, act, coalesce(breadth, 0) AS breadth FROM g LEFT JOIN b USING (gene) WHERE n >= 5)
SELECT *, CASE WHEN drop > 0.1 AND act > 0.05 AND breadth >= 1 THEN 'GREEN' WHEN drop > 0.1 AND act > 0.05 THEN 'AMBER' ELSE 'RED' END AS label FROM r ORDER BY drop DESC NULLS LAST, breadth DESC, act DESC, gene LIMIT 30""")
def hit_rank(s, d):
    """The thirty genes with the largest drop, with their active effect, the number of lineages that show it, and a label."""
    g = summarised(views.corrected(s, d), ["gene"], {"m": (C("y") - C("yc"), 0.5), "a": (F.when(F.abs("contrib") > 0.05, F.abs("contrib")), 0.5)}, n=F.count("*"))
    g = g.where("n >= 5").select("gene", q6(C("m")).alias("drop"), q6(F.coalesce("a", F.lit(0.0))).alias("act"))
    l = views.observations(s, d).groupBy("gene", "lineage").agg(F.count("*").alias("n"), (F.abs(stats.pearson(C("y"), C("cn"))) - F.abs(stats.pearson(C("yc"), C("cn")))).alias("delta"))
    b = l.groupBy("gene").agg(F.count(F.when((C("n") >= 3) & _positive(), 1)).alias("breadth"))
    x = g.join(b, "gene", "left").withColumn("breadth", F.coalesce("breadth", F.lit(0)))
    large = F.coalesce((C("drop") > 0.1) & (C("act") > 0.05), F.lit(False))
    x = x.withColumn("label", F.when(large & (C("breadth") >= 1), "GREEN").when(large, "AMBER").otherwise("RED"))
    return x.orderBy(F.desc_nulls_last("drop"), F.desc("breadth"), F.desc("act"), "gene").limit(30)


@query(f"""{D}, a AS (SELECT gene, {q('median(y)')} AS v FROM dc GROUP BY gene), b AS (SELECT gene, {q('median(dependency)')} AS v FROM dependency GROUP BY gene), p AS (SELECT DISTINCT gene FROM genes WHERE removed_on IS NULL)
SELECT a.gene, CAST(abs(a.v) > 0.2 AS INT) + CAST(coalesce(sign(a.v) = sign(b.v), false) AS INT) + CAST(p.gene IS NOT NULL AS INT) >= 2 AS supported FROM a LEFT JOIN b USING (gene) LEFT JOIN p ON p.gene = a.gene WHERE a.v IS NOT NULL""")
def orthogonal(s, d):
    a = median(views.corrected(s, d), ["gene"], "y").select("gene", q6(C("median")).alias("va")).where("va is not null")
    b = median(table(s, d, "dependency").where("gene is not null"), ["gene"], "dependency").select("gene", q6(C("median")).alias("vb"))
    p = table(s, d, "genes").where("removed_on is null").select("gene", F.lit(1).alias("known")).distinct()
    x = a.join(b, "gene", "left").join(p, "gene", "left")
    score = (F.abs("va") > 0.2).cast("int") + F.coalesce(F.signum("va") == F.signum("vb"), F.lit(False)).cast("int") + C("known").isNotNull().cast("int")
    return x.select("gene", (score >= 2).alias("supported"))


@query(f"{D}, {views.GENES_SQL}, tp AS (SELECT gene FROM (SELECT gene, max(abs(contrib)) AS x FROM dc GROUP BY gene) WHERE x IS NOT NULL ORDER BY x DESC, gene LIMIT 20) SELECT gene, cell_line, y, yc, chrom, gs FROM dc JOIN tp USING (gene) LEFT JOIN genes_v USING (gene)")
def gene_panel(s, d):
    """All rows of the twenty genes with the largest effect, with the gene's place."""
    c = views.corrected(s, d)
    top = c.groupBy("gene").agg(F.max(F.abs("contrib")).alias("x")).where("x is not null").orderBy(F.desc("x"), "gene").limit(20)
    return c.join(F.broadcast(top.select("gene")), "gene").join(views.genes(s, d), "gene", "left").select("gene", "cell_line", "y", "yc", "chrom", "gs")


@query(f"{K}, {_DELTA}, {_DK} SELECT {q('avg(delta)')} - {q('avg(dk)')} AS contrast, avg(delta) > avg(dk) AS holds FROM dl JOIN dk USING (gene)")
def pilot_contrast(s, d):
    x = _arms(s, d).agg(F.avg("delta").alias("a"), F.avg("dk").alias("b"))
    return x.select((q6(C("a")) - q6(C("b"))).alias("contrast"), (C("a") > C("b")).alias("holds"))


@query(f"""{K}, {_TWO}, n AS (SELECT count(*) FILTER (p_true >= 0.9) AS n FROM tw), u AS (SELECT gene FROM (SELECT gene, p_true, row_number() OVER (ORDER BY p_true DESC, gene) AS i FROM tw), n WHERE CASE WHEN n >= 60 THEN p_true >= 0.9 ELSE i <= 60 END),
st AS (SELECT gene FROM tw WHERE p_true <= 0.06) SELECT gene, 'unstable' AS kind FROM u UNION ALL SELECT gene, 'stable' FROM st WHERE gene NOT IN (SELECT gene FROM u)""")
def pilot_select(s, d):
    """Genes above a prevalence, or the sixty with the highest where fewer are; and those below another that aren't among them."""
    p = cut(_prevalences(s, d))
    above = p.where("p_true >= 0.9").select("gene")
    u = above if above.limit(60).count() >= 60 else p.orderBy(F.desc("p_true"), "gene").limit(60).select("gene")
    st = p.where("p_true <= 0.06").select("gene").join(u, "gene", "left_anti")
    return u.withColumn("kind", F.lit("unstable")).unionByName(st.withColumn("kind", F.lit("stable")))


@query(f"SELECT source, count(*) AS n, {q('avg(bp_dist)')} AS mean_dist, {q('avg(has_same_chr_bp)')} AS with_bp, count(*) FILTER (isnan(prox_inv) OR prox_inv IS NULL) AS bad, max(prox_exp_100k) AS top FROM design GROUP BY source")
def design_summary(s, d):
    return table(s, d, "design").groupBy("source").agg(
        F.count("*").alias("n"), q6(F.avg("bp_dist")).alias("mean_dist"), q6(F.avg("has_same_chr_bp")).alias("with_bp"),
        F.count(F.when(F.isnan("prox_inv") | C("prox_inv").isNull(), 1)).alias("bad"), F.max("prox_exp_100k").alias("top"),
    )


@query(f"{K}, {_DELTA}, {_DK} SELECT gene FROM dl JOIN dk USING (gene) WHERE sign(delta) = sign(dk) AND r0 * r0 > 0.01 ORDER BY floor(abs(delta) * 1e6 + 0.5) DESC, gene LIMIT 30")
def case_select(s, d):
    x = _arms(s, d).where(S.same_sign(C("delta"), C("dk")) & (C("r0") * C("r0") > 0.01))
    return x.orderBy(F.desc(q6(F.abs("delta"))), "gene").limit(30).select("gene")


@query(f"""{D}, {_P}, qq AS (SELECT gene, p, {q('least(1.0, min(x) OVER (ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))')} AS q FROM (SELECT gene, p, p * count(*) OVER () / rank_ AS x FROM (SELECT gene, p, count(*) OVER (ORDER BY p) AS rank_ FROM pv))),
g AS (SELECT gene, {q('avg(abs(contrib))')} AS c, {q('median(y - yc)')} AS e FROM dc GROUP BY gene), t AS (SELECT quantile_cont(c, 0.5) AS a FROM g)
SELECT gene, c, e, p, q FROM g JOIN qq USING (gene), t WHERE c >= a AND e IS NOT NULL AND p <= 0.1 AND q <= 0.2 AND gene NOT IN (SELECT gene FROM genes WHERE removed_on IS NOT NULL AND gene IS NOT NULL)""")
def prereg_select(s, d):
    g = summarised(views.corrected(s, d), ["gene"], {"m": (C("y") - C("yc"), 0.5)}, c=q6(F.avg(F.abs("contrib"))))
    g = cut(g.select("gene", "c", q6(C("m")).alias("e")))
    t = g.agg(F.percentile("c", 0.5).alias("a"))
    r = quant(stats.benjamini_hochberg(_gene_p(s, d), "p").select("gene", "p", "q"), "q")
    x = g.join(r, "gene").join(F.broadcast(t), F.lit(True)).where("c >= a and e is not null and p <= 0.1 and q <= 0.2")
    return x.join(table(s, d, "genes").where("removed_on is not null"), "gene", "left_anti").select("gene", "c", "e", "p", "q")


@query(f"{O}, {_M3}, {_FIT3} SELECT id, {q('c')} AS contrib, {q('y - c')} AS prox_only, {q('c - avg(c) OVER (PARTITION BY gene)')} AS centred, {q('y - (c - avg(c) OVER (PARTITION BY gene))')} AS prox_only_centred FROM (SELECT id, gene, y, b2 * near + b3 * far AS c FROM obs JOIN f USING (gene))")
def prox_contrib(s, d):
    o = cut(views.observations(s, d))
    o = o.join(broadcast_if_small(_fit3(s, d, o).select("gene", "coef_near", "coef_far")), "gene")
    o = o.withColumn("c", S.contribution([C("coef_near"), C("coef_far")], [C("near"), C("far")]))
    return _contributions(o)


def _contributions(o):
    """Contribution c of each row and the response without it, as they are and centred on the gene's mean."""
    o = o.join(broadcast_if_small(o.groupBy("gene").agg(F.avg("c").alias("m"))), "gene")
    return o.select("id", q6(C("c")).alias("contrib"), q6(C("y") - C("c")).alias("prox_only"), q6(C("c") - C("m")).alias("centred"), q6(C("y") - (C("c") - C("m"))).alias("prox_only_centred"))


_MP = moments_sql("y", ("cn", "prox"), frm="op", name="mp")
_BP = "CASE WHEN abs(s_cn_cn * s_prox_prox - s_cn_prox * s_cn_prox) > 1e-9 * abs(s_cn_cn * s_prox_prox) THEN (s_cn_cn * s_y_prox - s_cn_prox * s_y_cn) / (s_cn_cn * s_prox_prox - s_cn_prox * s_cn_prox) END"


@query(f"""{O}, op AS (SELECT *, exp(-dist / 100000.0::DOUBLE) AS prox FROM obs), {_MP}, kf AS (SELECT gene, {_BP} AS b FROM mp WHERE n >= 10)
SELECT id, {q('c')} AS contrib, {q('y - c')} AS prox_only, {q('c - avg(c) OVER (PARTITION BY gene)')} AS centred, {q('y - (c - avg(c) OVER (PARTITION BY gene))')} AS prox_only_centred FROM (SELECT id, gene, y, b * prox AS c FROM op JOIN kf USING (gene))""")
def prox_contrib_kernel(s, d):
    """The same by the kernel of the distance."""
    o = cut(views.observations(s, d).withColumn("prox", S.kernels(C("dist"))["prox_exp_100k"]))
    f = stats.ols(o, ["gene"], "y", ["cn", "prox"], least=10).select("gene", "coef_prox")
    return _contributions(o.join(broadcast_if_small(f), "gene").withColumn("c", C("coef_prox") * C("prox")))


@query(f"""{O}, on_ AS (SELECT *, CAST(dist <= 100000 AS INT) AS w1, CAST(dist <= 1000000 AS INT) AS w2 FROM obs), {moments_sql('y', ('cn', 'w1', 'w2'), frm='on_', name='mn')}, {fit3_sql('y', 'cn', 'w1', 'w2', frm='mn', name='nf')}
SELECT id, {q('c')} AS contrib, {q('y - c')} AS prox_only, {q('c - avg(c) OVER (PARTITION BY gene)')} AS centred, {q('y - (c - avg(c) OVER (PARTITION BY gene))')} AS prox_only_centred FROM (SELECT id, gene, y, b2 * w1 + b3 * w2 AS c FROM on_ JOIN nf USING (gene))""")
def prox_contrib_nested(s, d):
    """The same by nested windows."""
    o = cut(views.observations(s, d).withColumns({"w1": (C("dist") <= 100_000).cast("int"), "w2": (C("dist") <= 1_000_000).cast("int")}))
    f = stats.ols(o, ["gene"], "y", ["cn", "w1", "w2"], least=20).select("gene", "coef_w1", "coef_w2")
    return _contributions(o.join(broadcast_if_small(f), "gene").withColumn("c", C("coef_w1") * C("w1") + C("coef_w2") * C("w2")))

@query(f"{O}, {_M3}, {_FIT3}, p AS (SELECT id, gene, y, b0 + b1 * cn + b2 * near + b3 * far AS pred FROM obs JOIN f USING (gene)), md AS (SELECT gene, median(pred) AS m FROM p GROUP BY gene) SELECT id, {q('coalesce(y - (pred - m), y)')} AS corrected FROM p JOIN md USING (gene)")
def correct_full(s, d):
    o = cut(views.observations(s, d))
    o = o.join(broadcast_if_small(_fit3(s, d, o)), "gene")
    o = cut(o.select("id", "gene", "y", (C("intercept") + C("coef_cn") * C("cn") + C("coef_near") * C("near") + C("coef_far") * C("far")).alias("pred")))
    m = median(o, ["gene"], "pred", "m")
    return o.join(broadcast_if_small(m), "gene").select("id", q6(F.coalesce(C("y") - (C("pred") - C("m")), C("y"))).alias("corrected"))


@query(f"{O}, sp AS (SELECT *, CAST(id % 5 = 0 AS INT) AS held FROM obs) SELECT held, {q('median(d)')} AS delta, count(*) AS genes FROM (SELECT held, gene, abs({corr('y', 'cn')}) - abs({corr('yc', 'cn')}) AS d FROM sp GROUP BY held, gene HAVING count(*) >= 10) WHERE d IS NOT NULL GROUP BY held")
def split_score(s, d):
    o = views.observations(s, d).withColumn("held", (C("id") % 5 == 0).cast("int"))
    x = stats.delta_abs_corr(o, ["held", "gene"], "cn", "y", "yc")
    return x.groupBy("held").agg(q6(F.median("delta")).alias("delta"), F.count("*").alias("genes"))


@query(f"{O}, h AS (SELECT gene, id % 2 AS half, sum(cn * cn) AS a, sum(cn * near) AS b, sum(near * near) AS c, sum(y * cn) AS u, sum(y * near) AS v FROM obs GROUP BY 1, 2 HAVING count(*) >= 5), k AS (SELECT gene, half, CASE WHEN abs(a * c - b * b) > 1e-9 * abs(a * c) THEN (u * c - v * b) / (a * c - b * b) END AS k FROM h) SELECT {q(nn('corr(a.k, b.k)'))} AS reliability FROM k a JOIN k b ON a.gene = b.gene AND a.half = 0 AND b.half = 1")
def split_half(s, d):
    """Correlation of the slopes (no intercept) of the two halves of each gene's rows."""
    h = stats.ols(views.observations(s, d).withColumn("half", C("id") % 2), ["gene", "half"], "y", ["cn", "near"], least=5, intercept=False)
    p = h.groupBy("gene").pivot("half", [0, 1]).agg(F.max("coef_cn"))
    return p.agg(q6(stats.pearson(C("0"), C("1"))).alias("reliability"))


@query(f"""{K}, {_DELTA}, {_DK}, ac AS (SELECT gene, avg(CAST(near + far > 0 AS INT)) AS act, avg(CAST(neark + fark > 0 AS INT)) AS actk FROM obs GROUP BY gene),
fl AS (SELECT ascii(gene) % 4 AS chunk, CAST(act >= 0.10 AND {_SIGN} AS INT) AS a, CAST(actk >= 0.10 AND floor(dk * 1e6 + 0.5) > 0 AS INT) AS k FROM dl JOIN dk USING (gene) JOIN ac USING (gene))
SELECT chunk, count(*) AS genes, {q('avg(a)')} AS directional, {q('avg(k)')} AS control, {q('avg(a - k)')} AS excess FROM fl GROUP BY GROUPING SETS ((chunk), ()) HAVING count(*) > 0""")
def chunk_union(s, d):
    """Flags of genes made chunk by chunk, gathered, joined to those of the control arm, and their pairwise excess by chunk and in all."""
    o = cut(views.controlled(s, d))
    act = o.groupBy("gene").agg(F.avg((C("near") + C("far") > 0).cast("int")).alias("act"), F.avg((C("neark") + C("fark") > 0).cast("int")).alias("actk"))
    chunk = F.ascii("gene") % 4
    flags = lambda x, delta, a, name: x.join(act, "gene").select("gene", chunk.alias("chunk"), ((C(a) >= 0.10) & _positive(delta)).cast("int").alias(name))
    true = stats.delta_abs_corr(o, ["gene"], "cn", "y", "yc")
    gathered = [flags(true.where(chunk == i), "delta", "act", "a") for i in range(4)]
    every = gathered[0]
    for part in gathered[1:]:
        every = every.unionByName(part)
    x = every.join(flags(_control_delta(s, d, o), "dk", "actk", "k").drop("chunk"), "gene")
    return x.groupingSets([["chunk"], []], "chunk").agg(F.count("*").alias("genes"), q6(F.avg("a")).alias("directional"), q6(F.avg("k")).alias("control"), q6(F.avg(C("a") - C("k"))).alias("excess"))


@query(f"""{K}, {_DK}, {delta_sql("dl", "yc")}, w AS (SELECT gene, avg(CAST(dist <= 250000 AS INT)) AS a, avg(CAST(dist <= 2000000 AS INT)) AS b, avg(CAST(distk <= 250000 AS INT)) AS ak, avg(CAST(distk <= 2000000 AS INT)) AS bk FROM obs GROUP BY gene),
c AS (SELECT gene, unnest(['250k', '2M']) AS condition, unnest([CAST(a >= 0.10 AND {_SIGN} AS INT), CAST(b >= 0.10 AND {_SIGN} AS INT)]) AS t, unnest([CAST(ak >= 0.10 AND floor(dk * 1e6 + 0.5) > 0 AS INT), CAST(bk >= 0.10 AND floor(dk * 1e6 + 0.5) > 0 AS INT)]) AS k FROM dl JOIN dk USING (gene) JOIN w USING (gene))
SELECT condition, count(*) AS genes, {q('avg(t)')} AS directional, {q('avg(k)')} AS control, {q('avg(t - k)')} AS excess FROM c GROUP BY condition""")
def directional_by_condition(s, d):
    """Share of directional genes under each window, in the observations and the control arm, with the excess."""
    o = cut(views.controlled(s, d))
    sides = {"250k": 250_000, "2M": 2_000_000}
    w = o.groupBy("gene").agg(*[F.avg((C(c) <= v).cast("int")).alias(f"{c}_{k}") for k, v in sides.items() for c in ("dist", "distk")])
    x = stats.delta_abs_corr(o, ["gene"], "cn", "y", "yc").join(_control_delta(s, d, o), "gene").join(w, "gene")
    hit = lambda c, delta: ((C(c) >= 0.10) & _positive(delta)).cast("int")
    c = x.select(F.explode(F.array(*[F.struct(F.lit(k).alias("condition"), hit(f"dist_{k}", "delta").alias("t"), hit(f"distk_{k}", "dk").alias("k")) for k in sides])).alias("c")).select("c.*")
    return c.groupBy("condition").agg(F.count("*").alias("genes"), q6(F.avg("t")).alias("directional"), q6(F.avg("k")).alias("control"), q6(F.avg(C("t") - C("k"))).alias("excess"))


@query(f"{O}, z AS (SELECT lineage AS line, avg(y) AS m, stddev_samp(y) / sqrt(count(*)) AS se FROM obs WHERE lineage IS NOT NULL GROUP BY lineage HAVING count(*) >= 5) SELECT line, {q('m / se')} AS z, {q('2 * exp(-(m / se) * (m / se) / 2)')} AS ranking_score FROM z")
def line_ranking(s, d):
    z = views.observations(s, d).where("lineage is not null").groupBy(C("lineage").alias("line")).agg(F.count("*").alias("n"), F.try_divide(F.avg("y"), F.stddev_samp("y") / F.sqrt(F.count("*"))).alias("z")).where("n >= 5")
    return z.select("line", q6(C("z")).alias("z"), q6(2 * F.exp(-C("z") * C("z") / 2)).alias("ranking_score"))
