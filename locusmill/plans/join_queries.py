"""Joins over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusmill.functions.quant import q6
from locusmill.functions.scalars import near_far
from locusmill.operators import intervals
from locusmill.operators.ranges import median
from locusmill.plans import views
from locusmill.plans.registry import q, query
from locusmill.session import broadcast_if_small, cut
from locusmill.sources.tables import table

C = F.col
_GS = f"WITH {views.SEGMENTS_SQL}, {views.GENES_SQL}"
_GB = f"WITH {views.SEGMENTS_SQL}, {views.BREAKS_SQL}, {views.GENES_SQL}"
_DIST = (
    "nd AS (SELECT gene, cell, least(5000000, min(abs((gs + ge) // 2 - pos))) AS dist FROM genes_v JOIN bp USING (chrom) GROUP BY gene, cell)"
)


@query(f"""{_GS} SELECT gene, cell, {q('sum(greatest(0, least(e, ge) - greatest(s, gs)) * cn) / any_value(greatest(1, ge - gs))')} AS cn
FROM seg JOIN genes_v USING (chrom) WHERE e > gs AND s < ge GROUP BY gene, cell""")
def interval_weighted_cn(s, d):
    return intervals.weighted_copy_number(views.segments(s, d), views.genes(s, d)).select("gene", "cell", q6(C("cn")).alias("cn"))


@query(f"""{_GS} SELECT gene, count(*) AS pairs, CAST(sum(greatest(0, least(e, ge) - greatest(s, gs))) AS BIGINT) AS bases
FROM seg JOIN genes_v USING (chrom) WHERE e >= gs AND s < ge GROUP BY gene""")
def interval_closed(s, d):
    return intervals.touching(views.segments(s, d), views.genes(s, d)).groupBy("gene").agg(F.count("*").alias("pairs"), F.sum("overlap").alias("bases"))


@query(f"{_GS} SELECT seg_id, gene, least(e, ge) - greatest(s, gs) AS bases FROM seg JOIN genes_v USING (chrom) WHERE s < ge AND gs < e")
def overlap_len(s, d):
    pairs = intervals.interval_join(views.segments(s, d), views.genes(s, d), ["chrom"], "s", "e", "gs", "ge")
    return pairs.select("seg_id", "gene", (F.least("e", "ge") - F.greatest("s", "gs")).alias("bases"))


@query(f"""WITH {views.SEGMENTS_SQL}, {views.BREAKS_SQL} SELECT seg_id, least(5000000, min(abs((s + e) // 2 - pos))) AS dist FROM seg JOIN bp USING (cell, chrom) GROUP BY seg_id""")
def nearest_dist(s, d):
    mids = views.segments(s, d).select("seg_id", "cell", "chrom", F.floor((C("s") + C("e")) / 2).alias("mid"))
    return intervals.nearest(mids, views.breaks(s, d), ["cell", "chrom"], "mid", "pos", 5_000_000).select("seg_id", "dist")


@query(f"{_GB}, {_DIST} SELECT gene, {q('avg(CAST(dist <= 250000 AS INT))')} AS near, {q('avg(CAST(dist > 250000 AND dist <= 2000000 AS INT))')} AS far, count(*) AS cells FROM nd GROUP BY gene")
def prevalence(s, d):
    """Cells are counted per chromosome; only the pairs of a gene and a cell with a close breakpoint are made."""
    near, far = near_far(C("d"), 250_000, 2_000_000)
    genes, breaks = views.genes(s, d), cut(views.breaks(s, d))
    cells = breaks.groupBy("chrom").agg(F.countDistinct("cell").alias("cells"))
    close = intervals.near_pairs(genes, breaks, 2_500_000).groupBy("gene").agg(F.sum(near).alias("n"), F.sum(far).alias("f"))
    share = lambda c: q6(F.coalesce(c, F.lit(0)) / C("cells"))
    return genes.select("gene", "chrom").join(F.broadcast(cells), "chrom").join(close, "gene", "left").select("gene", share(C("n")).alias("near"), share(C("f")).alias("far"), "cells")


@query(f"{_GB}, {_DIST} SELECT gene, cell, dist FROM nd")
def gene_cell_dist(s, d):
    return intervals.gene_distances(views.genes(s, d), views.breaks(s, d))


_DD = "d1 AS (SELECT gene, cell_line, min(cn) AS cn FROM design GROUP BY 1, 2), d2 AS (SELECT gene, cell_line, min(dependency) AS y FROM dependency GROUP BY 1, 2)"


def _sides(s, d):
    a = table(s, d, "design").groupBy("gene", "cell_line").agg(F.min("cn").alias("cn"))
    b = table(s, d, "dependency").groupBy("gene", "cell_line").agg(F.min("dependency").alias("y"))
    return a, b


@query(f"WITH {_DD} SELECT gene, cell_line, cn, y FROM d1 JOIN d2 USING (gene, cell_line)")
def join_inner(s, d):
    a, b = _sides(s, d)
    return a.join(b, ["gene", "cell_line"])


@query(f"WITH {_DD} SELECT gene, cell_line, cn, y FROM d1 LEFT JOIN d2 USING (gene, cell_line)")
def join_left(s, d):
    a, b = _sides(s, d)
    return a.join(b, ["gene", "cell_line"], "left")


@query(f"WITH {_DD} SELECT gene, cell_line, cn, y FROM d1 FULL JOIN d2 USING (gene, cell_line)")
def join_outer(s, d):
    a, b = _sides(s, d)
    return a.join(b, ["gene", "cell_line"], "full")


@query("""SELECT seg_id, coalesce(m.name, c.ModelID) AS mapped FROM cnv c LEFT JOIN (SELECT DepMap_ID, arg_max(CCLE_name, added_on) AS name FROM depmap_model_map WHERE CCLE_name IS NOT NULL GROUP BY 1) m ON c.ModelID = m.DepMap_ID""")
def map_fallback(s, d):
    m = table(s, d, "depmap_model_map").where("CCLE_name is not null")
    return intervals.map_fallback(table(s, d, "cnv").select("seg_id", "ModelID"), "ModelID", m, "DepMap_ID", "CCLE_name", "added_on").select("seg_id", "mapped")


_HEADS = "h AS (SELECT DISTINCT split_part(trim(cell_line), '_', 1) AS k FROM dependency WHERE cell_line IS NOT NULL), n AS (SELECT DISTINCT CCLE_name AS name FROM depmap_model_map WHERE CCLE_name IS NOT NULL)"
_PREFIX = "SELECT k, name FROM (SELECT k, name, row_number() OVER (PARTITION BY k ORDER BY length(name), name) AS i FROM h JOIN n ON name = k OR starts_with(name, k || '_')) WHERE i = 1"


def _heads(s, d):
    return table(s, d, "dependency").where("cell_line is not null").select(F.split(F.trim("cell_line"), "_")[0].alias("k")).distinct()


def _names(s, d):
    return table(s, d, "depmap_model_map").where("CCLE_name is not null").select(C("CCLE_name").alias("name")).distinct()


@query(f"WITH {_HEADS} SELECT k, name AS match FROM ({_PREFIX})")
def prefix_match(s, d):
    return intervals.prefix_match(_heads(s, d), "k", _names(s, d), "name").select("k", "match")


@query(f"""WITH {_HEADS}, ids AS (SELECT DepMap_ID AS k, min(CCLE_name) AS name FROM depmap_model_map WHERE CCLE_name IS NOT NULL GROUP BY 1), p AS ({_PREFIX})
SELECT h.k, coalesce(ids.name, n.name, p.name) AS mapped, CASE WHEN ids.name IS NOT NULL THEN 'id' WHEN n.name IS NOT NULL THEN 'exact' WHEN p.name IS NOT NULL THEN 'prefix' END AS how
FROM h LEFT JOIN ids USING (k) LEFT JOIN n ON n.name = h.k LEFT JOIN p ON p.k = h.k""")
def map_cascade(s, d):
    ids = table(s, d, "depmap_model_map").where("CCLE_name is not null").groupBy("DepMap_ID").agg(F.min("CCLE_name").alias("name"))
    return intervals.map_cascade(_heads(s, d), "k", ids, _names(s, d), _names(s, d)).select("k", "mapped", "how")


@query(f"WITH {views.CORR_SQL} SELECT corr_id, {q('y - m')} AS centred FROM dc JOIN (SELECT gene, median(y) AS m FROM dc GROUP BY gene) USING (gene)", name="group_scalar")
def group_scalar(s, d):
    c = views.corrected(s, d)
    return c.join(broadcast_if_small(median(c, ["gene"], "y", "m")), "gene").select("corr_id", q6(C("y") - C("m")).alias("centred"))


@query("SELECT dep_id FROM dependency SEMI JOIN genes ON genes.gene = dependency.gene")
def semi_join_list(s, d):
    return table(s, d, "dependency").join(table(s, d, "genes"), "gene", "left_semi").select("dep_id")


@query("SELECT DISTINCT gene FROM genes WHERE gene NOT IN (SELECT gene FROM design WHERE gene IS NOT NULL AND bp_dist <= 100000)")
def anti_join(s, d):
    near = table(s, d, "design").where("bp_dist <= 100000")
    return table(s, d, "genes").join(near, "gene", "left_anti").select("gene").distinct()


_PAIRS = """nx AS (SELECT cell, chrom AS chrom1, pos AS start1, lead(chrom) OVER w AS chrom2, lead(pos) OVER w AS start2 FROM bp WINDOW w AS (PARTITION BY cell ORDER BY chrom, pos))"""


@query(f"""{_GB}, {_PAIRS} SELECT DISTINCT cell, chrom1, start1, chrom2, start2, gene FROM nx JOIN genes_v g ON (g.chrom = chrom1 AND start1 < ge + 1000000 AND start1 >= greatest(0, gs - 1000000))
OR (g.chrom = chrom2 AND start2 < ge + 1000000 AND start2 >= greatest(0, gs - 1000000)) WHERE chrom2 IS NOT NULL""")
def region_lookup(s, d):
    pairs = intervals.neighbours(views.breaks(s, d)).select("cell", C("chrom").alias("chrom1"), C("pos").alias("start1"), "chrom2", C("pos2").alias("start2")).where("chrom2 is not null")
    return intervals.region_lookup(pairs, views.genes(s, d)).select("cell", "chrom1", "start1", "chrom2", "start2", "gene")


@query("""SELECT design_id, m.lineage FROM design LEFT JOIN (SELECT DepMap_ID, min(substr(CCLE_name, strpos(CCLE_name, '_') + 1)) AS lineage FROM depmap_model_map GROUP BY 1) m ON cell_line = DepMap_ID""")
def lineage_annotation(s, d):
    m = table(s, d, "depmap_model_map").groupBy(C("DepMap_ID").alias("cell_line")).agg(F.min(F.expr("substr(CCLE_name, instr(CCLE_name, '_') + 1)")).alias("lineage"))
    return table(s, d, "design").select("design_id", "cell_line").join(m, "cell_line", "left").select("design_id", "lineage")


@query("""SELECT gene, a.n AS design_rows, b.n AS dep_rows FROM (SELECT gene, count(*) AS n FROM design WHERE gene IS NOT NULL GROUP BY 1) a FULL JOIN (SELECT gene, count(*) AS n FROM dependency WHERE gene IS NOT NULL GROUP BY 1) b USING (gene)""")
def align_columns(s, d):
    n = lambda t, a: table(s, d, t).where("gene is not null").groupBy("gene").agg(F.count("*").alias(a))
    return n("design", "design_rows").join(n("dependency", "dep_rows"), "gene", "full")


@query(f"""WITH {views.CORR_SQL}, t AS (SELECT gene, {q('avg(y)')} AS v FROM dc GROUP BY gene), c AS (SELECT gene, {q('avg(yc)')} AS v FROM dc GROUP BY gene) SELECT gene, t.v AS v_true, c.v AS v_control, t.v - c.v AS excess FROM t JOIN c USING (gene)""")
def paired_excess(s, d):
    a = views.corrected(s, d).groupBy("gene").agg(q6(F.avg("y")).alias("v_true"), q6(F.avg("yc")).alias("v_control"))
    return a.withColumn("excess", C("v_true") - C("v_control"))
