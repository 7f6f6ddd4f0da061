"""Views of the given tables that the screen queries share, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusmill.functions.scalars import near_far
from locusmill.operators import controls, units
from locusmill.plans.registry import copies_sql, drawn_sql, units_sql
from locusmill.sources.tables import table

# genes: one row per gene, the first by place.
GENES_SQL = (
    'genes_v AS (SELECT gene, chrom, "start" AS gs, "end" AS ge FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY chrom, "start", "end") AS i'
    " FROM (SELECT DISTINCT gene, chrom, \"start\", \"end\" FROM genes WHERE gene IS NOT NULL AND chrom IS NOT NULL AND \"start\" < \"end\")) WHERE i = 1)"
)
# segments: valid ones under the plain chromosome name, capped copy number.
SEGMENTS_SQL = (
    "seg AS (SELECT seg_id, ModelID AS cell, 'chr' || regexp_replace(regexp_replace(upper(trim(Chromosome)), '^CHR_?', ''), '^0+', '') AS chrom,"
    ' "Start" AS s, "End" AS e, least(CopyNumber, 10.0) AS cn FROM cnv WHERE ModelID IS NOT NULL AND Chromosome IS NOT NULL AND "Start" < "End"'
    " AND CopyNumber >= 0 AND CopyNumber <= 20)"
)
# breakpoints: both borders of each segment, once each.
BREAKS_SQL = "bp AS (SELECT DISTINCT cell, chrom, pos FROM (SELECT cell, chrom, s AS pos FROM seg UNION ALL SELECT cell, chrom, e FROM seg))"
CELLS_SQL = "cells AS (SELECT DISTINCT cell, chrom FROM bp)"
# observations: a scored gene and cell with the gene's copies and breakpoint distance in that cell.
_SIDES_SQL = (
    "sc AS (SELECT corr_id, gene, cell_line AS cell, dependency AS y, dependency_corrected AS yc FROM dependency_corrected WHERE dependency IS NOT NULL AND NOT isnan(dependency)"
    " AND dependency_corrected IS NOT NULL AND NOT isnan(dependency_corrected)),"
    " li AS (SELECT DepMap_ID AS cell, min(substr(CCLE_name, strpos(CCLE_name, '_') + 1)) AS lineage FROM depmap_model_map GROUP BY 1),"
    f" un AS ({units_sql('design', 'design_id', 'cn', ['cn_remark'])}),"
    f" de AS (SELECT design_id, gene, cell_line AS cell, least(10.0::DOUBLE, {copies_sql('v')}) AS cn, least(5000000, coalesce(bp_dist, 5000000)) AS dist FROM design JOIN un ON un.row_id = design_id WHERE v IS NOT NULL AND unit <> 'unknown')"
)
_FLAGS_SQL = "CAST({0} <= 250000 AS INT) AS near{1}, CAST({0} > 250000 AND {0} <= 2000000 AS INT) AS far{1}"
OBS_SQL = f"{_SIDES_SQL}, obs AS (SELECT corr_id * 1048576 + design_id AS id, gene, cell, cn, dist, {_FLAGS_SQL.format('dist', '')}, y, yc, lineage FROM de JOIN sc USING (gene, cell) LEFT JOIN li USING (cell))"
# the same with the distances of a cell dealt out anew among its design rows
CONTROL_SQL = (
    f"{_SIDES_SQL}, nu AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY design_id) AS i, row_number() OVER (PARTITION BY cell ORDER BY {drawn_sql(14, 'design_id')} * 2097152 + design_id % 2097152) AS j FROM de WHERE cell IS NOT NULL),"
    f" dn AS (SELECT a.*, b.dist AS distk FROM nu a JOIN nu b ON a.cell = b.cell AND a.i = b.j),"
    f" obs AS (SELECT corr_id * 1048576 + design_id AS id, gene, cell, cn, dist, {_FLAGS_SQL.format('dist', '')}, distk, {_FLAGS_SQL.format('distk', 'k')}, y, yc, lineage FROM dn JOIN sc USING (gene, cell) LEFT JOIN li USING (cell))"
)
CORR_SQL = (
    "dc AS (SELECT corr_id, gene, cell_line, CASE WHEN NOT isnan(dependency) THEN dependency END AS y, CASE WHEN NOT isnan(dependency_corrected) THEN dependency_corrected END AS yc,"
    " CASE WHEN NOT isnan(pred_structural) THEN pred_structural END AS pred, CASE WHEN NOT isnan(prox_contrib) THEN prox_contrib END AS contrib FROM dependency_corrected WHERE gene IS NOT NULL)"
)


def genes(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "genes").select("gene", "chrom", F.col("start").alias("gs"), F.col("end").alias("ge"))
    first = F.min(F.struct("chrom", "gs", "ge")).alias("x")
    return g.where("gene is not null and chrom is not null and gs < ge").groupBy("gene").agg(first).select("gene", "x.*")


def segments(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "cnv")
    chrom = F.concat(F.lit("chr"), F.regexp_replace(F.regexp_replace(F.upper(F.trim("Chromosome")), "^CHR_?", ""), "^0+", ""))
    return (
        c.where("ModelID is not null and Chromosome is not null and Start < End and CopyNumber >= 0 and CopyNumber <= 20")
        .select("seg_id", F.col("ModelID").alias("cell"), chrom.alias("chrom"), F.col("Start").alias("s"), F.col("End").alias("e"), F.least("CopyNumber", F.lit(10.0)).alias("cn"))
    )


def breaks(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d)
    return s.select("cell", "chrom", F.explode(F.array("s", "e")).alias("pos")).distinct()


def _scores(spark: SparkSession, d: str) -> DataFrame:
    v = lambda c: F.when(~F.isnan(c), F.col(c))
    t = table(spark, d, "dependency_corrected").select("corr_id", "gene", F.col("cell_line").alias("cell"), v("dependency").alias("y"), v("dependency_corrected").alias("yc"))
    return t.where("y is not null and yc is not null")


def _lineages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "depmap_model_map").groupBy(F.col("DepMap_ID").alias("cell")).agg(F.min(F.expr("substr(CCLE_name, instr(CCLE_name, '_') + 1)")).alias("lineage"))


def placed(spark: SparkSession, d: str) -> DataFrame:
    """Design rows with the copies in one unit (at most 10) and the distance (5,000,000 where there is none)."""
    rows = table(spark, d, "design").select("design_id", "gene", F.col("cell_line").alias("cell"), "cn", "cn_remark", "source", F.least(F.lit(5_000_000), F.coalesce("bp_dist", F.lit(5_000_000))).alias("dist"))
    u = units.to_copies(units.with_units(rows, ["cn_remark"], table(spark, d, "data_sources")), "cn")
    return u.where("copies is not null").select("design_id", "gene", "cell", F.least(F.lit(10.0), "copies").alias("cn"), "dist")


def _flags(df: DataFrame, dist: str, end: str = "") -> DataFrame:
    near, far = near_far(F.col(dist), 250_000, 2_000_000)
    return df.withColumns({f"near{end}": near, f"far{end}": far})


def _observed(spark: SparkSession, d: str, design: DataFrame) -> DataFrame:
    """Joined on gene and cell by shuffle (a hot gene is split over its cells), lineages by what the planner finds."""
    o = design.join(_scores(spark, d), ["gene", "cell"]).join(_lineages(spark, d), "cell", "left")
    return o.withColumn("id", F.col("corr_id") * 1048576 + F.col("design_id")).drop("corr_id", "design_id")


def observations(spark: SparkSession, d: str) -> DataFrame:
    """id, gene, cell, cn, dist, near, far, y, yc, lineage: a scored gene and cell with its copies and breakpoint distance."""
    return _flags(_observed(spark, d, placed(spark, d)), "dist")


def controlled(spark: SparkSession, d: str) -> DataFrame:
    """The observations with distances (``distk``, ``neark``, ``fark``) dealt out anew among the design rows of each cell."""
    rows = controls.permute(placed(spark, d).where("cell is not null"), ["cell"], "design_id", ["dist"], 14).withColumnRenamed("permuted_dist", "distk")
    return _flags(_flags(_observed(spark, d, rows), "dist"), "distk", "k")


def corrected(spark: SparkSession, d: str) -> DataFrame:
    v = lambda c: F.when(~F.isnan(c), F.col(c))
    return table(spark, d, "dependency_corrected").where("gene is not null").select(
        "corr_id", "gene", "cell_line", v("dependency").alias("y"), v("dependency_corrected").alias("yc"), v("pred_structural").alias("pred"), v("prox_contrib").alias("contrib")
    )
