"""Queries p3 to p6 over the given tables, with the SQL that states the same result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusmill.functions.quant import q6
from locusmill.plans.registry import copies_sql, units_sql
from locusmill.operators import coverage, drift, orphans, spelling, units
from locusmill.session import cut
from locusmill.sources.tables import table


def _cnv_units(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "cnv").select("seg_id", "CopyNumber", "cn_unit", "remark", "source")
    return units.with_units(rows, ["cn_unit", "remark"], table(spark, d, "data_sources"), value="CopyNumber")


def _design_units(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "design").select("design_id", "cn", "cn_remark", "source")
    return units.with_units(rows, ["cn_remark"], table(spark, d, "data_sources"), value="cn")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    parts = (("cnv", "seg_id", "CopyNumber", _cnv_units(spark, d)), ("design", "design_id", "cn", _design_units(spark, d)))
    a, b = (units.foreign_units(df, v).select(F.lit(t).alias("table_name"), F.col(i).alias("row_id"), "unit") for t, i, v, df in parts)
    return a.unionByName(b)


def p3_copies(spark: SparkSession, d: str) -> DataFrame:
    parts = (("cnv", "seg_id", "CopyNumber", _cnv_units(spark, d)), ("design", "design_id", "cn", _design_units(spark, d)))
    a, b = (
        units.to_copies(df, v).select(F.lit(t).alias("table_name"), F.col(i).alias("row_id"), "unit", q6(F.col("copies")).alias("copies"))
        for t, i, v, df in parts
    )
    return a.unionByName(b)


def _drift(spark: SparkSession, d: str) -> drift.Drift:
    return drift.Drift(table(spark, d, "raw_lines"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _drift(spark, d).steps().select("feed", "file_name", "change_kind", "field", "old_field")


def p4_names(spark: SparkSession, d: str) -> DataFrame:
    """What the borders of versions show by names and types alone, before renames are settled: feed, file_name, change, field."""
    s = _drift(spark, d).schemas
    seen = F.array(*[F.struct(F.lit(n).alias("change"), F.col(c).alias("fields")) for n, c in (("appeared", "added"), ("vanished", "gone"), ("recast", "recast"))])
    return s.select("feed", "file_name", F.explode(seen).alias("x")).select("feed", "file_name", "x.change", F.explode("x.fields").alias("field"))


def p4_table(spark: SparkSession, d: str) -> DataFrame:
    run = _drift(spark, d)
    return run.table(run.routes(cut(run.steps())))


def p4_versions(spark: SparkSession, d: str) -> DataFrame:
    run = _drift(spark, d)
    return run.routes(cut(run.steps()))


ENTITY = ("run_id", "model_id", "chrom")


def _bitmaps(spark: SparkSession, d: str) -> DataFrame:
    cnv = table(spark, d, "cnv").select("run_id", "ModelID", "Chromosome", "Start", "End")
    keys = {"run_id": F.col("run_id"), "model_id": F.col("ModelID"), "chrom": coverage.chromosome(F.col("Chromosome"))}
    return coverage.run_bitmaps(cnv, keys, F.col("Start"), F.col("End"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return coverage.clear_runs(_bitmaps(spark, d), ENTITY)


def p5_covered(spark: SparkSession, d: str) -> DataFrame:
    return coverage.set_runs(_bitmaps(spark, d), ENTITY)


def _gene_key(c: str):
    return F.upper(F.trim(F.regexp_replace(F.col(c), r"\s*\(\d+\)\s*$", "")))


def _references(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    dep = table(spark, d, "dependency").select("dep_id", "gene", "cell_line", "loaded_at")
    des = table(spark, d, "design").select("design_id", "gene", "cell_line", "loaded_at")
    genes, models = table(spark, d, "genes"), table(spark, d, "depmap_model_map")

    def sided(df: DataFrame, name: str, row_id: str, cell_space: str, cell_key) -> DataFrame:
        both = F.explode(F.array(
            F.struct(F.lit("gene").alias("field"), F.lit("gene").alias("space"), _gene_key("gene").alias("key")),
            F.struct(F.lit("cell_line").alias("field"), F.lit(cell_space).alias("space"), cell_key.alias("key")),
        ))
        return df.select(F.lit(name).alias("table_name"), F.col(row_id).alias("row_id"), "loaded_at", both.alias("r")).select("table_name", "row_id", "loaded_at", "r.*")

    refs = sided(dep, "dependency", "dep_id", "typed", F.col("cell_line")).unionByName(sided(des, "design", "design_id", "model", F.trim("cell_line")))
    meant = spelling.resolve(dep, "cell_line", models, "CCLE_name", "DepMap_ID")
    periods = models.select("DepMap_ID", "added_on", "removed_on").where(F.col("DepMap_ID").isNotNull()).distinct()
    parents = (
        genes.select(F.lit("gene").alias("space"), _gene_key("gene").alias("key"), "added_on", "removed_on")
        .unionByName(models.select(F.lit("model").alias("space"), F.trim("DepMap_ID").alias("key"), "added_on", "removed_on"))
        .unionByName(meant.join(periods, "DepMap_ID").select(F.lit("typed").alias("space"), F.col("cell_line").alias("key"), "added_on", "removed_on"))
    )
    return refs, parents


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphans(*_references(spark, d)).select("table_name", "row_id", "field", "period", "reason")


def p6_direct(spark: SparkSession, d: str) -> DataFrame:
    """The references whose spelling needs no list: genes of both tables and the models of design."""
    refs, parents = _references(spark, d)
    return orphans.orphans(refs.where("space != 'typed'"), parents.where("space != 'typed'"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.report(p6_found(spark, d))


QUERIES = {f.__name__: f for f in (p3_found, p3_copies, p4_found, p4_names, p4_table, p4_versions, p5_found, p5_covered, p6_found, p6_direct, p6_report)}

_UNITS = units_sql("cnv", "seg_id", "CopyNumber", ["cn_unit", "remark"]) + " UNION ALL " + units_sql("design", "design_id", "cn", ["cn_remark"])

_ISLANDS = """
WITH seg AS (
  SELECT run_id, ModelID AS model_id,
         regexp_replace(regexp_replace(regexp_replace(upper(Chromosome), '[^A-Z0-9]', '', 'g'), '^(CHROMOSOME|CHROM|CHR)', ''), '^0+', '') AS c,
         "Start" AS s, "End" AS e
  FROM cnv WHERE "End" > "Start" AND run_id IS NOT NULL AND ModelID IS NOT NULL),
ok AS (SELECT run_id, model_id, 'chr' || c AS chrom, s, e FROM seg WHERE regexp_matches(c, '^([1-9]|1[0-9]|2[0-2]|X|Y)$')),
o AS (SELECT *, max(e) OVER (PARTITION BY run_id, model_id, chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM ok)
"""

_SPLIT = " ".join(
    f"WHEN sep = {s} THEN regexp_extract_all({s} || line, '{p}([ ]*\"(?:[^\"]|\"\")*\"[ ]*|[^{p}]*)', 1)" for s, p in (("','", ","), ("';'", ";"), ("chr(9)", "\\t"), ("'|'", "\\|"))
)
_CELLS = f"list_transform(CASE {_SPLIT} ELSE [line] END, lambda c: trim(replace(regexp_replace(trim(c), '^\"|\"$', '', 'g'), '\"\"', '\"')))"
_P4_NAMES = f"""
WITH b AS (SELECT * FROM (SELECT feed, file_name, line_no, delivered_at, regexp_replace(line, '^\ufeff|[\\r\\n]+$', '', 'g') AS line FROM raw_lines) WHERE trim(line) <> '' AND NOT starts_with(ltrim(line), '#')),
h AS (SELECT feed, file_name, min(line_no) AS head_no, min(delivered_at) AS delivered FROM b GROUP BY ALL),
n AS (SELECT h.*, line AS head, list_transform([',', ';', chr(9), '|'], lambda s: len(x) - len(replace(x, s, ''))) AS c FROM (SELECT h.*, line, regexp_replace(line, '"[^"]*"', '', 'g') AS x FROM h JOIN b USING (feed, file_name) WHERE line_no = head_no) h),
s AS (SELECT *, CASE WHEN list_max(c) > 0 THEN [',', ';', chr(9), '|'][list_position(c, list_max(c))] END AS sep, row_number() OVER (PARTITION BY feed ORDER BY delivered, file_name) AS k FROM n),
hd AS (SELECT * EXCLUDE (line), {_CELLS} AS header FROM (SELECT *, head AS line FROM s)),
r AS (SELECT feed, k, header, {_CELLS} AS cells FROM b JOIN hd USING (feed, file_name) WHERE line_no <> head_no),
v AS (SELECT feed, k, unnest(range(1, len(header) + 1)) AS pos, unnest(cells[1:len(header)] || list_transform(range(greatest(0, len(header) - len(cells))), lambda i: NULL::VARCHAR)) AS x FROM r WHERE cells <> header),
t AS (SELECT feed, k, pos, max(CASE WHEN lower(x) IN ('', 'na') THEN NULL WHEN regexp_full_match(x, '[-+]?[0-9]+') THEN 0 WHEN regexp_full_match(x, '[-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][-+]?[0-9]+)?') THEN 1 ELSE 2 END) AS kind FROM v WHERE x IS NOT NULL GROUP BY ALL),
f AS (SELECT feed, file_name, k, min(pos) AS pos, field FROM (SELECT feed, file_name, k, unnest(range(1, len(header) + 1)) AS pos, unnest(header) AS field FROM hd) GROUP BY ALL),
g AS (SELECT f.*, t.kind FROM f LEFT JOIN t USING (feed, k, pos)),
z AS (SELECT feed, k + 1 AS k, field, kind AS was FROM g)
SELECT feed, file_name, 'appeared' AS change, field FROM g WHERE k > 1 AND NOT EXISTS (SELECT 1 FROM z WHERE z.feed = g.feed AND z.k = g.k AND z.field = g.field)
UNION ALL SELECT z.feed, hd.file_name, 'vanished', z.field FROM z JOIN hd USING (feed, k) WHERE NOT EXISTS (SELECT 1 FROM g WHERE z.feed = g.feed AND z.k = g.k AND z.field = g.field)
UNION ALL SELECT feed, file_name, 'recast', field FROM g JOIN z USING (feed, k, field) WHERE kind <> was
"""

_GENE_KEY = "upper(trim(regexp_replace({0}, '\\s*\\(\\d+\\)\\s*$', '')))"
_P6_DIRECT = f"""
WITH p AS (SELECT 'gene' AS space, {_GENE_KEY.format('gene')} AS k, added_on, removed_on FROM genes UNION ALL SELECT 'model', trim(DepMap_ID), added_on, removed_on FROM depmap_model_map),
r AS (SELECT 'dependency' AS table_name, dep_id AS row_id, 'gene' AS field, 'gene' AS space, {_GENE_KEY.format('gene')} AS k, loaded_at AS t FROM dependency
UNION ALL SELECT 'design', design_id, 'gene', 'gene', {_GENE_KEY.format('gene')}, loaded_at FROM design UNION ALL SELECT 'design', design_id, 'cell_line', 'model', trim(cell_line), loaded_at FROM design),
j AS (SELECT table_name, row_id, field, t, count(p.k) AS held, bool_or(p.k IS NOT NULL AND (t IS NULL OR (coalesce(added_on <= t, true) AND coalesce(t < removed_on, true)))) AS valid,
bool_and(coalesce(t < added_on, false)) AS early FROM r LEFT JOIN p ON r.space = p.space AND r.k = p.k WHERE r.k IS NOT NULL GROUP BY ALL)
SELECT table_name, row_id, field, strftime(t, '%Y-%m') AS period, CASE WHEN held = 0 THEN 'missing' WHEN early THEN 'late' ELSE 'deleted' END AS reason FROM j WHERE NOT valid
"""

SQL = {
    "p4_names": _P4_NAMES,
    "p6_direct": _P6_DIRECT,
    "p3_found": f"SELECT table_name, row_id, unit FROM ({_UNITS}) WHERE v IS NOT NULL AND unit NOT IN ('absolute', 'unknown')",
    "p3_copies": (
        "SELECT table_name, row_id, unit, floor(c * 1e6 + 0.5) / 1e6 AS copies"
        f" FROM (SELECT *, {copies_sql('v')} AS c FROM ({_UNITS}))"
    ),
    "p5_found": _ISLANDS + "SELECT run_id, model_id, chrom, prev AS gap_start, s AS gap_end FROM o WHERE prev < s",
    "p5_covered": _ISLANDS + """, g AS (SELECT *, sum(CASE WHEN prev IS NULL OR prev < s THEN 1 ELSE 0 END)
        OVER (PARTITION BY run_id, model_id, chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM o)
        SELECT run_id, model_id, chrom, min(s) AS "start", max(e) AS "end" FROM g GROUP BY run_id, model_id, chrom, k""",
}
