"""Round trips: the given tables written as the files of the field by a sink and read back by the source, with the SQL of what must come back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from locusmill.functions.quant import q6
from locusmill.plans import views
from locusmill.plans.registry import q, query
from locusmill.session import shared_folder
from locusmill.sources import files, sinks
from locusmill.sources.tables import table

C = F.col


def _place(s, name: str) -> str:
    return f"{shared_folder(s)}/files-{uuid.uuid4().hex}/{name}"


@query("SELECT seg_id, ModelID AS model, CopyNumber AS cn FROM cnv")
def scan_csv(s, d):
    path = _place(s, "cnv.csv")
    sinks.csv(table(s, d, "cnv").select("seg_id", "ModelID", "CopyNumber"), path)
    r = files.csv(s, path)
    return r.select(C("seg_id").cast("long").alias("seg_id"), C("ModelID").alias("model"), C("CopyNumber").cast("double").alias("cn"))


@query("SELECT design_id, gene, bp_dist FROM design")
def scan_tsv(s, d):
    path = _place(s, "design.tsv")
    sinks.csv(table(s, d, "design").select("design_id", "gene", "bp_dist"), path, "\t", False)
    return files.tsv(s, path, "design_id long, gene string, bp_dist long")


@query("""SELECT CASE WHEN starts_with(chrom, 'chr') THEN chrom ELSE 'chr' || chrom END AS chrom, "start", "end", trim(regexp_replace(gene, '\\s*\\(\\d+\\)\\s*$', '')) AS gene, strand FROM genes""")
def scan_bed(s, d):
    path = _place(s, "genes.bed")
    sinks.csv(table(s, d, "genes").select("chrom", "start", "end", F.concat("gene", F.lit(" (7157)")).alias("gene"), "strand"), path, "\t", False)
    return files.bed(s, path)


def _pairs(s, d):
    return views.segments(s, d).select(
        C("chrom").alias("chrom1"), C("s").alias("start1"), (C("s") + 1).alias("end1"), C("chrom").alias("chrom2"), C("e").alias("start2"), (C("e") + 1).alias("end2"),
        F.when(C("cn") < 2, "DEL").otherwise("DUP").alias("svtype"), F.lit(".").alias("score"), F.lit("+").alias("strand1"), F.lit("-").alias("strand2"), C("cell").alias("cell_line"),
        F.when(C("cn") < 2, "svclass=DEL-like").otherwise("svclass=DUP-like").alias("info"),
    )


_PAIR = f"WITH {views.SEGMENTS_SQL} SELECT {{0}} AS cell_line, chrom AS chrom1, s AS start1, s + 1 AS end1, chrom AS chrom2, e AS start2, e + 1 AS end2, CASE WHEN cn < 2 THEN 'DEL' ELSE 'DUP' END AS svtype FROM seg"


@query(_PAIR.format("'ALLCELLS'") + " WHERE cn < 2")
def scan_bedpe(s, d):
    """Without a header and without samples in the rows: the cell comes from the file's name, the class from the info field."""
    path = _place(s, "out")
    x = _pairs(s, d).withColumn("cell_line", F.lit("ALLCELLS"))
    sinks.bedpe(x, path)
    return files.bedpe(s, path, ["DEL"]).select("cell_line", "chrom1", "start1", "end1", "chrom2", "start2", "end2", "svtype")


@query(_PAIR.format("CASE WHEN regexp_full_match(trim(cell), 'ACH-[0-9]{6}') THEN trim(cell) ELSE 'OTHER' END"))
def scan_bedpe_header(s, d):
    path = _place(s, "out")
    x = _pairs(s, d).select("chrom1", "start1", "end1", "chrom2", "start2", "end2", F.concat("svtype", F.lit("-like")).alias("name"), F.when(C("cell_line").rlike("^ *ACH-[0-9]{6} *$"), F.trim("cell_line")).otherwise("OTHER_").alias("sample"))
    x.write.option("header", True).option("sep", "\t").csv(path)
    r = files.bedpe_with_header(s, path)
    return r.select(F.when(C("cell_line").rlike("^ACH-[0-9]{6}$"), C("cell_line")).otherwise("OTHER").alias("cell_line"), "chrom1", "start1", "end1", "chrom2", "start2", "end2", "svtype")


@query("SELECT trim(regexp_replace(gene, '\\s*\\(\\d+\\)\\s*$', '')) AS gene, trim(cell_line) AS cell_line, dependency FROM dependency WHERE cell_line IS NOT NULL AND gene IS NOT NULL")
def scan_dependency(s, d):
    """A long file under other headers."""
    path = _place(s, "dep.csv")
    sinks.csv(table(s, d, "dependency").where("cell_line is not null and gene is not null").select(C("gene").alias("Gene"), C("cell_line").alias("ModelID"), C("dependency").alias("dep")), path)
    return files.dependency(s, path)


@query("SELECT cell AS cell_line, g.gene AS gene, v AS dependency FROM (SELECT DISTINCT cell_line AS cell FROM design WHERE regexp_full_match(cell_line, 'ACH-[0-9]{6}')) c, (SELECT unnest(['A1', 'B2', 'C3']) AS gene) g LEFT JOIN (SELECT cell_line AS k, unnest(['A1', 'B2', 'C3']) AS gene, unnest([min(bp_dist), max(bp_dist), count(*)])::DOUBLE AS v FROM design GROUP BY cell_line) x ON k = cell AND x.gene = g.gene")
def scan_dependency_wide(s, d):
    """A matrix with a column per gene."""
    path = _place(s, "wide.csv")
    w = table(s, d, "design").where(C("cell_line").rlike("^ACH-[0-9]{6}$")).groupBy(C("cell_line").alias("id")).agg(F.min("bp_dist").alias("A1 (11)"), F.max("bp_dist").alias("B2 (22)"), F.count("*").alias("C3 (33)"))
    sinks.csv(w, path)
    return files.dependency(s, path)


_GUARD = "(SELECT quantile_cont(CopyNumber, 0.99) > 20 OR max(CopyNumber) > 50 FROM c)"


@query(f"WITH c AS (SELECT * FROM cnv WHERE ModelID IS NOT NULL AND Chromosome IS NOT NULL) SELECT trim(ModelID) AS cell_line, \"Start\" AS \"start\", \"End\" AS \"end\", {q(f'CASE WHEN {_GUARD} THEN CopyNumber ELSE 2 * pow(2, CopyNumber) END')} AS cn FROM c")
def scan_cnv(s, d):
    path = _place(s, "cnv.csv")
    sinks.csv(table(s, d, "cnv").where("ModelID is not null and Chromosome is not null").select("ModelID", "Chromosome", "Start", "End", "CopyNumber"), path)
    return files.cnv(s, path).select("cell_line", "start", "end", q6(C("cn")).alias("cn"))


@query("SELECT trim(regexp_replace(gene, '\\s*\\(\\d+\\)\\s*$', '')) AS gene, cell_line, prox_inv AS expression FROM design WHERE gene IS NOT NULL AND cell_line IS NOT NULL")
def scan_expression(s, d):
    path = _place(s, "expr.csv")
    sinks.csv(table(s, d, "design").where("gene is not null and cell_line is not null").select(C("gene"), C("cell_line"), C("prox_inv").alias("expression")), path)
    return files.expression(s, path)


@query(f"WITH {views.SEGMENTS_SQL}, x AS (SELECT DISTINCT cell, chrom, s, e FROM seg WHERE regexp_full_match(cell, 'ACH-[0-9]{{6}}') AND regexp_full_match(chrom, 'chr([0-9]+|X|Y)') AND s > 0) SELECT cell AS cell_line, chrom AS chrom1, s - 1 AS start1, chrom AS chrom2, e - 1 AS start2, 'DUP' AS svtype FROM x GROUP BY ALL")
def scan_breakends(s, d):
    """A sheet of breakends as text."""
    x = views.segments(s, d).where(C("cell").rlike("^ACH-[0-9]{6}$") & C("chrom").rlike("^chr([0-9]+|X|Y)$") & (C("s") > 0))
    text = lambda c: F.concat("chrom", F.lit(":"), c, F.lit("-"), c, F.lit("+"))
    path = _place(s, "sheet.csv")
    sinks.csv(x.select(C("cell").alias("CCLE_name"), text("s").alias("bp1"), text("e").alias("bp2"), F.lit("DUP-like").alias("class")), path)
    return files.breakend_table(files.csv(s, path)).select("cell_line", "chrom1", "start1", "chrom2", "start2", "svtype")


@query("SELECT design_id, gene, cn FROM design")
def sink_parquet(s, d):
    path = _place(s, "design.parquet")
    sinks.parquet(table(s, d, "design").select("design_id", "gene", "cn"), path, sidecar=True)
    return files.load_table(s, path)


@query("SELECT source, count(*) AS n, sum(seg_id)::BIGINT AS ids FROM cnv WHERE source IS NOT NULL GROUP BY source")
def sink_by_key(s, d):
    path = _place(s, "by")
    sinks.by_key(table(s, d, "cnv").where("source is not null").select("seg_id", "source"), path, "source")
    return s.read.parquet(path).groupBy("source").agg(F.count("*").alias("n"), F.sum("seg_id").alias("ids"))


@query("SELECT source, count(*) AS n, count(cn) AS held FROM design WHERE source IS NOT NULL GROUP BY source")
def sink_metrics(s, d):
    path = _place(s, "metrics")
    sinks.metrics(table(s, d, "design").where("source is not null").groupBy("source").agg(F.count("*").alias("n"), F.count("cn").alias("held")), path)
    return s.read.schema("source string, n long, held long").json(path)


@query("SELECT gene, count(*) AS n FROM design GROUP BY gene")
def sink_cached(s, d):
    """Made and written the first time, read the second."""
    folder, make = _place(s, "cache"), lambda: table(s, d, "design").groupBy("gene").agg(F.count("*").alias("n"))
    sinks.cached(s, folder, {"table": "design", "by": "gene"}, make)
    return sinks.cached(s, folder, {"by": "gene", "table": "design"}, lambda: make().limit(0))


@query("WITH a AS (SELECT DISTINCT ModelID AS key FROM cnv WHERE ModelID IS NOT NULL), b AS (SELECT DISTINCT cell_line AS key FROM design WHERE cell_line IS NOT NULL) SELECT 'cnv' AS side, key FROM a UNION ALL SELECT 'design', key FROM b UNION ALL SELECT 'all', key FROM a JOIN b USING (key)")
def audit_tables(s, d):
    return sinks.audit({"cnv": table(s, d, "cnv").select(C("ModelID").alias("key")), "design": table(s, d, "design").select(C("cell_line").alias("key"))}, "key")
