"""Scalar rules, filters and set operations over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from locusmill.functions import scalars as S
from locusmill.functions.quant import pow2_parts, q6
from locusmill.operators import clean
from locusmill.operators.intervals import neighbours
from locusmill.operators.ranges import summarised
from locusmill.plans import views
from locusmill.plans.registry import q, query
from locusmill.sources.tables import table

C = F.col


@query("SELECT seg_id, 'chr' || replace(Chromosome, 'chr', '') AS chrom FROM cnv")
def chrom_norm_simple(s, d):
    return table(s, d, "cnv").select("seg_id", S.chrom_simple(C("Chromosome")).alias("chrom"))


@query("""SELECT seg_id, CASE WHEN t LIKE 'chr%' THEN t ELSE 'chr' || regexp_replace(t, 'chr|Chr|CHR', '', 'g') END AS chrom
FROM (SELECT seg_id, CASE WHEN upper(trim(Chromosome)) IN ('MT', 'CHRMT') THEN 'M' ELSE trim(Chromosome) END AS t FROM cnv)""")
def chrom_norm_mt(s, d):
    return table(s, d, "cnv").select("seg_id", S.chrom_mito(C("Chromosome")).alias("chrom"))


@query("""SELECT seg_id, replace(CASE WHEN t IS NULL THEN '' WHEN t IN ('X', 'Y') THEN 'chr' || t WHEN t IN ('M', 'MT') THEN 'chrM' WHEN regexp_full_match(t, '[0-9]+') THEN 'chr' || t
WHEN starts_with(t, 'CHR') THEN t WHEN contains(t, '_') OR contains(t, 'RANDOM') OR contains(t, 'ALT') THEN '' ELSE 'chr' || t END, 'CHR', 'chr') AS chrom
FROM (SELECT seg_id, upper(replace(trim(Chromosome), 'chr', '')) AS t FROM cnv)""")
def chrom_norm_scaffold(s, d):
    return table(s, d, "cnv").select("seg_id", S.chrom_scaffold(C("Chromosome")).alias("chrom"))


_ACH = "CASE WHEN regexp_matches({0}, '(?i)^\\s*ACH[\\s_-]?\\d{{6}}\\s*$') THEN 'ACH-' || regexp_extract({0}, '\\d{{6}}') ELSE trim({0}) END"


@query(f"SELECT seg_id, {_ACH.format('ModelID')} AS model FROM cnv")
def ach_norm(s, d):
    return table(s, d, "cnv").select("seg_id", S.ach_id(C("ModelID")).alias("model"))


@query(f"SELECT seg_id, CASE WHEN regexp_matches(a, '^ACH-\\d{{6}}$') THEN a ELSE upper(regexp_replace(a, '[\\s.-]+', '_', 'g')) END AS model FROM (SELECT seg_id, {_ACH.format('ModelID')} AS a FROM cnv)")
def ccle_norm(s, d):
    return table(s, d, "cnv").select("seg_id", S.ccle_name(C("ModelID")).alias("model"))


@query("SELECT dep_id, upper(regexp_replace(cell_line, '[-_]+', '_', 'g')) AS key FROM dependency")
def separator_key(s, d):
    return table(s, d, "dependency").select("dep_id", S.plain_key(C("cell_line")).alias("key"))


@query("SELECT seg_id, coalesce(NOT regexp_matches(ModelID, '[=;]') AND (regexp_full_match(trim(ModelID), '[Aa][Cc][Hh][ _-]?[0-9]{6}') OR regexp_full_match(trim(ModelID), '[A-Z0-9]+(_[A-Z0-9]+)+')), false) AS valid FROM cnv")
def sample_valid(s, d):
    return table(s, d, "cnv").select("seg_id", S.valid_sample(C("ModelID")).alias("valid"))


@query("SELECT dep_id, trim(regexp_replace(gene, '\\s*\\(\\d+\\)\\s*$', '')) AS symbol FROM dependency")
def gene_symbol(s, d):
    return table(s, d, "dependency").select("dep_id", S.gene_symbol(C("gene")).alias("symbol"))


@query("SELECT dep_id, string_split_regex(trim(gene), '\\s+')[1] AS symbol FROM dependency")
def gene_first_token(s, d):
    return table(s, d, "dependency").select("dep_id", S.first_token(C("gene")).alias("symbol"))


@query("""SELECT DISTINCT feed, file_name, upper(regexp_replace(trim(split_part(file_name, '.', 1)), '[ .-]+', '_', 'g')) AS sample, upper(regexp_replace(trim(file_name), '[ .-]+', '_', 'g')) AS sample_bedpe FROM raw_lines""")
def sample_from_path(s, d):
    """Both readings of a file's name: up to its first point, and all but the ending .bedpe."""
    f = table(s, d, "raw_lines").select("feed", "file_name").distinct()
    return f.select("feed", "file_name", S.sample_of_path(F.concat(F.lit("in/"), "file_name")).alias("sample"), S.sample_of_bedpe(F.concat(F.lit("in/"), "file_name", F.lit(".BEDPE"))).alias("sample_bedpe"))


_BP = "regexp_extract(t, '^\\s*(?:[cC][hH][rR])?([0-9]+|[xX]|[yY]|[mM][tT]?):(\\d+)(?:-\\d+)?([+-])\\s*$', {})"


@query(f"""SELECT seg_id, 'chr' || upper({_BP.format(1)}) AS chrom, greatest(0, {_BP.format(2)}::BIGINT - 1) AS "start", {_BP.format(2)}::BIGINT AS "end", {_BP.format(3)} AS strand
FROM (SELECT seg_id, Chromosome || ':' || "Start" || '-' || "End" || (CASE WHEN seg_id % 2 = 0 THEN '+' ELSE '-' END) AS t FROM cnv) WHERE {_BP.format(3)} <> ''""")
def parse_breakpoint(s, d):
    text = F.concat("Chromosome", F.lit(":"), "Start", F.lit("-"), "End", F.when(C("seg_id") % 2 == 0, "+").otherwise("-"))
    return table(s, d, "cnv").select("seg_id", S.breakpoint_parts(text).alias("b")).where("b is not null").select("seg_id", "b.*")


@query("""SELECT seg_id, coalesce(nullif(concat_ws(';', CASE WHEN trim(cn_unit) <> '' THEN 'unit=' || trim(cn_unit) END, CASE WHEN trim(remark) <> '' THEN 'remark=' || trim(remark) END,
CASE WHEN trim(source) <> '' THEN 'source=' || trim(source) END), ''), '.') AS info FROM cnv""")
def info_kv(s, d):
    return table(s, d, "cnv").select("seg_id", S.info_text({"unit": C("cn_unit"), "remark": C("remark"), "source": C("source")}).alias("info"))


@query("SELECT seg_id, source AS source FROM cnv")
def info_extract(s, d):
    info = S.info_text({"unit": C("cn_unit"), "source": C("source")})
    return table(s, d, "cnv").select("seg_id", S.info_value(info, "source").alias("source"))


@query("SELECT p_partkey, replace(lower(p_type) || '-like', '-like', '') AS svtype FROM part")
def svtype_suffix(s, d):
    return table(s, d, "part").select("p_partkey", F.regexp_replace(F.concat(F.lower("p_type"), F.lit("-like")), "-like", "").alias("svtype"))


@query('SELECT seg_id, ("Start" + "End") // 2 AS mid, greatest(1, "End" - "Start") AS len FROM cnv WHERE "Start" IS NOT NULL AND "End" IS NOT NULL')
def midpoint(s, d):
    return table(s, d, "cnv").where("Start is not null and End is not null").select("seg_id", S.midpoint(C("Start"), C("End")).alias("mid"), S.length(C("Start"), C("End")).alias("len"))


@query(f"WITH {views.SEGMENTS_SQL} SELECT seg_id, cn FROM seg")
def clip_filter(s, d):
    return views.segments(s, d).select("seg_id", "cn")


@query(f"SELECT seg_id, {q('pow(2, x - floor(x))')} * pow(2, floor(x) + 1) AS cn FROM (SELECT seg_id, CopyNumber::DOUBLE AS x FROM cnv)")
def log2_to_cn(s, d):
    """Every row; rounded relatively, so no size overflows the rounding."""
    mantissa, whole = pow2_parts(C("CopyNumber"))
    return table(s, d, "cnv").select("seg_id", (mantissa * F.pow(F.lit(2.0), whole + 1)).alias("cn"))


@query(f"""SELECT seg_id, {q('pow(2, x - floor(x))')} * pow(2, floor(x) + 1) AS cn, {q('x + 1')} AS log2_cn FROM (SELECT seg_id, CopyNumber::DOUBLE AS x FROM cnv)""")
def log2_to_cn_all(s, d):
    """Every row; null stays null. cn is rounded relatively and infinite beyond doubles, where log2_cn still holds it."""
    mantissa, whole = pow2_parts(C("CopyNumber"))
    return table(s, d, "cnv").select("seg_id", (mantissa * F.pow(F.lit(2.0), whole + 1)).alias("cn"), q6(C("CopyNumber") + 1).alias("log2_cn"))


@query(f"""WITH g AS (SELECT source, quantile_cont(CopyNumber, 0.99) > 20 OR max(CopyNumber) > 50 AS abs FROM cnv WHERE CopyNumber IS NOT NULL GROUP BY source)
SELECT seg_id, {q('CASE WHEN g.abs THEN CopyNumber ELSE 2 * pow(2, CopyNumber) END')} AS cn FROM cnv JOIN g USING (source) WHERE CopyNumber IS NOT NULL""")
def abs_cn_guard(s, d):
    return clean.absolute_guard(table(s, d, "cnv").where("CopyNumber is not null"), "CopyNumber", "source").select("seg_id", q6(C("cn")).alias("cn"))


@query("SELECT design_id, " + ", ".join(f"{q(f'exp(-bp_dist / {v}.0)')} AS {k}" for k, v in S.DECAYS.items()) + " FROM design")
def kernels(s, d):
    k = S.kernels(C("bp_dist"))
    return table(s, d, "design").select("design_id", *[q6(k[n]).alias(n) for n in S.DECAYS])


@query("SELECT design_id, floor(1e12 / (bp_dist + 1) + 0.5) / 1e12 AS inv_1, floor(1e12 / (bp_dist + 1000) + 0.5) / 1e12 AS inv_1000 FROM design")
def inv_kernel(s, d):
    fine = lambda eps: (F.floor(F.lit(1e12) / (C("bp_dist") + eps) + 0.5).cast("double") / F.lit(1e12))
    return table(s, d, "design").select("design_id", fine(1).alias("inv_1"), fine(1000).alias("inv_1000"))


@query("SELECT design_id, " + ", ".join(f"CAST(coalesce(bp_dist <= {w}, false) AS INT) AS {k}" for k, w in S.WINDOWS.items()) + ", CAST(bp_dist < 5000000 AS INT) AS has_bp FROM design")
def window_flags(s, d):
    return table(s, d, "design").select("design_id", *[S.within(C("bp_dist"), w).alias(k) for k, w in S.WINDOWS.items()], (C("bp_dist") < 5_000_000).cast("int").alias("has_bp"))


@query("SELECT design_id, CAST(x <= 250000 AS INT) AS near, CAST(x > 250000 AND x <= 2000000 AS INT) AS far FROM (SELECT design_id, coalesce(bp_dist, 5000000) AS x FROM design)")
def near_far(s, d):
    near, far = S.near_far(C("bp_dist"), 250_000, 2_000_000)
    return table(s, d, "design").select("design_id", near.alias("near"), far.alias("far"))


@query("SELECT design_id, CAST(x <= 100000 AS INT) AS within_w1, CAST(x <= 1000000 AS INT) AS within_w2 FROM (SELECT design_id, coalesce(bp_dist, 10000000) AS x FROM design)")
def nested_windows(s, d):
    a, b = S.nested(C("bp_dist"), 100_000, 1_000_000)
    return table(s, d, "design").select("design_id", a.alias("within_w1"), b.alias("within_w2"))


@query("SELECT corr_id, sign(dependency) = sign(dependency_corrected) AS same FROM dependency_corrected WHERE NOT isnan(dependency) AND NOT isnan(dependency_corrected)")
def same_sign(s, d):
    t = table(s, d, "dependency_corrected").where("dependency is not null and not isnan(dependency) and dependency_corrected is not null and not isnan(dependency_corrected)")
    return t.select("corr_id", S.same_sign(C("dependency"), C("dependency_corrected")).alias("same"))


@query(f"WITH {views.CORR_SQL} SELECT corr_id, greatest(abs(y), abs(yc), abs(contrib)) AS most FROM dc")
def row_abs_max(s, d):
    return views.corrected(s, d).select("corr_id", S.abs_max([C("y"), C("yc"), C("contrib")]).alias("most"))


@query("""SELECT design_id, a AS flag_cn, b AS flag_bp_close, c AS flag_bp_very_close, CAST(a + b + c >= 2 AS INT) AS confounded, CAST(a + b + c >= 1 AS INT) AS confounded_any FROM (SELECT design_id,
CAST(coalesce(abs(cn - 2) >= 1, false) AS INT) AS a, CAST(coalesce(bp_dist <= 1000000, false) AS INT) AS b, CAST(coalesce(bp_dist <= 100000, false) AS INT) AS c FROM design)""")
def qc_flags(s, d):
    return table(s, d, "design").select("design_id", *[c.alias(k) for k, c in S.qc_flags(C("cn"), C("bp_dist")).items()])


@query(f"""WITH {views.CORR_SQL}, g AS (SELECT gene, count(*) AS n, median(y) AS my, median(contrib) AS mc, avg(CAST(abs(contrib) > 0.05 AS INT)) AS act, max(abs(pred)) AS top FROM dc GROUP BY gene)
SELECT gene, CASE WHEN k >= 4 THEN 'GREEN' WHEN k = 3 THEN 'AMBER' ELSE 'RED' END AS label FROM (SELECT gene, CAST(coalesce(n >= 15, false) AS INT) + CAST(coalesce(my < 0, false) AS INT)
+ CAST(coalesce(abs(mc) > 0.01, false) AS INT) + CAST(coalesce(act > 0.3, false) AS INT) + CAST(coalesce(top > 1, false) AS INT) AS k FROM g)""")
def interest_label(s, d):
    c = summarised(
        views.corrected(s, d), ["gene"], {"my": (C("y"), 0.5), "mc": (C("contrib"), 0.5)},
        n=F.count("*"), act=F.avg((F.abs("contrib") > 0.05).cast("int")), top=F.max(F.abs("pred")),
    )
    rules = [C("n") >= 15, C("my") < 0, F.abs("mc") > 0.01, C("act") > 0.3, C("top") > 1]
    return c.select("gene", S.label(rules, 4).alias("label"))


@query(f'WITH {views.SEGMENTS_SQL} SELECT seg_id, cell, chrom, greatest(0, x - 1) AS "start", x AS "end" FROM (SELECT seg_id, cell, chrom, s AS x FROM seg UNION ALL SELECT seg_id, cell, chrom, e FROM seg)')
def boundaries(s, d):
    x = views.segments(s, d).select("seg_id", "cell", "chrom", F.explode(F.array("s", "e")).alias("end"))
    return x.select("seg_id", "cell", "chrom", F.greatest(F.lit(0), C("end") - 1).alias("start"), "end")


@query("SELECT gene, count(*) FILTER (ok) AS kept, count(*) FILTER (NOT ok) AS dropped FROM (SELECT gene, coalesce(NOT isnan(pred_structural) AND abs(pred_structural) < 1, false) AS ok FROM dependency_corrected) GROUP BY gene")
def clean_coef(s, d):
    ok = S.clean_coefficient(C("pred_structural"), 1.0)
    return table(s, d, "dependency_corrected").groupBy("gene").agg(F.count(F.when(ok, 1)).alias("kept"), F.count(F.when(~ok, 1)).alias("dropped"))


@query("""SELECT gene, cell, y, dep_id FROM (SELECT *, row_number() OVER (PARTITION BY gene, cell ORDER BY dep_id) AS i FROM (
SELECT trim(gene) AS gene, trim(cell_line) AS cell, dependency AS y, dep_id FROM dependency) WHERE gene <> '' AND cell <> '' AND y IS NOT NULL) WHERE i = 1""")
def dedupe_first(s, d):
    t = table(s, d, "dependency").select(F.trim("gene").alias("gene"), F.trim("cell_line").alias("cell"), C("dependency").alias("y"), "dep_id")
    return clean.first_by(t.where("gene != '' and cell != '' and y is not null"), ["gene", "cell"], "dep_id")


@query("""SELECT seg_id, ModelID AS cell, 'chr' || replace(Chromosome, 'chr', '') AS chrom, "Start" AS s, "End" AS e, least(CopyNumber, 10.0) AS cn FROM cnv
WHERE ModelID IS NOT NULL AND Chromosome IS NOT NULL AND "Start" < "End" AND CopyNumber >= 0 AND CopyNumber <= 20""")
def validate_cnv(s, d):
    t = table(s, d, "cnv").select("seg_id", C("ModelID").alias("cell"), S.chrom_simple(C("Chromosome")).alias("chrom"), C("Start").alias("s"), C("End").alias("e"), C("CopyNumber").alias("cn"))
    return clean.valid_segments(t, 10.0)


_NEXT = "nx AS (SELECT cell, chrom, pos, lead(chrom) OVER w AS chrom2, lead(pos) OVER w AS pos2 FROM bp WINDOW w AS (PARTITION BY cell ORDER BY chrom, pos))"


def _pairs(s, d):
    return neighbours(views.breaks(s, d))


@query(f"WITH {views.SEGMENTS_SQL}, {views.BREAKS_SQL}, {_NEXT} SELECT cell, chrom AS chrom1, pos AS start1, pos + 1 AS end1, chrom2, pos2 AS start2, pos2 + 1 AS end2 FROM nx WHERE chrom2 IS NOT NULL AND pos >= 0")
def validate_sv(s, d):
    x = _pairs(s, d).select("cell", C("chrom").alias("chrom1"), C("pos").alias("start1"), (C("pos") + 1).alias("end1"), "chrom2", C("pos2").alias("start2"), (C("pos2") + 1).alias("end2"))
    return clean.valid_pairs(x)


@query(f"WITH {views.GENES_SQL} SELECT gene, chrom, gs, ge FROM genes_v")
def validate_genes(s, d):
    return views.genes(s, d)


@query("""SELECT count(*) AS n, count(*) FILTER (ModelID IS NULL) AS no_sample, count(*) FILTER ("Start" < 0) AS negative, count(*) FILTER ("End" <= "Start") AS empty,
count(*) FILTER (NOT regexp_matches(Chromosome, '^chr')) AS bare_chrom FROM cnv""")
def bedpe_violations(s, d):
    return clean.violations(table(s, d, "cnv"), {"no_sample": C("ModelID").isNull(), "negative": C("Start") < 0, "empty": C("End") <= C("Start"), "bare_chrom": ~C("Chromosome").rlike("^chr")})


@query(f"WITH {views.SEGMENTS_SQL} SELECT seg_id, CASE WHEN cn < 1.5 THEN 'DEL' ELSE 'DUP' END AS svtype FROM seg WHERE cn < 1.5 OR cn > 2.5")
def class_filter(s, d):
    """Breakend pairs of the classes asked for; -like classes are the class itself."""
    x = views.segments(s, d).select("seg_id", F.when(C("cn") < 1.5, "DEL-like").when(C("cn") > 2.5, "DUP").otherwise("NEUTRAL").alias("svtype"))
    return clean.of_classes(x, "svtype", ["DEL", "DUP-like"])


@query(f"WITH {views.SEGMENTS_SQL}, {views.BREAKS_SQL} SELECT cell, chrom, pos FROM bp")
def distinct_breaks(s, d):
    return views.breaks(s, d)


@query("SELECT gene, cell_line, min(corr_id) AS corr_id FROM dependency_corrected GROUP BY gene, cell_line")
def drop_duplicates(s, d):
    return clean.first_by(table(s, d, "dependency_corrected").select("gene", "cell_line", "corr_id"), ["gene", "cell_line"], "corr_id")


@query(f"""WITH {views.SEGMENTS_SQL}, {views.BREAKS_SQL} SELECT b.cell, b.chrom, b.pos FROM bp b LEFT JOIN (SELECT cell, chrom, pos, lag(pos) OVER (PARTITION BY cell, chrom ORDER BY pos) AS p FROM bp) x
USING (cell, chrom, pos) WHERE x.p IS NULL OR b.pos - x.p > 100000""")
def dedupe_tol(s, d):
    return clean.thin(views.breaks(s, d), ["cell", "chrom"], "pos", 100_000)


@query(f"WITH {views.CORR_SQL} SELECT gene, count(y) AS n FROM dc GROUP BY gene HAVING count(y) >= 20")
def min_group(s, d):
    return views.corrected(s, d).groupBy("gene").agg(F.count("y").alias("n")).where("n >= 20")


@query("SELECT design_id, cn BETWEEN 1.8 AND 2.2 AS neutral, abs(cn - 2) <= 0.5 AS near_two FROM design WHERE cn IS NOT NULL")
def cn_neutral(s, d):
    return table(s, d, "design").where("cn is not null").select("design_id", C("cn").between(1.8, 2.2).alias("neutral"), (F.abs(C("cn") - 2) <= 0.5).alias("near_two"))


@query(f"WITH {views.OBS_SQL}, b AS (SELECT gene, quantile_cont(cn, 0.1) AS lo, quantile_cont(cn, 0.9) AS hi FROM obs GROUP BY gene) SELECT gene, cell FROM obs JOIN b USING (gene) WHERE cn BETWEEN lo AND hi")
def cn_trim(s, d):
    return clean.trimmed(views.observations(s, d), "gene", "cn", 0.1, 0.9).select("gene", "cell")


@query(f"WITH {views.GENES_SQL} SELECT gene, chrom FROM genes_v WHERE chrom NOT IN ('chrX', 'chrY')")
def autosomes(s, d):
    return views.genes(s, d).where(~C("chrom").isin("chrX", "chrY")).select("gene", "chrom")


@query(f"WITH {views.CORR_SQL}, v AS (SELECT gene, var_samp(y) AS v FROM dc GROUP BY gene HAVING count(y) >= 5), t AS (SELECT quantile_cont(floor(v * 1e6 + 0.5) / 1e6, 0.25) AS t FROM v) SELECT gene FROM v, t WHERE floor(v * 1e6 + 0.5) / 1e6 <= t")
def low_var_stratum(s, d):
    v = views.corrected(s, d).groupBy("gene").agg(F.count("y").alias("n"), q6(F.var_samp("y")).alias("v")).where("n >= 5")
    return clean.lowest_share(v, "v", 0.25).select("gene")


@query("""SELECT DISTINCT d.source, m.word FROM (SELECT DISTINCT source, remark FROM cnv WHERE remark IS NOT NULL) d JOIN (SELECT DISTINCT lower(platform) AS word FROM data_sources WHERE platform IS NOT NULL
UNION SELECT unnest(['Log2', 'RATIO', 'copies', 'percent'])) m ON contains(lower(d.remark), lower(m.word))""", name="contains_ci")
def contains_ci(s, d):
    """Sources with a remark that holds one of the words, in any case."""
    remarks = table(s, d, "cnv").where("remark is not null").select("source", "remark").distinct()
    words = table(s, d, "data_sources").where("platform is not null").select(F.lower("platform").alias("word")).union(s.createDataFrame([(w,) for w in ("Log2", "RATIO", "copies", "percent")], "word string")).distinct()
    return clean.containing(remarks, "remark", words, "word").select("source", "word").distinct()


@query("""SELECT count(DISTINCT ModelID) AS cnv_cells, count(DISTINCT cell_line) AS dep_cells, count(*) FILTER (ModelID IS NOT NULL AND cell_line IS NOT NULL) AS common
FROM (SELECT DISTINCT ModelID FROM cnv WHERE ModelID IS NOT NULL) FULL JOIN (SELECT DISTINCT cell_line FROM dependency WHERE cell_line IS NOT NULL) ON ModelID = cell_line""")
def overlap_counts(s, d):
    return clean.overlap_counts(table(s, d, "cnv").select(C("ModelID").alias("k")), table(s, d, "dependency").select(C("cell_line").alias("k")), "k", "cnv_cells", "dep_cells")


@query("SELECT cell FROM (SELECT ModelID AS cell FROM cnv UNION ALL SELECT cell_line FROM dependency UNION ALL SELECT cell_line FROM design)")
def union_all(s, d):
    a, b, c = (table(s, d, t).select(C(k).alias("cell")) for t, k in (("cnv", "ModelID"), ("dependency", "cell_line"), ("design", "cell_line")))
    return a.unionByName(b).unionByName(c)


@query("SELECT ModelID AS cell FROM cnv INTERSECT SELECT cell_line FROM design")
def intersect(s, d):
    return table(s, d, "cnv").select(C("ModelID").alias("cell")).intersect(table(s, d, "design").select("cell_line"))


@query("SELECT gene FROM design UNION SELECT gene FROM dependency")
def union_distinct(s, d):
    return table(s, d, "design").select("gene").union(table(s, d, "dependency").select("gene")).distinct()


@query("SELECT gene FROM dependency EXCEPT SELECT gene FROM genes", name="except")
def except_(s, d):
    return table(s, d, "dependency").select("gene").subtract(table(s, d, "genes").select("gene"))


@query("SELECT * FROM (SELECT corr_id, unnest(['dependency', 'dependency_corrected', 'prox_contrib']) AS field, unnest([dependency, dependency_corrected, prox_contrib]) AS value FROM dependency_corrected)")
def unpivot_wide(s, d):
    t = table(s, d, "dependency_corrected").select("corr_id", "dependency", "dependency_corrected", "prox_contrib")
    return t.unpivot(["corr_id"], ["dependency", "dependency_corrected", "prox_contrib"], "field", "value")


@query("""SELECT gene, kind FROM (SELECT gene, kind, row_number() OVER (PARTITION BY gene ORDER BY kind) AS i FROM (SELECT gene, 1 AS kind FROM design UNION ALL SELECT gene, 2 FROM dependency)) WHERE i = 1""")
def union_first(s, d):
    u = table(s, d, "design").select("gene", F.lit(1).alias("kind")).union(table(s, d, "dependency").select("gene", F.lit(2)))
    return u.groupBy("gene").agg(F.min("kind").alias("kind"))


@query("""SELECT chrom, gs, ge, coalesce(nullif(regexp_extract(attr, 'gene_name "([^"]+)"', 1), ''), nullif(regexp_extract(attr, 'gene_id "([^"]+)"', 1), ''), 'NA') AS gene FROM (
SELECT chrom, "start" AS gs, "end" AS ge, CASE WHEN strand IS NULL THEN 'gene_id "' || gene || '";' ELSE 'gene_id "X"; gene_name "' || gene || '";' END AS attr FROM genes)""")
def gtf_parse(s, d):
    from locusmill.sources.files import parse_gtf

    attr = F.when(C("strand").isNull(), F.concat(F.lit('gene_id "'), "gene", F.lit('";'))).otherwise(F.concat(F.lit('gene_id "X"; gene_name "'), "gene", F.lit('";')))
    lines = table(s, d, "genes").select(F.concat_ws("\t", "chrom", F.lit("x"), F.lit("gene"), C("start") + 1, "end", F.lit("."), F.coalesce("strand", F.lit(".")), F.lit("."), attr).alias("value"))
    return parse_gtf(lines).select("chrom", "gs", "ge", "gene")
