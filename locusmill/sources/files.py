"""Text and parquet sources of the screen analysis, with explicit schemas and lazy plans."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from locusmill.functions import scalars as S

BED = "chrom string, start bigint, end bigint, gene string, strand string"
BEDPE = "chrom1 string, start1 bigint, end1 bigint, chrom2 string, start2 bigint, end2 bigint, name string, score string, strand1 string, strand2 string, sample string, info string"
GTF = ("seqname", "origin", "feature", "first", "last", "score", "strand", "frame", "attr")

# Headers under which a field may come, lower case with underscores.
ALIASES: dict[str, tuple[str, ...]] = {
    "cell_line": ("cell_line", "modelid", "model_id", "depmap_id", "sample", "sample_id", "cell", "line"),
    "gene": ("gene", "gene_name", "symbol", "hugo_symbol"),
    "dependency": ("dependency", "dep", "gene_effect", "effect", "score"),
    "chrom": ("chrom", "chromosome", "chr", "seqname"),
    "start": ("start", "startpos", "loc.start", "begin"),
    "end": ("end", "endpos", "loc.end", "stop"),
    "cn": ("cn", "copynumber", "copy_number", "total_cn", "segment_mean", "segmentmean", "seg_mean"),
    "expression": ("expression", "tpm", "value"),
}


def canonical_header(name: str) -> str:
    return name.strip().lower().replace(" ", "_")


def rename_known(df: DataFrame, fields: Iterable[str]) -> DataFrame:
    """Columns known under another header get the field's name; the first in the list of headers wins."""
    by = {canonical_header(c): c for c in df.columns}
    for f in fields:
        found = next((by[a] for a in ALIASES[f] if a in by), None)
        if found and found != f:
            df = df.withColumnRenamed(found, f)
    return df


def csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", encoding: str = "UTF-8") -> DataFrame:
    r = spark.read.option("header", schema is None).option("sep", sep).option("encoding", encoding)
    return r.schema(schema).csv(path) if schema else r.csv(path)


def tsv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return csv(spark, path, schema, "\t")


def bed(spark: SparkSession, path: str) -> DataFrame:
    """Genes of a headerless BED file, chromosome and symbol normalised."""
    b = spark.read.option("sep", "\t").option("comment", "#").schema(BED).csv(path)
    return b.withColumn("chrom", S.chrom_mito(F.col("chrom"))).withColumn("gene", S.gene_symbol(F.col("gene")))


def bedpe(spark: SparkSession, paths: str | list[str], classes: Iterable[str] | None = None) -> DataFrame:
    """Breakend pairs of headerless BEDPE files; the sample comes from the file name where the column is empty."""
    r = spark.read.option("sep", "\t").option("comment", "#").schema(BEDPE).csv(paths)
    path = F.col("_metadata.file_name")
    svtype = F.regexp_replace(F.coalesce(S.info_value(F.col("info"), "svclass"), "name"), "-like", "")
    out = (
        r.select("*", path.alias("__file")).where("start1 is not null")
        .withColumn("cell_line", F.coalesce(F.nullif("sample", F.lit("")), S.sample_of_path(F.col("__file")))).withColumn("svtype", svtype)
        .withColumn("chrom1", S.chrom_mito(F.col("chrom1"))).withColumn("chrom2", S.chrom_mito(F.col("chrom2"))).drop("__file")
    )
    return out.where(F.col("svtype").isin(*classes)) if classes else out


def bedpe_with_header(spark: SparkSession, path: str, classes: Iterable[str] | None = None) -> DataFrame:
    """Breakend pairs of BEDPE files with a header: typed places, svtype (of ``svtype``, ``name``, ``svclass`` or ``info``), cell_line
    (of ``cell_line`` or ``sample`` where it is a valid name, else of the file's name), chromosomes with scaffolds emptied."""
    r = spark.read.option("header", True).option("sep", "\t").option("comment", "#").csv(path)
    absent = [c for c in ("chrom1", "start1", "end1", "chrom2", "start2", "end2") if c not in r.columns]
    if absent:
        raise ValueError(f"columns {absent} are missing in {path}")
    text = lambda c: F.col(c).cast("string") if c in r.columns else F.lit(None).cast("string")
    svtype = F.coalesce(text("svtype"), F.replace(text("name"), F.lit("-like"), F.lit("")), F.replace(text("svclass"), F.lit("-like"), F.lit("")), F.replace(S.info_value(text("info"), "svclass"), F.lit("-like"), F.lit("")), F.lit("UNKNOWN"))
    said = F.coalesce(text("cell_line"), text("sample"))
    out = r.select(
        *[S.chrom_scaffold(F.col(c)).alias(c) if c.startswith("chrom") else F.expr(f"try_cast({c} as bigint)").alias(c) for c in ("chrom1", "start1", "end1", "chrom2", "start2", "end2")],
        svtype.alias("svtype"), F.when(S.valid_sample(said), S.ccle_name(said)).otherwise(S.sample_of_bedpe(F.col("_metadata.file_name"))).alias("cell_line"),
    )
    return out.where(F.col("svtype").isin(*[c.replace("-like", "") for c in classes])) if classes else out


def breakend_table(df: DataFrame) -> DataFrame:
    """Rows of a sheet with CCLE_name, bp1, bp2 and class (delivered as CSV or parquet) as breakend pairs."""
    one, two = S.breakpoint_parts(F.col("bp1")), S.breakpoint_parts(F.col("bp2"))
    info = S.info_text({c: F.col(c) for c in ("gene1", "gene2", "fusion", "site1", "site2") if c in df.columns})
    return (
        df.withColumn("a", one).withColumn("b", two).where("a is not null and b is not null")
        .select(
            F.col("a.chrom").alias("chrom1"), F.col("a.start").alias("start1"), F.col("a.end").alias("end1"), F.col("b.chrom").alias("chrom2"),
            F.col("b.start").alias("start2"), F.col("b.end").alias("end2"), F.regexp_replace("class", "-like", "").alias("svtype"), F.lit(".").alias("score"),
            F.col("a.strand").alias("strand1"), F.col("b.strand").alias("strand2"), S.ccle_name(F.col("CCLE_name")).alias("cell_line"), info.alias("info"),
        ).dropDuplicates(["cell_line", "chrom1", "start1", "chrom2", "start2", "svtype"])
    )


def load_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, or the CSV beside it."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return csv(spark, path.removesuffix(".parquet") + ".csv")


def unpivot(df: DataFrame, key: str, name: str, value: str) -> DataFrame:
    rest = [c for c in df.columns if c != key]
    return df.unpivot([key], rest, name, value)


def dependency(spark: SparkSession, path: str, ids: DataFrame | None = None, encoding: str = "UTF-8") -> DataFrame:
    """gene, cell_line, dependency of a long file, or of a wide one with a column per gene."""
    df = rename_known(csv(spark, path, encoding=encoding), ("cell_line", "gene", "dependency"))
    if not {"gene", "dependency"} <= set(df.columns):
        df = unpivot(df, df.columns[0], "gene", "dependency").withColumnRenamed(df.columns[0], "cell_line")
    df = df.select(S.gene_symbol(F.col("gene")).alias("gene"), F.trim("cell_line").alias("cell_line"), F.expr("try_cast(dependency as double)").alias("dependency"))
    if ids is None:
        return df
    return df.join(ids.toDF("cell_line", "__to"), "cell_line", "left").withColumn("cell_line", F.coalesce("__to", "cell_line")).drop("__to")


def cnv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Segments under the canonical fields, ratios of two brought to copies by the guard of the whole file."""
    from locusmill.operators.clean import absolute_guard

    df = rename_known(csv(spark, path, sep=sep), ("cell_line", "chrom", "start", "end", "cn"))
    typed = df.select(
        F.trim("cell_line").alias("cell_line"), S.chrom_mito(F.col("chrom")).alias("chrom"), F.expr("try_cast(start as bigint)").alias("start"),
        F.expr("try_cast(end as bigint)").alias("end"), F.expr("try_cast(cn as double)").alias("raw"),
    ).withColumn("__all", F.lit(1))
    return absolute_guard(typed, "raw", "__all").drop("raw", "__all")


def expression(spark: SparkSession, path: str) -> DataFrame:
    """gene, cell_line, expression; of a matrix only the rows marked as default entry, if such a mark exists."""
    df = csv(spark, path)
    mark = next((c for c in df.columns if canonical_header(c) == "isdefaultentryformodel"), None)
    if mark:
        df = df.where(F.lower(mark).isin("yes", "true", "1")).drop(mark)
    df = rename_known(df, ("cell_line", "gene", "expression"))
    if "expression" not in df.columns:
        df = unpivot(df, "cell_line" if "cell_line" in df.columns else df.columns[0], "gene", "expression")
    return df.select(S.gene_symbol(F.col("gene")).alias("gene"), F.col(df.columns[0]).alias("cell_line") if "cell_line" not in df.columns else "cell_line", F.expr("try_cast(expression as double)").alias("expression"))


def parse_gtf(lines: DataFrame) -> DataFrame:
    """Gene rows of GTF lines (column ``value``) as half-open intervals: chrom, gs, ge, gene, strand."""
    f = F.split("value", "\t")
    cols = {n: f[i] for i, n in enumerate(GTF)}
    named = lambda k: F.nullif(F.regexp_extract(cols["attr"], f'{k} "([^"]+)"', 1), F.lit(""))
    return lines.where(~F.col("value").startswith("#") & (cols["feature"] == "gene")).select(
        S.chrom_mito(cols["seqname"]).alias("chrom"), (cols["first"].cast("long") - 1).alias("gs"), cols["last"].cast("long").alias("ge"),
        F.coalesce(named("gene_name"), named("gene_id"), F.lit("NA")).alias("gene"), cols["strand"].alias("strand"),
    )


def gtf(spark: SparkSession, path: str) -> DataFrame:
    return parse_gtf(spark.read.text(path))


def gene_list(spark: SparkSession, path: str) -> DataFrame:
    """One identifier per line: the first word, distinct, without blanks and comments."""
    t = spark.read.text(path).select(S.first_token(F.split("value", ",")[0]).alias("gene"))
    return t.where("gene != '' and not startswith(gene, '#')").distinct()


def bedpe_archive(spark: SparkSession, path: str, classes: Iterable[str] | None = None) -> DataFrame:
    """Members of tar archives of (gzipped) BEDPE files. An archive is one task; a member is read line by line."""
    import gzip

    wanted = frozenset(classes or ())

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for member in tar:
                        if not member.isfile() or ".bedpe" not in member.name:
                            continue
                        raw = tar.extractfile(member)
                        text = io.TextIOWrapper(gzip.GzipFile(fileobj=raw) if member.name.endswith(".gz") else raw)
                        df = pd.read_csv(text, sep="\t", comment="#", header=0, dtype=str)
                        df = df.reindex(columns=["chrom1", "start1", "end1", "chrom2", "start2", "end2", "svclass"])
                        if wanted:
                            df = df[df["svclass"].isin(wanted)]
                        df["sample"] = member.name.rsplit("/", 1)[-1].split(".")[0]
                        yield df

    schema = "chrom1 string, start1 string, end1 string, chrom2 string, start2 string, end2 string, svclass string, sample string"
    out = spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, schema)
    whole = {c: F.expr(f"try_cast({c} as bigint)") for c in ("start1", "end1", "start2", "end2")}
    return out.withColumns(whole | {"chrom1": S.chrom_mito(F.col("chrom1")), "chrom2": S.chrom_mito(F.col("chrom2"))})


def settings(path: str) -> Mapping[str, object]:
    """``key: value`` lines of a configuration file; deeper indentation nests, ``- x`` lines make a list."""
    out: dict[str, object] = {}
    open_: list[tuple[int, dict | list, dict | None, str]] = [(-1, out, None, "")]
    bare = lambda v: v.strip().strip("\"'")
    with open(path) as f:
        for line in f:
            body = line.split("#")[0].rstrip()
            if not body.strip():
                continue
            depth = len(body) - len(body.lstrip())
            while depth <= open_[-1][0]:
                open_.pop()
            _, held, above, name = open_[-1]
            if body.lstrip().startswith("- "):
                if isinstance(held, dict) and above is not None:
                    held = above[name] = []
                    open_[-1] = (open_[-1][0], held, above, name)
                held.append(bare(body.lstrip()[2:]))
                continue
            k, _, v = body.partition(":")
            held[k.strip()] = bare(v) if v.strip() else {}
            if not v.strip():
                open_.append((depth, held[k.strip()], held, k.strip()))
    return out
