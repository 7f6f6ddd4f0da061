import io
import tarfile

import pytest

from pyspark.sql import functions as F

from locusmill.sources import files, sinks


def put(path, text):
    path.write_text(text)
    return str(path)


def test_text_sources(spark, tmp_path):
    bed = put(tmp_path / "g.bed", "chr1\t10\t20\tTP53 (7157)\t+\nMT\t1\t2\tX\t-\n")
    assert [tuple(r) for r in files.bed(spark, bed).collect()] == [("chr1", 10, 20, "TP53", "+"), ("chrM", 1, 2, "X", "-")]
    gtf = put(tmp_path / "g.gtf", '# x\n1\ts\tgene\t11\t20\t.\t+\t.\tgene_id "E1"; gene_name "TP53";\n1\ts\texon\t1\t2\t.\t+\t.\tx\n1\ts\tgene\t1\t2\t.\t+\t.\tgene_id "E2";\n')
    assert [(r["chrom"], r["gs"], r["ge"], r["gene"]) for r in files.gtf(spark, gtf).collect()] == [("chr1", 10, 20, "TP53"), ("chr1", 0, 2, "E2")]
    wide = put(tmp_path / "w.csv", "id,TP53 (7157),MYC (4609)\nACH-1,0.5,bad\n")
    assert sorted((r["gene"], r["cell_line"], r["dependency"]) for r in files.dependency(spark, wide).collect()) == [("MYC", "ACH-1", None), ("TP53", "ACH-1", 0.5)]
    long = put(tmp_path / "l.csv", "Gene,ModelID,dep\nA,x,1.5\n")
    ids = spark.createDataFrame([("x", "ACH-9")], "a string, b string")
    assert [tuple(r) for r in files.dependency(spark, long, ids).select("gene", "cell_line", "dependency").collect()] == [("A", "ACH-9", 1.5)]
    cnv = put(tmp_path / "c.csv", "ModelID,Chromosome,Start,End,CopyNumber\nA,1,1,5,0\nA,1,5,9,1\n")
    assert [r["cn"] for r in files.cnv(spark, cnv).orderBy("start").collect()] == [2.0, 4.0]
    genes = put(tmp_path / "genes.txt", "TP53 extra\n\n# no\nTP53\nMYC,1\n")
    assert sorted(r[0] for r in files.gene_list(spark, genes).collect()) == ["MYC", "TP53"]
    assert files.settings(put(tmp_path / "c.yaml", "a: 1 # x\nb: 'y'\n\n")) == {"a": "1", "b": "y"}
    assert files.settings(put(tmp_path / "n.yaml", "a:\n  b: 2\n  c:\n    - x\n    - y # z\nd: 3\n")) == {"a": {"b": "2", "c": ["x", "y"]}, "d": "3"}


def test_breakends(spark, tmp_path):
    put(tmp_path / "ACH-000001.bedpe", "# c\n1\t9\t10\t2\t19\t20\tDEL-like\t.\t+\t-\t\t.\n")
    put(tmp_path / "ACH-000002.bedpe", "1\t9\t10\t2\t19\t20\tx\t.\t+\t-\tS2\tsvclass=DUP\n")
    rows = files.bedpe(spark, str(tmp_path / "*.bedpe")).orderBy("cell_line").collect()
    assert [(r["cell_line"], r["svtype"], r["chrom1"]) for r in rows] == [("ACH-000001", "DEL", "chr1"), ("S2", "DUP", "chr1")]
    assert files.bedpe(spark, str(tmp_path / "*.bedpe"), ["DUP"]).count() == 1
    put(tmp_path / "ACH_000003.x.bedpe.txt", "#c\nchrom1\tstart1\tend1\tchrom2\tstart2\tend2\tname\tsample\nchr1\t9\t10\tMT\t19\t20\tDEL-like\tACH 000009\n1_random\tbad\t10\tx\t19\t20\tDUP\ta=b\n")
    h = files.bedpe_with_header(spark, str(tmp_path / "ACH_000003.x.bedpe.txt")).orderBy("svtype").collect()
    assert [tuple(r) for r in h] == [("chr1", 9, 10, "chrM", 19, 20, "DEL", "ACH-000009"), ("", None, 10, "chrX", 19, 20, "DUP", "ACH_000003_X_BEDPE_TXT")]
    raw = b"chrom1\tstart1\tend1\tchrom2\tstart2\tend2\tsvclass\n1\t1\t2\t3\t4\t5\tDEL\n1\t1\t2\t3\t4\t5\tINV\n"
    with tarfile.open(tmp_path / "a.tar.gz", "w:gz") as tar:
        info = tarfile.TarInfo("d/S7.somatic.bedpe")
        info.size = len(raw)
        tar.addfile(info, io.BytesIO(raw))
    assert [(r["sample"], r["chrom2"], r["start2"]) for r in files.bedpe_archive(spark, str(tmp_path / "a.tar.gz"), ["DEL"]).collect()] == [("S7", "chr3", 4)]
    sheet = spark.createDataFrame([("ach 000001", "1:10-10+", "2:20-20-", "DUP-like", "G")] * 2 + [("x", "bad", "2:1-1+", "DEL", None)], "CCLE_name string, bp1 string, bp2 string, class string, gene1 string")
    table = files.breakend_table(sheet)
    assert [(r["cell_line"], r["start1"], r["svtype"], r["info"]) for r in table.collect()] == [("ACH-000001", 9, "DUP", "gene1=G")]
    sinks.bedpe(table, str(tmp_path / "out"))
    assert spark.read.option("sep", "\t").csv(str(tmp_path / "out")).count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "k string, v double")
    sinks.parquet(df, str(tmp_path / "t.parquet"), sidecar=True)
    assert files.load_table(spark, str(tmp_path / "t.parquet")).count() == 2
    assert files.load_table(spark, str(tmp_path / "none" / "x.parquet").replace("none/x", "t")).count() == 2
    assert files.csv(spark, str(tmp_path / "t.csv")).count() == 2
    sinks.by_key(df, str(tmp_path / "p"), "k")
    assert (tmp_path / "p" / "k=a").exists()
    sinks.metrics(df, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).count() == 2
    made = []
    keep = lambda: made.append(1) or df
    assert [sinks.cached(spark, str(tmp_path), {"a": 1}, keep).count() for _ in range(2)] == [2, 2] and made == [1]
    assert sinks.audit({"x": df, "y": df.where("k = 'a'")}, "k").where("side = 'all'").collect()[0]["key"] == "a"
    assert sinks.report(df.agg(F.sum("v").alias("total")), "T") == "T\n=\ntotal: 1.5"


def test_gates(spark):
    from locusmill.operators import clean

    df = spark.createDataFrame([("a", 1), (None, -1)], "k string, v int")
    counts = clean.violations(df, {"no_key": F.col("k").isNull(), "negative": F.col("v") < 0, "large": F.col("v") > 9})
    with pytest.raises(ValueError, match="no_key"):
        clean.require(counts)
    with pytest.warns(UserWarning):
        assert clean.require(counts, strict=False) == {"no_key": 1, "negative": 1}
    assert clean.require(clean.violations(df.where("v > 0"), {"negative": F.col("v") < 0})) == {}
    both = clean.overlap_counts(df.select("k"), df.select("k"), "k", "l", "r")
    assert clean.require_overlap(both) == 1
    with pytest.raises(ValueError):
        clean.require_overlap(both, 2)
    assert [r["c"] for r in clean.of_classes(spark.createDataFrame([("DEL-like",), ("INV",), (None,)], "c string"), "c", ["DEL"]).collect()] == ["DEL"]
