import pytest
from pyspark.sql import functions as F

from locusmill.functions import scalars as S


def one(spark, column, *values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(column(F.col("x"))).collect()]


@pytest.mark.parametrize("text,want", [
    ("13:33777850-33777850+", ("chr13", 33777849, 33777850, "+")), ("MT:2000-2000-", ("chrMT", 1999, 2000, "-")), ("1:1-1+", ("chr1", 0, 1, "+")), ("chrX:5+", ("chrX", 4, 5, "+")),
    ("13:33777850", None), ("", None), (None, None), ("nonsense", None),
])
def test_breakpoint(spark, text, want):
    got = one(spark, S.breakpoint_parts, text)[0]
    assert (tuple(got) if got else None) == want


def test_names(spark):
    assert one(spark, S.chrom_mito, "MT", "chrMT", " 7", "Chr7", "chr7", None) == ["chrM", "chrM", "chr7", "chr7", "chr7", None]
    assert one(spark, S.chrom_scaffold, "chr1_random", "x", "MT", "07", None, "ALT1") == ["", "chrX", "chrM", "chr07", "", ""]
    assert one(spark, S.ccle_name, "ach 000123", "Abc-12 lung.x", " q ") == ["ACH-000123", "ABC_12_LUNG_X", "Q"]
    assert one(spark, S.gene_symbol, "TP53 (7157)", "TP53", "A (x)") == ["TP53", "TP53", "A (x)"]
    assert one(spark, S.sample_of_path, "a/b/ACH-1.sv.bedpe", "x", "q/ach 000001.v2.bedpe") == ["ACH_1", "X", "ACH-000001"]
    assert one(spark, S.sample_of_bedpe, "a/b/A549.lung.BEDPE", "ach_000001.bedpe") == ["A549_LUNG", "ACH-000001"]
    assert one(spark, S.chrom_scaffold, "GL000220", "chrM", "CHR3", " 11 ", "Un_x") == ["chrGL000220", "chrM", "chr3", "chr11", ""]
    assert one(spark, S.valid_sample, "ach 000123", "ACH-000123", "A549_LUNG", "A549", "a549_lung", "X=Y_Z", None) == [True, True, True, False, False, False, False]
    assert one(spark, lambda c: S.info_value(c, "svclass"), "a=1;svclass=DEL;b=2", "a=1", None) == ["DEL", None, None]


def test_kernels(spark):
    df = spark.createDataFrame([(95_000,)], "d long")
    r = df.select(*[c.alias(k) for k, c in S.kernels(F.col("d")).items()]).first()
    assert r["prox_exp_50k"] == pytest.approx(0.14956861922263506, abs=1e-15)
    assert r["prox_exp_100k"] == pytest.approx(0.38674102345450123, abs=1e-15)
    assert r["prox_inv"] == pytest.approx(1.0526204987315923e-05, abs=1e-18)


def test_windows_and_flags(spark):
    df = spark.createDataFrame([(1, 2.0), (250_000, 3.5), (250_001, 2.0), (None, None)], "d long, cn double")
    near, far = S.near_far(F.col("d"), 250_000, 2_000_000)
    assert [tuple(r) for r in df.select(near, far).collect()] == [(1, 0), (1, 0), (0, 1), (0, 0)]
    assert [r[0] for r in df.select(S.qc_flags(F.col("cn"), F.col("d"))["confounded"]).collect()] == [1, 1, 0, 0]


def test_log2_conversion_keeps_every_row(spark, data, tmp_path):
    from locusmill.plans.scalar_queries import log2_to_cn_all

    values = [None, -50.0, 0.0, 1.0, 29.5, 30.0, 35.25, 200.0, 3269.8202]
    spark.createDataFrame(list(enumerate(values)), "seg_id long, CopyNumber double").write.parquet(str(tmp_path / "cnv.parquet"))
    got = {r["seg_id"]: r for r in log2_to_cn_all(spark, str(tmp_path)).collect()}
    assert len(got) == len(values) and got[0]["cn"] is None and got[0]["log2_cn"] is None
    for i, x in enumerate(values[1:-1], 1):
        assert abs(got[i]["cn"] / 2 ** (x + 1) - 1) < 1e-6 and got[i]["log2_cn"] == x + 1
    assert got[8]["cn"] == float("inf") and abs(got[8]["log2_cn"] - 3270.8202) < 1e-6
    assert log2_to_cn_all(spark, data).count() == spark.read.parquet(f"{data}/cnv.parquet").count()


def test_breakpoints_of_the_field(spark):
    """Spellings that breakend sheets hold, with what each must become."""
    good = {
        "13:33777850-33777850+": ("chr13", 33777849, 33777850, "+"), "1:1000000-1000000-": ("chr1", 999999, 1000000, "-"), "chrX:123456-123456-": ("chrX", 123455, 123456, "-"),
        "Y:10000000-10000000-": ("chrY", 9999999, 10000000, "-"), "M:1000-1000+": ("chrM", 999, 1000, "+"), "MT:2000-2000-": ("chrMT", 1999, 2000, "-"), "  13:33777850-33777850+  ": ("chr13", 33777849, 33777850, "+"),
        "x:50000000-50000000+": ("chrX", 49999999, 50000000, "+"), "CHR13:33777850-33777850+": ("chr13", 33777849, 33777850, "+"), "1:1-1+": ("chr1", 0, 1, "+"),
    }
    assert [tuple(x) for x in one(spark, S.breakpoint_parts, *good)] == list(good.values())
    assert one(spark, S.breakpoint_parts, "", "invalid", "13:33777850", "13:33777850-33777850", None) == [None] * 5
