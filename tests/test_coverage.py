import random

from pyspark.sql import functions as F

from locusmill.operators import coverage

SCHEMA = "run long, model string, chrom string, s long, e long, starts string, shard string"


def gaps_and_runs(spark, rows, bits):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    keys = {"run": F.col("run"), "model": F.col("model"), "chrom": F.col("chrom")}
    b = coverage.run_bitmaps(df, keys, F.col("s"), F.col("e"), bits)
    gaps = sorted(tuple(r) for r in coverage.clear_runs(b, list(keys), bits).collect())
    runs = sorted(tuple(r) for r in coverage.set_runs(b, list(keys), bits).collect())
    return gaps, runs


def brute(rows):
    covered = {}
    for run, model, chrom, s, e in rows:
        if None not in (run, model, chrom, s, e) and e > s:
            covered.setdefault((run, model, chrom), set()).update(range(s, e))
    gaps, runs = [], []
    for k, bases in covered.items():
        x = sorted(bases)
        start = x[0]
        for a, b in zip(x, x[1:] + [None]):
            if b != a + 1:
                runs.append((*k, start, a + 1))
                if b is not None:
                    gaps.append((*k, a + 1, b))
                    start = b
    return sorted(gaps), sorted(runs)


def test_against_single_bases(spark):
    rng = random.Random(3)
    for bits in (3, 5, 24):
        rows = []
        for _ in range(400):
            s = rng.randrange(0, 300)
            rows.append((rng.randrange(3), rng.choice(["a", "A", " a"]), "chr1", s, s + rng.randrange(-2, 25)))
        rows += rows[:50]
        assert gaps_and_runs(spark, rows, bits) == brute(rows)


def test_nulls_touching_and_empty(spark):
    rows = [(1, "m", "chr1", 0, 5), (1, "m", "chr1", 5, 8), (1, "m", "chr1", 20, 21), (None, "m", "chr1", 0, 5), (1, None, "chr1", 9, 10), (1, "m", None, 9, 10), (1, "m", "chr1", None, 10), (1, "m", "chr1", 9, None), (1, "m", "chr1", 12, 12), (1, "m", "chr1", 15, 11)]
    assert gaps_and_runs(spark, rows, 4) == ([(1, "m", "chr1", 8, 20)], [(1, "m", "chr1", 0, 8), (1, "m", "chr1", 20, 21)])
    assert gaps_and_runs(spark, [], 4) == ([], [])


def test_hot_shard_over_many_batches(spark):
    rows = spark.range(30_000).select(F.lit(1).alias("k"), (F.col("id") * 3).alias("s"), (F.col("id") * 3 + 2).alias("e"))
    b = coverage.run_bitmaps(rows.repartition(6), {"k": F.col("k")}, F.col("s"), F.col("e"), 24)
    assert b.count() == 1
    assert coverage.clear_runs(b, ["k"], 24).count() == 29_999


def test_chromosome(spark):
    names = ["chr7 ", "CHR_X", "07", "x", "Chromosome 22", "chr23", "", None, "chrUn", "chr01"]
    df = spark.createDataFrame([(n,) for n in names], "c string")
    assert [r[0] for r in df.select(coverage.chromosome(F.col("c"))).collect()] == ["chr7", "chrX", "chr7", "chrX", "chr22", None, None, None, None, "chr1"]


def test_huge_segments_make_few_pieces(spark):
    """Beyond a few shards a segment's whole shards are one piece, and still hide and join what they should."""
    rows = [(1, "m", "chr1", 5, 1 << 60), (1, "m", "chr1", 3, 4), (1, "m", "chr1", (1 << 60) + 2, (1 << 60) + 5), (2, "m", "chr1", 0, 900), (2, "m", "chr1", 300, 310), (2, "m", "chr1", 950, 960), (2, "m", "chr1", 1000, 3000)]
    b = 1 << 60
    assert gaps_and_runs(spark, rows, 24) == ([(1, "m", "chr1", 4, 5), (1, "m", "chr1", b, b + 2), (2, "m", "chr1", 900, 950), (2, "m", "chr1", 960, 1000)], [(1, "m", "chr1", 3, 4), (1, "m", "chr1", 5, b), (1, "m", "chr1", b + 2, b + 5), (2, "m", "chr1", 0, 900), (2, "m", "chr1", 950, 960), (2, "m", "chr1", 1000, 3000)])
    rng = random.Random(9)
    many = [(rng.randrange(2), "m", "chr1", s := rng.randrange(0, 3000), s + rng.choice([3, 9, 40, 400])) for _ in range(60)]
    for bits in (3, 4):
        assert gaps_and_runs(spark, many, bits) == brute(many)
