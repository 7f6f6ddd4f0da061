import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from locusmill.operators import clean, intervals
from locusmill.operators import ranges as R

C = F.col


@pytest.fixture(scope="module")
def rows(spark):
    """One group holds nine tenths of the rows; ties, nulls, NaN, a null key and a group without values."""
    rng = random.Random(1)
    made = [
        (None if i % 50 == 0 else rng.choice(["hot"] * 18 + ["a", "b"]), None if rng.random() < 0.1 else float("nan") if rng.random() < 0.05 else round(rng.gauss(0, 1), 2), i)
        for i in range(4000)
    ] + [("none", None, 1)]
    return spark.createDataFrame(made, "g string, v double, k long")


def test_percentiles_equal_the_built_in(rows):
    clean_ = rows.withColumn("v", F.when(~F.isnan("v"), C("v")))
    got = {r["g"]: tuple(r) for r in R.summarised(rows, ["g"], {"m": (C("v"), 0.5), "q": (F.abs("v"), [0.1, 0.9, 1.0])}, n=F.count("*")).select("g", "n", "m", "q").collect()}
    want = {r["g"]: tuple(r) for r in clean_.groupBy("g").agg(F.count("*").alias("n"), F.median("v").alias("m"), F.percentile(F.abs("v"), F.array(F.lit(0.1), F.lit(0.9), F.lit(1.0))).alias("q")).collect()}
    assert got == want and got["none"][2:] == (None, None)
    assert R.summarised(rows, [], {"m": (C("v"), 0.5)}).first()["m"] == clean_.agg(F.median("v")).first()[0]


def test_weights_stand_for_rows(rows):
    w = rows.withColumn("w", F.pmod(C("k"), F.lit(4)))
    repeated = w.where("w > 0 and not isnan(v)").withColumn("i", F.explode(F.sequence(F.lit(1), C("w"))))
    got = {r["g"]: r["m"] for r in R.summarised(w, ["g"], {"m": (C("v"), 0.5)}, weight=C("w")).collect()}
    want = {r["g"]: r["m"] for r in repeated.groupBy("g").agg(F.median("v").alias("m")).collect()}
    assert got == want


def test_ranks_and_numbers(rows):
    w = Window.partitionBy("g").orderBy("v")
    kept = rows.where("v is not null and not isnan(v)")
    want = {(r["g"], r["k"]): r["r"] for r in kept.withColumn("r", F.rank().over(w) + (F.count("*").over(Window.partitionBy("g", "v")) - 1) / 2).collect()}
    assert {(r["g"], r["k"]): r["r"] for r in R.average_rank(rows, ["g"], "v", "r").collect()} == want
    numbers = {(r["g"], r["k"]): r["i"] for r in R.numbered(rows, ["g"], "k", "i").collect()}
    assert numbers == {(r["g"], r["k"]): r["i"] for r in rows.withColumn("i", F.row_number().over(Window.partitionBy("g").orderBy("k")) - 1).collect()}


def test_empty(rows):
    none = rows.limit(0)
    assert R.summarised(none, ["g"], {"m": (C("v"), 0.5)}).collect() == [] and R.summarised(none, [], {"m": (C("v"), 0.5)}).collect()[0]["m"] is None
    assert R.average_rank(none, ["g"], "v", "r").count() == 0


def test_a_hot_group_is_spread(spark):
    """One gene holds nine tenths of the rows; no task of the last step holds more than its share of them."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        df = spark.range(20_000).select(F.when(C("id") % 10 > 0, "hot").otherwise("cold").alias("g"), F.pmod(C("id") * 7919, F.lit(20_011)).alias("v"))
        per = R.numbered(df, ["g"], "v", "i").groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in per) == 20_000 and max(r["count"] for r in per) < 2.2 * 20_000 / 8
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_range_number(spark):
    edges = [1.0, 2.0, 2.5, 7.0, 9.0]
    df = spark.createDataFrame([(float(x),) for x in (-5, 1, 1.5, 2, 2.4, 7, 8, 9, 100)], "v double")
    assert [r[0] for r in df.select(R.range_number(C("v"), edges)).collect()] == [sum(e < x for e in edges) for x in (-5, 1, 1.5, 2, 2.4, 7, 8, 9, 100)]
    assert df.select(R.range_number(C("v"), [])).distinct().count() == 1


def test_neighbours_over_bins(spark):
    rng = random.Random(3)
    places = sorted({(rng.choice("ab"), rng.choice(["c1", "c2"]), rng.randrange(1000)) for _ in range(150)})
    df = spark.createDataFrame(places, "cell string, chrom string, pos long")
    nxt = {p: q for p, q in zip(places, places[1:]) if p[0] == q[0]}
    for size in (7, 100, 10_000):
        got = {(r["cell"], r["chrom"], r["pos"]): (r["chrom2"], r["pos2"]) for r in intervals.neighbours(df, size).collect()}
        assert got == {p: (nxt[p][1:] if p in nxt else (None, None)) for p in places}
        kept = {tuple(r) for r in clean.thin(df, ["cell", "chrom"], "pos", 5, size).select("cell", "chrom", "pos").collect()}
        last = {}
        want = set()
        for c, h, p in places:
            if p - last.get((c, h), -10**9) > 5:
                want.add((c, h, p))
            last[c, h] = p
        assert kept == want
