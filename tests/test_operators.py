import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusmill.operators import controls, intervals, pvalues, resample, robust, stats

C = F.col
GENES = [("A", "chr1", 1_000_000, 1_010_000), ("B", "chr1", 5_000_000, 5_000_100), ("Z", "chr9", 1, 2)]


def genes(spark):
    return spark.createDataFrame(GENES, "gene string, chrom string, gs long, ge long")


def test_weighted_copy_number(spark):
    seg = spark.createDataFrame([("c1", "chr1", 0, 1_005_000, 2.0), ("c1", "chr1", 1_005_000, 3_000_000, 4.0), ("c2", "chr1", 1_009_000, 1_020_000, 5.0), ("c1", "chr1", 1_010_000, 9, 5.0)], "cell string, chrom string, s long, e long, cn double")
    got = {(r["gene"], r["cell"]): r["cn"] for r in intervals.weighted_copy_number(seg, genes(spark), 1000).collect()}
    assert got == {("A", "c1"): 3.0, ("A", "c2"): 0.5}


def test_interval_join_against_all_pairs(spark):
    rng = random.Random(1)
    rows = lambda n: [(i, rng.choice("ab"), s := rng.randrange(500), s + rng.randrange(0, 60)) for i in range(n)]
    a, b = rows(120), rows(120)
    left, right = spark.createDataFrame(a, "i long, k string, s long, e long"), spark.createDataFrame(b, "j long, k string, gs long, ge long")
    want = sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3])
    for size in (7, 64, 10_000):
        assert sorted(map(tuple, intervals.interval_join(left, right, ["k"], "s", "e", "gs", "ge", size).select("i", "j").collect())) == want


def test_nearest(spark):
    rng = random.Random(2)
    p = [(i, rng.choice("abc"), rng.randrange(1000)) for i in range(200)]
    t = [(rng.choice("ab"), rng.randrange(1000)) for _ in range(40)]
    want = {i: min(50, min(abs(x - y) for kk, y in t if kk == k)) for i, k, x in p if k != "c"}
    for size in (9, 10_000):
        got = intervals.nearest(spark.createDataFrame(p, "i long, k string, x long"), spark.createDataFrame(t, "k string, at long"), ["k"], "x", "at", 50, size)
        assert {r["i"]: r["dist"] for r in got.collect()} == want


def test_gene_distances(spark):
    b = spark.createDataFrame([("c1", "chr1", 1_100_000), ("c2", "chr1", 900_000_000), ("c1", "chr2", 5)], "cell string, chrom string, pos long")
    got = {(r["gene"], r["cell"]): r["dist"] for r in intervals.gene_distances(genes(spark), b).collect()}
    assert got == {("A", "c1"): 95_000, ("B", "c1"): 3_900_050, ("A", "c2"): 5_000_000, ("B", "c2"): 5_000_000}


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    x1, x2 = rng.normal(size=800), (rng.random(800) < 0.3).astype(float)
    y = 1 + 2 * x1 - 3 * x2 + rng.normal(scale=0.1, size=800)
    y[:40] += 50
    return spark.createDataFrame([("g", i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x1, x2, y))] + [("few", 0, 1.0, 0.0, 1.0)], "gene string, cell long, x1 double, x2 double, y double")


def huber_loss(beta, scale, x, y, epsilon=1.35, alpha=1e-4):
    r = np.abs(y - beta[0] - x @ beta[1:]) / scale
    h = np.where(r <= epsilon, r * r, 2 * epsilon * r - epsilon * epsilon)
    return len(y) * scale + scale * h.sum() + alpha * (beta[1:] ** 2).sum()


def test_huber_is_the_minimum_of_its_loss(planted):
    """No small step in coefficients or scale lowers the loss (computed in numpy); a few groups below the limit have no fit."""
    h = {r["gene"]: r for r in robust.huber(planted, ["gene"], "y", ["x1", "x2"]).collect()}
    assert h["few"]["coef_x1"] is None and h["g"]["converged"]
    d = planted.where("gene = 'g'").toPandas()
    x, y = d[["x1", "x2"]].to_numpy(), d["y"].to_numpy()
    beta, scale = np.array([h["g"]["intercept"], h["g"]["coef_x1"], h["g"]["coef_x2"]]), h["g"]["scale"]
    best = huber_loss(beta, scale, x, y)
    for i in range(3):
        for step in (1e-3, -1e-3):
            moved = beta.copy()
            moved[i] += step
            assert huber_loss(moved, scale, x, y) > best
    assert huber_loss(beta, scale * 1.01, x, y) > best and huber_loss(beta, scale * 0.99, x, y) > best
    assert abs(beta[1] - 2) < 0.05 and abs(beta[2] + 3) < 0.1
    o = stats.ols(planted, ["gene"], "y", ["x1", "x2"]).where("gene = 'g'").first()
    assert abs(o["intercept"] - 1) > 1
    big = robust.huber(planted, ["gene"], "y", ["x1", "x2"], epsilon=1e6, alpha=0.0, rounds=2).where("gene = 'g'").first()
    assert big["coef_x1"] == pytest.approx(o["coef_x1"], abs=1e-9)


def test_quantile_fit_is_the_minimum_of_its_loss(planted):
    d = planted.where("gene = 'g'").toPandas()
    x, y = d[["x1", "x2"]].to_numpy(), d["y"].to_numpy()
    for tau, alpha in ((0.5, 0.0), (0.8, 0.05)):
        m = robust.quantile(planted, ["gene"], "y", ["x1", "x2"], tau, alpha).where("gene = 'g'").first()
        beta = np.array([m["intercept"], m["coef_x1"], m["coef_x2"]])

        def loss(b):
            r = y - b[0] - x @ b[1:]
            return np.where(r >= 0, tau * r, (tau - 1) * r).sum() + alpha * len(y) * np.abs(b[1:]).sum()

        for i in range(3):
            for step in (0.02, -0.02):
                moved = beta.copy()
                moved[i] += step
                assert loss(moved) > loss(beta) - 1e-3
    assert abs(m["coef_x1"]) < 2.01


def test_large_groups_get_the_same_fits_by_passes(planted):
    for fit, names in ((robust.huber, ("intercept", "coef_x1", "coef_x2", "scale")), (robust.quantile, ("intercept", "coef_x1", "coef_x2"))):
        a, b = (fit(planted, ["gene"], "y", ["x1", "x2"], rounds=4, most=m).where("gene = 'g'").first() for m in (10_000, 100))
        assert [a[n] for n in names] == pytest.approx([b[n] for n in names], rel=1e-9) and a["n"] == b["n"] == 800


def test_elastic_net(planted):
    e = {r["gene"]: r for r in robust.elastic_net(planted.where("cell >= 40"), ["gene"], "y", ["x1", "x2"], C("cell")).collect()}
    assert abs(e["g"]["coef_x1"] - 2) < 0.05 and abs(e["g"]["coef_x2"] + 3) < 0.1


def test_ols_equals_numpy(planted):
    d = planted.where("gene = 'g'").toPandas()
    want = np.linalg.lstsq(np.column_stack([np.ones(len(d)), d["x1"], d["x2"]]), d["y"], rcond=None)[0]
    r = stats.ols(planted, ["gene"], "y", ["x1", "x2"]).where("gene = 'g'").first()
    assert np.allclose([r["intercept"], r["coef_x1"], r["coef_x2"]], want)
    assert stats.ols(planted, ["gene"], "y", ["x1", "x2"]).where("gene = 'few'").count() == 0


def test_constant_columns_give_null(spark):
    df = spark.createDataFrame([("g", 1.0, float(i)) for i in range(5)], "g string, a double, b double")
    assert df.groupBy("g").agg(stats.pearson(C("a"), C("b")).alias("r")).first()["r"] is None


def test_ranks_and_tests(spark):
    df = spark.createDataFrame([(1, 0.1), (2, 0.1), (3, 0.4), (4, None), (5, 0.2)], "i long, v double")
    assert {r["i"]: r["r"] for r in stats.average_rank(df, [], "v", "r").collect()} == {1: 1.5, 2: 1.5, 5: 3.0, 3: 4.0}
    q = {r["i"]: r["q"] for r in stats.benjamini_hochberg(df, "v").collect()}
    assert q == pytest.approx({1: 0.2, 2: 0.2, 5: 0.8 / 3, 3: 0.4})
    assert pvalues.correlation(0.5, 20) == pytest.approx(0.02477, abs=2e-4) and pvalues.kolmogorov(0.0, 5, 5) == 1.0
    assert pvalues.wilcoxon(0, 20) < 1e-3 and math.isnan(pvalues.wilcoxon(0, 0))


def test_controls_keep_counts_and_lengths(spark):
    df = spark.createDataFrame([("c", "chr1", i * 1000, i * 1000 + 77) for i in range(50)], "cell string, chrom string, s long, e long")
    for out in (controls.rotate_interval(df, "s", "e", F.lit(60_000), 1, F.length("cell")), controls.scatter(df, "s", "e", F.lit(60_000), 2, C("s"))):
        rows = out.collect()
        assert len(rows) == 50 and all(r["e"] - r["s"] == 77 and 0 <= r["s"] and r["e"] <= 60_000 for r in rows)
    p = controls.permute(df, ["cell"], "s", ["e", "s"], 3).collect()
    assert sorted(r["permuted_e"] for r in p) == sorted(r["e"] for r in p) and [r["permuted_e"] for r in p] != [r["e"] for r in p]
    assert all(r["permuted_e"] - r["permuted_s"] == 77 for r in p)  # values of one row stay together


def test_resampling(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(rng.normal(size=300))], "i long, v double")
    a, b = (resample.bootstrap(df.repartition(n), ["v"], "i", "mean", 300).first() for n in (1, 7))
    # one sample's interval may miss the true mean 0; its centre and width follow from the sample
    assert tuple(a) == pytest.approx(tuple(b)) and a["v_lo"] < a["v"] < a["v_hi"] and a["v_hi"] - a["v_lo"] == pytest.approx(2 * 1.96 / 300**0.5, rel=0.2)
    m = resample.bootstrap(df, ["v"], "i", "median", 100).first()
    assert m["v"] == pytest.approx(np.median([r["v"] for r in df.collect()])) and m["v_lo"] < m["v"] < m["v_hi"]
    up = df.withColumn("v", C("v") + 1)
    assert resample.permutation_medians(up.limit(0), df, "v", "i", 20).first()["p"] is None
    assert resample.permutation_medians(up, df, "v", "i", 100).first()["p"] == 0 and resample.permutation_medians(df, df, "v", "i", 100).first()["p"] > 0.2
    g = spark.createDataFrame([("g", i, float(x), float(2 * x + e), float(2 * x)) for i, (x, e) in enumerate(zip(rng.normal(size=400), rng.normal(size=400)))], "g string, k long, x double, y double, c double")
    whole, parts = (resample.permutation_genes(g, "g", "k", "y", "x", "c", 50, block_rows=n).first() for n in (10_000, 100))
    assert whole["drop"] == pytest.approx(parts["drop"]) and whole["p"] == parts["p"] == pytest.approx(1 / 51)
    draws = spark.range(20_000).select(resample.poisson(controls.drawn(7, C("id"))).alias("w"))
    shares = {r["w"]: r["count"] / 20_000 for r in draws.groupBy("w").count().collect()}
    assert all(shares[k] == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.015) for k in (0, 1, 2, 3))
    e = spark.createDataFrame([("same", 50, 100, 50, 100), ("more", 90, 100, 10, 100)], "k string, a long, b long, c long, d long")
    post = {r["k"]: r["p"] for r in resample.posterior_difference(e, "k", "a", "b", "c", "d").collect()}
    assert abs(post["same"] - 0.5) < 0.05 and post["more"] > 0.999


def test_columns_of_p_values(spark):
    df = spark.createDataFrame([(0.1, 50, 60, 1.96, 0.5, 20), (0.9, 5, 5, 6.0, 1.0, 9), (0.0, 0, 5, 0.0, None, 9)], "d double, a long, b long, z double, r double, n long")
    got = df.select(pvalues.kolmogorov_p(C("d"), C("a"), C("b")).alias("k"), pvalues.normal_two_sided_p(C("z")).alias("z"), pvalues.correlation_p(C("r"), C("n")).alias("r")).collect()
    assert [g["k"] for g in got[:2]] == pytest.approx([pvalues.kolmogorov(0.1, 50, 60), pvalues.kolmogorov(0.9, 5, 5)]) and got[2]["k"] is None
    assert [g["z"] for g in got] == pytest.approx([pvalues.normal_two_sided(z) for z in (1.96, 6.0, 0.0)], rel=1e-6)
    assert [g["r"] for g in got] == [pytest.approx(0.02477, abs=2e-4), 0.0, None]
