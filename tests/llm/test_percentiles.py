import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from locusmill.llm import percentiles as P

SCHEMA = "day int, gene string, a double, b double, grp string, v string, lo string"


def brute(rows, k):
    by = {}
    for r in rows:
        x = r[k]
        if x is not None and not math.isnan(x):
            by.setdefault(r[1], []).append(x)
    return {(g, p): sorted(x)[max(1, math.ceil(round(p * len(x), 6))) - 1] for g, x in by.items() for p in (0.5, 0.9, 0.99)}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = []
    for i in range(4000):
        g = rng.choice(["hot"] * 6 + ["x", "y", None, f"g{i % 40}"])
        a = rng.choice([None, float("nan"), rng.gauss(0, 1), round(rng.gauss(0, 1), 1), math.exp(rng.gauss(0, 2)), -math.exp(rng.gauss(0, 2))])
        out.append((i % 7, g, a, 1.5))
    out += out[:300]
    return out + [(0, "alone", 3.0, None), (0, "nothing", None, None), (1, "inf", math.inf, 1.0), (1, "inf", -math.inf, 1.0), (1, "wide", 1.7e308, 1.0), (1, "wide", -1.7e308, 1.0), (1, "tiny", 5e-324, 0.0), (1, "tiny", 0.0, 0.0)]


def values(spark, rows, *keep):
    return P.long_values(spark.createDataFrame([(*r, "q", "r", "s") for r in rows], SCHEMA), "gene", ["a", "b"], *keep)


def test_exact(spark, rows):
    got = P.percentiles(values(spark, rows), [0.5, 0.9, 0.99]).collect()
    seen = {(r["grp"], r["p"]): r["v"] for r in got if r["col"] == "a"}
    assert seen == brute(rows, 2)
    assert ("nothing", 0.5) not in seen


def test_small_fanout(spark, rows):
    some = [(r[0], r[1], None if r[2] is None else round(r[2], 1), None) for r in rows if r[1] in ("x", "alone")]
    assert {(r["grp"], r["p"]): r["v"] for r in P.percentiles(values(spark, some), [0.5], fanout=4).collect() if r["col"] == "a"} == {k: v for k, v in brute(some, 2).items() if k[1] == 0.5}


def test_days_combine(spark, rows):
    v = values(spark, rows, "day").where("grp = 'hot'")
    i = P.start(v, [0.5, 0.9])
    daily = P.stretch_counts(v, i, "day")
    assert daily.select("day").distinct().count() == 7
    whole, summed = (sorted(map(tuple, P.combine(c).collect())) for c in (P.stretch_counts(v, i), daily.drop("day")))
    assert whole == summed
    answers = P.percentiles(v, [0.5, 0.9])
    per = P.day_ranks(v, answers, "day").groupBy("grp", "col", "p").agg(F.sum("below").alias("below"), F.sum("at").alias("at"))
    for r in answers.join(per, ["grp", "col", "p"]).collect():
        assert r["below"] < r["rank"] <= r["below"] + r["at"]


def test_empty(spark):
    assert P.percentiles(values(spark, []), [0.5]).count() == 0


def test_midpoints_keep_the_order():
    x = np.array([-math.inf, -1.7e308, -1.0, -5e-324, 0.0, 5e-324, 0.1, 1.0, 1.7e308, math.inf])
    assert (np.diff(P.image(x).astype(object)) > 0).all() and (P.unimage(P.image(x)) == x).all()
    lo, hi = np.repeat(x, len(x)), np.tile(x, len(x))
    lo, hi = lo[lo < hi], hi[lo < hi]
    m = P.midpoints(lo, hi)
    assert (np.diff(m.astype(object), axis=1) >= 0).all() and (m.max(axis=1) > lo).all() and (m[:, -1] <= hi).all() and (m[:, 0] >= lo).all()


def test_values_of_any_magnitude_take_few_passes(spark, monkeypatch):
    """150 values, each a hundred times the one before."""
    passes = []
    monkeypatch.setattr(P, "narrow", lambda i, c, real=P.narrow: passes.append(1) or real(i, c))
    x = [10.0 ** (2 * i - 150) for i in range(150)] + [-(10.0**i) for i in range(20)]
    v = P.long_values(spark.createDataFrame([("g", a) for a in x], "g string, a double"), "g", ["a"])
    assert {r["p"]: r["v"] for r in P.percentiles(v, [0.5, 0.99]).collect()} == {p: sorted(x)[math.ceil(round(p * 170, 6)) - 1] for p in (0.5, 0.99)}
    assert len(passes) <= 13
