from datetime import datetime

from pyspark.sql import functions as F

from locusmill.operators import orphans, spelling

REFS = "table_name string, row_id long, field string, space string, key string, loaded_at timestamp, slot string"
PARENTS = "space string, key string, added_on timestamp, removed_on timestamp, slot string"


def t(day):
    return datetime(2024, 3, day)


def run(spark, refs, parents, **k):
    r = spark.createDataFrame([(*x, "s") for x in refs], REFS)
    p = spark.createDataFrame([(*x, "s") for x in parents], PARENTS)
    return sorted(tuple(x) for x in orphans.orphans(r, p, **k).collect())


def test_reasons(spark):
    parents = [("g", "A", t(5), None), ("g", "B", t(1), t(10)), ("g", "B", t(1), t(10)), ("g", "C", None, t(3)), ("m", "A", None, None), ("g", "D", t(1), t(2)), ("g", "D", t(6), t(8)), ("g", None, t(1), None)]
    refs = [("t", i, "gene", sp, k, d) for i, (sp, k, d) in enumerate([
        ("g", "A", t(4)), ("g", "A", t(5)), ("g", "B", t(10)), ("g", "B", t(9)), ("g", "C", t(3)), ("g", "Z", t(1)), ("m", "A", t(1)), ("m", "B", t(1)), ("g", None, t(1)),
        ("g", "D", t(4)), ("g", "D", t(7)), ("g", "D", None), ("g", "Z", None), ("g", "Z", t(1)),
    ])]
    want = [("t", 0, "gene", "2024-03", "late"), ("t", 2, "gene", "2024-03", "deleted"), ("t", 4, "gene", "2024-03", "deleted"), ("t", 5, "gene", "2024-03", "missing"), ("t", 7, "gene", "2024-03", "missing"), ("t", 9, "gene", "2024-03", "deleted"), ("t", 12, "gene", None, "missing"), ("t", 13, "gene", "2024-03", "missing")]
    assert run(spark, refs, parents) == want
    assert run(spark, refs, parents, range_rows=1, tasks=3) == want


def test_empty(spark):
    assert run(spark, [], [("g", "A", None, None)]) == []
    assert run(spark, [("t", 1, "gene", "g", "A", t(1))], []) == [("t", 1, "gene", "2024-03", "missing")]


def test_hot_key_is_spread(spark):
    refs = spark.range(20_000).select(F.lit("t").alias("table_name"), F.col("id").alias("row_id"), F.lit("gene").alias("field"), F.lit("g").alias("space"), F.lit("HOT").alias("key"), F.lit(t(1)).alias("loaded_at"))
    parents = spark.createDataFrame([("g", "HOT", t(2), None, "s")], PARENTS)
    out = orphans.orphans(refs, parents)
    assert out.count() == 20_000
    tasks = out.groupBy(F.spark_partition_id()).count().collect()
    assert len(tasks) == 4 and max(r["count"] for r in tasks) < 8_000
    assert orphans.report(out).collect()[0]["n"] == 20_000


def test_resolve(spark):
    entries = spark.createDataFrame([("ABC123_LUNG", "ACH-000001"), ("ABC123_SKIN", "ACH-000002"), ("ABC123R_LUNG", "ACH-000003"), (None, "ACH-000004"), ("XYZW77_BONE", "ACH-041848"), ("XYZW77_BONE", "ACH-041848")], "n string, i string")
    typed = ["abc 123 / pulmonary", "ABC123", "abc123r", "ACH-41848", "[ach_000004]", "ACH-999999", "xyzw7_bone", "XYZW777", "xzyw77", "хyzw77", "nobody", "", None, " ", "ABC123_SKIN", "ACH-OOOOO4.0"]
    got = spelling.resolve(spark.createDataFrame([(x,) for x in typed], "v string"), "v", entries, "n", "i").collect()
    assert dict(map(tuple, got)) == {
        "abc 123 / pulmonary": "ACH-000001", "abc123r": "ACH-000003", "ACH-41848": "ACH-041848", "[ach_000004]": "ACH-000004", "xyzw7_bone": "ACH-041848", "XYZW777": "ACH-041848",
        "xzyw77": "ACH-041848", "хyzw77": "ACH-041848", "ABC123_SKIN": "ACH-000002", "ACH-OOOOO4.0": "ACH-000004",
    }
    assert spelling.resolve(spark.createDataFrame([("a",)], "v string"), "v", entries.limit(0), "n", "i").count() == 0


def test_only_hot_keys_are_salted_and_no_task_gets_more_than_its_share(spark):
    """One key holds a tenth of the references, 200 ranges of parents hold the rest."""
    n = 40_000
    key = F.when(F.col("id") % 10 == 0, "HOT").otherwise(F.concat(F.lit("k"), F.pmod(F.col("id") * 7919, F.lit(5_000)).cast("string")))
    refs = spark.range(n).select(F.lit("t").alias("table_name"), F.col("id").alias("row_id"), F.lit("f").alias("field"), F.lit("g").alias("space"), key.alias("key"), F.lit(t(1)).alias("loaded_at"))
    parents = spark.range(5_000).select(F.lit("g").alias("space"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.lit(t(2)).alias("added_on"), F.lit(None).cast("timestamp").alias("removed_on"))
    assert [k for k, _ in orphans.hot_keys(refs.select("key"), 200)] == ["HOT"]
    out = orphans.orphans(refs, parents, range_rows=25)
    assert {(r["reason"], r["count"]) for r in out.groupBy("reason").count().collect()} == {("missing", n // 10), ("late", n - n // 10)}
    assert max(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()) < 4 * n / 200


def test_a_very_long_key_among_short_ones(spark):
    refs = [("t", i, "f", "g", k, t(3)) for i, k in enumerate(["x" * 50_000, *["a", "b"] * 3_000])]
    assert run(spark, refs, [("g", "x" * 50_000, t(1), None), ("g", "a", t(1), None)]) == sorted(("t", i, "f", "2024-03", "missing") for i in range(2, 6_001, 2))
