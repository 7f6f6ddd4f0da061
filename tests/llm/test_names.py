from locusmill.llm import names

ENTRIES = [("ABC123_LUNG", "ACH-000001"), ("ABC123_SKIN", "ACH-000002"), ("ABC123R_LUNG", "ACH-000003"), (None, "ACH-000004"), ("XYZW77_URINARY_TRACT", "ACH-041848"), ("XYZW77_URINARY_TRACT", "ACH-041848"), ("QRST9_SOFT_TISSUE", "ACH-000006")]


def mapped(spark, values, entries=ENTRIES):
    e = spark.createDataFrame([(*x, "z") for x in entries], "name string, id string, words string")
    rows = spark.createDataFrame([(i, v, "y", "z") for i, v in enumerate(values)], "row long, v string, sim string, word string")
    return {r["row"]: r["id"] for r in names.map_values(rows, "v", e, "name", "id").collect()}


def test_spellings_exact_null_repeated_and_long_values(spark):
    typed = ["abc 123 / pulmonary", "ABC123", "abc123r", "ACH-41848", "[ach_000004]", "ACH-999999", "xyzw7_bladder", "XYZW777 cells", "xzyw77", "хyzw77 p30", "nobody", "", " ", "?!", "ACH-OOOOO4.0", "QRS9;soft tissue", "unknown", "'abc/123' (CUTANEOUS)"]
    want = ["ACH-000001", "NONE", "ACH-000003", "ACH-041848", "ACH-000004", "NONE", "ACH-041848", "ACH-041848", "ACH-041848", "ACH-041848", "NONE", "NONE", "NONE", "NONE", "ACH-000004", "ACH-000006", "NONE", "ACH-000002"]
    typed += ["abc 123 lung"] * 3 + ["x" * 50_000, "word " * 5_000, "ACH-000003 "]
    want += ["ACH-000001"] * 3 + ["NONE", "NONE", "ACH-000003"]
    assert mapped(spark, [*typed, "ABC123_SKIN", None, "ACH-000003"]) == dict(enumerate(want))


def test_empty(spark):
    assert mapped(spark, []) == {}
    assert mapped(spark, ["abc 123 lung"], []) == {0: "NONE"}


def test_unmatched_report(spark):
    e = spark.createDataFrame(ENTRIES, "name string, id string")
    rows = spark.createDataFrame([("nobody",), ("nobody",), ("abc123r",)], "v string")
    assert [tuple(r) for r in names.unmatched(names.map_values(rows, "v", e, "name", "id"), "v", "id").collect()] == [("nobody", 2)]


def test_agrees_with_the_plain_resolver(spark, data):
    from pyspark.sql import functions as F

    from locusmill.operators.spelling import resolve
    from locusmill.sources.tables import table

    models, dep = table(spark, data, "depmap_model_map"), table(spark, data, "dependency")
    a = dict(map(tuple, names.rank_entries(dep, "cell_line", models, "CCLE_name", "DepMap_ID").drop("score").collect()))
    b = dict(map(tuple, resolve(dep.select(F.col("cell_line")), "cell_line", models, "CCLE_name", "DepMap_ID").collect()))
    assert a == b and len(a) > 100
