import pytest

from locusmill.operators import units

COLUMNS = "id long, v double, said string, note string, source string, unit string, copies string"
SOURCES = "source string, readme string, v double"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, a, b, s, "old", "old") for i, (v, a, b, s) in enumerate(rows)], COLUMNS)


def sources(spark):
    return spark.createDataFrame(
        [("a", "Segment means are log2(tumour/normal); zero means two copies.", 1.0), ("b", "Absolute copies multiplied by 100.", 1.0),
         ("c", "nothing of use", None), (None, "percent", None), ("d", None, None), ("a", "Segment means are log2(tumour/normal); zero means two copies.", 1.0)], SOURCES
    )


def run(spark, rows):
    df = units.to_copies(units.with_units(frame(spark, rows), ["said", "note"], sources(spark)), "v")
    return {r["id"]: (r["unit"], None if r["copies"] is None else round(r["copies"], 9)) for r in df.collect()}


@pytest.mark.parametrize("text,unit", [
    ("log2(r + 1), where r is the ratio to diploid; normal tissue gives 1.", "log2_ratio_plus_1"), ("log2p1", "log2_ratio_plus_1"),
    ("binary log of one plus the relative copy number", "log2_ratio_plus_1"), ("Log R ratio (log2), not centred", "log2_ratio"), ("L2R", "log2_ratio"),
    ("ratio to diploid, not copies", "ratio"), ("T/N", "ratio"), ("rel.", "ratio"), ("times 100, integer copies", "hundredths"), ("1/100 copies", "hundredths"),
    ("Dosage in per cent of the diploid state (100 = two copies).", "percent"), ("%", "percent"), ("already converted to absolute copies", "absolute"),
    ("Integer-like copy calls after purity correction; 2 is normal.", "absolute"), ("hg38 lifted", None), ("", None), ("   ", None), (None, None), ("absent", None),
    ("x" * 200_000 + " unit is 0.01 copies", "hundredths"),
])
def test_unit_of_text(text, unit):
    assert units.unit_of_text(text, units._automaton()) == unit


def test_rows_outrank_sources_and_all_values_convert(spark):
    got = run(spark, [
        (1.0, None, None, "a"), (3.0, "copies", None, "a"), (150.0, None, "in % of diploid", "a"), (250.0, None, None, "b"), (1.0, None, None, "c"), (1.0, None, None, None),
        (None, "log2", None, "a"), (float("nan"), "log2", None, "a"), (1.0, "log2p1", "ok", "d"), (0.5, "ratio", None, "zzz"), (3.0, "copies", None, "a"),
    ])
    assert got == {
        0: ("log2_ratio", 4.0), 1: ("absolute", 3.0), 2: ("percent", 3.0), 3: ("hundredths", 2.5), 4: ("unknown", None), 5: ("unknown", None), 6: ("log2_ratio", None),
        7: ("log2_ratio", None), 8: ("log2_ratio_plus_1", 2.0), 9: ("ratio", 1.0), 10: ("absolute", 3.0),
    }


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert units.with_units(empty, ["said"], sources(spark)).count() == 0
    rows = units.with_units(frame(spark, [(1.0, None, None, "a")]), ["said"], sources(spark).limit(0)).collect()
    assert [r["unit"] for r in rows] == ["unknown"]
    assert units.foreign_units(units.with_units(frame(spark, [(None, "log2", None, "a")]), ["said"], sources(spark)), "v").count() == 0


@pytest.mark.parametrize("text,value,unit", [
    ("purity 80 %, absolute copies", 2.0, "absolute"), ("80 % purity", 2.0, "percent"), ("80 %", 80.0, "percent"), ("2.31 ratio, 40 % tumour, called in copies", 2.31, "ratio"),
    ("coverage ratio: 0.8; log2 scale", 1.0, "log2_ratio"), ("log2p1", 1.0, "log2_ratio_plus_1"), ("x100", 100.0, "hundredths"), ("-1.25 log2", -1.25, "log2_ratio"), ("12.5x diploid and 3 copies", 3.0, "absolute"),
])
def test_numbers_beside_aliases(text, value, unit):
    assert units.unit_of_text(text, units._automaton(), value) == unit


def test_the_value_settles_a_text_that_several_rows_share(spark):
    rows = frame(spark, [(40.0, "40 % of reads; 3 copies", None, "c"), (3.0, "40 % of reads; 3 copies", None, "c")])
    got = {r["id"]: r["unit"] for r in units.with_units(rows, ["said", "note"], sources(spark), value="v").collect()}
    assert got == {0: "percent", 1: "absolute"}
