from datetime import datetime

from locusmill.operators.drift import Drift
from locusmill.session import cut

SCHEMA = "feed string, file_name string, target string, delivered_at timestamp, line_no int, line string, cells string, k int"


def rows(feed, name, day, lines, target="cnv"):
    return [(feed, name, target, datetime(2024, 1, day), i + 1, x, "x", 9) for i, x in enumerate(lines)]


A = [f"ACH-0000{i:02d},chr{i % 5 + 1},{i * 1000},{i * 1000 + 77},{i % 4}.{i:02d}17,B{i % 2}" for i in range(12)]
HEAD = "ModelID,Chromosome,Start,End,CopyNumber,batch"


def changes(spark, lines):
    run = Drift(spark.createDataFrame(lines, SCHEMA))
    steps = cut(run.steps())
    return run, steps, sorted((r["feed"], r["file_name"], r["change_kind"], r["field"], r["old_field"]) for r in steps.collect())


def test_renames_retypes_additions_and_removals(spark):
    second = ["﻿# note", "", "﻿\"Sample\";\"copyno\";\"Start\";\"End\";\"extra\"", *[
        f"\"{a[0]}\";{float(a[4]) * 100:.0f}%;{a[2]}.0;{a[3]};{i}" for i, a in enumerate(x.split(",") for x in A[3:])
    ], "", "ACH-1;NA;;;"]
    third = ["weird_name|copyno|Start|End|extra", *[
        f"{a[0]}|{float(a[4]) * 100:.0f}%|{a[2]}.0|{a[3]}|{i}" for i, a in enumerate(x.split(",") for x in A[3:])
    ]]
    lines = rows("f", "1.csv", 1, [HEAD, *A, A[0], HEAD]) + rows("f", "2.csv", 2, second) + rows("f", "3.csv", 3, third)
    run, steps, got = changes(spark, lines)
    assert got == [
        ("f", "2.csv", "added", "extra", ""), ("f", "2.csv", "removed", "Chromosome", ""), ("f", "2.csv", "removed", "batch", ""), ("f", "2.csv", "renamed", "Sample", "ModelID"),
        ("f", "2.csv", "renamed", "copyno", "CopyNumber"), ("f", "2.csv", "retyped", "Start", ""), ("f", "2.csv", "retyped", "copyno", ""), ("f", "3.csv", "renamed", "weird_name", "Sample"),
    ]
    table = run.table(run.routes(steps)).collect()
    assert len(table) == 12 + 10 + 9
    cell = {(r["file_name"], r["ModelID"]): r for r in table}
    assert abs(cell["2.csv", "ACH-000005"]["CopyNumber"] - 1.0517) < 0.006 and cell["3.csv", "ACH-000005"]["Start"] == 5000
    assert cell["2.csv", "ACH-1"]["CopyNumber"] is None and cell["1.csv", "ACH-000001"]["Chromosome"] == "chr2"


def test_a_look_alike_name_with_other_values_is_no_rename(spark):
    second = ["ModelID,Chromosome,Start,End,CN,batch", *[",".join([*a[:4], f"{90 - i}.5", a[5]]) for i, a in enumerate(x.split(",") for x in A)]]
    got = changes(spark, rows("f", "1", 1, [HEAD, *A]) + rows("f", "2", 2, second))[2]
    assert got == [("f", "2", "added", "CN", ""), ("f", "2", "removed", "CopyNumber", "")]


def test_odd_input(spark):
    lines = rows("g", "1", 1, [None, "", "# only a comment"]) + rows("g", "2", 2, ["a"]) + rows("g", "3", 3, ["a", "1", "2,3"]) + rows("h", "1", 1, ["x\ty", "1"]) + rows("h", "2", 2, ["x\ty", "1\t2\t3", "\"a\tb\"\t2"])
    run, steps, got = changes(spark, lines)
    assert got == [("h", "2", "retyped", "x", "")]
    assert run.table(run.routes(steps)).count() == 5
    assert changes(spark, [])[2] == []


def test_order_and_case(spark):
    first, second = ["a,b,c", "1,2,x"], ["c,b,A", "x,2,1"]
    assert changes(spark, rows("f", "1", 1, first) + rows("f", "2", 1, second))[2] == [("f", "2", "renamed", "A", "a")]


def test_fingerprints_depend_on_names_and_types_alone(spark):
    """Neither an untyped column elsewhere in the feed nor the order of the fields makes another version."""
    one = rows("f", "1", 1, ["a,b", "1,x"]) + rows("f", "2", 2, ["b,a", "y,2"]) + rows("f", "3", 3, ["a,b", "1.5,x"])
    two = rows("g", "1", 1, ["a,b", "1,x"]) + rows("g", "2", 2, ["a,b,c", "1,x,NA"])
    run, steps, got = changes(spark, one + two)
    v = {(r["feed"], r["file_name"]): (r["fingerprint"], r["version"]) for r in run.schemas.collect()}
    assert v["f", "1"] == v["f", "2"] and v["f", "1"][0] == v["g", "1"][0] != v["f", "3"][0] and v["f", "3"][1] == 2 and v["g", "2"][1] == 2
    assert got == [("f", "3", "retyped", "a", ""), ("g", "2", "added", "c", "")]


def test_nothing_is_lost_silently(spark):
    """Two fields of one canonical field, a name that stands twice, and cells that can't be cast."""
    run, steps, _ = changes(spark, rows("f", "1", 1, ["Sample,ModelID,Start,CopyNumber,note,note", "ZZTOP,ACH-1,12x,none,p,q"]))
    r = run.table(run.routes(steps)).first()
    assert r["ModelID"] == "ACH-1" and r["Start"] is None and r["CopyNumber"] is None
    assert r["extra"] == "CopyNumber=none;Sample=ZZTOP;Start=12x;note=p;note=q"
    placed = {(x["field"], x["pos"]): (x["canonical"], x["placed"]) for x in run.routes(steps).collect()}
    assert placed["Sample", 0] == ("ModelID", "extra") and placed["ModelID", 1] == ("ModelID", "ModelID")


def test_long_chain_of_renames(spark):
    names = ["CN", "q1", "q2", "q3", "q4", "q5", "q6"]
    lines = [x for i, n in enumerate(names) for x in rows("f", f"{i}", i + 1, [f"ModelID,Start,{n}", *[f"M{j},{j * 7},{j}.{j}5" for j in range(9)]])]
    run, steps, got = changes(spark, lines)
    assert [g[3:] for g in got] == list(zip(names[1:], names[:-1]))
    assert {r["CopyNumber"] for r in run.table(run.routes(steps)).collect()} == {float(f"{j}.{j}5") for j in range(9)}
