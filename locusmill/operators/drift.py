"""Delivered text files whose fields drift: one table per target, and a list of every change.

1. Each file gets a schema: the names of its header with the types of their values. The schema's
   fingerprint doesn't depend on the order of the fields.
2. The files of a feed are ordered by time; a file whose fingerprint differs from its predecessor's
   begins a new version. Equal fingerprints need no further look.
3. At the border of two versions the migration steps are stated: rename, add (default null), remove and
   cast. A rename is settled by the records that both files hold: they are aligned by values that are
   unique in both, and a vanished and a new field are the same quantity if their values agree on
   the aligned records; names decide only where there are too few of those.
4. The steps' renames are chained from version to version (by doubling pointers, so a feed of any length
   takes a logarithmic number of joins), and every file is routed by its version: each canonical
   field has a place in the file's records, everything else goes as text into ``extra``.

A record stays one row with an array of cells from the first step to the last, and isn't shuffled to find the
changes. Only where a border has both vanished and new fields are its records keyed for the alignment.

Defined results: null, blank and comment lines and repeated lines hold no record, a line that repeats
the header neither; a file without any line but comments doesn't exist, nor one without feed or name; a
record with too few cells has nulls for the rest, surplus cells are dropped; empty cells and NA are null;
a field without a value has no type and is never retyped; equal delivery times are ordered by file name;
of a name that stands twice in a header the first column counts, the other goes to ``extra``; of two fields
that lead to one canonical field the one that bears its name, else the better known, else the first wins, and the
other goes to ``extra`` under its own name; a cell that can't be cast goes there too; an empty table has no
change; further columns are ignored.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusmill.session import broadcast_if_small, cut

SEPARATORS = (",", ";", "\t", "|")
MISSING = ("", "na")

# Names under which the same quantity is delivered, squeezed to lower-case letters and digits.
FAMILIES: dict[str, tuple[str, ...]] = {
    "ModelID": ("modelid", "model", "sample", "sampleid", "depmapid", "achid", "lineid", "cellline", "cellid"),
    "Chromosome": ("chromosome", "chr", "chrom", "seqname", "seqnames", "contig"),
    "Start": ("start", "begin", "locstart", "startpos", "segstart", "startposition", "chromstart", "from"),
    "End": ("end", "stop", "locend", "endpos", "segend", "endposition", "chromend", "to"),
    "CopyNumber": ("copynumber", "cn", "totalcn", "segmentcn", "copies", "segmean", "segmentmean", "copyno", "abscn"),
    "gene": ("gene", "symbol", "hugosymbol", "genesymbol", "genename", "hugo", "geneid"),
    "cell_line": ("cellline", "model", "lineid", "line", "modelid", "celllinename", "depmapid", "sample", "cellid"),
    "dependency": ("dependency", "depscore", "geneeffect", "score", "effect", "effectv2", "dependencyscore", "chronos", "ceres"),
}
CANON = {"cnv": ("ModelID", "Chromosome", "Start", "End", "CopyNumber"), "dependency": ("gene", "cell_line", "dependency")}
FIELDS = (*CANON["cnv"], *CANON["dependency"])
FILE = ("feed", "file_name")
PACK = 20  # cells whose kinds share a number


def _squeezed(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def _family(target: Column, name: Column) -> Column:
    """Canonical field that a name is known for in a target, or null."""
    out = F.lit(None).cast("string")
    for t, fields in CANON.items():
        for f in fields:
            out = F.when((target == t) & _squeezed(name).isin(*FAMILIES[f]), f).otherwise(out)
    return out


def _known(canonical: Column, name: Column) -> Column:
    """0 for the canonical name itself, then the rank of the name in its family; a large number for others."""
    out = F.lit(1000)
    for f, names in FAMILIES.items():
        rank = F.array_position(F.array(*[F.lit(n) for n in names]), _squeezed(name)).cast("int")
        out = F.when((canonical == f) & (rank > 0), rank).otherwise(out)
    return F.when(canonical == name, 0).otherwise(out)


def _stems(name: Column) -> Column:
    """Telling words of a name: split at case and signs, without plural s and without filler words."""
    parts = F.split(F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1 $2"), "[^A-Za-z0-9]+", " ")), " ")
    stems = F.transform(parts, lambda w: F.regexp_replace(w, "s$", ""))
    return F.filter(stems, lambda w: ~w.isin("", "n", "num", "count", "id", "name", "value", "no", "v2", "new", "old"))


def _cells(line: Column, sep: Column) -> Column:
    """The cells of a line, unquoted and trimmed. In a line with quotes the separator is put in front, so that each match takes one."""
    out = F.array(line)
    for s in SEPARATORS:
        q = "\\" + s if s in "|" else s
        quoted = F.regexp_extract_all(F.concat(F.lit(s), line), F.lit(f'{q}([ ]*"(?:[^"]|"")*"[ ]*|[^{q}]*)'), F.lit(1))
        out = F.when(sep == s, F.when(line.contains('"'), quoted).otherwise(F.split(line, q, -1))).otherwise(out)
    bare = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.trim(c), '^"|"$', ""), '""', '"'))
    return F.transform(out, lambda c: F.when(c.contains('"'), bare(c)).otherwise(F.trim(c)))


def records(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records (feed, file_name, line_no, mark, cells, kinds) and files (feed, file_name, target, delivered_at, header).

    Writes the files. Missing cells are null. Repeated lines bear the same ``mark``, the hash of their text.
    """
    text = F.regexp_replace(F.col("line"), "^﻿|[\r\n]+$", "")
    lines = (
        raw.where(F.col("feed").isNotNull() & F.col("file_name").isNotNull())
        .select(*FILE, "target", "delivered_at", F.col("line_no").cast("int").alias("line_no"), text.alias("line"))
        .where((F.trim("line") != "") & ~F.ltrim("line").startswith("#"))
    )
    heads = lines.groupBy(*FILE).agg(F.min("line_no").alias("head_no"), F.min("delivered_at").alias("delivered"))
    bare = F.regexp_replace("h", '"[^"]*"', "")
    counts = [F.struct((F.length(bare) - F.length(F.replace(bare, F.lit(s), F.lit("")))).alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(SEPARATORS)]
    first = lines.select(*FILE, "target", F.col("line").alias("h"), F.col("line_no").alias("head_no"))
    files = cut(
        first.join(broadcast_if_small(heads), [*FILE, "head_no"])
        .groupBy(*FILE, "head_no", "delivered").agg(F.min(F.struct("h", "target")).alias("x")).select(*FILE, "head_no", "delivered", "x.*")
        .withColumn("best", F.array_max(F.array(*counts)))
        .withColumn("sep", F.when(F.col("best.n") > 0, F.col("best.s")))
        .select(*FILE, "head_no", F.col("delivered").alias("delivered_at"), "target", "sep", _cells(F.col("h"), F.col("sep")).alias("header"))
    )
    parsed = (
        lines.select(*FILE, "line_no", "line").join(broadcast_if_small(files.select(*FILE, "head_no", "sep", "header")), [*FILE])
        .where(F.col("line_no") != F.col("head_no"))
        .select(*FILE, "line_no", F.xxhash64("line").alias("mark"), _cells(F.col("line"), F.col("sep")).alias("cells"), "header")
        .where(F.col("cells") != F.col("header"))
        .select(*FILE, "line_no", "mark", F.transform(F.slice("cells", 1, F.size("header")), lambda v: F.when(~F.lower(v).isin(*MISSING), v)).alias("cells"))
    )
    return parsed.withColumn("kinds", _packed_kinds(F.col("cells"))), files


def _kind(v: Column) -> Column:
    """0 integer, 1 decimal, 2 text; null for a missing value."""
    return (
        F.when(v.isNull(), F.lit(None).cast("int"))
        .when(v.rlike("^[-+]?[0-9]+$"), 0)
        .when(v.rlike("^[-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][-+]?[0-9]+)?$"), 1)
        .otherwise(2)
    )


def _packed_kinds(cells: Column) -> Column:
    """Kinds of a record's cells as one bit of three each, ``PACK`` cells to a number: the records of a file are joined by bitwise or."""
    bit = lambda v: F.coalesce(F.get(F.array(F.lit(1), F.lit(2), F.lit(4)), _kind(v)), F.lit(0)).cast("long")
    one = lambda c: F.aggregate(F.reverse(F.slice(cells, c * PACK + 1, PACK)), F.lit(0).cast("long"), lambda acc, v: acc * 8 + bit(v))
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(cells) - 1) / PACK).cast("int")), one)


def _kind_at(packed: Column, pos: Column) -> Column:
    """The widest kind that a file's records show at a place; null if they hold no value."""
    bits = F.call_function("shiftright", F.get(packed, F.floor(pos / PACK).cast("int"))["bits"], (pos % PACK) * 3).bitwiseAND(F.lit(7).cast("long"))
    return F.when(bits >= 4, 2).when(bits >= 2, 1).when(bits == 1, 0)


def number_in(c: str) -> Column:
    """Cast rule of a measured value: the number in the cell, a hundredth of it before a % sign."""
    n = F.expr(f"try_cast(nullif(regexp_extract({c}, '[-+]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?', 0), '') as double)")
    return n * F.when(F.col(c).rlike("[0-9]\\s*%"), 0.01).otherwise(1.0)


def _leading_number(c: str) -> Column:
    """Number at the start of a cell after signs like < or ~, else null."""
    return F.expr(f"try_cast(nullif(regexp_extract({c}, '^[<>=~ ]*([-+]?[0-9]*[.]?[0-9]+([eE][-+]?[0-9]+)?)', 1), '') as double)")


def _names(fields: Column) -> Column:
    return F.transform(fields, lambda x: x["field"])


class Drift:
    """The pieces of one run over raw lines. The files, the parsed records and the schemas, which several
    steps read, are written to the shared folder at once; the rest is lazy."""

    def __init__(self, raw: DataFrame):
        parsed, files = records(raw)
        order = Window.partitionBy("feed").orderBy("delivered_at", "file_name")
        numbered = files.select(*FILE, "target", "header", F.row_number().over(order).alias("k"))
        self.records = cut(parsed)
        self.schemas = cut(self._versions(numbered), after=files)

    def _versions(self, files: DataFrame) -> DataFrame:
        """One row per file: feed, file_name, target, k, header, fields, fingerprint, version, before, and the steps that names alone show.

        ``fields``: the distinct names with their types in order of name; ``before``: the same of the file before, of which ``added``,
        ``gone`` and ``recast`` are names.
        """
        kinds = (
            self.records.select(*FILE, F.posexplode("kinds").alias("part", "bits")).groupBy(*FILE, "part").agg(F.bit_or("bits").alias("bits"))
            .groupBy(*FILE).agg(F.array_sort(F.collect_list(F.struct("part", "bits"))).alias("kinds"))
        )
        first = F.filter(F.transform("header", lambda h, i: F.struct(h.alias("field"), _kind_at(F.col("kinds"), i).alias("kind"), i.alias("pos"))), lambda x: F.array_position("header", x["field"]) == x["pos"] + 1)
        fields = F.array_sort(F.transform(first, lambda x: F.struct(x["field"].alias("field"), x["kind"].alias("kind"))))
        said = F.transform(F.col("fields"), lambda x: F.concat_ws(":", x["field"], F.coalesce(x["kind"].cast("string"), F.lit("-"))))
        print_ = F.substring(F.sha2(F.concat_ws("\u0001", said), 256), 1, 16)
        order = Window.partitionBy("feed").orderBy("k")
        fresh = F.coalesce(F.col("fingerprint") != F.lag("fingerprint").over(order), F.lit(True))
        s = files.join(kinds, [*FILE], "left").withColumn("fields", fields).drop("kinds").withColumn("fingerprint", print_)
        s = s.withColumn("fresh", fresh).withColumn("before", F.lag("fields").over(order)).withColumn("version", F.sum(F.col("fresh").cast("int")).over(order))
        border = F.col("fresh") & F.col("before").isNotNull()
        now, was = _names(F.col("fields")), _names(F.col("before"))
        typed = lambda c: F.filter(c, lambda x: x["kind"].isNotNull())
        other = _names(F.array_except(typed("fields"), typed("before")))
        return s.withColumns({
            "added": F.when(border, F.array_except(now, was)), "gone": F.when(border, F.array_except(was, now)),
            "recast": F.when(border, F.array_intersect(other, _names(typed("before")))),
        }).drop("fresh")

    def _votes(self) -> DataFrame:
        """How far vanished and new fields agree on records that both files of a border hold: feed, k, i (of the vanished), j (of the new), n, values, agree.

        A record is keyed by pairs of neighbouring shared fields, so that every field stands in a key (by single fields if
        only two are shared); a key that one record alone bears in either file aligns the two. Of the values only a hash and
        the leading number travel.
        """
        border = self.schemas.where((F.size("added") > 0) & (F.size("gone") > 0)).select(
            "feed", "file_name", "k", "header", "added", "gone", F.array_intersect(_names(F.col("fields")), _names(F.col("before"))).alias("shared")
        )
        before = self.schemas.select("feed", (F.col("k") + 1).alias("k"), F.col("file_name").alias("old_file"), F.col("header").alias("old_header"))
        pairs = border.join(before, ["feed", "k"])
        side = lambda file, header, mine, other, flag: pairs.select("feed", F.col(file).alias("file_name"), "k", F.lit(flag).alias("late"), F.col(header).alias("header"), F.col(mine).alias("own"), F.size(other).alias("others"), "shared")
        sides = side("file_name", "header", "added", "gone", 1).unionByName(side("old_file", "old_header", "gone", "added", 0))
        at = lambda names: F.transform(names, lambda n: F.array_position("header", n).cast("int") - 1)
        sides = sides.select(*FILE, "k", "late", "others", at(F.col("own")).alias("own"), at(F.col("shared")).alias("shared"))
        value = lambda i: F.get("cells", i)
        plain = lambda i: F.regexp_replace(value(i), "^([-+]?[0-9]+)\\.0+$", "$1")
        n = F.size("shared")
        both = lambda i, j: F.when(value(i).isNotNull() & value(j).isNotNull(), F.xxhash64(j, plain(i), plain(j)))
        # the number of a key is its place among the shared names, which both files have in one order
        paired = F.transform(F.sequence(F.lit(0), n - 1, F.lit(2)), lambda m: both(F.get("shared", m), F.get("shared", F.pmod(m + 1, n))))
        single = F.transform("shared", lambda i: F.when(value(i).isNotNull(), F.xxhash64(plain(i))))
        keys = F.when(n == 0, F.array().cast("array<bigint>")).when(n > 2, paired).otherwise(single)
        keyed = (
            self.records.select(*FILE, "mark", "cells").join(broadcast_if_small(sides), [*FILE])
            .select("feed", "k", "late", "mark", "others", F.transform("own", value).alias("vals"), F.posexplode(keys).alias("m", "key")).where("key is not null")
            .select("feed", "k", "late", "mark", "m", "key", "others", F.posexplode("vals").alias("own", "v")).where("v is not null")
            .select("feed", "k", "late", "mark", "m", "key", "own", F.xxhash64("v").alias("h"), _leading_number("v").alias("x"), F.explode(F.sequence(F.lit(0), F.col("others") - 1)).alias("other"))
        )
        late = F.col("late") == 1
        sided = lambda f, c, flag: f(F.when(late if flag else ~late, F.col(c)))
        both_hold = (
            keyed.groupBy("feed", "k", "m", "key", F.when(late, F.col("other")).otherwise(F.col("own")).alias("i"), F.when(late, F.col("own")).otherwise(F.col("other")).alias("j"))
            .agg(*[sided(f, c, flag).alias(f"{name}{flag}") for flag in (0, 1) for name, f, c in (("a", F.min, "mark"), ("b", F.max, "mark"), ("h", F.max, "h"), ("x", F.max, "x"))])
            .where("a0 = b0 and a1 = b1")
        )
        x, y = F.col("x0"), F.col("x1")
        near = reduce(Column.__or__, [F.abs(x - y * z) <= 0.06 * F.greatest(F.abs(x), F.lit(0.5)) for z in (1.0, 0.01, 100.0)])
        agree = F.avg(F.when((F.col("h0") == F.col("h1")) | F.coalesce(near, F.lit(False)), 1.0).otherwise(0.0))
        return both_hold.groupBy("feed", "k", "i", "j").agg(F.approx_count_distinct("a1").alias("n"), F.approx_count_distinct("h0").alias("values"), agree.alias("agree"))

    def _moves(self) -> DataFrame:
        """feed, k, moves: the renames of each border as structs of field and old_field."""
        border = self.schemas.where((F.size("added") > 0) & (F.size("gone") > 0)).select("feed", "k", "target", "added", "gone")
        pairs = border.select("feed", "k", "target", "added", F.posexplode("gone").alias("i", "r")).select("feed", "k", "target", "i", "r", F.posexplode("added").alias("j", "a"))
        alike = (
            (_family(F.col("target"), F.col("r")) == _family(F.col("target"), F.col("a")))
            | (_squeezed(F.col("r")) == _squeezed(F.col("a"))) | F.arrays_overlap(_stems(F.col("r")), _stems(F.col("a")))
        )
        judged = (
            pairs.join(self._votes(), ["feed", "k", "i", "j"], "left")
            .withColumn("alike", F.coalesce(alike, F.lit(False))).na.fill({"n": 0, "values": 0, "agree": 0.0})
            .where(F.when(F.col("alike"), (F.col("n") < 3) | (F.col("agree") >= 0.2)).otherwise((F.col("n") >= 3) & (F.col("values") >= 3) & (F.col("agree") >= 0.6)))
            .withColumn("score", F.col("alike").cast("double") + 2 * F.col("agree"))
        )
        rank = lambda side, other: F.row_number().over(Window.partitionBy("feed", "k", side).orderBy(F.desc("score"), other))
        best = judged.withColumn("x", rank("r", "a")).withColumn("y", rank("a", "r")).where("x = 1 and y = 1")
        return best.groupBy("feed", "k").agg(F.collect_list(F.struct(F.col("a").alias("field"), F.col("r").alias("old_field"))).alias("moves"))

    def steps(self) -> DataFrame:
        """Migration steps at the borders of versions: feed, file_name, k, version, change_kind, field, old_field."""
        b = self.schemas.where((F.size("added") > 0) | (F.size("gone") > 0) | (F.size("recast") > 0)).join(self._moves(), ["feed", "k"], "left")
        moves = F.coalesce("moves", F.array().cast("array<struct<field:string,old_field:string>>"))
        kind_of = lambda fields, name: F.element_at(F.filter(fields, lambda x: x["field"] == name), 1)["kind"]
        moved_cast = F.filter("moves", lambda m: kind_of("fields", m["field"]) != kind_of("before", m["old_field"]))
        step = lambda kind, x, old=None: F.struct(F.lit(kind).alias("change_kind"), x.alias("field"), (F.lit("") if old is None else old).alias("old_field"))
        every = F.concat(
            F.transform(F.array_except("added", _names(F.col("moves"))), lambda x: step("added", x)),
            F.transform(F.array_except("gone", F.transform("moves", lambda m: m["old_field"])), lambda x: step("removed", x)),
            F.transform("moves", lambda m: step("renamed", m["field"], m["old_field"])),
            F.transform("recast", lambda x: step("retyped", x)), F.transform(moved_cast, lambda m: step("retyped", m["field"])),
        )
        return b.withColumn("moves", moves).select(*FILE, "k", "version", F.explode(every).alias("s")).select(*FILE, "k", "version", "s.*")

    def routes(self, steps: DataFrame) -> DataFrame:
        """Where each field of each file goes: feed, file_name, version, fingerprint, pos, field, canonical, placed (its own column, or ``extra``).

        The chain of renames leads from each version back to the first; a root name goes to the canonical
        field it is known for, or keeps its own name. Every round doubles the length of the chains.
        """
        heads = self.schemas.groupBy("feed", "version").agg(F.min_by(F.struct("target", _names(F.col("fields")).alias("names"), _names(F.col("before")).alias("before")), "k").alias("x"))
        renamed = steps.where("change_kind = 'renamed'").select("feed", "version", "field", "old_field")
        at = heads.select("feed", "version", "x.target", "x.before", F.explode("x.names").alias("field")).join(renamed, ["feed", "version", "field"], "left")
        old = F.coalesce("old_field", "field")
        chained = (F.col("version") > 1) & F.array_contains("before", old)
        nodes = cut(at.select("feed", "version", "target", "field", F.when(chained, F.col("version") - 1).otherwise(F.col("version")).alias("up"), F.when(chained, old).otherwise(F.col("field")).alias("root")))
        longest = nodes.agg(F.max("version").alias("v")).first()["v"] or 1
        for _ in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
            above = nodes.select("feed", F.col("version").alias("up"), F.col("field").alias("root"), F.col("up").alias("__up"), F.col("root").alias("__root"))
            nodes = cut(nodes.join(above, ["feed", "up", "root"]).select("feed", "version", "target", "field", F.col("__up").alias("up"), F.col("__root").alias("root")), after=nodes)
        lead = nodes.select("feed", "version", "field", F.coalesce(_family(F.col("target"), F.col("root")), "root").alias("canonical"))
        columns = self.schemas.select(*FILE, "version", "fingerprint", F.posexplode("header").alias("pos", "field"))
        w = Window.partitionBy(*FILE, "canonical").orderBy(_known(F.col("canonical"), F.col("field")), "pos")
        own = F.col("canonical").isin(*FIELDS) & (F.row_number().over(w) == 1)
        return columns.join(lead, ["feed", "version", "field"]).withColumn("placed", F.when(own, F.col("canonical")).otherwise("extra"))

    def table(self, routes: DataFrame) -> DataFrame:
        """All records of both targets under the canonical fields; what has no place of its own goes as text into ``extra``."""
        place = [F.max(F.when(F.col("placed") == f, F.col("pos"))).alias(f"at_{f}") for f in FIELDS]
        name = F.when(F.col("canonical").isin(*FIELDS), F.col("field")).otherwise(F.col("canonical"))
        others = F.collect_list(F.when(F.col("placed") == "extra", F.struct(name.alias("name"), "pos"))).alias("others")
        files = routes.groupBy(*FILE, "version").agg(*place, others).join(self.schemas.select(*FILE, "target"), [*FILE])
        once = self.records.groupBy(*FILE, "mark", "cells").agg(F.min("line_no").alias("line_no"))
        r = once.join(broadcast_if_small(files), [*FILE]).withColumns({f"raw_{f}": F.get("cells", F.col(f"at_{f}")) for f in FIELDS})
        whole = lambda f: F.expr(f"try_cast(try_cast(raw_{f} as double) as bigint)")
        cast = {f: whole(f) if f in ("Start", "End") else number_in(f"raw_{f}") if f in ("CopyNumber", "dependency") else F.col(f"raw_{f}") for f in FIELDS}
        r = r.withColumns(cast)
        lost = [F.when(F.col(f"raw_{f}").isNotNull() & F.col(f).isNull(), F.concat(F.lit(f + "="), f"raw_{f}")) for f in FIELDS]
        more = F.transform("others", lambda x: F.concat(x["name"], F.lit("="), F.get("cells", x["pos"])))
        extra = F.array_join(F.array_sort(F.filter(F.concat(more, F.array(*lost)), lambda x: x.isNotNull())), ";")
        return r.select("target", *FILE, "line_no", "version", *FIELDS, extra.alias("extra"))
