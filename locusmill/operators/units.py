"""Quantities stated in different units, brought to absolute copies.

A multi-pattern automaton finds unit aliases in the texts that go with a value. Overlapping hits
are settled by the longest match. Hits of one text are told apart by the number that stands at the alias: an alias
at the row's own value says most, one without a number comes next, and one at another number (a purity of 80 %) counts only
where nothing else is said. What is left is settled by the rank of the units, and the texts by the
order of the fields (the row's own statements before the readme of its source). The unit then picks
a row of the conversion table, which is a handful of constants and joined by broadcast.

Defined results: a null or NaN value has null copies and is never reported; a text without an alias
says nothing; a row about which nothing is said has the unit ``unknown`` and null copies; an empty
table gives an empty table; columns of the input are kept, and an input column of a result's name
is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusmill.session import broadcast_if_small

# Aliases of each unit, lower case, blanks squeezed. A ``~`` stands for "this reading
# is void"; the phrase only keeps shorter aliases inside it from counting.
ALIASES: dict[str, tuple[str, ...]] = {
    "log2_ratio": (
        "log2", "log 2", "log_2", "lg2", "l2r", "log2r", "lrr", "log r ratio", "log ratio", "base-2 log", "base 2 log",
        "base-2 logarithm", "base 2 logarithm", "binary log", "binary logarithm", "logarithm", "log2(t/n)", "log2 ratio",
        "log2(ratio)", "log2(tumour/normal)", "log2(tumor/normal)", "log2 fold", "log2fc",
    ),
    "plus_one": (
        "+ 1", "+1", "1 +", "1+", "p1", "plus one", "plus 1", "one plus", "1 plus", "log2p1", "log2(x+1)", "log2(ratio+1)", "log2(ratio + 1)", "pseudocount 1",
    ),
    "hundredths": (
        "hundredths", "hundredths of a copy", "hundredth", "hundredth of a copy", "centicopies", "centicopy", "centi-copies", "ccn",
        "x100", "x 100", "times 100", "multiplied by 100", "1/100", "0.01", "0.01 copies", "copies x100", "copies * 100", "copies*100",
        "1/100 copies", "times one hundred", "200 = two copies", "scaled by 100",
    ),
    "percent": (
        "%", "pct", "percent", "per cent", "percentage", "perc.", "% of normal dosage", "% dosage", "percent of 2n", "pct of 2n",
        "percentage of 2n", "% of diploid", "per cent of the diploid state", "normal is 100", "100 is normal", "100 = two copies",
    ),
    "ratio": (
        "ratio", "t/n", "t / n", "tumour/normal", "tumor/normal", "fold", "fold vs 2n", "x diploid", "rel.", "relative", "relative to 2n",
        "relative copy number", "rel. copy number", "depth ratio", "linear", "linear scale", "ratio to diploid", "times diploid",
        "multiple of diploid", "fraction of diploid",
    ),
    "absolute": (
        "copies", "copy", "abs", "abs.", "absolute", "absolute cn", "absolute copies", "absolute copy number", "total cn", "total copies",
        "total copy number", "n copies", "number of copies", "copy calls", "copy number", "copy count", "integer copies", "cn calls",
    ),
    "~": (
        "not copies", "not absolute", "not absolute copies", "not log2", "not log", "not a ratio", "not percent", "two copies", "2 copies",
        "means two copies", "= two copies", "corresponds to two copies", "copies were not", "not in copies", "cn unit", "copy number unit",
    ),
}

# Unit, whether the value is a binary logarithm, factor, offset:
# copies = factor * (2 ** value or value) + offset.
CONVERSIONS = (
    ("absolute", False, 1.0, 0.0),
    ("log2_ratio", True, 2.0, 0.0),
    ("log2_ratio_plus_1", True, 2.0, -2.0),
    ("ratio", False, 2.0, 0.0),
    ("percent", False, 0.02, 0.0),
    ("hundredths", False, 0.01, 0.0),
)

# Aliases that state two things at once.
PARTS = {w: ("log2_ratio", "plus_one") for w in ("log2p1", "log2(x+1)", "log2(ratio+1)", "log2(ratio + 1)")}

# Which statement counts where a text holds several: the scale words outrank what they scale.
RANK = ("log2_ratio_plus_1", "log2_ratio", "hundredths", "percent", "ratio", "absolute")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for unit, words in ALIASES.items():
        for w in words:
            a.add_word(w, (unit, len(w)))
    a.make_automaton()
    return a


def _edge(text: str, at: int, inside: int) -> bool:
    """Whether a match may begin or end at this border: not in the middle of a word or number."""
    if not 0 <= at < len(text) or not text[inside].isalnum():
        return True
    a, b = text[at], text[inside]
    beyond = 2 * at - inside
    point = a == "." and b.isdigit() and 0 <= beyond < len(text) and text[beyond].isdigit()
    return not (a.isalpha() and b.isalpha() or a.isdigit() and b.isdigit() or point)


_BEFORE = re.compile(r"([-+]?\d+(?:\.\d+)?) ?\Z")
_AFTER = re.compile(r" ?[:=]? ?([-+]?\d+(?:\.\d+)?)(?![\w.]*\w)")


def _number_at(t: str, s: int, e: int, taken: Sequence[tuple[int, int, str]]) -> float | None:
    """The number beside an alias at [s, e), if it belongs to no other alias."""
    k = s  # back over one blank and the number
    while k and (t[k - 1].isdigit() or t[k - 1] in ".+-" or k == s and t[k - 1] == " "):
        k -= 1
    for m in (_BEFORE.search(t[k:s]), _AFTER.match(t, e)):
        if m:
            at = (k if m.re is _BEFORE else 0) + m.start(1)
            if not any(a <= at < b for a, b, _ in taken):
                return float(m[1])
    return None


def unit_of_text(text: str | None, automaton: ahocorasick.Automaton, value: float | None = None) -> str | None:
    """The unit one text states for a value, or null."""
    if text is None:
        return None
    t = re.sub(r"\s+", " ", text.lower()).strip()
    hits = []
    for end, (unit, n) in automaton.iter(t):
        start = end - n + 1
        if _edge(t, start - 1, start) and _edge(t, end + 1, end):
            hits.append((start, end + 1, unit))
    taken: list[tuple[int, int, str]] = []
    for s, e, unit in sorted(hits, key=lambda h: (h[0] - h[1], h[0])):
        if all(e <= a or s >= b for a, b, _ in taken):
            taken.append((s, e, unit))
    said: dict[int, set[str]] = {}
    for s, e, unit in taken:
        number = _number_at(t, s, e, taken) if unit != "~" else None
        own = number is not None and value is not None and abs(number - value) <= 1e-9 * max(1.0, abs(value))
        for u in PARTS.get(t[s:e], (unit,)):
            said.setdefault(1 if number is None else 0 if own else 2, set()).add(u)
    for _, units in sorted(said.items()):
        if {"log2_ratio", "plus_one"} <= units:
            return "log2_ratio_plus_1"
        if found := next((u for u in RANK if u in units), None):
            return found
    return None


def _unit_column(texts: Sequence[str], value: str | None = None) -> Column:
    """First stated unit of the given text columns, in order; each distinct text is read once a batch, one with digits once for each value."""

    def stated(batches):
        automaton = _automaton()
        for columns in batches:
            columns = columns if isinstance(columns, tuple) else (columns,)
            unit = pd.Series([None] * len(columns[0]), dtype=object)
            values = columns[-1] if value else None
            for c in columns[: len(texts)]:
                codes, distinct = pd.factorize(c)
                fresh = [unit_of_text(x, automaton) for x in distinct] + [None]
                found = pd.Series([fresh[i] for i in codes], dtype=object)
                if values is not None:
                    numbered = [bool(re.search(r"\d", x)) for x in distinct] + [False]
                    for i in [i for i, k in enumerate(codes) if numbered[k]]:
                        found.iat[i] = unit_of_text(distinct[codes[i]], automaton, values.iat[i])
                unit = unit.where(unit.notna(), found)
            yield unit

    several = len(texts) + (value is not None) > 1
    stated.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]] if several else Iterator[pd.Series], "return": Iterator[pd.Series]}
    held = [F.col(f"`{c}`").cast("string") for c in texts] + ([F.col(f"`{value}`").cast("double")] if value else [])
    return F.pandas_udf(stated, "string")(*held)


def with_units(df: DataFrame, texts: Sequence[str], sources: DataFrame, source: str = "source", readme: str = "readme", value: str | None = None) -> DataFrame:
    """Adds ``unit``: what ``texts`` say (the earlier column first) of the ``value``, else what the source's readme says."""
    stated = (
        sources.where(F.col(source).isNotNull())
        .select(F.col(source).alias("__source"), _unit_column([readme]).alias("__said"))
        .groupBy("__source").agg(F.min("__said").alias("__said"))
    )
    rows = df.drop("unit").withColumn("__own", _unit_column(texts, value))
    return (
        rows.join(broadcast_if_small(stated), F.col(source) == F.col("__source"), "left")
        .withColumn("unit", F.coalesce("__own", "__said", F.lit("unknown")))
        .drop("__own", "__said", "__source")
    )


def to_copies(df: DataFrame, value: str) -> DataFrame:
    """Adds ``copies`` by the unit's row of the conversion table."""
    factors = df.sparkSession.createDataFrame(CONVERSIONS, "unit string, __log boolean, __factor double, __offset double")
    v = F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    return (
        df.drop("copies").join(F.broadcast(factors), "unit", "left")
        .withColumn("copies", F.col("__factor") * F.when(F.col("__log"), F.pow(F.lit(2.0), v)).otherwise(v) + F.col("__offset"))
        .drop("__log", "__factor", "__offset")
    )


def foreign_units(df: DataFrame, value: str) -> DataFrame:
    """Rows of ``with_units`` with a value that is stated in another unit than absolute copies."""
    return df.where(F.col(value).isNotNull() & ~F.col("unit").isin("absolute", "unknown"))
