"""Filters, validators and de-duplication."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusmill.functions.scalars import log2_to_copies
from locusmill.operators.ranges import joined, summarised
from locusmill.session import broadcast_if_small, cut


def first_by(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The row with the smallest ``order`` of each key; combined on the map side, unlike a window."""
    rest = [c for c in df.columns if c not in keys and c != order]
    picked = df.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("__x"))
    return picked.select(*keys, "__x.*")


def valid_segments(df: DataFrame, cap: float) -> DataFrame:
    """No nulls, start before end, copy number from 0 to twice the cap, then capped."""
    return df.dropna().where((F.col("s") < F.col("e")) & (F.col("cn") >= 0) & (F.col("cn") <= 2 * cap)).withColumn("cn", F.least("cn", F.lit(cap)))


def valid_pairs(df: DataFrame) -> DataFrame:
    """Breakend pairs without nulls, ends after starts, no negative place."""
    return df.dropna().where("start1 >= 0 and start2 >= 0 and start1 < end1 and start2 < end2")


def of_classes(df: DataFrame, column: str, classes: Sequence[str]) -> DataFrame:
    """Rows of the classes; ``-like`` is taken off on both sides."""
    bare = F.replace(F.col(column), F.lit("-like"), F.lit(""))
    return df.withColumn(column, bare).where(F.col(column).isin(*[c.replace("-like", "") for c in classes]))


def violations(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """One row: the number of rows, and of those that break each rule (a null breaks none)."""
    return df.agg(F.count("*").alias("n"), *[F.count(F.when(c, 1)).alias(k) for k, c in rules.items()])


def require(counts: DataFrame, strict: bool = True) -> dict[str, int]:
    """Broken rules of ``violations`` with their counts; raises if there are any and ``strict`` holds, else warns."""
    found = {k: v for k, v in counts.first().asDict().items() if k != "n" and v}
    if found and strict:
        raise ValueError(f"rules broken: {found}")
    if found:
        warnings.warn(f"rules broken: {found}", stacklevel=2)
    return found


def require_overlap(counts: DataFrame, least: int = 1) -> int:
    """Common keys of ``overlap_counts``; raises where there are fewer than ``least``."""
    common = counts.first()["common"] or 0
    if common < least:
        raise ValueError(f"{common} common keys, {least} needed")
    return common


def thin(df: DataFrame, keys: Sequence[str], place: str, tolerance: int, bin_size: int = 10_000_000) -> DataFrame:
    """Rows further than ``tolerance`` from the row before; a chain of close rows leaves its first.

    The row before is looked for in the row's own bin; the first row of a bin gets the last of the bins before it, from one row a bin.
    """
    keys = list(keys)
    b = df.withColumn("__b", F.floor(F.col(place) / bin_size))
    last = b.groupBy(*keys, "__b").agg(F.max(place).alias("__last"))
    carried = last.select(*keys, "__b", F.lag("__last").over(Window.partitionBy(*keys).orderBy("__b")).alias("__last"))
    inside = F.lag(place).over(Window.partitionBy(*keys, "__b").orderBy(place))
    out = joined(b.withColumn("__p", inside), carried, [*keys, "__b"]).withColumn("__p", F.coalesce("__p", "__last"))
    return out.where(F.col("__p").isNull() | (F.col(place) - F.col("__p") > tolerance)).drop("__p", "__b", "__last")


def trimmed(df: DataFrame, group: str, value: str, low: float, high: float) -> DataFrame:
    """Rows whose value lies between two percentiles of their group."""
    edges = summarised(df, [group], {"__q": (F.col(value), [low, high])})
    return df.join(broadcast_if_small(edges), group).where(F.col(value).between(F.col("__q")[0], F.col("__q")[1])).drop("__q")


def lowest_share(df: DataFrame, value: str, share: float) -> DataFrame:
    """Rows at or below a percentile of the whole table (one row is broadcast)."""
    edge = summarised(df, [], {"__t": (F.col(value), share)})
    return df.join(F.broadcast(edge), F.col(value) <= F.col("__t")).drop("__t")


def containing(df: DataFrame, text: str, words: DataFrame, word: str) -> DataFrame:
    """Pairs of text and word where the text holds the word in any case.

    Words meet the texts that hold their rarest stretch of three signs (shorter words: any of their own length), so
    the join is an equi-join on such stretches; a check of the whole word follows. A text is cut into as many stretches as it has signs.
    """
    low, w = F.lower(F.col(text)), F.lower(F.col(word))
    grams = lambda c, n: F.array_distinct(F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>")))
    keyed = df.withColumn("__t", low).withColumn("__g", F.explode(F.array_distinct(F.flatten(F.array(*[grams(F.col("__t"), n) for n in (1, 2, 3)])))))
    short = words.select(word, w.alias("__w")).where(F.length("__w") > 0).withColumn("__g", F.explode(F.when(F.length("__w") <= 3, F.array("__w")).otherwise(grams(F.col("__w"), 3))))
    seen = keyed.groupBy("__g").agg(F.count("*").alias("__n"))
    rarest = short.join(seen, "__g").groupBy(word, "__w").agg(F.min_by("__g", F.struct("__n", "__g")).alias("__g"))
    return keyed.join(rarest, "__g").where(F.col("__t").contains(F.col("__w"))).drop("__t", "__g", "__w")


def overlap_counts(a: DataFrame, b: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Distinct keys of either side and in common, in one row."""
    x = a.select(key, F.lit(1).alias("__a"), F.lit(0).alias("__b")).union(b.select(key, F.lit(0), F.lit(1))).where(F.col(key).isNotNull())
    flags = x.groupBy(key).agg(F.max("__a").alias("a"), F.max("__b").alias("b"))
    return flags.agg(F.sum("a").alias(left), F.sum("b").alias(right), F.sum(F.col("a") * F.col("b")).alias("common"))


def absolute_guard(df: DataFrame, value: str, group: str, p99: float = 20.0, top: float = 50.0) -> DataFrame:
    """Adds ``cn``: the value itself where its group looks absolute already, else two times two to its power."""
    looks = summarised(df, [group], {"p": (F.col(value), 0.99)}, most=F.max(value)).select(group, ((F.col("p") > p99) | (F.col("most") > top)).alias("__abs"))
    return df.join(broadcast_if_small(looks), group).withColumn("cn", F.when(F.col("__abs"), F.col(value)).otherwise(log2_to_copies(F.col(value)))).drop("__abs")
