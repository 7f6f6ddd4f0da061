"""Ranks, running sums and exact percentiles inside groups, cut into value ranges so that no group lies in one task.

Rows are first counted per group and distinct value (map-side combined) and written once. The values are then
cut into ranges: sums per group and range are cumulated over a table of a few rows a group, and only inside one range
of one group by a window. A group with nearly all rows is spread over the ranges like the table as a whole.

Defined results: null and NaN values have no rank and count in no percentile; ties share what they get; a
group without a value keeps its row in ``summarised``, with null percentiles; null keys form a group; an empty
table gives no row (one row of nulls without keys).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusmill.session import broadcast_if_small, cut

C = F.col


def parts_of(df: DataFrame) -> int:
    """Ranges that a table is cut into: at least as many as shuffle partitions."""
    return max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def joined(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null; the keys of the left side stay."""
    r = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = [left[k].eqNullSafe(r[f"__r_{k}"]) for k in keys] or F.lit(True)
    return left.join(r, on, how).drop(*[f"__r_{k}" for k in keys])


def range_number(value: Column, edges: Sequence[float]) -> Column:
    """Number of the edges below the value, by halving: a handful of steps whatever their number."""
    steps = [1 << i for i in reversed(range(max(1, len(edges).bit_length())))]
    padded = F.array(*[F.lit(float(e)) for e in edges], *[F.lit(float("inf"))] * (2 * steps[0] - 1 - len(edges)))
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda at, s: at + F.when(F.get(padded, at + s - 1) < value.cast("double"), s).otherwise(0))


def value_range(df: DataFrame, order: str, parts: int | None = None) -> Column:
    """Number of the value range a row falls in. The edges are a fixed list from one job (approximate
    percentiles, so that ranges are about equal); every use of the column sees the same ranges."""
    parts = parts or parts_of(df)
    found = df.agg(F.percentile_approx(C(order).cast("double"), [i / parts for i in range(1, parts)], 10 * parts).alias("e")).first()["e"]
    return range_number(C(order), sorted(set(found or [])))


def cumulated(counts: DataFrame, order: str, weight: str, by: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """Adds ``__before``: the sum of ``weight`` over smaller ``order`` in the group. Writes ``counts`` unless it is written; runs a job for the ranges."""
    counts = counts if counts.__dict__.get("written") else cut(counts)
    by = list(by)
    ranged = counts.withColumn("__part", value_range(counts, order, parts))
    sums = ranged.groupBy(*by, "__part").agg(F.sum(weight).alias("__s"))
    over = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, "__part", F.coalesce(F.sum("__s").over(over), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy(*by, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumn("__in", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return joined(placed, broadcast_if_small(offsets), [*by, "__part"]).withColumn("__before", C("__in") + C("__offset")).drop("__part", "__in", "__offset")


def numbered(df: DataFrame, by: Sequence[str], order: str, name: str) -> DataFrame:
    """Adds the row's number in its group, from 0. ``order`` is a number that doesn't repeat within a group."""
    return cumulated(df.withColumn("__one", F.lit(1)), order, "__one", by).withColumnRenamed("__before", name).drop("__one")


def average_rank(df: DataFrame, by: Sequence[str], value: str, name: str) -> DataFrame:
    """Adds the average rank of ``value`` within the groups; ties share the mean of their ranks, rows without a value fall away."""
    kept = df.where(C(value).isNotNull() & ~F.isnan(C(value).cast("double")))
    ranks = cumulated(kept.groupBy(*by, value).agg(F.count("*").alias("__n")), value, "__n", by)
    ranks = ranks.select(*by, value, (C("__before") + (C("__n") + 1) / 2).alias(name))
    return joined(kept, broadcast_if_small(ranks), [*by, value])


def summarised(df: DataFrame, by: Sequence[str], quantiles: Mapping[str, tuple[Column, float | Sequence[float]]], weight: Column | None = None, **aggregates: Column) -> DataFrame:
    """One row per group: exact interpolated percentiles of columns (an array where several are asked for), and plain aggregates.

    The percentile p of n values lies at place p * (n - 1) between its neighbours in order. ``weight``: how many
    rows a row stands for (a whole number; those with none fall away).
    """
    by, names = list(by), list(quantiles)
    asked = [list(p) if isinstance(p, (list, tuple)) else [p] for _, p in quantiles.values()]
    cells = F.array(*[F.struct(F.lit(i).alias("i"), c.cast("double").alias("v")) for i, (c, _) in enumerate(quantiles.values())])
    times = (F.lit(1) if weight is None else weight).cast("long").alias("w")
    long = df.select(*by, times, F.explode(cells).alias("x")).select(*by, "w", "x.i", (C("x.v") + 0.0).alias("v")).where("w > 0 and v is not null and not isnan(v)")
    counts = cut(long.groupBy(*by, "i", "v").agg(F.sum("w").alias("n")))
    parts = parts_of(df)
    edges = {r["i"]: sorted(set(r["e"])) for r in counts.groupBy("i").agg(F.percentile_approx("v", [k / parts for k in range(1, parts)], 10 * parts).alias("e")).collect()}
    part = F.lit(0)
    for i, e in edges.items():
        part = F.when(C("i") == i, range_number(C("v"), e)).otherwise(part)
    ranged = counts.withColumn("part", part)
    group = [*by, "i"]
    sums = ranged.groupBy(*group, "part").agg(F.sum("n").alias("s"))
    over = Window.partitionBy(*group)
    sums = sums.withColumn("total", F.sum("s").over(over)).withColumn("before", F.coalesce(F.sum("s").over(over.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    probs = F.array(*[F.array(*[F.lit(float(p)) for p in ps]) for ps in asked])
    places = F.transform(F.get(probs, C("i")), lambda p: p * (C("total") - 1))
    ranks = F.array_distinct(F.flatten(F.transform(places, lambda x: F.array(F.floor(x), F.ceil(x)))))
    wanted = sums.withColumn("ranks", ranks).withColumn("ranks", F.filter("ranks", lambda r: (r >= C("before")) & (r < C("before") + C("s")))).where("size(ranks) > 0")
    inside = Window.partitionBy(*group, "part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    at = joined(ranged, broadcast_if_small(wanted.select(*group, "part", "before", "total", "ranks")), [*group, "part"])
    at = at.withColumn("from", C("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    found = at.select(*group, "total", "v", F.explode(F.filter("ranks", lambda r: (r >= C("from")) & (r < C("from") + C("n")))).alias("rank"))
    held = found.groupBy(*group).agg(F.max("total").alias("total"), F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))  # two ranks a percentile
    value = lambda p: F.try_element_at("at", p)
    mixed = F.transform(places, lambda x: F.when(value(F.floor(x)) == value(F.ceil(x)), value(F.floor(x))).otherwise((F.ceil(x) - x) * value(F.floor(x)) + (x - F.floor(x)) * value(F.ceil(x))))
    rows = held.withColumn("q", mixed).groupBy(*by).agg(*[
        F.first(F.when(C("i") == i, C("q") if isinstance(p, (list, tuple)) else F.get("q", F.lit(0))), ignorenulls=True).alias(n) for i, (n, (_, p)) in enumerate(quantiles.items())
    ])
    base = df.groupBy(*by).agg(*[c.alias(n) for n, c in (aggregates or {"__rows": F.count("*")}).items()])
    return joined(base, rows, by, "left").select(*by, *aggregates, *names)


def median(df: DataFrame, by: Sequence[str], value: Column | str, name: str = "median") -> DataFrame:
    return summarised(df, by, {name: (C(value) if isinstance(value, str) else value, 0.5)})
