"""Negative controls: places moved by arithmetic on keys and a seed, the same on any partitioning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusmill.operators.ranges import joined, numbered
from locusmill.session import cut

C = F.col


def drawn(seed: int, *keys: Column) -> Column:
    """Number from 0 up to 2**31 - 2 drawn for the keys: products of primes, so any engine gets the same."""
    out = F.lit(seed * 97 + 13).cast("long")
    for k in keys:
        out = F.pmod(out * 48271 + F.pmod(k.cast("long"), F.lit(2147483647)) * 40503 + 11, F.lit(2147483647))
    return F.pmod(out * 48271, F.lit(2147483647))


def key_number(c: Column) -> Column:
    """A number for a text key: the first 28 bits of its md5."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 7), 16, 10).cast("long")


def size_of(chrom: Column, sizes: Mapping[str, int]) -> Column:
    return F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, v)])[chrom]


def rotate(df: DataFrame, place: str, size: Column, seed: int, *keys: Column) -> DataFrame:
    """All places of a group moved by one offset around the circle; rows without a size stay."""
    off = F.pmod(drawn(seed, *keys), size)
    return df.withColumn(place, F.coalesce(F.pmod(C(place) + off, size), place))


def rotate_interval(df: DataFrame, start: str, end: str, size: Column, seed: int, *keys: Column) -> DataFrame:
    """The middle is rotated and the length put back around it, so no interval grows over the origin."""
    mid, long = F.floor((C(start) + C(end)) / 2), C(end) - C(start)
    moved = F.pmod(mid + F.pmod(drawn(seed, *keys), size), size)
    s = F.greatest(F.lit(0), F.least(size - long, moved - F.floor(long / 2))).cast("long")
    return df.withColumn("__s", F.coalesce(s, C(start))).withColumn("__l", long).withColumn(start, C("__s")).withColumn(end, C("__s") + C("__l")).drop("__s", "__l")


def scatter(df: DataFrame, start: str, end: str, size: Column, seed: int, *keys: Column) -> DataFrame:
    """A new start for each row within its chromosome, the length kept."""
    room = F.greatest(F.lit(1), size - (C(end) - C(start)))
    s = F.coalesce(F.pmod(drawn(seed, *keys), room), C(start))
    return df.withColumn("__l", C(end) - C(start)).withColumn(start, s).withColumn(end, C(start) + C("__l")).drop("__l")


def scatter_across(df: DataFrame, chrom: str, place: str, sizes: Mapping[str, int], seed: int, *keys: Column) -> DataFrame:
    """A new chromosome, in proportion to the sizes, and a new place for each row."""
    total, at, which, where = sum(sizes.values()), 0, F.lit(None).cast("string"), F.lit(None).cast("long")
    x = F.pmod(drawn(seed, *keys) * 1048573 + drawn(seed + 1, *keys), F.lit(total))
    df = df.withColumn("__x", x)
    for k, v in sizes.items():
        inside = (C("__x") >= at) & (C("__x") < at + v)
        which, where = F.when(inside, k).otherwise(which), F.when(inside, C("__x") - at).otherwise(where)
        at += v
    return df.withColumn(chrom, which).withColumn(place, where).drop("__x")


def permute(df: DataFrame, by: Sequence[str], order: str, values: Sequence[str], seed: int) -> DataFrame:
    """The group's rows with ``permuted_<value>`` of other rows: two orders are numbered by ranges and joined. ``order`` is a number unique in its group."""
    df = cut(df)
    two = numbered(df.withColumn("__draw", drawn(seed, C(order)) * 2097152 + F.pmod(C(order), F.lit(2097152))), by, "__draw", "__i").select(*by, "__i", *[C(v).alias(f"permuted_{v}") for v in values])
    return joined(numbered(df, by, order, "__i"), two, [*by, "__i"]).drop("__i")
