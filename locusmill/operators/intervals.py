"""Interval and nearest-place joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusmill.functions.scalars import overlap
from locusmill.operators.ranges import joined

BIN = 1_000_000


def interval_join(left: DataFrame, right: DataFrame, keys: Sequence[str], l_start: str, l_end: str, r_start: str, r_end: str, bin_size: int = BIN) -> DataFrame:
    """Pairs of half-open intervals that overlap, each once.

    Both sides are spread over fixed bins and joined on keys and bin, so neither has to fit anywhere and
    a hot key is split by place. A pair that shares several bins is kept in the bin where its overlap
    begins. Columns of the sides must differ but for the keys.
    """
    spread = lambda df, s, e: df.where(F.col(s) < F.col(e)).withColumn("__bin", F.explode(F.sequence(F.floor(F.col(s) / bin_size), F.floor((F.col(e) - 1) / bin_size))))
    joined = spread(left, l_start, l_end).join(spread(right, r_start, r_end), [*keys, "__bin"])
    begins = F.floor(F.greatest(l_start, r_start) / bin_size)
    return joined.where((F.col(l_start) < F.col(r_end)) & (F.col(r_start) < F.col(l_end)) & (F.col("__bin") == begins)).drop("__bin")


def weighted_copy_number(segments: DataFrame, genes: DataFrame, bin_size: int = BIN) -> DataFrame:
    """Per gene and cell: copy number weighted by overlap over the gene's length; uncovered bases count as 0."""
    pairs = interval_join(segments.select("cell", "chrom", "s", "e", "cn"), genes, ["chrom"], "s", "e", "gs", "ge", bin_size)
    part = overlap(F.col("s"), F.col("e"), F.col("gs"), F.col("ge")) * F.col("cn")
    return pairs.groupBy("gene", "cell").agg((F.sum(part) / F.first(F.greatest(F.lit(1), F.col("ge") - F.col("gs")))).alias("cn"))


def touching(segments: DataFrame, genes: DataFrame, bin_size: int = BIN) -> DataFrame:
    """Closed variant: a segment that ends where the gene starts is a pair too, with overlap 0."""
    wide = segments.withColumn("__e", F.col("e") + 1)
    pairs = interval_join(wide, genes, ["chrom"], "s", "__e", "gs", "ge", bin_size)
    return pairs.withColumn("overlap", overlap(F.col("s"), F.col("e"), F.col("gs"), F.col("ge"))).drop("__e")


def nearest(points: DataFrame, targets: DataFrame, keys: Sequence[str], place: str, at: str, cap: int | None = None, bin_size: int = 10_000_000) -> DataFrame:
    """``points`` with ``dist``, the distance to the nearest target under the same keys; points without one fall away.

    Both sides go through one sorted window per key and bin of places: the target before and the target behind each
    point. Beyond the bin they come from the bins on either side, of which each has one row with its first and last target.
    """
    keys = list(keys)
    both = points.select(*points.columns, F.col(place).alias("__p"), F.lit(None).cast("long").alias("__t")).unionByName(
        targets.select(*keys, F.col(at).alias("__p"), F.col(at).cast("long").alias("__t")), allowMissingColumns=True
    ).withColumn("__b", F.floor(F.col("__p") / bin_size))
    w = Window.partitionBy(*keys, "__b").orderBy("__p")
    before = F.max("__t").over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    behind = F.min("__t").over(w.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    over = Window.partitionBy(*keys).orderBy("__b")
    bins = both.groupBy(*keys, "__b").agg(F.min("__t").alias("__first"), F.max("__t").alias("__last")).select(
        *keys, "__b", F.last("__last", ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1)).alias("__lb"),
        F.first("__first", ignorenulls=True).over(over.rowsBetween(1, Window.unboundedFollowing)).alias("__rb"),
    )
    out = joined(both.withColumn("__l", before).withColumn("__r", behind).where("__t is null"), bins, [*keys, "__b"])
    out = out.withColumn("__l", F.coalesce("__l", "__lb")).withColumn("__r", F.coalesce("__r", "__rb")).where("__l is not null or __r is not null")
    d = F.least(F.col("__p") - F.col("__l"), F.col("__r") - F.col("__p"))
    d = F.least(d, F.lit(cap)) if cap is not None else d
    return out.withColumn("dist", d).drop("__p", "__t", "__l", "__r", "__b", "__lb", "__rb")


def near_pairs(genes: DataFrame, breaks: DataFrame, reach: int) -> DataFrame:
    """gene, cell, d: distance from each gene's middle to the cell's nearest breakpoint on its chromosome, for pairs within ``reach``.

    Places and middles meet in bins of the reach, a middle in its own and both neighbours. A cell's places in one
    bin go as an array through a search by halving.
    """
    mid = F.floor((F.col("gs") + F.col("ge")) / 2).cast("long")
    g = genes.select("gene", "chrom", mid.alias("mid")).withColumn("__b", F.explode(F.array(*[F.floor(F.col("mid") / reach) + i for i in (-1, 0, 1)])))
    inside = breaks.withColumn("__b", F.floor(F.col("pos") / reach)).groupBy("cell", "chrom", "__b").agg(F.array_sort(F.collect_set("pos")).alias("__p"))  # distinct places within a bin: bounded by its width
    halves = F.filter(F.array(*[F.lit(1 << i) for i in reversed(range(reach.bit_length()))]), lambda s: s <= F.size("__p"))
    below = F.aggregate(halves, F.lit(0), lambda at, s: at + F.when(F.get("__p", at + s - 1) <= F.col("mid"), s).otherwise(0))
    near = g.join(inside, ["chrom", "__b"]).withColumn("__i", below)
    d = F.least(F.col("mid") - F.get("__p", F.col("__i") - 1), F.get("__p", F.col("__i")) - F.col("mid"))
    return near.select("gene", "cell", d.alias("d")).where(F.col("d") <= reach).groupBy("gene", "cell").agg(F.min("d").alias("d"))


def gene_distances(genes: DataFrame, breaks: DataFrame, cap: int = 5_000_000) -> DataFrame:
    """gene, cell, dist: from each gene's middle to the cell's nearest breakpoint on its chromosome, capped.

    Only cells with a breakpoint on the chromosome appear. The pairs of a cell and chromosome without a close
    breakpoint get the cap: the full grid of genes and cells is the result's size.
    """
    grid = genes.select("gene", "chrom").join(breaks.select("cell", "chrom").distinct(), "chrom")
    near = near_pairs(genes, breaks, cap)
    return grid.join(near, ["gene", "cell"], "left").select("gene", "cell", F.least(F.coalesce("d", F.lit(cap)), F.lit(cap)).alias("dist"))


def neighbours(breaks: DataFrame, bin_size: int = 10_000_000) -> DataFrame:
    """Each breakpoint (cell, chrom, pos) with the next one of its cell, chrom2 and pos2, in order of chromosome and place.

    The next is looked for in the bin of the place; the last of a bin gets the first of the bins behind, from one row a bin.
    """
    b = breaks.withColumn("__b", F.floor(F.col("pos") / bin_size))
    inside = Window.partitionBy("cell", "chrom", "__b").orderBy("pos")
    over = Window.partitionBy("cell").orderBy("chrom", "__b")
    first = b.groupBy("cell", "chrom", "__b").agg(F.min("pos").alias("__first")).select("cell", "chrom", "__b", F.lead("chrom").over(over).alias("__nc"), F.lead("__first").over(over).alias("__np"))
    x = b.withColumn("__here", F.lead("pos").over(inside)).join(first, ["cell", "chrom", "__b"])
    return x.select("cell", "chrom", "pos", F.when(F.col("__here").isNotNull(), F.col("chrom")).otherwise(F.col("__nc")).alias("chrom2"), F.coalesce("__here", "__np").alias("pos2"))


def map_fallback(df: DataFrame, key: str, mapping: DataFrame, source: str, target: str, order: str) -> DataFrame:
    """``key`` mapped where a mapping exists, itself elsewhere; of repeated mappings the last by ``order`` holds."""
    last = mapping.where(F.col(source).isNotNull()).groupBy(F.col(source).alias(key)).agg(F.max_by(target, order).alias("__to"))
    return df.join(last, key, "left").withColumn("mapped", F.coalesce("__to", key)).drop("__to")


def prefix_match(df: DataFrame, key: str, names: DataFrame, name: str) -> DataFrame:
    """key -> the shortest name that equals it or begins with it and an underscore, then the first by letter."""
    heads = F.transform(F.split(name, "_"), lambda w, i: F.array_join(F.slice(F.split(name, "_"), 1, i + 1), "_"))
    by_head = names.select(name, F.explode(F.array_distinct(heads)).alias(key)).groupBy(key).agg(F.min(F.struct(F.length(name).alias("n"), F.col(name).alias("m"))).alias("__x"))
    return df.join(by_head, key).select(*df.columns, F.col("__x.m").alias("match"))


def map_cascade(df: DataFrame, key: str, ids: DataFrame, exact: DataFrame, names: DataFrame) -> DataFrame:
    """Name by id table, else by exact name, else by prefix; ``how`` says which."""
    a = df.join(ids.toDF(key, "__a"), key, "left").join(exact.toDF("__b").withColumn(key, F.col("__b")), key, "left")
    p = prefix_match(df.select(key).distinct(), key, names.toDF("__n"), "__n").withColumnRenamed("match", "__c")
    out = a.join(p, key, "left").withColumn("mapped", F.coalesce("__a", "__b", "__c"))
    return out.withColumn("how", F.when(F.col("__a").isNotNull(), "id").when(F.col("__b").isNotNull(), "exact").when(F.col("__c").isNotNull(), "prefix")).drop("__a", "__b", "__c")


def region_lookup(pairs: DataFrame, regions: DataFrame, flank: int = 1_000_000) -> DataFrame:
    """Breakend pairs with either end within ``flank`` of a region (columns chrom, gs, ge), with the region's columns."""
    ends = pairs.select("*", F.explode(F.array(F.struct(F.col("chrom1").alias("chrom"), F.col("start1").alias("p")), F.struct(F.col("chrom2").alias("chrom"), F.col("start2").alias("p")))).alias("__e")).select(
        *pairs.columns, F.col("__e.chrom").alias("chrom"), F.col("__e.p").alias("__p"), (F.col("__e.p") + 1).alias("__q")
    )
    wide = regions.withColumn("__s", F.greatest(F.lit(0), F.col("gs") - flank)).withColumn("__t", F.col("ge") + flank)
    return interval_join(ends, wide, ["chrom"], "__p", "__q", "__s", "__t").drop("chrom", "__p", "__q", "__s", "__t", "gs", "ge").distinct()
