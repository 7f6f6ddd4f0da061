"""Covered stretches and holes of intervals, by compressed run bitmaps.

Each base is one bit. The bits of an entity are cut into shards of ``2 ** shard_bits`` bases, and a
shard's bitmap is kept as its set runs (two int arrays). Every input partition first unites its own
segments to one bitmap for each entity and shard, so repeated and nested segments vanish before the
shuffle; the bitmaps of one entity and shard are then united in a sorted stream. Set runs and clear
runs come from neighbouring runs, and over shard borders from one row per shard.

A segment that fills many shards leaves its whole shards to a second level, whose bases are shards; so even a broken row with a
huge end makes a bounded number of pieces.

A hot entity is spread over its shards; a hot shard costs at most one bitmap per input partition. No
group is held in memory: the stream carries the one bitmap that is open. What crosses shard borders is settled by a window
with one row per shard of an entity.

Defined results: a row with a null key or bound, or with end <= start, covers nothing; touching
segments make one stretch; repeated rows change nothing; an empty table gives no stretch and no hole;
further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_BITS = 24
FEW = 4  # shards that a segment is cut into one by one


def _union(shard_size: int):
    """mapInArrow function over rows sorted by the key columns and shard; the last two columns are
    run starts and run ends, as numbers or lists of numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None
        schema = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = batch.columns[:-2]
            s, e = batch.columns[-2], batch.columns[-1]
            if pa.types.is_list(s.type):
                sizes = np.diff(s.offsets.to_numpy())
                row = np.repeat(np.arange(batch.num_rows), sizes)
                s, e = s.flatten().to_numpy(), e.flatten().to_numpy()
            else:
                row = np.arange(batch.num_rows)
                s, e = s.to_numpy(), e.to_numpy()
            names = batch.schema.names
            if carry is not None:
                old = carry.columns[-2].combine_chunks()
                n_old = len(old.flatten())
                keys = [pa.concat_arrays([carry.columns[i].combine_chunks(), k]) for i, k in enumerate(keys)]
                s = np.concatenate([old.flatten().to_numpy(), s])
                e = np.concatenate([carry.columns[-1].combine_chunks().flatten().to_numpy(), e])
                row = np.concatenate([np.zeros(n_old, dtype=np.int64), row + 1])
            new = np.zeros(len(keys[0]), dtype=bool)
            new[0] = True
            for k in keys:
                code = k.dictionary_encode().indices.to_numpy()
                new[1:] |= code[1:] != code[:-1]
            group = np.cumsum(new) - 1
            first = np.flatnonzero(new)
            base = group[row].astype(np.int64) * (2 * shard_size)
            lo, hi = base + s, base + e
            order = np.argsort(lo, kind="stable")
            lo, hi = lo[order], np.maximum.accumulate(hi[order])
            start = np.ones(len(lo), dtype=bool)
            start[1:] = lo[1:] > hi[:-1]
            at = np.flatnonzero(start)
            run_lo, run_hi = lo[at], hi[np.append(at[1:], len(lo)) - 1]
            owner = run_lo // (2 * shard_size)
            offsets = np.searchsorted(owner, np.arange(len(first) + 1)).astype(np.int32)
            shift = owner * (2 * shard_size)
            take = pa.array(first)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array((x - shift).astype(np.int32))) for x in (run_lo, run_hi)]
            out = pa.table([k.take(take) for k in keys] + lists, names=names)
            schema = out.schema
            carry = out.slice(out.num_rows - 1)
            if out.num_rows > 1:
                yield from out.slice(0, out.num_rows - 1).to_batches()
        if carry is not None:
            yield from carry.cast(schema).combine_chunks().to_batches()

    return run


def run_bitmaps(df: DataFrame, keys: dict[str, Column], start: Column, end: Column, shard_bits: int = SHARD_BITS) -> DataFrame:
    """One row per entity, level and shard: the keys, ``level``, ``shard``, and the set runs ``starts``/``ends`` inside it."""
    size = 1 << shard_bits
    names = [*keys, "level", "shard"]
    rows = df.select(*[c.alias(k) for k, c in keys.items()], start.cast("long").alias("__s"), end.cast("long").alias("__e"))
    ok = (F.col("__e") > F.col("__s"))
    for k in keys:
        ok = ok & F.col(k).isNotNull()
    a, z = F.shiftright("__s", shard_bits), F.shiftright(F.col("__e") - 1, shard_bits)
    whole = z - a > FEW  # then only the first and last shard are cut, and those between are one segment of level 1
    edge = lambda level, s, e: F.struct(F.lit(level).alias("level"), s.alias("s"), e.alias("e"))
    pieces = F.when(whole, F.array(
        edge(0, F.col("__s"), (a + 1) * size), edge(1, a + 1, z), edge(0, z * size, F.col("__e")),
    )).otherwise(F.array(edge(0, F.col("__s"), F.col("__e"))))
    cut = (
        rows.where(ok).select(*keys, F.explode(pieces).alias("__x")).select(*keys, "__x.*")
        .withColumn("shard", F.explode(F.sequence(F.shiftright("s", shard_bits), F.shiftright(F.col("e") - 1, shard_bits))))
        .select(
            *names,
            (F.greatest(F.col("s"), F.col("shard") * size) - F.col("shard") * size).cast("int").alias("starts"),
            (F.least(F.col("e"), (F.col("shard") + 1) * size) - F.col("shard") * size).cast("int").alias("ends"),
        )
    )
    types = dict(cut.dtypes)
    out = ", ".join([f"`{n}` {types[n]}" for n in names] + ["starts array<int>", "ends array<int>"])
    local = cut.sortWithinPartitions(*names).mapInArrow(_union(size), out)
    return local.repartition(*names).sortWithinPartitions(*names).mapInArrow(_union(size), out)


def _rows(bitmaps: DataFrame, keys: Sequence[str], shard_bits: int) -> DataFrame:
    """The runs in absolute places, a row per shard (``at``: its begin) or run of shards, with ``reach``: the furthest end of all rows before."""
    size = 1 << shard_bits
    near = bitmaps.where("level = 0").select(*keys, F.lit(1).alias("kind"), (F.col("shard") * size).alias("at"), *[F.transform(c, lambda x: x + F.col("shard") * size).alias(c) for c in ("starts", "ends")])
    far = bitmaps.where("level = 1").select(*keys, F.col("shard"), F.explode(F.arrays_zip("starts", "ends")).alias("r"))
    place = lambda x: (x + F.col("shard") * size) * size
    far = far.select(*keys, F.lit(0).alias("kind"), place(F.col("r.starts")).alias("at"), F.array(place(F.col("r.starts"))).alias("starts"), F.array(place(F.col("r.ends"))).alias("ends"))
    w = Window.partitionBy(*keys).orderBy("at", "kind")
    return near.unionByName(far).withColumn("reach", F.max(F.element_at("ends", -1)).over(w.rowsBetween(Window.unboundedPreceding, -1)))


def _prev() -> Column:
    """Of each run of a row: the furthest end before it, null for the entity's first run."""
    return F.transform("starts", lambda s, i: F.when(i == 0, F.col("reach")).otherwise(F.greatest(F.col("reach"), F.get("ends", i - 1))))


def clear_runs(bitmaps: DataFrame, keys: Sequence[str], shard_bits: int = SHARD_BITS) -> DataFrame:
    """Holes between the first and last covered base: the keys, ``gap_start``, ``gap_end``."""
    runs = _rows(bitmaps, keys, shard_bits).select(*keys, F.explode(F.arrays_zip("starts", _prev().alias("prev"))).alias("r"))
    return runs.where(F.col("r.prev") < F.col("r.starts")).select(*keys, F.col("r.prev").alias("gap_start"), F.col("r.starts").alias("gap_end"))


def set_runs(bitmaps: DataFrame, keys: Sequence[str], shard_bits: int = SHARD_BITS) -> DataFrame:
    """Continuous covered stretches: the keys, ``start``, ``end``. A stretch ends where the run before the next one's begin did."""
    w = Window.partitionBy(*keys).orderBy("at", "kind")
    fresh = F.filter(F.arrays_zip("starts", _prev().alias("prev")), lambda r: r["prev"].isNull() | (r["prev"] < r["starts"]))
    rows = _rows(bitmaps, keys, shard_bits).withColumn("fresh", fresh)
    behind = w.rowsBetween(1, Window.unboundedFollowing)
    # the first fresh run behind tells where the last stretch of this row ends; without one it ends at the entity's end
    rows = rows.withColumn("last", F.coalesce(
        F.first(F.when(F.size("fresh") > 0, F.element_at("fresh", 1)["prev"]), ignorenulls=True).over(behind),
        F.max(F.element_at("ends", -1)).over(Window.partitionBy(*keys)),
    ))
    ended = F.transform("fresh", lambda r, i: F.struct(r["starts"].alias("start"), F.coalesce(F.get("fresh", i + 1)["prev"], F.col("last")).alias("end")))
    return rows.where(F.size("fresh") > 0).select(*keys, F.explode(ended).alias("r")).select(*keys, "r.start", "r.end")


def chromosome(c: Column) -> Column:
    """``chr1``..``chr22``, ``chrX``, ``chrY`` for any spelling; null for anything else."""
    bare = F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    bare = F.regexp_replace(F.regexp_replace(bare, "^(CHROMOSOME|CHROM|CHR)", ""), "^0+", "")
    return F.when(bare.rlike("^([1-9]|1[0-9]|2[0-2]|X|Y)$"), F.concat(F.lit("chr"), bare))
