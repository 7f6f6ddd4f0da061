"""References to records that are missing, removed, or not there yet.

The keys of parents and references are cut into ranges of the key's order. Each range is one task's
partition: its parents come first and lie in the task as arrays sorted by the 64-bit hash of their key,
and batches of references are probed by vectorised binary search; a hit is settled by the text of the key.

Keys that hold more references than a range should are found by a frequent-items sketch (one pass, no shuffle of
keys, a bounded list), and only those are salted: the references of such a key are spread over as many
tasks as its share calls for, each with a copy of that key's parents.

Defined results: a null reference refers to nothing and is no miss; a key with several validity
periods is held if any of them covers the time; before the first it is late, otherwise deleted; a
null ``added_on`` means ever since, a null ``removed_on`` still valid; a reference without a time is
only checked for ``missing``, its period is null; empty parents make every reference missing, empty
references give no rows; repeated references are reported each; keys may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusmill.session import cut

RANGE_ROWS = 50_000
MIN, MAX = -(1 << 62), 1 << 62
OUT = "table_name string, row_id long, field string, t long, reason string"


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one range, parents first: is_ref, hash, key, t, removed, table_name, row_id, field."""
    parts: list[pa.RecordBatch] = []
    held = None
    for batch in batches:
        n = pc.sum(batch.column("is_ref")).as_py() or 0
        if n < batch.num_rows:
            parts.append(batch.slice(0, batch.num_rows - n).select(["hash", "key", "t", "removed"]))
        if not n:
            continue
        if held is None:
            held = pa.Table.from_batches(parts or [batch.slice(0, 0).select(["hash", "key", "t", "removed"])]).combine_chunks().sort_by("hash")
            hashes, added, removed = (held.column(c).to_numpy() for c in ("hash", "t", "removed"))
            keys = held.column("key").combine_chunks()
        refs = batch.slice(batch.num_rows - n)
        probe, key = refs.column("hash").to_numpy(), refs.column("key")
        t = pc.fill_null(refs.column("t"), MAX).to_numpy(zero_copy_only=False)
        lo, hi = (np.searchsorted(hashes, probe, side) for side in ("left", "right"))
        known, valid = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        earliest = np.full(n, MAX, dtype=np.int64)
        for step in range(int((hi - lo).max(initial=0))):
            row = np.flatnonzero(lo + step < hi)
            at = (lo + step)[row]
            same = np.asarray(pc.equal(keys.take(pa.array(at)), key.take(pa.array(row))))
            row, at = row[same], at[same]
            known[row] = True
            valid[row] |= (added[at] <= t[row]) & (t[row] < removed[at])
            earliest[row] = np.minimum(earliest[row], added[at])
        valid |= known & pc.is_null(refs.column("t")).to_numpy(zero_copy_only=False)
        miss = np.flatnonzero(~valid)
        if len(miss):
            reason = np.where(~known, "missing", np.where(t < earliest, "late", "deleted"))[miss]
            out = refs.take(pa.array(miss))
            yield pa.RecordBatch.from_arrays([*(out.column(c) for c in ("table_name", "row_id", "field", "t")), pa.array(reason, pa.string())], names=["table_name", "row_id", "field", "t", "reason"])


def hot_keys(refs: DataFrame, tasks: int) -> list[tuple[str, int]]:
    """Keys with more than a task's share of the references, and the number of tasks they need: at most ``tasks`` keys. Runs a job."""
    k = min(tasks, 5000)
    found = refs.agg(F.count("key").alias("n"), F.expr(f"approx_top_k(key, {k}, {20 * k})").alias("top")).first()
    share = -(-found["n"] // tasks) or 1
    return [(x["item"], -(-x["count"] // share)) for x in found["top"] or () if x["count"] > share]


def orphans(refs: DataFrame, parents: DataFrame, range_rows: int = RANGE_ROWS, tasks: int | None = None) -> DataFrame:
    """refs: table_name, row_id, field, space, key, loaded_at. parents: space, key, added_on, removed_on.

    ``space`` keeps the keys of different parent tables apart. Returns table_name, row_id, field,
    period (YYYY-MM of loaded_at), reason. There are ``tasks`` ranges (the session's shuffle partitions), and more where
    those would hold over ``range_rows`` parents each. Writes the parents and counts them; looks for hot keys in one job.
    """
    spark = refs.sparkSession
    key = F.concat_ws("\u0001", "space", "key")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    held = cut(
        parents.where(F.col("key").isNotNull())
        .select(key.alias("key"), F.coalesce(micros("added_on"), F.lit(MIN)).alias("t"), F.coalesce(micros("removed_on"), F.lit(MAX)).alias("removed")).distinct()
    )
    tasks = max(tasks or int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held.count() // range_rows))
    asked = refs.where(F.col("key").isNotNull()).select(key.alias("key"), micros("loaded_at").alias("t"), "table_name", F.col("row_id").cast("long").alias("row_id"), "field")
    hot = F.broadcast(spark.createDataFrame(hot_keys(asked.select("key"), tasks), "key string, salts long"))  # at most ``tasks`` rows
    none = lambda t: F.lit(None).cast(t)
    left = held.join(hot, "key", "left").select(
        "key", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts") - 1, F.lit(0)).cast("int"))).alias("salt"), F.lit(0).alias("is_ref"), F.xxhash64("key").alias("hash"), "t", "removed",
        none("string").alias("table_name"), none("long").alias("row_id"), none("string").alias("field"),
    )
    right = asked.join(hot, "key", "left").select(
        "key", F.coalesce(F.pmod(F.xxhash64("table_name", "row_id", "field"), "salts"), F.lit(0)).cast("int").alias("salt"), F.lit(1).alias("is_ref"), F.xxhash64("key").alias("hash"), "t",
        none("long").alias("removed"), "table_name", "row_id", "field",
    )
    found = (
        left.unionByName(right).repartitionByRange(tasks, "key", "salt").sortWithinPartitions("is_ref")
        .select("is_ref", "hash", "key", "t", "removed", "table_name", "row_id", "field").mapInArrow(_probe, OUT)
    )
    return found.select("table_name", "row_id", "field", F.date_format(F.timestamp_micros("t"), "yyyy-MM").alias("period"), "reason")


def report(misses: DataFrame) -> DataFrame:
    """Misses per table, field, period and reason."""
    return misses.groupBy("table_name", "field", "period", "reason").agg(F.count("*").alias("n"))
