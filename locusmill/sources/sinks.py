"""Sinks: tables as CSV or parquet, one folder per key, BEDPE, JSON metrics, text reports, audits, and a cache by settings."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, sep: str = ",", header: bool = True) -> None:
    df.write.mode("overwrite").option("header", header).option("sep", sep).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def parquet(df: DataFrame, path: str, sidecar: bool = False) -> None:
    """Parquet, and the same rows as CSV beside it if asked for."""
    df.write.mode("overwrite").parquet(path)
    if sidecar:
        csv(df.sparkSession.read.parquet(path), path.removesuffix(".parquet") + ".csv")


def by_key(df: DataFrame, path: str, key: str) -> None:
    """A folder per key, each with few files: rows are rebalanced by key, and the adaptive planner splits a hot key over several tasks."""
    df.hint("rebalance", key).write.mode("overwrite").partitionBy(key).parquet(path)


def cached(spark: SparkSession, folder: str, settings: Mapping[str, object], make: Callable[[], DataFrame]) -> DataFrame:
    """The table made under these settings before, or made and written now; other settings are another table."""
    mark = hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]
    path = f"{folder.rstrip('/')}/cache-{mark}.parquet"
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.mode("errorifexists").parquet(path)
        return spark.read.parquet(path)


def audit(sides: Mapping[str, DataFrame], key: str) -> DataFrame:
    """Which keys each side holds, and which all hold: side, key. Nulls are none."""
    every = None
    for name, df in sides.items():
        one = df.select(F.lit(name).alias("side"), F.col(key).cast("string").alias("key")).where("key is not null").distinct()
        every = one if every is None else every.unionByName(one)
    common = every.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(sides)).select(F.lit("all").alias("side"), "key")
    return every.unionByName(common)


def bedpe(df: DataFrame, path: str) -> None:
    csv(df.select("chrom1", "start1", "end1", "chrom2", "start2", "end2", "svtype", "score", "strand1", "strand2", "cell_line", "info"), path, "\t", False)


def metrics(df: DataFrame, path: str) -> None:
    """Each row as a JSON line."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def report(metrics_row: DataFrame, title: str, sections: Mapping[str, DataFrame] | None = None, rows: int = 20) -> str:
    """Text of a one-row table of metrics, and of the first ``rows`` rows of further tables; no more comes to the driver."""
    row = metrics_row.limit(1).collect()
    lines = [title, "=" * len(title), *(f"{k}: {v}" for k, v in (row[0].asDict() if row else {}).items())]
    for name, df in (sections or {}).items():
        held = df.limit(rows).collect()
        lines += ["", name, "-" * len(name), "\t".join(df.columns), *("\t".join(str(v) for v in r) for r in held)]
    return "\n".join(lines)
