"""Session helpers: builder for tests and bench, tables written to the shared folder, size-checked broadcast."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 8 << 20  # largest table file size that is broadcast
BROADCAST_ROWS = 500_000
_WRITTEN: dict[str, set[str]] = {}  # tables of each application that are still there


def get_spark(cores: str = "*", partitions: int = 8) -> SparkSession:
    """Session on one machine, so its folder for written tables may lie there too."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("locusmill")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Only a session whose tasks run in
    the driver's own process may do without; it gets a scratch folder."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not context.master.partition("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def cut(df: DataFrame, after: DataFrame | None = None) -> DataFrame:
    """The rows written as a table to the shared folder, and read from there: lineage ends, lost executors
    cost nothing, and later steps read only the columns they need. Runs a job.

    ``after``: a table of an earlier call that nothing needs any more; it is removed.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written = path
    _WRITTEN.setdefault(spark.sparkContext.applicationId, set()).add(path)
    if after is not None:
        remove(after)
    return out


def remove(df: DataFrame) -> None:
    """Deletes the table behind a result of ``cut``; anything else is left alone."""
    if path := df.__dict__.get("written"):
        _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    files, p = _path(spark, path)
    files.delete(p, True)
    _WRITTEN.get(spark.sparkContext.applicationId, set()).discard(path)


def remove_all(spark: SparkSession) -> None:
    """Deletes every table that ``cut`` wrote in this application. For callers who have written or shown their results."""
    for path in list(_WRITTEN.get(spark.sparkContext.applicationId, ())):
        _delete(spark, path)


def small(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows; reads no more rows than that. Runs a job."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only behind a checked size in bytes and rows; otherwise the join stays to the adaptive planner.

    The table is written first (unless it already is), so what leads to it runs once.
    """
    kept = df if df.__dict__.get("written") else cut(df)
    files, p = _path(kept.sparkSession, kept.written)
    if files.getContentSummary(p).getLength() > max_bytes or kept.count() > max_rows:
        return kept
    return F.broadcast(kept)
