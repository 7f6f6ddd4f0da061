"""Queries p1, p2, p7, p8 and p9 over the given tables, with SQL where it can state the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusmill.llm import leaks, names, percentiles, pii, tokens
from locusmill.sources.tables import table


def _typed(spark: SparkSession, d: str) -> DataFrame:
    cnv = table(spark, d, "cnv").select(F.lit("cnv").alias("table_name"), F.col("seg_id").alias("row_id"), F.col("ModelID").alias("value"))
    dep = table(spark, d, "dependency").select(F.lit("dependency").alias("table_name"), F.col("dep_id").alias("row_id"), F.col("cell_line").alias("value"))
    return names.map_values(cnv.unionByName(dep), "value", table(spark, d, "depmap_model_map"), "CCLE_name", "DepMap_ID")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _typed(spark, d).select("table_name", "row_id", F.col("DepMap_ID").alias("depmap_id"))


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return names.unmatched(_typed(spark, d), "value", "DepMap_ID", "table_name")


SCORES = ("pred_structural", "dependency")
PROBS = (0.5, 0.9, 0.99)


def _scores(spark: SparkSession, d: str, *keep: str) -> DataFrame:
    return percentiles.long_values(table(spark, d, "dependency_corrected"), "gene", SCORES, *keep)


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    found = percentiles.percentiles(_scores(spark, d), PROBS)
    return found.select(
        F.col("grp").alias("gene"), F.col("col").alias("field"), "p", F.col("total").alias("n"), "rank", F.col("v").alias("value"), F.lit(0.0).alias("error_bound")
    )


def p2_days(spark: SparkSession, d: str) -> DataFrame:
    """Per day: rows below and at the percentiles of all days."""
    values = _scores(spark, d, "scored_on")
    found = percentiles.day_ranks(values, percentiles.percentiles(values, PROBS), "scored_on")
    return found.select(F.col("scored_on").cast("string").alias("scored_on"), F.col("grp").alias("gene"), F.col("col").alias("field"), "p", F.col("answer").alias("value"), "n", "below", "at")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.with_ids(table(spark, d, "documents"))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.places(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find(_leaks(spark, d)).select("doc_id", "item_id")


def p8_places(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d)


def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Leaked passages and questions with the number of their mails and their longest run."""
    return _leaks(spark, d).groupBy("item_id", "field").agg(F.countDistinct("doc_id").alias("mails"), F.max("words").alias("longest"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(table(spark, d, "documents")).select("doc_id", "kind", "start_pos")


def p9_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "documents"))


QUERIES = {
    f.__name__: f for f in (p1_found, p1_unmatched, p2_percentiles, p2_days, p7_ids, p8_found, p8_places, p8_items, p9_found, p9_redacted)
}

_RANKED = """
WITH v AS (SELECT scored_on, gene, 'pred_structural' AS field, pred_structural AS x FROM dependency_corrected
           UNION ALL SELECT scored_on, gene, 'dependency', dependency FROM dependency_corrected),
ok AS (SELECT * FROM v WHERE x IS NOT NULL AND NOT isnan(x)),
r AS (SELECT gene, field, x, row_number() OVER (PARTITION BY gene, field ORDER BY x) AS i, count(*) OVER (PARTITION BY gene, field) AS n FROM ok),
q AS (SELECT r.gene, r.field, q.p::DOUBLE AS p, n, i AS rank, x AS value FROM r, (VALUES (50, 0.5), (90, 0.9), (99, 0.99)) q(c, p)
      WHERE i = greatest(1, (q.c * n + 99) // 100))
"""

SQL = {
    "p2_percentiles": _RANKED + "SELECT gene, field, p, n, rank, value, 0.0::DOUBLE AS error_bound FROM q",
    "p2_days": _RANKED + """SELECT ok.scored_on::VARCHAR AS scored_on, ok.gene, ok.field, q.p, q.value, count(*) AS n,
        count(*) FILTER (ok.x < q.value) AS below, count(*) FILTER (ok.x = q.value) AS at
        FROM ok JOIN q ON ok.gene IS NOT DISTINCT FROM q.gene AND ok.field = q.field GROUP BY ALL""",
}
