"""Registration of queries with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a function (spark, folder) -> DataFrame under its name."""

    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            SQL[name or f.__name__] = sql
        return f

    return keep


def q(x: str) -> str:
    """The SQL twin of functions.quant.q6."""
    return f"CASE WHEN NOT isnan(CAST({x} AS DOUBLE)) THEN floor(CAST({x} AS DOUBLE) * 1e6 + 0.5) / 1e6 END"


def q20(x: str) -> str:
    """The SQL twin of functions.quant.q20."""
    return f"floor(({x}) * 1048576.0::DOUBLE + 0.5::DOUBLE) / 1048576.0::DOUBLE"


def drawn_sql(seed: int, *keys: str) -> str:
    """The SQL twin of operators.controls.drawn."""
    out = f"CAST({seed * 97 + 13} AS BIGINT)"
    for k in keys:
        out = f"(({out} * 48271 + ({k} % 2147483647) * 40503 + 11) % 2147483647)"
    return f"(({out} * 48271) % 2147483647)"


_TEXT = "regexp_replace(lower({0}), '\\s+', ' ', 'g')"


def _unit_sql(c: str) -> str:
    """Unit of one text by regular expressions, in the order of the more telling words."""
    t = _TEXT.format(c)
    return (
        f"CASE WHEN {c} IS NULL THEN NULL"
        f" WHEN regexp_matches({t}, 'log2p1|(lg2|log2|binary log).*(\\+ ?1|1 ?\\+|one plus)') THEN 'log2_ratio_plus_1'"
        f" WHEN regexp_matches({t}, 'log|lg2|l2r') THEN 'log2_ratio'"
        f" WHEN regexp_matches({t}, 'hundredths|centicop|ccn|x100|times 100|by 100|1/100|0\\.01') THEN 'hundredths'"
        f" WHEN regexp_matches({t}, '%|pct|per ?cent') THEN 'percent'"
        f" WHEN regexp_matches({t}, 'ratio|t/n|fold|x diploid|rel\\.|relative') THEN 'ratio'"
        f" WHEN regexp_matches({t}, 'cop(y|ies)|\\babs') THEN 'absolute' END"
    )


def units_sql(t: str, row_id: str, value: str, texts: list[str]) -> str:
    said = ", ".join(_unit_sql("t." + c) for c in texts)
    return (
        f"SELECT '{t}' AS table_name, t.{row_id} AS row_id, t.{value} AS v, coalesce({said}, s.unit, 'unknown') AS unit"
        f" FROM {t} t LEFT JOIN (SELECT source, min({_unit_sql('readme')}) AS unit FROM data_sources GROUP BY source) s ON t.source = s.source"
    )


def copies_sql(v: str) -> str:
    """The SQL twin of operators.units.to_copies for a row with its unit."""
    return (
        f"CASE unit WHEN 'absolute' THEN {v} WHEN 'log2_ratio' THEN 2 * pow(2, {v}) WHEN 'log2_ratio_plus_1' THEN 2 * pow(2, {v}) - 2"
        f" WHEN 'ratio' THEN 2 * {v} WHEN 'percent' THEN 0.02::DOUBLE * {v} WHEN 'hundredths' THEN 0.01::DOUBLE * {v} END"
    )
