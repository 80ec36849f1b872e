"""The registered queries, gathered from the families of operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pagemill.plans import coverage_queries, evidence_queries, export_queries, linkage_queries, more_queries, relational_queries, relational_sql, source_queries, state_queries, target_queries, text_queries, url_queries

FLAGSHIP = "f1_canonical_url"
FAMILIES = (
    (url_queries.QUERIES, url_queries.SQL),
    (relational_queries.QUERIES, relational_sql.SQL),
    (text_queries.QUERIES, text_queries.SQL),
    (linkage_queries.QUERIES, linkage_queries.SQL),
    (source_queries.QUERIES, source_queries.SQL),
    (more_queries.QUERIES, more_queries.SQL),
    (export_queries.QUERIES, export_queries.SQL),
    (evidence_queries.QUERIES, evidence_queries.SQL),
    (state_queries.QUERIES, state_queries.SQL),
    (target_queries.QUERIES, target_queries.SQL),
    (coverage_queries.QUERIES, coverage_queries.SQL),
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: q for found, _ in FAMILIES for k, q in found.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for _, found in FAMILIES for k, q in found.items()}
