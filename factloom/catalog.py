"""The queries of the library's own operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .operators import archive, crawl, discovery, enrichment, evidence, ordering, record_queries, records, refresh, shapes, snapshots
from .plans import relational
from .streaming import jobs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return relational.queries() | evidence.queries() | records.queries() | record_queries.queries() | discovery.queries() | crawl.queries() | snapshots.queries() | ordering.queries() | archive.queries() | enrichment.queries() | refresh.queries() | shapes.queries() | jobs.queries()


def oracle_sql() -> dict[str, str]:
    return relational.oracle_sql() | evidence.oracle_sql() | records.oracle_sql() | record_queries.oracle_sql() | discovery.oracle_sql() | crawl.oracle_sql() | snapshots.oracle_sql() | archive.oracle_sql() | enrichment.oracle_sql() | refresh.oracle_sql() | shapes.oracle_sql() | jobs.oracle_sql()
