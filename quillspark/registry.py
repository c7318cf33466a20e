"""Queries over the driver's tables, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.plans import catalog_documents, catalog_records, catalog_search, catalog_sources

Query = Callable[[SparkSession, str], DataFrame]
CATALOGS = [catalog_search, catalog_documents, catalog_sources, catalog_records]


def queries() -> dict[str, Query]:
    return {k: f for c in CATALOGS for k, f in c.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for c in CATALOGS for k, s in c.SQL.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_search.flagship(spark, sf_dir)
