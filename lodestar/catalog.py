"""The registered queries of the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.plans import answers, datasets, files, registry, releases, reports, routes, rows, spaces, texts  # noqa: F401  (they register their queries)

QUERIES = registry.QUERIES
ORACLE_SQL = registry.ORACLE_SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route scores of all runs."""
    return routes.route_score(spark, sf_dir)
