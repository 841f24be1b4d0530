"""All queries of the evaluation's operators by name, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spanlab.plans import chunk_queries, retrieval_queries, rule_queries, span_queries, stat_queries, structure_queries  # noqa: F401
from spanlab.plans.tables import ORACLES, QUERIES
from spanlab.session import release, ship


def _shipped(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        release()  # what the queries before kept
        return build(ship(spark), sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _shipped(build) for name, build in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
