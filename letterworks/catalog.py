"""All registered queries of the engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from letterworks.plans import import_queries, report_queries, review_queries, search_queries, stream_queries, text_queries  # noqa: F401  (they register their queries)
from letterworks.plans.registry import ORACLES, QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_queries.flagship(spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict:
    return dict(ORACLES)
