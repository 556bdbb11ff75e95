"""Named queries over a directory of tables, with their equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from neurolith.plans import experiment_queries, model_queries, signal_queries, table_queries, text_queries, upkeep_queries

PARTS = (signal_queries, model_queries, experiment_queries, text_queries, table_queries, upkeep_queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leave-one-group-out confusion matrix of the prototype classifier."""
    return model_queries.confusion_matrix(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for part in PARTS for k, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for part in PARTS for k, s in part.SQL.items()}
