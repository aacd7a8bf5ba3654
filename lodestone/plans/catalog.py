"""Named queries over the driver's tables, each with the SQL that must agree with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import answer_queries, build_queries, engine_queries, graph_queries, job_queries, search_queries, store_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grounded answers to the benchmark's questions over the documents, by hybrid search."""
    return QUERIES["q18_answer"](spark, sf_dir)
