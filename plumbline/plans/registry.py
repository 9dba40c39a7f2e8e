"""Every registered query of the engine, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators import aggregates, filters, questions

from . import evidence_queries, fact_queries, graph_queries, index_queries, mesh_queries, question_queries, relational_queries, scalar_queries, threshold_queries
from .views import elements


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return scalar_queries.Q | relational_queries.Q | evidence_queries.Q | graph_queries.Q | index_queries.Q | fact_queries.Q | mesh_queries.Q | threshold_queries.Q | question_queries.Q


def oracle_sql() -> dict[str, str]:
    return scalar_queries.SQL | relational_queries.SQL | evidence_queries.SQL | graph_queries.SQL | index_queries.SQL | fact_queries.SQL | mesh_queries.SQL | threshold_queries.SQL | question_queries.SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question end to end: parse it, filter elements by what it says, count by storey."""
    question = spark.createDataFrame([("quantos elementos por piso com altura maior que 10 m?",)], "q string")
    asked = questions.asked(question, "q").first()["asked"]
    rows = elements(spark, sf_dir)
    for field, op, value in asked["conditions"]:
        rows = rows.where(filters.numeric_filter([field], op, value))
    return aggregates.buckets(rows, asked["agg_field"] or "ifc_class")
