"""All queries of the reference's operators, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorespan.plans import chunks, evaluation, evidence, graph, lifecycle, parsing, relational, retrieval, search, text, views

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (chunks, evaluation, evidence, graph, lifecycle, parsing, relational, retrieval, search, text, views)


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, (q, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.search_hybrid(spark, sf_dir)
