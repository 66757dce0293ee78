"""The registered queries of the engine's own operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vellumine.plans import bookfiles, books, candidates, catalogue, documents, fb2, markdown, pages, streams, text, trees

_PLANS = (text, catalogue, documents, books, markdown, trees, bookfiles, fb2, pages, candidates, streams)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of the books that the conversations make."""
    return text.book_headings(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for plan in _PLANS for name, sql in plan.SQL.items()}
