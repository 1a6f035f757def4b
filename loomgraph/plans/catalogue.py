"""Named queries over the driver's tables, with the SQL each one must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import case_queries, graph_queries, text_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**text_queries.QUERIES, **graph_queries.QUERIES, **case_queries.QUERIES}
ORACLE_SQL: dict[str, str] = {**text_queries.ORACLE_SQL, **graph_queries.ORACLE_SQL, **case_queries.ORACLE_SQL}
