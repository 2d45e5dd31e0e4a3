"""All queries of the library by name, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import desk_queries, market_queries, message_queries, ops_queries, record_queries, report_queries, search_queries, source_queries, store_queries, text_queries

FLAGSHIP = "rules_match_verdict"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**text_queries.QUERIES, **market_queries.QUERIES, **report_queries.QUERIES, **message_queries.QUERIES, **store_queries.QUERIES, **desk_queries.QUERIES, **ops_queries.QUERIES, **source_queries.QUERIES, **search_queries.QUERIES, **record_queries.QUERIES}
ORACLES: dict[str, str] = {**text_queries.ORACLES, **market_queries.ORACLES, **report_queries.ORACLES, **message_queries.ORACLES, **store_queries.ORACLES, **desk_queries.ORACLES, **ops_queries.ORACLES, **source_queries.ORACLES, **search_queries.ORACLES, **record_queries.ORACLES}
