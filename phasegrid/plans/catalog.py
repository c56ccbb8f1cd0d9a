"""Registry of the engine's queries (name -> callable) and oracles (name -> SQL)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from phasegrid.plans import event_queries, kernel_queries, relational_queries, signal_queries, stream_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**signal_queries.QUERIES, **event_queries.QUERIES, **relational_queries.QUERIES, **kernel_queries.QUERIES, **stream_queries.QUERIES}
ORACLES: dict[str, str] = {**signal_queries.ORACLES, **event_queries.ORACLES, **relational_queries.ORACLES, **kernel_queries.ORACLES, **stream_queries.ORACLES}
