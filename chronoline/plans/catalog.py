"""Registered queries of the sequence engine and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoline.plans import catalog_queries, choice_queries, estimator_queries, media_queries, naming_queries, pipeline_queries, placement_queries, quality_queries, recursive_sql, repeat_queries, retiming_queries, scan_queries, score_queries, sequence_queries

MODULES = (sequence_queries, estimator_queries, catalog_queries, choice_queries, media_queries, naming_queries, pipeline_queries, placement_queries, quality_queries, repeat_queries, retiming_queries, scan_queries, score_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in (*MODULES, recursive_sql) for name, sql in m.ORACLES.items()}
