"""Registry of named queries and their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
MODULES = ["q_matching", "q_catalog", "q_filters", "q_text", "q_layers", "q_body", "q_joins", "q_aggregates", "q_dedupe", "q_ranking", "q_masks", "q_vectors", "q_events"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register ``fn(spark, sf_dir)`` under ``name``; ``sql`` is its twin for the correctness gate."""
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            from .oracle import complete

            ORACLES[name] = complete(sql)
        return fn

    return add


def load_all() -> None:
    for module in MODULES:
        importlib.import_module(f"lookweave.plans.{module}")
