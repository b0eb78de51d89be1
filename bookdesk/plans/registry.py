"""Registered queries: each name maps to a Spark callable ``(spark, sf_dir)
-> DataFrame`` over the bridge views, and (where SQL can say it) to an
independent DuckDB oracle written the way the shop's own SQL is written
(correlated sub-selects, NOT EXISTS, recursive CTEs).

Every query runs over whole tables; a LIMIT appears only where paging is
the feature being checked.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    import importlib
    for mod in MODULES:
        importlib.import_module(f"{__package__}.{mod}")


MODULES = ["q_support", "q_listing", "q_bookings", "q_ingest", "q_accounts", "q_content", "q_documents", "q_outcomes",
           "q_streams"]
