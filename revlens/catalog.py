"""Registered queries: one per operator ID of the blueprint's inventory.

Each entry is ``(spark, sf_dir) -> DataFrame`` over the shared tables (or
tables Spark derives from them, see ``sources.fixtures``), plus, where the
semantics are expressible in SQL, an independent DuckDB oracle query.  The
oracle never reuses the Spark operator code: only the derived-table
templates are shared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn
    return deco


def _load_all():
    # importing the modules registers their queries
    from revlens.plans import (q_metrics, q_diffs, q_vectors, q_events,  # noqa: F401
                               q_findings, q_feedback, q_misc, q_streaming, q_codefacts, q_context, q_flow)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(ORACLE)
