"""Query registry.

A query is a callable ``(spark, sf_dir) -> DataFrame``.  Queries that have an
exact SQL counterpart register it as ``oracle``; the driver runs both at
sf0.01 and compares rows, columns and values.  Queries without an oracle
(models, iterative tests) are checked by fixture tests in ``tests/``.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}

# Modules whose import registers queries.
_MODULES = (
    "loupe.plans.q_relational",
    "loupe.plans.q_profile",
    "loupe.plans.q_clean",
    "loupe.plans.q_text",
    "loupe.plans.q_series",
    "loupe.plans.q_stats",
    "loupe.plans.q_models",
    "loupe.plans.q_sources",
    "loupe.plans.q_reports",
    "loupe.plans.q_streaming",
)


def query(key: str, oracle: str | None = None):
    """Register ``fn`` under ``key`` (and its oracle SQL, if any)."""
    def deco(fn: QueryFn) -> QueryFn:
        if key in _QUERIES:
            raise ValueError(f"duplicate query key {key!r}")
        _QUERIES[key] = fn
        if oracle is not None:
            _ORACLES[key] = oracle.strip()
        return fn
    return deco


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(m)


def all_queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def all_oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
