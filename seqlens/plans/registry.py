"""Named queries: each pairs a Spark plan with an independent oracle SQL.

A query callable takes ``(spark, sf_dir)`` and returns a DataFrame; its
oracle is DuckDB SQL over the same parquet tables (``None`` when the
operator is not expressible in SQL, e.g. model fitting or streams).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn
    return deco


def _load_all() -> None:
    # importing the modules fills the registry
    from seqlens.plans import (  # noqa: F401
        q_label, q_profile, q_rates, q_scalar, q_buckets, q_corr, q_metrics,
        q_split, q_encode, q_models, q_score)


def queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_ORACLES)
