"""Named queries: Spark plan + DuckDB oracle SQL per operator ID of the survey.

``QUERIES[name] = (spark_fn, oracle_sql_or_None)``; ``spark_fn(spark, sf_dir)``
returns a lazy DataFrame whose double columns carry the tie-safe rounding, so the
value hash is comparable across engines.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.exprs import round_doubles

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def register(name: str, sql: str | None = None, rounded: bool = True):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return round_doubles(df) if rounded else df
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = (run, sql)
        return fn
    return deco


def load_all():
    """Import every module that registers queries."""
    from . import queries_core, queries_marts, queries_stats, queries_ml  # noqa: F401
    return QUERIES
