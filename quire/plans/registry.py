"""Query registry: every implemented operator as (Spark job, DuckDB oracle SQL).

Each query takes ``(spark, sf_dir)`` and reads the driver tables in full.  The
oracle SQL computes the same columns (same names, same types) on DuckDB views of
the same parquet files.  Array results are rendered as strings (``array_join``)
so both engines hash them the same way.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register a query under ``name`` with its oracle SQL (None = no
    SQL form; the driver then checks rows only)."""

    def wrap(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return wrap


def _load_all() -> None:
    # Importing the modules runs their @register decorators.
    from quire.plans import (  # noqa: F401
        q_assemble,
        q_batch,
        q_corpus,
        q_extract,
        q_mixing,
        q_prompts,
        q_sources,
        q_templates,
        q_scoring,
    )


def queries() -> dict[str, Query]:
    _load_all()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load_all()
    return dict(_SQL)
