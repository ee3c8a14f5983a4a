"""Named queries: each maps (spark, sf_dir) to the DataFrame of one operator.

Queries read the driver's parquet folder through the fixture derivation, so every query's
work grows with the given tables.  The companion oracle SQL lives in sublens.plans.oracle.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sublens.sources.fixture import derive_tables

QueryFn = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, QueryFn] = {}


def query(name: str):
    """Register fn(tables) or fn(tables, spark) under `name`."""
    def wrap(fn):
        required = [p for p in inspect.signature(fn).parameters.values() if p.default is p.empty]
        wants_spark = len(required) > 1

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tables = derive_tables(spark, sf_dir)
            return fn(tables, spark) if wants_spark else fn(tables)
        run.__name__ = name
        run.__doc__ = fn.__doc__
        if name in _QUERIES:
            raise ValueError(f"duplicate query {name}")
        _QUERIES[name] = run
        return fn
    return wrap


def all_queries() -> dict[str, QueryFn]:
    # Importing the modules registers their queries.
    from sublens.plans import queries_core, queries_drivers, queries_io  # noqa: F401
    return dict(_QUERIES)
