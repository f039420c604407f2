"""Query registry: each Spark query is registered next to its SQL oracle.

A query is ``fn(spark, sf_dir) -> DataFrame`` over the driver's tables.  The
oracle is ANSI SQL over the same tables (DuckDB views), with identical column
names.  Queries without an oracle are checked on rows only plus the
invariant tests in ``tests/``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def with_ctes(ctes: dict[str, str], body: str, once: tuple[str, ...] = ()) -> str:
    """``WITH a AS (...), b AS (...) body`` from an ordered dict of CTE bodies; those in ``once`` are computed once."""
    parts = ",\n".join(f"{k} AS {'MATERIALIZED ' if k in once else ''}(\n{v.strip()}\n)" for k, v in ctes.items())
    return f"WITH {parts}\n{body.strip()}\n"
