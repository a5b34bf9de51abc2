"""Registry of runnable queries and of their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: str


REGISTRY: dict[str, Query] = {}


def query(name: str, ids: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``; ``ids`` are the inventory lines it covers."""
    from finegrid.plans.bindings import Tables

    def register(fn):
        if name in REGISTRY:
            raise ValueError(f"query '{name}' is registered twice")
        REGISTRY[name] = Query(lambda spark, sf_dir: fn(Tables(spark, sf_dir)), sql, ids)
        return fn

    return register


# Results are compared as values, so a double is rounded on both sides.  The small
# shift moves exact decimal ties off the rounding edge, where engines may differ.
SHIFT = 1e-7


def r4(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + SHIFT, 4)


def R(expr: str) -> str:
    return f"(round(({expr}) + 1e-7, 4) + 0.0)"
