"""Append-only event tables and their current state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from finegrid.operators.relational import keep_one


def latest(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Current row per key: the last write wins."""
    return keep_one(events, keys, order, last=True)


def with_default(wanted: DataFrame, state: DataFrame, keys: list[str], column: str, default: str) -> DataFrame:
    """State of every wanted key; ``default`` where nothing was ever recorded."""
    return wanted.join(state, keys, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def insert_ignore(existing: DataFrame, incoming: DataFrame, unique: list[str], order: list[str]) -> DataFrame:
    """Incoming rows that add a new key: the first of each, unless the key exists already."""
    return keep_one(incoming, unique, order, last=False).join(existing.select(*unique), unique, "left_anti")


def newest_page(log: DataFrame, order: list[str], size: int) -> DataFrame:
    return log.orderBy(*[F.col(c).desc() for c in order]).limit(size)


def overlay_reviews(texts: DataFrame, reviews: DataFrame, keys: list[str], editable: dict[str, Column]) -> DataFrame:
    """Texts with the edits of decided reviews.

    ``reviews`` holds the latest review per key with ``status``; ``editable`` maps a
    text column to the edited value, an expression over the review's columns.
    """
    decided = reviews.where(F.col("status").isin("approved", "rejected"))
    decided = decided.select(*keys, "status", *[v.alias(f"_edit_{c}") for c, v in editable.items()])
    out = texts.join(decided, keys, "left")
    for c in editable:
        out = out.withColumn(c, F.coalesce(f"_edit_{c}", c)).drop(f"_edit_{c}")
    return out.withColumn("status", F.coalesce("status", F.lit("auto")))
