"""All registered queries."""

from __future__ import annotations

import importlib

from finegrid.plans.registry import REGISTRY, Query

MODULES = ["panel_queries", "raster_queries", "space_queries", "rule_queries", "message_queries", "source_queries", "table_queries", "stream_queries", "model_queries"]


def all_queries() -> dict[str, Query]:
    for name in MODULES:
        importlib.import_module(f"finegrid.plans.{name}")
    return dict(REGISTRY)
