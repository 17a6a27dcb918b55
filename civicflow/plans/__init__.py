"""Registered queries: each maps (spark, sf_dir) -> DataFrame, with a DuckDB twin."""

from __future__ import annotations

import importlib

# Modules that expose QUERIES (and optionally ORACLE) dicts.
_MODULES = ("requests", "weather", "series", "forecast", "staffing", "text", "classify", "zones", "geo", "sources", "streaming", "presentation")


def _load():
    queries, oracle = {}, {}
    for name in _MODULES:
        mod = importlib.import_module(f"civicflow.plans.{name}")
        queries.update(mod.QUERIES)
        oracle.update(getattr(mod, "ORACLE", {}))
    return queries, oracle


def all_queries():
    return _load()[0]


def all_oracle_sql():
    return _load()[1]
