"""Registered queries and their SQL twins."""

from __future__ import annotations

import importlib

MODULES = ("series_queries", "profile_queries", "forecast_queries", "workload_queries", "stream_queries")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"tracelens.plans.{name}")


def all_queries() -> dict:
    from tracelens.plans.registry import QUERIES

    _load()
    return dict(QUERIES)


def all_sql() -> dict[str, str]:
    from tracelens.plans.registry import SQL

    _load()
    return dict(SQL)
