"""All queries of the core, by name, with the SQL that each is checked against."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("skew", "datasets", "lists", "splits", "scorers", "metrics")


def all_queries() -> dict:
    return {k: v for m in _MODULES for k, v in import_module(f"recmill.queries.{m}").QUERIES.items()}


def all_sql() -> dict:
    return {k: v for m in _MODULES for k, v in import_module(f"recmill.queries.{m}").SQL.items()}
