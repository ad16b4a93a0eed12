"""Queries of the training-data operators and the SQL they are checked against."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("q_groupsplit", "q_nearest", "q_setjoin", "q_cooccur", "q_topn", "q_leakage", "q_mixing", "q_reading")

QUERIES = {k: v for m in _MODULES for k, v in import_module(f"recmill.llm.{m}").QUERIES.items()}
SQL = {k: v for m in _MODULES for k, v in import_module(f"recmill.llm.{m}").SQL.items()}
