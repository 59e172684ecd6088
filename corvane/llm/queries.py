"""All queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ["conversation_queries", "splitting_queries", "neighbour_queries", "composition_queries", "credential_queries", "moderation_queries", "handwritten_queries", "pair_queries"]

QUERIES: dict = {}
SQL: dict = {}
for _m in MODULES:
    _mod = importlib.import_module(f"corvane.llm.{_m}")
    QUERIES.update(_mod.QUERIES)
    SQL.update(_mod.SQL)
