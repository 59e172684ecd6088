"""The registered queries of the core and their SQL."""

from __future__ import annotations

import importlib

MODULES = ["references", "source", "knowledge", "overview", "insight", "graphs", "quality"]


def _collect(what: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(getattr(importlib.import_module(f"corvane.plans.{m}"), what))
    return out


def all_queries() -> dict:
    return _collect("QUERIES")


def all_sql() -> dict:
    return _collect("SQL")
