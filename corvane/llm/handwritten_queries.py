"""Queries of problem 1."""

from __future__ import annotations

from corvane.llm import handwritten as H
from corvane.session import table


def p1_found(spark, d):
    return H.classify(table(spark, d, "repository_files")).select("id").distinct()


def p1_handwritten(spark, d):
    return H.handwritten(table(spark, d, "repository_files")).select("id", "repository_id", "path")


QUERIES = {"p1_found": p1_found, "p1_handwritten": p1_handwritten}
SQL: dict = {}
