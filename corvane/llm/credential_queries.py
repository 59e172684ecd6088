"""Queries of problem 2."""

from __future__ import annotations

from corvane.llm import credentials as C
from corvane.session import table


def p2_found(spark, d):
    return C.found(table(spark, d, "security_issues"))


def p2_redacted(spark, d):
    return C.scan(table(spark, d, "security_issues")).select("id", "snippet", "evidence").distinct()


QUERIES = {"p2_found": p2_found, "p2_redacted": p2_redacted}
SQL: dict = {}
