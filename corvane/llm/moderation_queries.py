"""Queries of problem 10."""

from __future__ import annotations

from corvane.llm import moderation as M
from corvane.session import table


def p10_scores(spark, d):
    docs = table(spark, d, "documents")
    return M.score_documents(docs, M.train(docs, table(spark, d, "moderation_labels")))


def p10_found(spark, d):
    return p10_scores(spark, d).where("toxic").select("doc_id")


def p10_rates(spark, d):
    return M.rates(p10_scores(spark, d))


QUERIES = {"p10_found": p10_found, "p10_scores": p10_scores, "p10_rates": p10_rates}
SQL: dict = {}
