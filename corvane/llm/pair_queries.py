"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.llm import pairs as P
from corvane.session import table


def p3_found(spark, d):
    return P.defective_pairs(table(spark, d, "chat_messages")).select("id", "defect").distinct()


def p3_coverage(spark, d):
    f = P.defective_pairs(table(spark, d, "chat_messages"))
    return f.groupBy("defect").agg(F.count(F.lit(1)).alias("n_pairs"), *[F.round(F.avg(t), 4).alias(f"{t}_share") for t in P.TAGS])


QUERIES = {"p3_found": p3_found, "p3_coverage": p3_coverage}
SQL: dict = {}
