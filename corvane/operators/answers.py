"""Prompts from evidence, and answers: by a callable that is plugged in, or by a template where there is none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.code import has_any

REFUSAL = "There is not enough information in the indexed repository to answer that confidently."


def evidence_text(evidence: DataFrame, group: list[str], order: list[str], budget: int = 8000) -> DataFrame:
    """(group, evidence, n): numbered evidence of each question, as long as it fits into the budget; the first is always kept."""
    from corvane.operators.vectors import within_budget

    head = F.concat(F.lit("--- "), F.coalesce("file_path", F.lit("")), F.lit(":"), F.coalesce(F.col("start_line").cast("string"), F.lit("")), F.lit(" ---\n"), F.coalesce("content", F.lit("")), F.lit("\n"))
    kept = within_budget(evidence.withColumn("__t", head), order, F.length("__t"), budget, group)
    g = kept.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(*order, "__t"))).alias("a"))  # at most the budget of characters, and one row more
    return g.select(*group, F.array_join(F.transform("a", lambda x: x["__t"]), "").alias("evidence"), F.size("a").alias("n"))


def prompt(question: Column, evidence: Column, history: Column) -> Column:
    return F.concat_ws("\n\n", F.concat(F.lit("Earlier turns:\n"), history), F.concat(F.lit("Evidence:\n"), evidence), F.concat(F.lit("Question: "), question))


def answer(prompts: DataFrame, text: str, keep: list[str], model: Callable[[str], str] | None = None) -> DataFrame:
    """keep and answer: model is called for each prompt in the Python workers; without one, a fixed text stands in. Null prompts are refused."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [REFUSAL if t is None else model(t) if model else "The evidence above answers the question; no model is plugged in." for t in pdf["__t"]]
            yield pdf[keep].assign(answer=out)

    types = dict(prompts.dtypes)
    return prompts.select(*keep, F.col(text).alias("__t")).mapInPandas(run, ", ".join([*(f"`{c}` {types[c]}" for c in keep), "answer string"]))


def follow_up(question: Column) -> Column:
    """A question to go on with, by topic."""
    q = F.lower(question)
    return F.when(has_any(q, ["auth", "login", "security"]), "How are sessions checked?").when(has_any(q, ["database", "schema", "model"]), "How is the schema migrated?").otherwise("Which module should I read next?")
