"""Queries of problems 8 and 9."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.llm import mixing, packing
from corvane.llm.tokens import with_token_counts
from corvane.session import table


def p8_containers(spark, d):
    return packing.pack_texts(table(spark, d, "documents"), table(spark, d, "containers"))


def p8_report(spark, d):
    return packing.fill_report(p8_containers(spark, d), table(spark, d, "containers"))


def p9_mix(spark, d):
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_texts(spark, d):
    return mixing.with_texts(p9_mix(spark, d), table(spark, d, "documents"))


def p9_report(spark, d):
    goals = table(spark, d, "mix_targets")
    mixed, budgets = mixing.mix_with_plan(table(spark, d, "documents"), goals)
    return mixing.share_report(mixed, goals, budgets)


def p9_shares(spark, d):
    """Whether each source that has texts lies within two percent of its planned tokens, or none of its least used texts fits into what is lacking; and no text is used more often than its cap allows."""
    docs, goals = table(spark, d, "documents"), table(spark, d, "mix_targets")
    mixed, budgets = mixing.mix_with_plan(docs, goals)
    sized = with_token_counts(docs.withColumn("s", mixing.clean_source(F.col("source"))), "text", ["doc_id", "s"]).where("n_tokens > 0")
    uses = sized.join(mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("uses")), "doc_id", "left").groupBy("s", F.coalesce("uses", F.lit(0)).alias("uses")).agg(F.min("n_tokens").alias("shortest"))
    least = uses.groupBy("s").agg(F.min_by("shortest", "uses").alias("shortest"), F.min("uses").alias("least"))
    plan = spark.createDataFrame(sorted(budgets.items()), "p string, budget double")
    r = mixing.share_report(mixed, goals, budgets).where("n_docs > 0")
    j = r.join(F.broadcast(plan), F.col("source") == F.col("p")).join(F.broadcast(least), F.col("source") == F.col("s"))  # a row for each source
    gap = F.abs(F.col("n_tokens") - F.col("budget"))
    near = (gap <= 0.02 * F.col("budget") + 1) | (gap <= F.col("shortest") + 1)
    return j.select("source", (near & (F.col("most_uses") <= F.col("repeat_cap"))).alias("kept"))


def p8_cover(spark, d):
    """Of each kind of container: texts placed, texts whose pieces do not number all of their tokens in a row, containers over their capacity, and texts cut though they fit."""
    docs, kinds = table(spark, d, "documents"), table(spark, d, "containers")
    p = packing.pack_texts(docs, kinds)
    cap = kinds.select(F.col("container_kind").alias("k"), F.col("capacity_tokens").cast("long").alias("cap")).distinct()
    full = p.groupBy("container_kind", "container_no").agg(F.sum("n_tokens").alias("n")).join(cap, F.col("container_kind") == F.col("k"))
    over = full.groupBy(F.col("container_kind").alias("kind")).agg(F.sum((F.col("n") > F.col("cap")).cast("long")).alias("n_over"))
    text = p.groupBy("container_kind", "doc_id").agg(F.sum("n_tokens").alias("n"), F.max(F.col("start_token") + F.col("n_tokens")).alias("end"), F.count(F.lit(1)).alias("pieces")).join(cap, F.col("container_kind") == F.col("k"))
    g = text.groupBy("container_kind").agg(F.count(F.lit(1)).alias("n_docs"), F.sum((F.col("n") != F.col("end")).cast("long")).alias("n_broken"), F.sum(((F.col("pieces") > 1) & (F.col("n") <= F.col("cap"))).cast("long")).alias("n_cut"))
    return g.join(over, F.col("container_kind") == F.col("kind")).select("container_kind", "n_docs", "n_broken", "n_over", "n_cut")


QUERIES = {"p8_containers": p8_containers, "p8_report": p8_report, "p9_mix": p9_mix, "p9_texts": p9_texts, "p9_report": p9_report, "p8_cover": p8_cover, "p9_shares": p9_shares}
SQL = {
    "p8_cover": "select container_kind, (select count(distinct doc_id) from documents) n_docs, 0::bigint n_broken, 0::bigint n_over, 0::bigint n_cut from (select distinct container_kind from containers)",
    "p9_shares": "select distinct s as source, true kept from (select regexp_replace(lower(trim(source)), '[\\s-]+', '_', 'g') s, target_share, repeat_cap from mix_targets) where target_share > 0 and repeat_cap > 0 and s in (select regexp_replace(lower(trim(source)), '[\\s-]+', '_', 'g') from documents where length(text) > 0)",
}
