"""Queries of problem 7."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.llm import neighbours as N
from corvane.session import table


def p7_found(spark, d):
    p = N.near_pairs(table(spark, d, "repository_embeddings"), "chunk_id", "embedding")
    return p.select(F.col("item_a").alias("chunk_id_a"), F.col("item_b").alias("chunk_id_b"))


def p7_neighbours(spark, d):
    n = N.nearest(table(spark, d, "repository_embeddings"), "chunk_id", "embedding", s=N.Search(min_similarity=None))
    return n.select(F.col("item").alias("chunk_id"), F.col("neighbour").alias("neighbour_id"), F.round("similarity", 4).alias("similarity"), "rank")


def p7_embeddings(spark, d):
    """Similarities of the 5 nearest of all other rows of embeddings, for each row whose id is divisible by 50."""
    n = N.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", s=N.Search(min_similarity=None))
    return n.where(F.col("item").cast("long") % 50 == 0).select(F.col("item").cast("long").alias("vec_id"), F.col("rank").cast("long").alias("rank"), F.round("similarity", 2).alias("similarity"))


QUERIES = {"p7_found": p7_found, "p7_neighbours": p7_neighbours, "p7_embeddings": p7_embeddings}
#: All pairs of chunks by brute force take minutes at scale 0.1; tests do that on a fixture. The smaller table has SQL for the stated queries.
SQL = {
    "p7_embeddings": """with e as (select vec_id, embedding::double[] v, sqrt(list_dot_product(embedding::double[], embedding::double[])) n from embeddings where len(embedding) = 64), p as (select a.vec_id, list_dot_product(a.v, b.v) / (a.n * b.n) s from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0 and a.n > 0 and b.n > 0)
 select vec_id, rank, round(s, 2) similarity from (select *, row_number() over (partition by vec_id order by s desc) as rank from p) where rank <= 5""",
}
