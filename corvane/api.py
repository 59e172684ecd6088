"""One repository, or many, from a folder to tables: what a user calls."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import code as X
from corvane.operators import analyzers as A
from corvane.operators import chunking as C
from corvane.operators import graph as G
from corvane.operators import lines as L
from corvane.operators import scanners as S
from corvane.operators import vectors as V
from corvane.operators.scoring import security_score
from corvane.session import cut, ship
from corvane.sources.repository import manifest_dependencies, read_files, tech_stack


@dataclass
class Analysis:
    """Tables of an analysis; all are keyed by repository_id, and lazy but for files."""

    files: DataFrame
    metrics: DataFrame
    smells: DataFrame
    issues: DataFrame
    edges: DataFrame
    coupling: DataFrame
    dependencies: DataFrame
    stack: DataFrame
    chunks: DataFrame
    summary: DataFrame


def analyze(spark: SparkSession, root: str, repository_id: str | None = None, dim: int = 384) -> Analysis:
    """Reads the files below root and derives everything from them. Chunks are embedded by the hashing stand-in."""
    ship(spark)
    files = cut(read_files(spark, root, repository_id))
    text = files.where("is_text")
    lines = L.line_counts(text).select("id", "total_lines", "blank_lines", "comment_lines", "code_lines")
    known = cut(A.facts(text))
    fns = A.file_complexity(known.select("id", F.inline("functions")))
    key = files.select("id", "repository_id", "path", X.module_type(F.col("path"), F.col("extension")).alias("module_type"))
    metrics = key.join(lines, "id", "left").join(fns, "id", "left")
    smells = A.declaration_smells(text, known).unionByName(S.line_smells(text).select("id", "line_number", "smell_type", "severity", F.lit(1.0).alias("measured_value"), F.lit(0.0).alias("threshold"))).join(key.select("id", "repository_id", "path"), "id")
    issues = S.security_issues(text)
    edges = G.import_edges(text)
    coupling = G.coupling(files.select("repository_id", "path").distinct(), edges)
    routed = text.withColumn("route", C.route(F.col("path"), F.col("extension"), F.col("content"))).where("route <> 'skip'")
    whole = routed.where("route <> 'code'").select("id", F.lit("Whole File").alias("chunk_type"), F.lit("").alias("names"), F.lit(1).cast("long").alias("start_line"), L.n_lines(F.col("content")).alias("end_line"), F.lit(None).cast("long").alias("part"), "content")
    code = C.code_chunks(routed.where("route = 'code'"), known)
    chunks = whole.unionByName(code).join(files.select("id", "repository_id", F.col("path").alias("file_path")), "id")
    base = F.sha2(F.concat_ws("|", "repository_id", "file_path", "chunk_type", "names", "start_line"), 256)
    chunks = chunks.withColumn("chunk_id", F.when(F.col("part").isNull(), base).otherwise(F.concat(base, F.lit("_"), F.col("part").cast("string"))))
    chunks = V.hash_embedding(chunks, "content", ["repository_id", "chunk_id", "file_path", "chunk_type", "start_line", "end_line", "content"], dim)
    n = lambda s: F.sum((F.col("severity") == s).cast("long"))
    sec = issues.groupBy("repository_id").agg(security_score(n("Critical"), n("High"), n("Medium"), n("Low")).alias("security_score"))
    g = metrics.groupBy("repository_id").agg(F.count(F.lit(1)).alias("n_files"), F.coalesce(F.sum("code_lines"), F.lit(0)).alias("code_lines"), F.bround(F.avg("file_complexity"), 2).alias("average_complexity"), F.max("max_complexity").alias("max_complexity"))
    summary = g.join(sec, "repository_id", "left").withColumn("security_score", F.coalesce("security_score", F.lit(100.0))).withColumn("grade", X.grade(F.col("security_score")))
    return Analysis(files, metrics, smells, issues, edges, coupling, manifest_dependencies(text), tech_stack(text), chunks, summary)


def search(analysis: Analysis, question: str, limit: int = 5) -> DataFrame:
    """The chunks that fit a question best, reranked."""
    spark = analysis.chunks.sparkSession
    kind = len(analysis.chunks.select("embedding").first()[0]) if not analysis.chunks.isEmpty() else 1
    q = V.hash_embedding(spark.createDataFrame([(question,)], "t string"), "t", [], kind).first()["embedding"]
    return V.grounded(analysis.chunks, q, limit)
