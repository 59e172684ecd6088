"""Queries of problem 5."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from corvane.llm.splitting import Plan, split_files, split_texts
from corvane.session import shared_dir, table


def _pieces(spark, d):
    return split_texts(table(spark, d, "repository_embeddings"), "chunk_id", "content", "start_line")


def p5_found(spark, d):
    return _pieces(spark, d).select("chunk_id").distinct()


def p5_pieces(spark, d):
    return _pieces(spark, d)


def p5_cover(spark, d):
    """Of each item: its length by its pieces, whether they are numbered 0, 1, 2 ... and within the limit, its first line, and its text put together again."""
    p = _pieces(spark, d)
    end = F.max("end_pos").alias("n_chars")
    whole = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("piece_no", "start_pos", "end_pos", "content"))), lambda x: x["content"]))
    # a piece without what it shares with the one before: what lies behind that one's end
    from pyspark.sql import Window

    before = F.coalesce(F.lag("end_pos").over(Window.partitionBy("chunk_id").orderBy("piece_no")), F.lit(0))
    own = p.withColumn("content", F.substring("content", (before - F.col("start_pos") + 1).cast("int"), (F.col("end_pos") - before).cast("int")))
    g = own.groupBy("chunk_id").agg(end, (F.max("piece_no") + 1 == F.count(F.lit(1))).alias("numbered"), (F.max(F.col("end_pos") - F.col("start_pos")) <= Plan().limit).alias("within"), F.min("start_line").alias("first_line"), F.md5(whole).alias("digest"))
    return g


def p5_files(spark, d):
    """All documents written to a few large files and cut by byte ranges: bytes of files, bytes covered by pieces, and pieces with a broken character."""
    path = f"{shared_dir(spark).rstrip('/')}/texts_{uuid.uuid4().hex}"
    table(spark, d, "documents").where("text is not null").select("text").write.text(path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path).select("path", "length")
    p = split_files(spark, files).groupBy("path").agg(F.max("end_pos").alias("n"), F.sum(F.contains("content", F.lit("�")).cast("long")).alias("broken"))
    j = files.join(p, "path", "left").select("length", F.coalesce("n", "length").alias("n"), F.coalesce("broken", F.lit(0)).alias("broken"))
    return j.agg(F.sum("length").alias("n_bytes"), F.sum("n").alias("n_covered"), F.sum("broken").alias("n_broken"))


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces, "p5_cover": p5_cover, "p5_files": p5_files}
SQL = {
    "p5_found": "select distinct chunk_id from repository_embeddings where length(content) > 3000 and chunk_id is not null",
    "p5_cover": "select chunk_id, length(content) n_chars, true numbered, true as within, case when start_line >= 1 then start_line else 1 end first_line, md5(content) digest from (select distinct on (chunk_id) * from repository_embeddings where length(content) > 3000 and chunk_id is not null)",
    "p5_files": "select sum(octet_length(encode(text)) + 1) n_bytes, sum(octet_length(encode(text)) + 1) n_covered, 0 n_broken from documents where text is not null",
}
