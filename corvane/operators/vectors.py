"""Exact vector search, re-ranking, hashing embeddings and the assembly of evidence for a question."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.code import boost
from corvane.session import shared_dir


def _unit_rows(b: pa.RecordBatch, dim: int) -> tuple[pa.Array, np.ndarray]:
    """Keys and unit vectors of a batch (key, vector of dim doubles); rows whose vector is zero or holds a null or NaN are left out."""
    v = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
    norm = np.linalg.norm(v, axis=1)
    good = np.flatnonzero(np.isfinite(norm) & (norm > 0))
    return b.column(0).take(pa.array(good)), v[good] / norm[good][:, None]


def search(chunks: DataFrame, query: list[float], k: int, vector: str = "embedding", key: str = "chunk_id") -> DataFrame:
    """The k rows most similar to one query vector, with similarity (rounded to 4 digits); ties by key, which should be unique.

    Vectors are compared in Arrow batches; every task keeps its k best, and the k best of all are joined back to their rows. Rows
    without a usable vector of the query's length are left out; a zero query finds nothing.
    """
    dim, q = len(query), np.asarray(query, np.float64)
    n = float(np.linalg.norm(q))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sims = [], np.zeros(0)
        for b in batches if n > 0 else ():
            names, x = _unit_rows(b, dim)
            keys, sims = keys + names.to_pylist(), np.r_[sims, x @ (q / n)]
            if len(keys) > 4 * k:
                top = sorted(range(len(keys)), key=lambda j: (-sims[j], keys[j]))[:k]
                keys, sims = [keys[j] for j in top], sims[top]
        yield pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(sims, pa.float64())], names=["__key", "__s"])

    text = dict(chunks.dtypes)[key]
    kind = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[text]
    d = chunks.where((F.size(vector) == dim) & F.col(key).isNotNull()).select(key, F.col(vector).cast("array<double>"))
    top = d.mapInArrow(best, f"__key {text}, __s double").orderBy(F.desc("__s"), "__key").limit(k)
    return chunks.join(F.broadcast(top), F.col(key) == F.col("__key")).withColumn("similarity", F.round("__s", 4)).orderBy(F.desc("__s"), key).drop("__s", "__key")


def search_many(data: DataFrame, queries: DataFrame, k: int, key: str, vector: str, dim: int, tile: int = 16_384, block: int = 256) -> DataFrame:
    """(query, key, similarity, rank): for each query row the k other rows of data with the highest cosine similarity, exactly.

    Queries are stored in the shared folder; data is dealt to tiles, and the task of a tile reads the queries in blocks and keeps the k best
    of its tile for each. What is shuffled is data once and k rows for each query and tile; the driver sees neither.
    """
    spark = data.sparkSession
    kind = dict(data.dtypes)[key]
    arrow = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]
    path = f"{shared_dir(spark).rstrip('/')}/queries_{uuid.uuid4().hex}"
    usable = lambda d: d.where((F.size(vector) == dim) & F.col(key).isNotNull()).select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("v"))
    usable(queries).write.parquet(path)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [(n.to_pylist(), x) for n, x in (_unit_rows(b, dim) for b in batches) if len(n)]
        if not own:
            return
        keys, x = np.array([i for n, _ in own for i in n], object), np.concatenate([v for _, v in own])
        order = np.argsort(keys, kind="stable")
        keys, x = keys[order], x[order]  # ties go to the smaller key, which is the smaller place now
        fs, at = pa.fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
        stored = pa.dataset.dataset(at, filesystem=fs, format="parquet", schema=pa.schema([("k", arrow), ("v", pa.list_(pa.float64()))]))
        for b in stored.to_batches(batch_size=block, use_threads=False, batch_readahead=1, fragment_readahead=1):
            names, q = _unit_rows(b, dim)
            names = np.array(names.to_pylist(), object)
            for t in range(0, len(keys) if len(names) else 0, tile):
                s = q @ x[t : t + tile].T
                m = min(s.shape[1], k + 1)
                least = np.partition(s, s.shape[1] - m, axis=1)[:, -m]
                i, j = np.nonzero(s >= least[:, None])
                o = np.lexsort((j, -s[i, j], i))
                i, j = i[o], j[o]
                start = np.r_[True, i[1:] != i[:-1]] if len(i) else np.zeros(0, bool)
                first = np.maximum.accumulate(np.where(start, np.arange(len(i)), 0)) if len(i) else i
                ok = (np.arange(len(i)) - first < m) & (names[i] != keys[t + j])
                i, j = i[ok], j[ok]
                yield pa.RecordBatch.from_arrays([pa.array(names[i].tolist(), arrow), pa.array(keys[t + j].tolist(), arrow), pa.array(s[i, j], pa.float64())], names=["query", key, "sim"])

    d = usable(data)
    found = d.repartition(max(1, -(-d.count() // tile)), "k").mapInArrow(best, f"query {kind}, `{key}` {kind}, sim double")
    w = Window.partitionBy("query").orderBy(F.desc("sim"), key)
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select("query", key, F.round("sim", 4).alias("similarity"), "rank")


def rerank(hits: DataFrame, limit: int, path: str = "file_path", key: str = "chunk_id") -> DataFrame:
    """The `limit` hits with the highest rounded similarity times (1 + boost of the path)."""
    return hits.withColumn("boosted", F.col("similarity") * (1 + boost(F.col(path)))).orderBy(F.desc("boosted"), key).limit(limit)


def grounded(chunks: DataFrame, query: list[float], limit: int) -> DataFrame:
    """Search with more candidates than asked for (at least 10), then re-rank."""
    return rerank(search(chunks, query, max(10, 2 * limit)), limit)


def hash_embedding(texts: DataFrame, text: str, keep: list[str], dim: int = 384, out: str = "embedding") -> DataFrame:
    """Vectors of norm 1 by the hashing trick over words and word pairs: the stand-in where no embedding model is at hand. Empty and null texts have zeros."""

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            vs = []
            for t in pdf["__t"]:
                v = np.zeros(dim, np.float32)
                ws = (t or "").lower().split()
                for w in [*ws, *(f"{a} {b}" for a, b in zip(ws, ws[1:]))]:
                    h = xxhash.xxh64_intdigest(w)
                    v[h % dim] += 1.0 if h >> 63 else -1.0
                n = np.linalg.norm(v)
                vs.append((v / n if n else v).tolist())
            yield pdf[keep].assign(**{out: vs})

    types = dict(texts.dtypes)
    return texts.select(*keep, F.col(text).alias("__t")).mapInPandas(embed, ", ".join([*(f"`{c}` {types[c]}" for c in keep), f"`{out}` array<float>"]))


def neighbours(hits: DataFrame, chunks: DataFrame, reach: int = 150) -> DataFrame:
    """Chunks of a hit's file whose first lines are less than `reach` away, not the hit's own: equality on file and on line bands, then the exact distance.

    hits and chunks: repository_id, chunk_id, file_path, start_line, content. Repeated contents count once, the one with the smallest chunk_id.
    """
    h = hits.where("file_path is not null and start_line is not null").select("repository_id", "file_path", F.col("start_line").alias("at"), F.explode(F.array(*[(F.floor(F.col("start_line") / reach) + i).cast("long") for i in (-1, 0, 1)])).alias("band"))
    c = chunks.where("file_path is not null and start_line is not null").withColumn("band", F.floor(F.col("start_line") / reach).cast("long"))
    j = c.join(h.distinct(), ["repository_id", "file_path", "band"]).where((F.abs(F.col("start_line") - F.col("at")) > 0) & (F.abs(F.col("start_line") - F.col("at")) < reach))
    seen = j.join(hits.select(F.col("content").alias("__c")).distinct(), F.col("content") == F.col("__c"), "left_anti")
    w = Window.partitionBy("repository_id", "content").orderBy("chunk_id")
    return seen.withColumn("__r", F.row_number().over(w)).where("__r = 1").select("repository_id", "chunk_id", "file_path", "start_line", "content", F.lit(0.8).alias("similarity"))


def within_budget(rows: DataFrame, order: list[str], length: Column, budget: int = 8000, group: list[str] | None = None) -> DataFrame:
    """Rows, in ascending order, until their lengths' sum exceeds the budget; the first is always kept and nothing after the first that is too much.

    Of a group at most budget + 1 rows with a length can matter for where it ends; only these reach its window, as a limit before and after
    the shuffle. The rows themselves are then compared with that end.
    """
    keys = [F.col(g) for g in group or []]
    d = rows.withColumn("__n", length).withColumn("__o", F.struct(*order))
    w = Window.partitionBy(*keys).orderBy("__o")
    head = d.where("__n > 0").select(*keys, "__o", "__n").withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= budget + 1)
    named = [F.col(g).alias(f"__g{i}") for i, g in enumerate(group or [])]
    ends = head.withColumn("__s", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("__s") > budget).groupBy(*named).agg(F.min("__o").alias("__stop"))
    first = d.groupBy(*[k.alias(f"__h{i}") for i, k in enumerate(keys)]).agg(F.min("__o").alias("__first"))
    same = lambda c: [F.col(g).eqNullSafe(F.col(f"__{c}{i}")) for i, g in enumerate(group or [])] or F.lit(True)
    j = d.join(ends, same("g"), "left").join(first, same("h"), "left")
    kept = F.col("__stop").isNull() | (F.col("__o") < F.col("__stop")) | (F.col("__o") == F.col("__first"))
    return j.where(kept).select(*rows.columns)


def confidence(evidence: DataFrame, group: list[str]) -> DataFrame:
    """0 to 100 from the best similarity, the number of rows and of files; with whether the best may be cited (at least 0.15)."""
    g = evidence.groupBy(*group).agg(F.max("similarity").alias("best"), F.count(F.lit(1)).alias("n"), F.countDistinct("file_path").alias("files"))
    raw = F.least(F.lit(65.0), F.col("best") * 65) + F.least(F.lit(20), F.col("n") * 4) + F.least(F.lit(15), F.col("files") * 5)
    return g.select(*group, F.greatest(F.lit(10), F.least(F.lit(100), F.floor(raw))).cast("int").alias("confidence"), (F.col("best") >= 0.15).alias("citable"))
