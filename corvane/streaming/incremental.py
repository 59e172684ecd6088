"""Streams: incremental indexes, orphan counts kept up to date, windows over events, state of chats."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corvane.operators.references import KEY, merge_counts


def file_stream(spark: SparkSession, path: str, schema, **options: str) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.format("parquet").schema(schema).options(**options).load(path)


def only_new(batch: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of batch whose keys known does not have: files whose path and hash are unchanged need no new chunks. Null keys are never known."""
    return batch.join(known.select(*keys).distinct(), keys, "left_anti")


def index_new_files(stream: DataFrame, index_path: str, chunk: Callable[[DataFrame], DataFrame], checkpoint: str, keys: tuple[str, ...] = ("repository_id", "path", "content_hash")):
    """Starts a query that chunks each batch's new files and appends them; every batch has a folder of its own, written over if it is repeated."""

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        try:
            seen = spark.read.option("recursiveFileLookup", "true").parquet(f"{index_path}/files")
            fresh = only_new(batch, seen, list(keys))
        except Exception as e:  # noqa: BLE001 - no folder yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            fresh = batch
        fresh = fresh.dropDuplicates(list(keys)).persist()
        chunk(fresh).write.mode("overwrite").parquet(f"{index_path}/chunks/batch={epoch}")
        fresh.select(*keys).write.mode("overwrite").parquet(f"{index_path}/files/batch={epoch}")
        fresh.unpersist()

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def keep_orphan_state(deltas: DataFrame, state_path: str, checkpoint: str):
    """Starts a query that adds each batch of deltas (target, scope, key, refs, exist) to the state; state n is written from state n - 1."""

    def step(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        parts = [batch.select(*KEY, "refs", "exist")]
        if epoch:
            parts.append(spark.read.parquet(f"{state_path}/state={epoch - 1}"))
        merge_counts(*parts).write.mode("overwrite").parquet(f"{state_path}/state={epoch}")

    return deltas.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Events per window and type; events later than `late` are dropped by the watermark."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))


def once(events: DataFrame, keys: list[str], late: str = "1 day") -> DataFrame:
    """Events, repeated ones dropped as long as they come within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def summaries_due(messages: DataFrame, limit: int = 10) -> DataFrame:
    """(session_id, n): once for each session, when it has more than `limit` messages of the speakers and no summary."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, done = state.get if state.exists else (0, False)
        for b in batches:
            role = b["role"].fillna("").str.strip().str.lower()
            n += int(role.isin(["user", "assistant", "human", "ai"]).sum())
            done = done or bool((role == "summary").any())
        fire = n > limit and not done
        state.update((n, done or fire))
        yield pd.DataFrame({"session_id": [key[0]], "n": [n]} if fire else {"session_id": pd.Series([], dtype=str), "n": pd.Series([], dtype="int64")})

    return messages.groupBy("session_id").applyInPandasWithState(step, "session_id string, n long", "n long, done boolean", "append", GroupStateTimeout.NoTimeout)


def latest_state(events: DataFrame, keys: list[str], at: str, values: list[str]) -> DataFrame:
    """The last values of each key by time: what an append-only log of state changes says now."""
    m = F.max(F.struct(at, *values)).alias("m")
    return events.groupBy(*keys).agg(m).select(*keys, *[F.col(f"m.{c}").alias(c) for c in (at, *values)])
