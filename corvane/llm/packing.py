"""Filling containers of fixed capacity with items, by exact complements over counts of lengths.

The lengths' counts (at most one for each length up to the capacity) are all that the packing needs. From the largest length
down, an index of single lengths, pair sums and triple sums is asked for combinations that fill the gap exactly, and a
combination is used for as many containers as the counts allow. What has no exact complement is filled best-fit. The result is
a table of patterns, each for a run of containers; items find their container by their number among the items of their length.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.tokens import VOCABULARY, with_token_counts
from corvane.operators.order import any_rank, parts_for
from corvane.session import cut


class Complements:
    """Available lengths with counts, and the exact fills of a gap by one, two or three of them."""

    def __init__(self, counts: np.ndarray):
        self.n = counts  # n[length]
        self.pairs = -1  # sums of two available lengths, as bits; a superset while lengths run out

    def _pairs(self) -> int:
        if self.pairs < 0:
            lens = np.flatnonzero(self.n)
            bits = sum(1 << int(x) for x in lens)
            self.pairs = 0
            for x in lens:
                self.pairs |= bits << int(x)
        return self.pairs

    def one(self, g: int, used: dict[int, int]) -> list[int] | None:
        return [g] if g > 0 and self.n[g] > used.get(g, 0) else None

    def two(self, g: int, used: dict[int, int]) -> list[int] | None:
        if g < 2:
            return None
        x = np.arange(g - 1, (g + 1) // 2 - 1, -1)
        for a in x[(self.n[x] > 0) & (self.n[g - x] > 0)]:
            a, b = int(a), int(g - a)
            need = dict(used)
            for y in (a, b):
                need[y] = need.get(y, 0) + 1
            if self.n[a] >= need[a] and self.n[b] >= need[b]:
                return [a, b]
        return None

    def three(self, g: int, used: dict[int, int]) -> list[int] | None:
        if g < 3:
            return None
        sums, lens = self._pairs(), np.flatnonzero(self.n[: g - 1])[::-1]
        for a in map(int, lens):
            if (sums >> (g - a)) & 1 and self.n[a] > used.get(a, 0) and (r := self.two(g - a, used | {a: used.get(a, 0) + 1})):
                return [a, *r]
        return None


def pack(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns (lengths of a container, number of such containers) that use every item of counts {length: number}, 1 <= length <= capacity."""
    n = np.zeros(capacity + 1, np.int64)
    for x, c in counts.items():
        n[x] += c
    c, out, left = Complements(n), [], {}

    def use(pattern: list[int], times: int | None = None) -> None:
        lens, per = np.unique(pattern, return_counts=True)
        m = int((n[lens] // per).min()) if times is None else times
        n[lens] -= per * m
        if (n[lens] == 0).any():
            c.pairs = c.pairs if c.pairs < 0 or len(out) % 64 else -1
        out.append((pattern, m))

    for x in range(capacity, 0, -1):
        while n[x]:
            g, used = capacity - x, {x: 1}
            fill = [] if g == 0 else c.one(g, used) or c.two(g, used) or c.three(g, used)
            if fill is None:
                left[x], n[x] = int(n[x]), 0  # no exact complement: for best fit
            else:
                use([x, *fill])
    for x, k in left.items():
        n[x] += k
    while (lens := np.flatnonzero(n)).size:
        pattern, g = [], capacity
        free = n.copy()
        while True:
            fit = lens[(lens <= g) & (free[lens] > 0)]
            if not fit.size:
                break
            pattern.append(int(fit[-1]))
            free[fit[-1]] -= 1
            g -= int(fit[-1])
        use(pattern)
    return out


def slots(patterns: list[tuple[list[int], int]]) -> tuple[pd.DataFrame, int]:
    """Rows (length, first number, first container, items of that length in a container), sorted; and the number of containers."""
    nxt: dict[int, int] = {}
    rows, box = [], 0
    for pattern, m in patterns:
        for x, k in zip(*np.unique(pattern, return_counts=True)):
            rows.append((int(x), nxt.get(int(x), 0), box, int(k)))
            nxt[int(x)] = nxt.get(int(x), 0) + int(k) * m
        box += m
    return pd.DataFrame(rows, columns=["length", "first", "box", "per"]).sort_values(["length", "first"], ignore_index=True), box


def pack_items(df: DataFrame, item: str, size: str, capacities: list[tuple[str, int]]) -> DataFrame:
    """(container_kind, container_no, item, piece_no, start, size): every item in one container of each kind.

    An item larger than the capacity is cut into pieces of the capacity and a rest, which is an item like others; no other item is
    cut. Items of size 0 (or null) go into container 0, which takes no space. Repeated items count each time (with numbers of
    their own). The table of patterns that tasks get has at most a few rows for each length up to the capacity.
    """
    kinds = F.from_json(F.lit(json.dumps([{"container_kind": k, "capacity": int(c)} for k, c in capacities])), "array<struct<container_kind:string,capacity:long>>")
    d = df.select(F.col(item), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("total"))
    d = d.select("*", F.inline(kinds))  # a row for each kind; none if there are no kinds
    full, rest = F.floor(F.col("total") / F.col("capacity")), F.col("total") % F.col("capacity")
    last = d.select("*", full.alias("piece_no"), (full * F.col("capacity")).alias("start"), rest.alias("size")).where((F.col("size") > 0) | (F.col("total") == 0))
    whole = d.where(F.col("total") >= F.col("capacity")).select("*", F.explode(F.sequence(F.lit(0).cast("long"), full - 1)).alias("piece_no")).select("*", (F.col("piece_no") * F.col("capacity")).alias("start"), F.col("capacity").alias("size"))
    pieces = any_rank(last.unionByName(whole.select(last.columns)).where("size > 0"), ["container_kind", "size"], [item, "piece_no"], "rank", parts_for(df))
    pieces = cut(pieces.select("container_kind", item, "piece_no", "start", "size", "rank"))
    hist = pieces.groupBy("container_kind", "size").agg(F.count(F.lit(1)).alias("n")).toPandas()
    tables = {}
    for kind, cap in capacities:
        h = hist[hist["container_kind"] == kind]
        s, _ = slots(pack(dict(zip(map(int, h["size"]), map(int, h["n"]))), int(cap)))
        tables[kind] = tuple(s[c].to_numpy(np.int64) for c in ("length", "first", "box", "per"))
    shared = df.sparkSession.sparkContext.broadcast(tables)
    kind_of = dict(pieces.dtypes)[item]

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for kind, g in pdf.groupby("container_kind"):
                length, first, box, per = shared.value[kind]
                size, rank = g["size"].to_numpy(np.int64), g["rank"].to_numpy(np.int64)
                at = np.searchsorted((length << 44) + first, (size << 44) + rank, side="right") - 1
                yield pd.DataFrame({"container_kind": kind, "container_no": box[at] + (rank - first[at]) // per[at], item: g[item], "piece_no": g["piece_no"], "start": g["start"], "size": size})

    placed = pieces.mapInPandas(place, f"container_kind string, container_no long, `{item}` {kind_of}, piece_no long, start long, size long")
    none = last.where("size = 0").select("container_kind", F.lit(0).cast("long").alias("container_no"), item, F.lit(0).cast("long").alias("piece_no"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("size"))
    return placed.unionByName(none)


def pack_texts(documents: DataFrame, containers: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Texts of documents (doc_id, text) in containers of each kind (container_kind, capacity_tokens); rows as in pack_items, size as n_tokens."""
    caps = [(r[0], r[1]) for r in containers.where("container_kind is not null and capacity_tokens > 0").select("container_kind", "capacity_tokens").distinct().collect()]
    sized = cut(with_token_counts(documents, "text", ["doc_id"], vocabulary=vocabulary))
    p = pack_items(sized, "doc_id", "n_tokens", sorted(caps))
    return p.withColumnRenamed("start", "start_token").withColumnRenamed("size", "n_tokens")


def fill_report(packed: DataFrame, containers: DataFrame) -> DataFrame:
    """Per kind: containers used, tokens, share of space left over, and the least number of containers that the tokens need."""
    g = packed.groupBy("container_kind").agg(F.countDistinct("container_no").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), F.countDistinct("doc_id").alias("n_docs"))
    c = containers.select("container_kind", F.col("capacity_tokens").cast("long").alias("capacity_tokens")).distinct()
    j = g.join(c, "container_kind")
    return j.withColumn("unused_share", F.round(1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6)).withColumn("least_containers", F.ceil(F.col("n_tokens") / F.col("capacity_tokens")))
