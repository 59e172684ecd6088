"""The most similar vectors of every vector: inverted lists with an adaptive scan over column blocks.

Vectors are normalised, rotated by a random orthogonal matrix and put into lists by the nearest of many centres, fitted on a
bounded sample. Every vector probes the few lists whose centres are nearest. In a probed list distances are built up over
blocks of columns: after a block, a candidate is abandoned if its partial distance, scaled to all columns, exceeds the radius
by more than a test allows that holds for random rotations; only survivors see the next block.

Exact copies (after scaling, to five decimals) are one class, represented once: a class of any size costs the scan of one
vector. Lists that are expected to be large are dealt to tiles, and tiles of members meet tiles of queries in tasks of bounded size.

Centres have two levels: a few top centres are fitted on the driver, on a sample of fixed size, and the centres of each top cell by a
task of its own; a vector is compared with the centres of its nearest top cells only.

Without a least similarity the radius is each query's k-th best so far. Neighbours may be far then and lie in many lists, so the lists
are larger (their number grows with the root of the vectors, and so does the work of a query), vectors are stored by list in the
shared folder, and tiles of queries that lie together read the lists they probe from there: no vector is copied for its probes.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import cut, shared_dir


@dataclass(frozen=True)
class Search:
    k: int = 5
    min_similarity: float | None = 0.90  # None: the k most similar of every vector, however far
    probes: int = 5  # lists probed by each vector, of up to 1,024 (see probes_of)
    list_size: int = 256  # vectors in a list, on average, as long as there are fewer than 4 * sqrt(vectors) lists
    max_lists: int = 131_072  # bound of the table of centres, which is broadcast: 33 MB; reached at a billion vectors
    fit_rows: int = 16_384  # bound of the sample on which top centres are fitted
    top_probes: int = 16  # top cells whose centres a vector is compared with; on check_l 16 of 30 find 99.94 % of the pairs above 0.90, 8 find 99.81 %
    tile: int = 4096  # vectors in a tile
    block: int = 16  # columns in a block
    epsilon: float = 2.1  # width of the test: larger abandons less
    seed: int = 7
    far_probes: int = 24  # lists probed where there is no least similarity
    exact_tile: int = 8192  # queries in a task of the search without a least similarity


def rotation(dim: int, seed: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float64)


def fit_centres(x: np.ndarray, n: int, seed: int, rounds: int = 6) -> np.ndarray:
    """n unit centres of unit vectors x by spherical k-means; centres that lose all vectors restart at the worst fitted ones."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(n, len(x)), replace=False)].copy()
    for _ in range(rounds):
        best, sim = np.empty(len(x), np.int32), np.empty(len(x), np.float32)
        for i in range(0, len(x), 4096):
            s = x[i : i + 4096] @ c.T
            best[i : i + 4096] = s.argmax(1)
            sim[i : i + 4096] = s.max(1)
        total = np.zeros_like(c)
        np.add.at(total, best, x)
        empty = np.flatnonzero(np.bincount(best, minlength=len(c)) == 0)
        total[empty] = x[np.argsort(sim)[: len(empty)]]
        c = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def scan(q: np.ndarray, m: np.ndarray, s: Search, slice_pairs: int = 262_144) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, member index, similarity) of pairs of unit vectors with at least s.min_similarity, by the adaptive scan.

    Survivors of the first block go on in slices, so that memory stays bounded where nearly all pairs are similar.
    """
    dim, r2 = q.shape[1], 2.0 - 2.0 * s.min_similarity
    d = min(s.block, dim)
    limit = lambda d: r2 * (d / dim) * (1 + s.epsilon / np.sqrt(d)) ** 2 if d < dim else r2 + 1e-6
    part = (q[:, :d] ** 2).sum(1)[:, None] + (m[:, :d] ** 2).sum(1)[None, :] - 2 * (q[:, :d] @ m[:, :d].T)
    first_i, first_j = np.nonzero(part <= limit(d))
    out = [(first_i[:0], first_j[:0], np.zeros(0))]
    for at in range(0, len(first_i), slice_pairs):
        i, j, e = first_i[at : at + slice_pairs], first_j[at : at + slice_pairs], d
        p = part[i, j]
        while e < dim and len(i):
            b, e = e, min(e + s.block, dim)
            p = p + ((q[i, b:e] - m[j, b:e]) ** 2).sum(1)
            ok = p <= limit(e)
            i, j, p = i[ok], j[ok], p[ok]
        sim = np.einsum("ij,ij->i", q[i], m[j], dtype=np.float64) if len(i) else np.zeros(0)
        ok = sim >= s.min_similarity
        out.append((i[ok], j[ok], sim[ok]))
    return tuple(np.concatenate([o[c] for o in out]) for c in range(3))


def _top(a: np.ndarray, b: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k best b of each a, by similarity and then b."""
    o = np.lexsort((b, -sim, a))
    a = a[o]
    start = np.r_[True, a[1:] != a[:-1]]
    first = np.maximum.accumulate(np.where(start, np.arange(len(a)), 0))
    return o[np.arange(len(a)) - first < k]


def unit_vectors(df: DataFrame, item: str, vector: str, dim: int, seed: int) -> DataFrame:
    """(item, class, vec): usable vectors, scaled to norm 1 and rotated, as bytes of float32. class is a hash of the scaled vector."""
    rot = rotation(dim, seed)
    schema = pa.schema([("item", pa.string()), ("class", pa.int64()), ("vec", pa.binary())])

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
            n = np.sqrt((x * x).sum(1))
            ok = np.isfinite(n) & (n > 0)
            u = x[ok] / n[ok][:, None]
            grid = np.rint(u * 1e5).astype(np.int32)
            v = (u @ rot).astype(np.float32)
            keys = np.array([xxhash.xxh64_intdigest(g.tobytes()) for g in grid], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)).cast(pa.string()), pa.array(keys), pa.array([r.tobytes() for r in v], pa.binary())], schema=schema)

    d = df.where(F.col(item).isNotNull() & (F.size(vector) == dim)).select(F.col(item).cast("string").alias("item"), F.col(vector).cast("array<float>").alias("v"))
    return d.mapInArrow(scale, "item string, class long, vec binary")


@dataclass
class Centres:
    """Centres of lists in two levels: those of top cell t are flat[first[t] : first[t + 1]]. share: each list's share of the sample."""

    tops: np.ndarray
    flat: np.ndarray
    first: np.ndarray
    share: np.ndarray

    def nearest(self, v: np.ndarray, probes: int, reach: int) -> np.ndarray:
        """Numbers of the nearest lists of each vector, the nearest first; -1 where the top cells in reach have too few."""
        probes = min(probes, len(self.flat))
        if len(self.tops) <= reach:
            s, ids = v @ self.flat.T, None
        else:
            near = np.argpartition(-(v @ self.tops.T), reach - 1, axis=1)[:, :reach]
            width = int(np.diff(self.first).max())
            s, ids = np.full((len(v), reach * width), -np.inf, np.float32), np.full((len(v), reach * width), -1, np.int32)
            for t in np.unique(near):
                r, c = np.nonzero(near == t)
                a, z = self.first[t], self.first[t + 1]
                at = c[:, None] * width + np.arange(z - a)
                s[r[:, None], at], ids[r[:, None], at] = v[r] @ self.flat[a:z].T, np.arange(a, z)
        top = np.argpartition(-s, probes - 1, axis=1)[:, :probes] if probes < s.shape[1] else np.tile(np.arange(s.shape[1]), (len(v), 1))
        top = np.take_along_axis(top, np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable"), 1)
        return top if ids is None else np.take_along_axis(ids, top, 1)

    def step(self, reach: int) -> int:
        """Rows for which nearest stays within a few MB."""
        width = len(self.flat) if len(self.tops) <= reach else reach * int(np.diff(self.first).max())
        return int(np.clip(4_000_000 // width, 64, 2048))


def fit_index(reps: DataFrame, n: int, dim: int, lists: int, s: Search) -> Centres:
    """Centres of about so many lists for n vectors (class, vec).

    Up to 64 lists are fitted at once. Else the driver fits sqrt(lists) top centres, on at most 2 * fit_rows vectors, and each top cell its share
    of the lists, on about 32 vectors for each list; a cell gets at most four times the mean number of lists. The driver sees only centres.
    """
    of = lambda rows, salt: F.pmod(F.xxhash64("class", F.lit(salt)), F.lit(1_000_000_000)) < int(np.ceil(1e9 * min(1.0, rows / max(1, n))))
    sample = reps.where(of(s.fit_rows, 1)).select("class", "vec").limit(2 * s.fit_rows).toPandas().sort_values("class")["vec"]
    x = np.frombuffer(b"".join(map(bytes, sample)), np.float32).reshape(-1, dim)
    home = lambda v, c: np.concatenate([(v[i : i + 2048] @ c.T).argmax(1) for i in range(0, len(v), 2048)]) if len(v) else np.zeros(0, int)
    if lists <= 64 or not len(x):
        c = fit_centres(x, lists, s.seed) if len(x) else np.zeros((1, dim), np.float32)
        return Centres(c.mean(0, keepdims=True), c, np.array([0, len(c)]), np.bincount(home(x, c), minlength=len(c)) / max(1, len(x)))
    tops = fit_centres(x, int(round(np.sqrt(lists))), s.seed)
    shared = reps.sparkSession.sparkContext.broadcast(tops)
    rows = min(n, 32 * lists)
    most = 4 * -(-lists // len(tops))

    def cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t = home(_floats(b.column(1), dim), shared.value).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), b.column(0), b.column(1)], names=["top", "class", "vec"])

    def fit_cell(t: pa.Table) -> pa.Table:
        t = t.sort_by("class")
        v = _floats(t.column("vec"), dim)
        k = int(np.clip(round(lists * len(v) / rows), 1, most))
        c = fit_centres(v[: 64 * k], k, s.seed)
        size = np.bincount(home(v, c), minlength=len(c))
        return pa.table({"top": pa.array([t.column("top")[0].as_py()] * len(c), pa.int32()), "no": pa.array(range(len(c)), pa.int32()), "size": pa.array(size, pa.int64()), "vec": pa.array([r.tobytes() for r in c], pa.binary())})

    cells = reps.where(of(rows, 2)).select("class", "vec").mapInArrow(cell, "top int, class long, vec binary").groupBy("top").applyInArrow(fit_cell, "top int, no int, size long, vec binary")
    got = cells.toPandas().sort_values(["top", "no"])
    flat = np.frombuffer(b"".join(map(bytes, got["vec"])), np.float32).reshape(-1, dim)
    first = np.r_[0, np.cumsum(np.bincount(got["top"], minlength=len(tops)))]
    return Centres(tops, flat, first, got["size"].to_numpy() / max(1, got["size"].sum()))


def near_classes(reps: DataFrame, dim: int, s: Search) -> DataFrame:
    """(a, b, sim): for each class a up to s.k other classes b with the highest similarity of at least s.min_similarity."""
    n = reps.count()
    centres = fit_index(reps, n, dim, int(np.clip(min(-(-n // s.list_size), 4 * np.sqrt(n)), 1, s.max_lists)), s)
    probes = probes_of(len(centres.flat), s)
    # how many tiles a list needs, from the sample's share; a wrong estimate costs time and no result
    tiles = np.maximum(1, np.ceil(centres.share * n / s.tile)).astype(np.int64)
    shared = reps.sparkSession.sparkContext.broadcast((centres, tiles))
    out = pa.schema([("list", pa.int32()), ("qt", pa.int32()), ("mt", pa.int32()), ("role", pa.int8()), ("class", pa.int64()), ("vec", pa.binary())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, t = shared.value
        for b in batches:
            keys, vec = b.column(0).to_numpy(), b.column(1)
            v = np.frombuffer(b"".join(vec.to_pylist()), np.float32).reshape(-1, dim)
            step = c.step(s.top_probes)
            for i in range(0, len(v), step):
                near = c.nearest(v[i : i + step], probes, s.top_probes)
                rows = np.repeat(np.arange(len(near)), near.shape[1])
                lst = near.ravel()
                rows, lst = rows[lst >= 0], lst[lst >= 0]
                home = near[:, 0]
                is_home = lst == home[rows]
                own = keys[i : i + step].view(np.uint64)
                nt = t[lst]
                my = (own[rows] % nt.astype(np.uint64)).astype(np.int64)
                parts = [(rows, lst, my, my * 0 - 1, is_home & (nt == 1), 3), (rows, lst, my, my * 0 - 1, ~is_home & (nt == 1), 1)]
                cols = [[], [], [], [], []]
                for r, l, _, _, ok, role in parts:
                    for at, x in zip(cols, (l[ok], np.zeros(ok.sum(), int), np.zeros(ok.sum(), int), np.full(ok.sum(), role), r[ok])):
                        at.append(x)
                for w in np.flatnonzero(nt > 1):  # tiles: the query's tile meets all tiles of members, the member's all tiles of queries
                    k = int(nt[w])
                    every, mine = np.arange(k), np.full(k, my[w])
                    for qt, mt, role in [(mine, every, 1), *([(every, mine, 2)] if is_home[w] else [])]:
                        for at, x in zip(cols, (np.full(k, lst[w]), qt, mt, np.full(k, role), np.full(k, rows[w]))):
                            at.append(x)
                l, qt, mt, role, r = (np.concatenate(x) for x in cols)
                yield pa.RecordBatch.from_arrays([pa.array(l.astype(np.int32)), pa.array(qt.astype(np.int32)), pa.array(mt.astype(np.int32)), pa.array(role.astype(np.int8)), pa.array(keys[i : i + step][r]), vec.slice(i, step).take(pa.array(r))], schema=out)

    def scan_list(t: pa.Table) -> pa.Table:
        role, key = t.column("role").to_numpy(), t.column("class").to_numpy()
        v = np.frombuffer(b"".join(t.column("vec").to_pylist()), np.float32).reshape(-1, dim)
        qi, mi = np.flatnonzero(role & 1), np.flatnonzero(role & 2)
        found = []
        for i in range(0, len(qi), 1024):
            for j in range(0, len(mi), 4096):
                a, b, sim = scan(v[qi[i : i + 1024]], v[mi[j : j + 4096]], s)
                ka, kb = key[qi[i : i + 1024]][a], key[mi[j : j + 4096]][b]
                ok = np.flatnonzero(ka != kb)
                ka, kb, sim = np.r_[ka[ok], kb[ok]], np.r_[kb[ok], ka[ok]], np.r_[sim[ok], sim[ok]]  # a pair holds in both directions
                top = _top(ka, kb, sim, 2 * s.k) if len(ok) else ok
                found.append((ka[top], kb[top], sim[top]))
        a, b, sim = (np.concatenate([f[c] for f in found]) if found else np.zeros(0, d) for c, d in ((0, np.int64), (1, np.int64), (2, np.float64)))
        top = _top(a, b, sim, 2 * s.k) if len(a) else np.zeros(0, int)
        return pa.table({"a": a[top], "b": b[top], "sim": sim[top]})

    probed = reps.select("class", "vec").mapInArrow(assign, "list int, qt int, mt int, role byte, class long, vec binary")
    tasks = max(int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * probes * (4 * dim + 48) // (64 << 20)))  # about 64 MB each
    pairs = probed.repartition(tasks, "list", "qt", "mt").groupBy("list", "qt", "mt").applyInArrow(scan_list, "a long, b long, sim double")
    best = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return pairs.groupBy("a", "b").agg(F.max("sim").alias("sim")).withColumn("r", F.row_number().over(best)).where(F.col("r") <= s.k).drop("r")


def _floats(vec: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(vec.to_pylist()), np.float32).reshape(-1, dim)


class Best:
    """The k most similar members so far of each query, by similarity and then key."""

    def __init__(self, keys: np.ndarray, q: np.ndarray, s: Search):
        self.keys, self.q, self.s, self.k = keys, q, s, s.k
        self.sim, self.member = np.full((len(q), s.k), -np.inf), np.zeros((len(q), s.k), np.int64)
        self.rest = 0  # calls for which the test is left out, because it left too many

    def meet(self, keys: np.ndarray, m: np.ndarray, who: np.ndarray | None = None, step: int = 1024, slice_pairs: int = 131_072) -> None:
        """Takes in members, for the queries `who` (all, exactly, if it is None)."""
        for at in range(0, len(self.q) if who is None else len(who), step):
            w = np.arange(at, min(at + step, len(self.q))) if who is None else who[at : at + step]
            i, j = self._candidates(self.q[w], m, self.sim[w, -1], who is not None)
            for x in range(0, len(i), slice_pairs):
                self._add(w[i[x : x + slice_pairs]], j[x : x + slice_pairs], keys, m)

    def _candidates(self, q: np.ndarray, m: np.ndarray, kth: np.ndarray, test: bool) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that may belong to the k best. Abandoned is what is further than the k-th best so far, by a test on the first blocks of
        columns where it leaves few (else all columns at once cost less, and the test is tried again after a while); the rest is compared in single precision with a margin."""
        dim, d = q.shape[1], self.s.block
        self.rest = max(0, self.rest - 1)
        if test and d < dim and not self.rest and np.isfinite(kth).all():
            r2 = 2 - 2 * kth
            factor = lambda d: (d / dim) * (1 + self.s.epsilon / np.sqrt(d)) ** 2 if d < dim else 1 + 1e-5
            part = (q[:, :d] ** 2).sum(1)[:, None] + (m[:, :d] ** 2).sum(1)[None, :] - 2 * (q[:, :d] @ m[:, :d].T)
            i, j = np.nonzero(part <= (r2 * factor(d))[:, None])
            if len(i) < 0.05 * part.size:
                p = part[i, j]
                while d < dim and len(i):
                    z = min(d + self.s.block, dim)
                    p = p + ((q[i, d:z] - m[j, d:z]) ** 2).sum(1)
                    ok = p <= r2[i] * factor(z) + 1e-5
                    i, j, p, d = i[ok], j[ok], p[ok], z
                return i, j
            self.rest = 256
        s = q @ m.T
        least = kth - 1e-5
        rows = np.flatnonzero(s.max(1) >= least)
        i, j = np.nonzero(s[rows] >= least[rows, None])
        return rows[i], j

    def _add(self, i: np.ndarray, j: np.ndarray, keys: np.ndarray, m: np.ndarray) -> None:
        ok = self.keys[i] != keys[j]
        i, j = i[ok], j[ok]
        sim = np.einsum("ij,ij->i", self.q[i], m[j], dtype=np.float64)
        u = np.unique(i)
        a, b, sim = np.r_[np.repeat(u, self.k), i], np.r_[self.member[u].ravel(), keys[j]], np.r_[self.sim[u].ravel(), sim]
        top = _top(a, b, sim, self.k)
        self.sim[u], self.member[u] = sim[top].reshape(-1, self.k), b[top].reshape(-1, self.k)

    def edges(self) -> pa.RecordBatch:
        a, ok = np.repeat(self.keys, self.k), np.isfinite(self.sim).ravel()
        return pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(self.member.ravel()[ok]), pa.array(self.sim.ravel()[ok])], schema=EDGE)


EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sim", pa.float64())])


def probes_of(lists: int, s: Search) -> int:
    """Lists to probe of so many: s.probes, and one more for each doubling beyond 1,024."""
    return min(lists, s.probes + int(np.ceil(np.log2(max(lists, 1024) / 1024))))


def all_near_classes(reps: DataFrame, dim: int, s: Search) -> DataFrame:
    """(a, b, sim): for each class a the s.k other classes b with the highest similarity (all others if they are fewer).

    There are sqrt(n) / 4 lists of about 4 * sqrt(n) vectors, stored by list; a tile of queries from neighbouring lists reads the s.far_probes
    lists that each query is nearest to, in blocks, so a query is compared with about 4 * s.far_probes * sqrt(n) vectors. With at most
    s.far_probes lists nothing is left out and the result is exact.
    """
    spark = reps.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/vectors_{uuid.uuid4().hex}"
    n = reps.count()
    centres = fit_index(reps, n, dim, int(np.clip(np.sqrt(n) / 4, 1, s.max_lists)), s)
    lists = len(centres.flat)
    exact, probes = lists <= s.far_probes, min(lists, s.far_probes)
    reach = max(s.top_probes, -(-4 * probes * len(centres.tops) // lists))  # top cells that hold four times as many lists
    a_bucket = -(-lists // 256)
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for b in batches:
            v, step = _floats(b.column(1), dim), c.step(reach)
            home = np.concatenate([c.nearest(v[i : i + step], 1, reach)[:, 0] for i in range(0, len(v), step)]) if len(v) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array((home // a_bucket).astype(np.int32)), b.column(0), b.column(1)], names=["list", "bucket", "class", "vec"])

    placed = reps.select("class", "vec").mapInArrow(assign, "list int, bucket int, class long, vec binary")
    spread = F.pmod(F.xxhash64("class"), F.lit(max(1, -(-n // (256 * 100_000)))))  # a bucket of a third of all vectors is written by several tasks
    placed.repartition(F.col("bucket"), spread).sortWithinPartitions("bucket", "list").write.partitionBy("bucket").option("compression", "none").option("parquet.enable.dictionary", "false").option("parquet.block.size", str(1 << 20)).parquet(path)

    def scan_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [(b.column(0).to_numpy(), _floats(b.column(1), dim)) for b in batches if b.num_rows]
        if not own:
            return
        c, best = shared.value, Best(np.concatenate([k for k, _ in own]), np.concatenate([v for _, v in own]), s)
        step = c.step(reach)
        near = np.concatenate([c.nearest(best.q[i : i + step], probes, reach) for i in range(0, len(best.q), step)])
        order = np.argsort(near.ravel(), kind="stable")
        asked, start = np.unique(near.ravel()[order], return_index=True)
        who = dict(zip(asked.tolist(), np.split(order // near.shape[1], start[1:])))
        who.pop(-1, None)
        fs, at = pa.fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
        demand: dict[int, int] = {}
        for l, w in who.items():
            demand[l // a_bucket] = demand.get(l // a_bucket, 0) + len(w)
        width = 64  # the first blocks are small: until there are k, every member of a block is taken in
        for bucket in sorted(demand, key=lambda b: -demand[b]):  # the queries' own lists first: their k-th best is soon near
            if fs.get_file_info(f"{at}/bucket={bucket}").type == pa.fs.FileType.NotFound:
                continue
            here = [l for l in who if l // a_bucket == bucket]
            members = pa.dataset.dataset(f"{at}/bucket={bucket}", filesystem=fs, format="parquet")
            for b in members.to_batches(columns=["list", "class", "vec"], filter=pa.dataset.field("list").isin(here), batch_size=8192, batch_readahead=1, fragment_readahead=1, use_threads=False):
                if not b.num_rows:
                    continue
                lst, keys, v = b.column(0).to_numpy(), b.column(1).to_numpy(), _floats(b.column(2), dim)
                edges = np.r_[0, np.flatnonzero(np.diff(lst)) + 1, len(lst)]
                for i, z in zip(edges, edges[1:]):
                    x = i
                    while x < z:
                        best.meet(keys[x : min(z, x + width)], v[x : min(z, x + width)], None if exact else who[int(lst[i])])
                        x, width = x + width, min(2048, 4 * width)
        yield best.edges()

    stored = spark.read.schema("list int, class long, vec binary").parquet(path)
    tiles = max(1, -(-n // s.exact_tile))
    edges = cut(stored.select("class", "vec", "list").repartitionByRange(tiles, "list", "class").select("class", "vec").mapInArrow(scan_lists, "a long, b long, sim double"))
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)
    return edges


def nearest(df: DataFrame, item: str, vector: str, dim: int = 64, s: Search = Search()) -> DataFrame:
    """(item, neighbour, similarity, rank): for each item up to s.k others with the highest cosine similarity, at least s.min_similarity.

    If that is None, every item has s.k others however far (all others if they are fewer): the most similar ones in the lists it probes.
    Vectors that are null, of another length, all zero or hold a null or NaN take no part; norms do not matter. An item that
    comes in several rows counts once for each different vector it has. Ties go to the smaller item. Copies of a vector are the
    nearest neighbours of each other with similarity 1: an item of a large class of copies gets s.k of them. An empty table gives no rows.
    """
    items = unit_vectors(df, item, vector, dim, s.seed)
    reps = cut(items.groupBy("class").agg(F.first("vec").alias("vec")))
    members = cut(items.select("class", "item").distinct())
    edges = all_near_classes(reps, dim, s) if s.min_similarity is None else near_classes(reps, dim, s)
    few = members.withColumn("r", F.row_number().over(Window.partitionBy("class").orderBy("item"))).where(F.col("r") <= s.k + 1)
    edges = edges if s.min_similarity is None else cut(edges)
    touched = edges.select(F.col("a").alias("class")).union(edges.select(F.col("b"))).distinct()
    copied = few.where("r = 2").select("class")
    few = cut(few.join(touched.union(copied).distinct(), "class", "left_semi"))
    size = few.groupBy("class").agg(F.max("r").alias("m"))
    # copies of the item itself: the first s.k others of its class
    f = few.select("class", F.col("item").alias("neighbour"), F.col("r").alias("fr"))
    mine = members.join(copied, "class", "left_semi").join(few.select("class", "item", "r"), ["class", "item"], "left")
    own = mine.join(f, "class").where((F.col("item") != F.col("neighbour")) & ((F.col("fr") <= s.k) | (F.col("r") <= s.k)))
    own = own.select("item", "neighbour", F.lit(1.0).alias("similarity"), F.when(F.col("r") < F.col("fr"), F.col("fr") - 1).otherwise(F.col("fr")).alias("rank"))
    # members of other classes fill the places that are left
    near = edges.join(f.withColumnRenamed("class", "b"), "b")
    near = near.withColumn("nr", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("sim"), "neighbour"))).where(F.col("nr") <= s.k)
    near = near.join(size.withColumnRenamed("class", "a"), "a").where(F.col("nr") + F.col("m") - 1 <= s.k)
    cross = near.join(members.withColumnRenamed("class", "a"), "a").select("item", "neighbour", F.col("sim").alias("similarity"), (F.col("nr") + F.col("m") - 1).alias("rank"))
    return own.unionByName(cross).where("item <> neighbour")


def near_pairs(df: DataFrame, item: str, vector: str, dim: int = 64, s: Search = Search()) -> DataFrame:
    """(item_a, item_b), item_a < item_b: pairs in which one is among the s.k most similar of the other, see nearest."""
    n = nearest(df, item, vector, dim, s)
    return n.select(F.least("item", "neighbour").alias("item_a"), F.greatest("item", "neighbour").alias("item_b")).distinct()
