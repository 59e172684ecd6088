import numpy as np
import pytest

from corvane.llm import neighbours as N
from corvane.llm.neighbour_queries import p7_neighbours

SCHEMA = "chunk_id string, embedding array<float>, class long, vec string, item string, sim double"


def table(spark, ids, x, extra=()):
    rows = [(i, None if v is None else [float(a) for a in v], 1, "v", "i", 0.5) for i, v in zip(ids, x)] + list(extra)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def families(n, size, dim=64, seed=0, noise=0.03):
    r = np.random.default_rng(seed)
    c = r.standard_normal((n, dim))
    return np.concatenate([c + noise * r.standard_normal((n, dim)) for _ in range(size)])


def brute(ids, x, k, least):
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = n @ n.T
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(ids)):
        for j in sorted(range(len(ids)), key=lambda j: (-s[i, j], ids[j]))[:k]:
            if s[i, j] >= least:
                out.add(tuple(sorted((ids[i], ids[j]))))
    return out


def test_recall_and_precision(spark):
    x = np.concatenate([families(120, 4), np.random.default_rng(1).standard_normal((1500, 64))])
    x *= np.random.default_rng(2).uniform(0.5, 3, (len(x), 1))
    ids = [f"c{i:05d}" for i in range(len(x))]
    got = {tuple(r) for r in N.near_pairs(table(spark, ids, x), "chunk_id", "embedding", s=N.Search(list_size=64)).collect()}
    want = brute(ids, x, 5, 0.9)
    assert len(want) > 300
    assert len(got & want) >= 0.98 * len(want)
    assert len(got - want) <= 0.01 * len(want)


def test_copies_are_one_class(spark):
    x = families(6, 3, seed=4)
    hot = np.tile(x[0] * 2, (300, 1))
    ids = [f"c{i:05d}" for i in range(len(x) + len(hot))]
    out = N.nearest(table(spark, ids, np.concatenate([x, hot])), "chunk_id", "embedding").collect()
    by = {}
    for r in out:
        by.setdefault(r["item"], []).append((r["rank"], r["neighbour"], r["similarity"]))
    copies = ["c00000", *ids[len(x) :]]
    for c in copies:
        assert [n for _, n, _ in sorted(by[c])] == [h for h in copies if h != c][:5]
    near = {ids[6], ids[12]}
    assert all({n for _, n, _ in by[i]} & set(copies) for i in near)


def test_tiles_give_the_same(spark):
    x = families(40, 5, seed=7)
    ids = [f"c{i:05d}" for i in range(len(x))]
    a, b = ({tuple(r) for r in N.near_pairs(table(spark, ids, x), "chunk_id", "embedding", s=N.Search(list_size=100, tile=t)).collect()} for t in (4096, 17))
    assert a == b == brute(ids, x, 5, 0.9)


def test_unusable_vectors_and_repeats(spark):
    x = families(3, 2, seed=9)
    ids = ["a", "b", "c", "d", "e", "f"]
    bad = [("n", None, 1, "", "", 0.0), ("z", [0.0] * 64, 1, "", "", 0.0), ("s", [1.0] * 32, 1, "", "", 0.0), ("h", [None] * 64, 1, "", "", 0.0), ("q", [float("nan")] * 64, 1, "", "", 0.0), (None, [1.0] * 64, 1, "", "", 0.0), ("a", [float(v) for v in x[0]], 2, "", "", 0.0)]
    got = {tuple(r) for r in N.near_pairs(table(spark, ids, x, bad), "chunk_id", "embedding").collect()}
    assert got == {("a", "d"), ("b", "e"), ("c", "f")}


@pytest.mark.parametrize("n", [0, 1])
def test_small_tables(spark, n):
    t = table(spark, ["a"][:n], np.ones((n, 64)))
    assert N.near_pairs(t, "chunk_id", "embedding").count() == 0


def test_rotation_keeps_distances():
    q = N.rotation(64, 7)
    assert np.allclose(q @ q.T, np.eye(64))


def test_dense_cluster_of_a_third(spark):
    rng = np.random.default_rng(11)
    dense = families(1, 1, seed=12) + 2e-3 * rng.standard_normal((400, 64))
    x = np.concatenate([dense, rng.standard_normal((800, 64))])
    ids = [f"c{i:05d}" for i in range(len(x))]
    out = N.nearest(table(spark, ids, x), "chunk_id", "embedding", s=N.Search(list_size=50, tile=64)).collect()
    by = {}
    for r in out:
        by.setdefault(r["item"], set()).add(r["neighbour"])
    assert all(len(by[i]) == 5 for i in ids[:400]) and set(by) == set(ids[:400])
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = n[:400] @ n[:400].T
    np.fill_diagonal(s, -2)
    hits = sum(len(by[ids[i]] & {ids[j] for j in np.argsort(-s[i])[:5]}) for i in range(400))
    assert hits >= 0.9 * 5 * 400


def test_every_chunk_has_its_nearest_however_far(spark, tmp_path):
    x = np.concatenate([families(20, 3, seed=14), np.random.default_rng(15).standard_normal((400, 64))])
    ids = [f"c{i:05d}" for i in range(len(x))]
    table(spark, ids, x, [("z", [0.0] * 64, 1, "", "", 0.0), ("n", None, 1, "", "", 0.0)]).write.parquet(str(tmp_path / "repository_embeddings.parquet"))
    got = {}
    for r in sorted(p7_neighbours(spark, str(tmp_path)).collect(), key=lambda r: r["rank"]):
        got.setdefault(r["chunk_id"], []).append(r["neighbour_id"])
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = n @ n.T
    np.fill_diagonal(s, -2)
    assert got == {ids[i]: [ids[j] for j in np.argsort(-s[i])[:5]] for i in range(len(ids))}


def test_exact_pass_over_tiles_and_few_vectors(spark):
    x = np.random.default_rng(16).standard_normal((90, 64))
    ids = [f"c{i:05d}" for i in range(len(x))]
    a, b = ({tuple(r)[:2] for r in N.nearest(table(spark, ids, x), "chunk_id", "embedding", s=N.Search(min_similarity=None, exact_tile=t)).collect()} for t in (8192, 7))
    assert a == b and len(a) == 5 * len(x)
    for n, want in ((0, 0), (1, 0), (3, 6)):
        assert N.nearest(table(spark, ids[:n], x[:n]), "chunk_id", "embedding", s=N.Search(min_similarity=None)).count() == want


def test_probes_follow_the_number_of_lists(spark, monkeypatch):
    assert [N.probes_of(n, N.Search()) for n in (1, 10, 900, 1024, 1025, 2048, 8192)] == [1, 5, 5, 5, 6, 6, 8]


def test_two_levels_of_centres_find_nearly_the_same(spark):
    """Lists so small that there are many: recall of close pairs and of the nearest however far, against brute force."""
    x = np.concatenate([families(400, 5, seed=17, noise=0.12), np.random.default_rng(18).standard_normal((2000, 64))])
    ids = [f"c{i:05d}" for i in range(len(x))]
    t = table(spark, ids, x).cache()
    want = brute(ids, x, 5, 0.9)
    reps = N.unit_vectors(t, "chunk_id", "embedding", 64, 7)
    c = N.fit_index(reps, len(x), 64, 250, N.Search())
    assert len(c.tops) == 16 and 200 < len(c.flat) < 320 and c.first[-1] == len(c.flat) and abs(c.share.sum() - 1) < 1e-9
    got = {tuple(r) for r in N.near_pairs(t, "chunk_id", "embedding", s=N.Search(list_size=16, top_probes=6)).collect()}
    assert len(want) > 1000 and len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)
    flat = N.fit_centres(x[:500].astype(np.float32) / np.linalg.norm(x[:500], axis=1, keepdims=True).astype(np.float32), 30, 1)
    two = N.Centres(flat[:3], flat, np.array([0, 10, 20, 30]), np.ones(30) / 30)
    v = np.random.default_rng(3).standard_normal((50, 64)).astype(np.float32)
    assert (two.nearest(v, 4, 3) == np.argsort(-(v @ flat.T), axis=1)[:, :4]).all()
    few = two.nearest(v, 12, 1)
    assert few.shape == (50, 10) and all(len({l // 10 for l in r if l >= 0}) == 1 for r in few)


def test_far_neighbours_by_lists(spark):
    """36 lists of which 20 are probed: every item has k others, and nearly all of the true ones."""
    x = np.concatenate([families(700, 6, seed=21, noise=0.5), np.random.default_rng(22).standard_normal((16_500, 64))])
    ids = [f"c{i:05d}" for i in range(len(x))]
    got = {}
    for r in N.nearest(table(spark, ids, x), "chunk_id", "embedding", s=N.Search(min_similarity=None, far_probes=20, exact_tile=3000)).collect():
        got.setdefault(r["item"], set()).add(r["neighbour"])
    assert set(got) == set(ids) and all(len(v) == 5 for v in got.values())
    n = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    hit = 0
    for i in range(0, len(x), 69):
        s = n @ n[i]
        s[i] = -2
        hit += len(got[ids[i]] & {ids[j] for j in np.argpartition(-s, 5)[:5]})
    assert hit >= 0.9 * 5 * len(range(0, len(x), 69))
