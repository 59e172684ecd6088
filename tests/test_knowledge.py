import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions.code import boost, grade, intent
from corvane.operators import chunking as C
from corvane.operators import scoring as S
from corvane.operators import vectors as V


@pytest.mark.parametrize(("n", "size", "overlap", "want"), [(0, 10, 3, []), (10, 10, 3, [0]), (11, 10, 3, [0, 7]), (30, 10, 10, [0, 10, 20]), (25, 10, 4, [0, 6, 12, 18])])
def test_window_starts(spark, n, size, overlap, want):
    assert spark.range(1).select(C.window_starts(F.lit(n), size, overlap)).first()[0] == want


def test_windows_cover_the_text(spark):
    t = "".join(f"line {i}\n" for i in range(300))
    out = C.windows(spark.createDataFrame([(1, t)], "id int, t string"), "t", ["id"], 500, 60).orderBy("chunk_no").collect()
    assert all(r["content"] == t[r["start_idx"] : r["end_idx"]] and r["start_line"] == t[: r["start_idx"]].count("\n") + 1 for r in out)
    assert out[-1]["end_idx"] == len(t)


def test_merge_functions(spark):
    f = spark.createDataFrame([("a", "f1", 1, 10), ("a", "getX", 12, 2), ("a", "f2", 15, 10), ("a", "f3", 60, 30), ("a", "f4", 95, 40)], "id string, name string, line int, loc int")
    got = [(r["start_line"], r["end_line"], r["names"]) for r in C.merge_functions(f, ["id"]).orderBy("start_line").collect()]
    assert got == [(1, 25, "f1, f2"), (60, 135, "f3, f4")]


def test_route_and_issue_overlap(spark):
    d = spark.createDataFrame([("a/test.py", ".py", "x"), ("package.json", ".json", "{}"), ("x.yaml", ".yaml", "a: 1"), ("index.ts", ".ts", "export * from 'a'\n"), ("m.py", ".py", "x = 1")], "p string, e string, c string")
    assert [r[0] for r in d.select(C.route(F.col("p"), F.col("e"), F.col("c"))).collect()] == ["skip", "config", "skip", "skip", "whole"]
    c = spark.createDataFrame([("1", "r", "src/a.py", 1, 10), ("2", "r", "src/a.py", 20, 30), ("3", "r", "b.py", None, None)], "id string, repository_id string, file_path string, start_line int, end_line int")
    i = spark.createDataFrame([("r", "a.py", 5), ("r", "lib/b.py", 99), ("r", None, 1)], "repository_id string, file_path string, line_number int")
    assert sorted(r[0] for r in C.chunks_with_issues(c, i).collect()) == ["1", "3"]


def test_search_many_is_exact(spark):
    x = np.random.default_rng(0).standard_normal((200, 8))
    x[7] = x[3]
    d = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(500, None), (501, [1.0]), (502, [0.0] * 8)], "id long, v array<double>").repartition(3)
    out = {}
    for r in V.search_many(d, d.where("id % 50 = 0"), 4, "id", "v", 8, block=2).collect():
        out.setdefault(r["query"], []).append((r["rank"], r["id"]))
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in (0, 50, 100, 150):
        s = n @ n[q]
        want = [i for i in sorted(range(200), key=lambda i: (-s[i], i)) if i != q][:4]
        assert [i for _, i in sorted(out[q])] == want


def test_search_rerank_and_neighbours(spark):
    c = spark.createDataFrame([("a", "x/auth.py", 1, [1.0, 0.0], "r", "c1"), ("b", "y.py", 10, [1.0, 0.05], "r", "c2"), ("c", "y.py", 100, [0.0, 1.0], "r", "c3"), ("d", "y.py", 400, None, "r", "c4")], "chunk_id string, file_path string, start_line int, embedding array<double>, repository_id string, content string")
    assert [r["chunk_id"] for r in V.search(c, [1.0, 0.0], 2).collect()] == ["a", "b"]
    assert V.grounded(c, [1.0, 0.1], 1).first()["chunk_id"] == "a"
    hits = c.where("chunk_id = 'b'")
    assert [r["chunk_id"] for r in V.neighbours(hits, c).collect()] == ["c"]


def test_budget_confidence_embedding(spark):
    d = spark.createDataFrame([(1, 9000), (2, 10)], "id int, n int")
    assert [r["id"] for r in V.within_budget(d, ["id"], F.col("n")).collect()] == [1]
    d = spark.createDataFrame([(1, 4000), (2, 3500), (3, 600)], "id int, n int")
    assert [r["id"] for r in V.within_budget(d, ["id"], F.col("n")).collect()] == [1, 2]
    e = spark.createDataFrame([("q", 0.9, "a"), ("q", 0.85, "b"), ("q", 0.7, "c")], "q string, similarity double, file_path string")
    assert tuple(V.confidence(e, ["q"]).first()) == ("q", 85, True)
    v = V.hash_embedding(spark.createDataFrame([("a b",), (None,)], "t string"), "t", [], 16).collect()
    assert abs(sum(x * x for x in v[0]["embedding"]) - 1) < 1e-5 and not any(v[1]["embedding"])


def test_scores(spark):
    c = lambda x: F.lit(x)
    row = spark.range(1).select(S.security_score(c(1), c(2), c(0), c(1)).alias("s"), *[v.alias(k) for k, v in S.health_parts(c(5.0), c(3), c(1), c(0), c(1), c(0), c(1), c(2), c(0.1), c(4.0)).items()], S.simulate(c(95), c(16)).alias("sim"), grade(c(80)).alias("g"), boost(c("src/auth/x.py")).alias("b"), intent(c("Explain the folder structure")).alias("i")).first()
    assert (row["s"], row["complexity"], row["maintainability"], row["security"], row["architecture"], row["documentation"], row["duplication"], row["sim"], row["g"], row["b"], row["i"]) == (40, 22, 20, 13, 10, 5, 3, 100, "B", 0.30, "ARCHITECTURE")
