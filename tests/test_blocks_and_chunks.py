import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.operators import analyzers as A
from corvane.operators import chunking as C
from corvane.operators import scoring as S
from corvane.operators import vectors as V


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-2, 2), min_size=1, max_size=60), st.integers(0, 59), st.integers(-8, 8))
def test_running_first(steps, start, most):
    r = A.Running(np.array(steps))
    sums = np.cumsum(steps)
    assert r.first(start, most) == next((i for i in range(start, len(steps)) if sums[i] <= most), None)


def slow_block_end(lines, i):
    opened = depth = 0
    for k in range(i, len(lines)):
        opened += lines[k].count("{")
        depth += lines[k].count("{") - lines[k].count("}")
        if opened and depth <= 0:
            return k + 1
    return len(lines)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a {", "}", "} else {", "x", "{ {", "} }", "f() {}", ""]), min_size=1, max_size=40))
def test_ends_of_brace_blocks(lines):
    ends = A.BlockEnds(lines)
    assert [ends.after(i) for i in range(len(lines))] == [slow_block_end(lines, i) for i in range(len(lines))]


RUBY = "class A\n  def one\n    if x\n      y\n    end\n  end\n\n  def two; 1 end\n\n  def three\n    begin\n      z\n    end while q\n  end\nend\n".split("\n")


@pytest.mark.parametrize(("i", "end"), [(0, 15), (1, 6), (2, 5), (9, 14), (10, 13)])
def test_ends_of_keyword_blocks(i, end):
    assert A.KeywordEnds(RUBY).after(i) == end


def test_many_declarations_in_one_file_take_little_time():
    text = "\n".join(f"function f{i}(a) {{" for i in range(20_000))
    assert len(A.declarations_of(text, ".js")) == 20_000


SMALL = "class Small {\n  int one() {\n    return 1;\n  }\n}"
JAVA = "package a;\n" + SMALL + "\n\nclass Big {\n" + "\n".join(f"  int m{k}(int a) {{\n    int b = a;\n    return b;\n    // {k}\n  }}\n" + "\n" * (30 if k == 3 else 1) for k in range(12)) + "\n  int getX() {\n    return 1; }\n}\n"


def test_code_chunks(spark):
    plain = "some words and more of them.\n" * 60
    long = "def f():\n" + "\n".join(f"    x{i} = {i} * 1234567890" for i in range(200))
    rows = [("j", ".java", JAVA), ("t", ".txt", plain), ("p", ".py", long), ("e", ".py", ""), ("n", ".py", None), ("b", ".py", "def broken(:\n")]
    f = spark.createDataFrame(rows, "id string, extension string, content string")
    got = {}
    for r in C.code_chunks(f, A.facts(f)).collect():
        got.setdefault(r["id"], []).append(r)
    assert set(got) == {"j", "t", "p", "b"}
    lines = JAVA.split("\n")
    for r in got["j"]:
        assert r["content"] == "\n".join(lines[r["start_line"] - 1 : r["end_line"]])
    kinds = sorted((r["chunk_type"], r["names"].split(", ")[0]) for r in got["j"])
    assert ("Class", "Small") in kinds and ("Class Header", "Big") in kinds
    assert not any("one" in r["names"].split(", ") or "getX" in r["names"] for r in got["j"])  # inside a small class; an accessor
    merged = [r for r in got["j"] if r["chunk_type"] == "Merged Functions"]
    assert len(merged) == 2 and merged[0]["end_line"] < merged[1]["start_line"] or merged[1]["end_line"] < merged[0]["start_line"]
    assert all(r["chunk_type"] == "Window" for r in got["t"] + got["b"]) and max(len(r["content"]) for r in got["t"]) == 800
    parts = sorted(got["p"], key=lambda r: r["part"])
    assert [r["part"] for r in parts] == list(range(len(parts))) and len(parts) > 1 and all(len(r["content"]) <= 2000 for r in parts)
    assert parts[0]["start_line"] == 1 and parts[-1]["end_line"] == 201
    assert C.code_chunks(f.limit(0), A.facts(f.limit(0))).count() == 0


def test_windows_like_slices(spark):
    r = random.Random(3)
    texts = ["".join(r.choice("ab\né中") for _ in range(n)) for n in (0, 1, 49, 50, 51, 120, 777)]
    d = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    for size, overlap in ((50, 10), (50, 0), (20, 30)):
        for x in C.windows(d, "t", ["k"], size, overlap).collect():
            t, a = texts[x["k"]], x["start_idx"]
            assert x["content"] == t[a : a + size] and x["end_idx"] == a + len(x["content"])
            assert x["start_line"] == 1 + t[:a].count("\n") and x["end_line"] == x["start_line"] + x["content"].count("\n")


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 9), st.integers(0, 30)), min_size=1, max_size=40))
def test_within_budget(spark, data):
    rows = [(g, p, i, n) for i, (g, p, n) in enumerate(data)]
    d = spark.createDataFrame(rows, "g string, p int, i int, n int")
    got = {r["i"] for r in V.within_budget(d, ["p", "i"], F.col("n"), 40, ["g"]).collect()}
    want = set()
    for g in {x[0] for x in rows}:
        total = 0
        for k, x in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (x[1], x[2]))):
            total += x[3]
            if k == 0 or total <= 40:
                want.add(x[2])
    assert got == want


def test_search_many_with_ties_and_tiles(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((300, 8)).round(1)
    x[100:150] = x[7]
    rows = [(f"k{i:03d}", [float(v) for v in x[i]]) for i in range(300)] + [("zero", [0.0] * 8), ("none", None), ("short", [1.0])]
    d = spark.createDataFrame(rows, "id string, v array<double>").repartition(5)
    q = d.where("id like '%0' or id in ('zero', 'none')")
    got = {}
    for row in V.search_many(d, q, 4, "id", "v", 8, tile=64, block=7).collect():
        got.setdefault(row["query"], []).append((row["rank"], row["id"]))
    n = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 300, 10):
        s = n @ n[i]
        best = sorted((j for j in range(300) if j != i), key=lambda j: (-round(float(s[j]), 12), j))[:4]
        assert [k for _, k in sorted(got[f"k{i:03d}"])] == [f"k{j:03d}" for j in best]
    assert set(got) == {f"k{i:03d}" for i in range(0, 300, 10)}
    assert V.search_many(d.limit(0), q, 4, "id", "v", 8).count() == 0 and V.search_many(d, q.limit(0), 4, "id", "v", 8).count() == 0


def test_assessment(spark):
    f = spark.createDataFrame(
        [("r", "README.md", 10, 1, 0, 0, "Unknown", False), ("r", "src/controllers/UserController.py", 100, 2, 0, 0, "Controller", False), ("r", "src/services/user_service.py", 100, 2, 1, 0, "Service", False), ("r", "src/repositories/repo.py", 100, 2, 0, 0, "Repository", False), ("r", "tests/test_user.py", 50, 1, 0, 0, "Unknown", False), ("q", None, None, None, None, None, None, None)],
        "repository_id string, path string, lines_of_code int, complexity int, code_smells_count int, coupling_score int, module_type string, in_dependency_cycle boolean",
    )
    langs = spark.createDataFrame([("r", 5)], "repository_id string, languages int")
    sec = spark.createDataFrame([("r", 90)], "repository_id string, security int")
    ratio = spark.createDataFrame([("r", 0.2)], "repository_id string, ratio double")
    got = {r["repository_id"]: r for r in S.assessment(f, langs, sec, ratio).collect()}
    assert (got["r"]["consistency"], got["r"]["security"], got["r"]["documentation"], got["r"]["architecture"]) == (80, 90, 40, 100)  # documents for 60 points are missing
    assert got["q"]["security"] == 100 and got["q"]["documentation"] == 0
    live = {r["repository_id"]: r for r in S.assessment(f, langs, sec, ratio, compat=True).collect()}
    assert live["r"]["consistency"] == 100
