import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import mixing as M
from corvane.llm import packing as P
from corvane.llm.tokens import count_tokens


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80), st.integers(40, 60))
def test_pack_uses_each_item_once(lens, cap):
    out = P.pack(dict(Counter(lens)), cap)
    assert all(sum(p) <= cap for p, _ in out)
    assert Counter(x for p, m in out for x in p for _ in range(m)) == Counter(lens)


def test_exact_complements_fill():
    out = P.pack({60: 10, 40: 10, 30: 5, 70: 5, 20: 4, 35: 4, 45: 4}, 100)
    assert sum(m for _, m in out) == 19 and all(sum(p) == 100 for p, _ in out)


def items(spark, sizes, extra="x"):
    return spark.createDataFrame([(i, s, extra, 1, 2) for i, s in enumerate(sizes)], "doc_id long, n_tokens long, container_kind string, rank int, size int")


def test_pack_items(spark):
    random.seed(4)
    sizes = [random.choice([0, None, 1, 7, 50, 50, 50, 99, 100, 230, 1000]) for _ in range(600)] + [50] * 300
    out = P.pack_items(items(spark, sizes), "doc_id", "n_tokens", [("a", 100), ("b", 512)]).collect()
    for kind, cap in (("a", 100), ("b", 512)):
        boxes, seen, cut = Counter(), {}, set()
        for r in out:
            if r["container_kind"] == kind:
                boxes[r["container_no"]] += r["size"]
                seen.setdefault(r["doc_id"], []).append((r["piece_no"], r["start"], r["size"]))
        assert set(seen) == set(range(len(sizes))) and max(boxes.values()) <= cap
        for i, ps in seen.items():
            ps.sort()
            assert sum(s for *_, s in ps) == (sizes[i] or 0) and [a for _, a, _ in ps] == list(np.cumsum([0, *[s for *_, s in ps]])[:-1])
            assert len(ps) == 1 or sizes[i] > cap
            cut |= {i} if len(ps) > 1 else set()
        used = sum(x or 0 for x in sizes)
        assert len([b for b, n in boxes.items() if n]) <= used / cap * 1.02 + 2


def test_pack_empty(spark):
    assert P.pack_items(items(spark, []), "doc_id", "n_tokens", [("a", 10)]).count() == 0
    assert P.pack_items(items(spark, [3]), "doc_id", "n_tokens", []).count() == 0


def test_pack_texts(spark):
    texts = ["word " * n for n in (3, 700, 0, 5)] + [None, "é" * 5000]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    caps = spark.createDataFrame([("small", 512), ("bad", 0), (None, 5)], "container_kind string, capacity_tokens int")
    out = P.pack_texts(docs, caps)
    got = Counter()
    for r in out.collect():
        got[r["doc_id"]] += r["n_tokens"]
    assert got == Counter({i: count_tokens(t) for i, t in enumerate(texts)})
    assert P.fill_report(out, caps).first()["n_docs"] == 6


def test_allocate_redistributes_to_siblings_first():
    root = M.build_tree([(("a", "x"), 0.25, 100.0), (("a", "y"), 0.25, 10.0), (("b", "z"), 0.5, 100.0)])
    M.allocate(root, 100)
    a, b = root.children["a"], root.children["b"]
    assert (a.children["x"].budget, a.children["y"].budget, b.budget) == (40.0, 10.0, 50.0)
    root = M.build_tree([(("a", "x"), 0.5, 20.0), (("b", "z"), 0.5, 100.0)])
    M.allocate(root, 100)
    assert root.children["b"].budget == 80.0


def docs(spark, spec):
    rows = [(i, "word " * (5 + i % 40), lang, src, 7) for i, (src, lang) in enumerate(x for s, l, n in spec for x in [(s, l)] * n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, epoch int")


def test_mix_reaches_shares(spark):
    d = docs(spark, [("readme", "en", 900), (" Read-Me", "de", 30), ("forum_post", "en", 300), ("review comment", None, 200), ("other", "en", 50), ("design_note", "xx9", 0)])
    t = spark.createDataFrame([("readme", 0.5, 2), ("read_me", 0.1, 4), ("forum_post", 0.2, 3), ("review_comment", 0.15, 1), ("tutorial", 0.05, 4), (None, 0.3, 1)], "source string, target_share double, repeat_cap int")
    m = M.mix(d, t).cache()
    rep = {r["source"]: r for r in M.share_report(m, t).collect()}
    assert set(rep) == {"readme", "read_me", "forum_post", "review_comment", "tutorial"}
    for s, want in (("readme", 0.5), ("read_me", 0.1), ("forum_post", 0.2), ("review_comment", 0.15)):
        assert want * 0.97 < rep[s]["share"] < want + 0.06
        assert rep[s]["most_uses"] <= rep[s]["repeat_cap"]
    assert rep["tutorial"]["n_rows"] == 0
    assert m.groupBy("doc_id", "epoch").count().where("count > 1").count() == 0
    assert {tuple(r) for r in m.collect()} == {tuple(r) for r in M.mix(d.repartition(7), t).collect()}


def test_sources_of_few_and_long_texts_reach_their_shares(spark):
    """Long texts beside short ones in several languages: what leaves leave over is filled, and only then is anything lacking."""
    rows = [(i, "word " * (900 if i % 7 == 0 else 3 + i % 11), ["en", "de", "fr", "pt"][i % 4], ["a", "b", "b", "c"][i % 4 if i % 5 else 0]) for i in range(500)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    t = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.1, 3), ("none", 0.1, 2)], "source string, target_share double, repeat_cap int")
    m, budgets = M.mix_with_plan(d, t, domains={"c": "x", "none": "x"})
    rep = {r["source"]: r for r in M.share_report(m, t, budgets).collect()}
    for s in "abc":
        assert abs(rep[s]["share"] - rep[s]["planned_share"]) < 0.02 * rep[s]["planned_share"] and rep[s]["most_uses"] <= rep[s]["repeat_cap"]
    assert rep["c"]["planned_share"] > 0.15 and rep["none"]["lacking"] == 0.1  # the share of none goes to c, its sibling
    short, _ = M.mix_with_plan(d, t, total=10_000_000.0)  # more than there is: everything is used as often as the caps allow
    uses = {r["source"]: (r["least"], r["most"]) for r in short.groupBy("source", "doc_id").count().groupBy("source").agg({"count": "min"}).withColumnRenamed("min(count)", "least").join(short.groupBy("source", "doc_id").count().groupBy("source").agg({"count": "max"}).withColumnRenamed("max(count)", "most"), "source").collect()}
    assert uses == {"a": (2, 2), "b": (1, 1), "c": (3, 3)}
    one = m.where("source = 'b'").orderBy("epoch", "order_key").collect()
    assert len({(r["epoch"], r["order_key"]) for r in one}) == len(one)


def test_fill_takes_long_texts_first():
    assert M.fill({"a": 100, "b": 7, "c": 0}, [("a", 60, 2), ("a", 30, 5), ("a", 9, 1), ("b", 8, 3), ("b", 7, 1), ("c", 1, 4), ("d", 1, 1)]) == [("a", 60, 1), ("a", 30, 1), ("a", 9, 1), ("b", 7, 1)]


def test_mix_empty(spark):
    t = spark.createDataFrame([("readme", 0.5, 2)], "source string, target_share double, repeat_cap int")
    d = docs(spark, [("readme", "en", 3)])
    assert M.mix(d.limit(0), t).count() == 0
    assert M.mix(d, t.limit(0)).count() == 0
    assert M.share_report(M.mix(d.limit(0), t), t).first()["share"] == 0.0


@pytest.mark.parametrize("text", ["", None, "a" * 100_000, " " * 100_000, "<|endoftext|>"])
def test_token_counts(text):
    assert count_tokens(text) >= (1 if text else 0)
