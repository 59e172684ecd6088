import random

import pytest

from corvane.llm import moderation as M

GOOD = ["The cache is cleared after each run.", "Please kill the child process before the parent exits.", "The trash folder is emptied daily.", "We measured the slow path and moved the lock.", "This damn bug took me the whole afternoon.", "The word list of the filter holds entries such as insults.", "Complexity fell after the rule was extracted."]
BAD = ["You are a worthless idiot and everybody laughs at you.", "Shut up, you pathetic clown.", "Those people are vermin and must be wiped out.", "Send me nude pictures tonight.", "I will find you and break your legs."]


def text(rng, bad):
    s = [rng.choice(GOOD) for _ in range(rng.randint(2, 6))]
    if bad:
        s.insert(rng.randint(0, len(s)), rng.choice(BAD))
    return " ".join(s)


@pytest.mark.parametrize(("a", "b"), [("You IDIOT", "you idiot"), ("y0u 1d10t", "you idiot"), ("you i-d-i-o-t", "you idiot"), ("you i d i o t", "you idiot"), ("you id​iot", "you idiot"), ("you idiоt", "you idiot"), ("yooou idiiiot", "you idiot"), ("you `code_name` idiot", "you § idiot")])
def test_disguises(a, b):
    assert M.plain(a) == M.plain(b)


def test_windows_cover_long_texts():
    t = "word " * 50_000
    assert len(M.windows(t)) > 1000
    assert M.windows("") == [] and M.windows("!!!") == []


def test_held_out_accuracy():
    rng = random.Random(1)
    docs = [(i, i % 6 == 0, M.windows(text(rng, i % 6 == 0))) for i in range(400)]
    docs = [(i, t != (i % 41 == 0), w) for i, t, w in docs]  # some wrong labels
    m = M.fit(docs)
    hit = [max((m.score(w) for w in M.windows(text(rng, b))), default=0) >= m.threshold for b in [True] * 60 + [False] * 200]
    assert sum(hit[:60]) >= 57 and sum(hit[60:]) <= 4


def test_table(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, i % 5 == 0), "forum_post" if i % 2 else " Forum-Post", 1.0) for i in range(300)] + [(900, None, None, 1.0), (901, "", "x", 1.0), (902, GOOD[0] * 3000 + " " + BAD[0], "x", 1.0), (903, BAD[0].upper(), "x", 1.0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, f"r{k}", "Abusive " if i % 5 == 0 else "clean", "x") for i in range(200) for k in range(2)] + [(1, "r9", None, "x"), (None, "r", "clean", "x"), (5, "r7", "clean", "x")], "doc_id long, annotator string, label string, text string")
    m = M.train(d, labels)
    out = M.score_documents(d, m)
    got = {r["doc_id"]: r["toxic"] for r in out.collect()}
    assert len(got) == len(rows)
    assert all(got[i] for i in range(0, 300, 5)) and sum(got[i] for i in range(300) if i % 5) <= 3
    assert got[902] and got[903] and not got[900] and not got[901]
    rep = {r["source"]: (r["n_docs"], r["n_toxic"]) for r in M.rates(out).collect()}
    assert rep["forum_post"][0] == 300 and rep[None] == (1, 0)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "You are a stupid moron, what a useless loser!", "x"), (2, GOOD[3], "x")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, "r", "clean")], "doc_id long, annotator string, label string")
    m = M.train(d, labels.limit(0))
    assert {r["doc_id"]: r["toxic"] for r in M.score_documents(d, m).collect()} == {1: True, 2: False}  # by the seeds alone
    assert M.score_documents(d.limit(0), M.train(d.limit(0), labels)).count() == 0


@pytest.mark.parametrize(("a", "b"), [("you are an i_d_i_o_t", "you are an idiot"), ("you I_D_I_O_T_", "you idiot_"), ("you IdIoT, StUpId", "you idiot, stupid"), ("you і_d_і_о_t", "you idiot"), ("see get_user, x_max, FooBar and MyIdiot", "see §, §, § and §")])
def test_disguises_that_look_like_code(a, b):
    assert M.plain(a) == M.plain(b)


def test_long_labelled_documents_keep_all_windows(spark, monkeypatch):
    long = "\n".join(f"the {a}{b} module reads the {b}{a} table" for a in ("alpha", "beta", "gamma", "delta", "kappa", "sigma", "omega", "theta") for b in (x + y for x in "bdfgklmnpr" for y in "aeiou")) + "\nyou are a useless idiot"
    docs = spark.createDataFrame([(1, long), (2, "the cache is closed")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, "a", "abusive"), (2, "a", "clean")], "doc_id long, annotator string, label string")
    seen = {}
    monkeypatch.setattr(M, "fit", lambda rows, *_: seen.update({i: (t, set(w)) for i, t, w in rows}))
    M.train(docs, labels)
    want = set(M.windows(long))
    assert len(want) > 400 and seen[1] == (True, want) and seen[2][0] is False


@pytest.mark.parametrize(("text", "want"), [("`you stupid idiot`", ["you stupid idiot"]), ("you/idiot/pig die", ["you idiot pig die"]), ("call `drop_all` in src/core/engine.py", ["cal § in §"]), ("你去死", ["你去死"]), ("滚蛋", ["滚蛋"]), ("die", ["die"]), ("ok", [])])
def test_short_windows_and_speech_dressed_as_code(text, want):
    assert M.windows(text) == want


def test_few_labels_do_not_make_stock_phrases_toxic(spark):
    """Ten toxic and twenty clean documents are labelled, of 900; phrases that stand in toxic ones by chance are frequent in the collection."""
    rng = random.Random(6)
    stock = [f"the {a} {v} the {b} after each {c}" for a, v, b, c in (rng.sample("reader writer loads closes index table merge split cursor worker parcel signal".split(), 4) for _ in range(40))]
    rows = [(i, ". ".join([*rng.sample(stock, 4), *([rng.choice(BAD)] if i % 30 == 0 else [])]) + ".", "x") for i in range(900)]
    labels = [(i, "r", "abusive") for i in range(0, 300, 30)] + [(i, "r", "clean") for i in range(1, 300, 15)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = M.score_documents(d, M.train(d, spark.createDataFrame(labels, "doc_id long, annotator string, label string"))).where("toxic").collect()
    hit = {r["doc_id"] for r in out}
    true = set(range(0, 900, 30))
    assert len(hit & true) >= 0.8 * len(true) and len(hit - true) <= len(true)
