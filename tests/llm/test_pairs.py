import datetime as dt

import pytest

from corvane.llm import pairs as P
from corvane.llm.languages import asked_language, language

T = dt.datetime(2024, 1, 1)
Q = "Which files depend on src/core/thing.py and why?"
A = "The report module reads it once at startup. Nothing else touches the shared cache."
CASES = [
    (Q, A, None), (Q, "Yes.", None), (Q, "src/a.py", None), (Q, "Nothing.", None), (Q, "", "empty"), (Q, None, "empty"), (Q, "```\n```", "empty"), (Q, "​ \n", "empty"), (Q, "N/A", "empty"), (Q, "<p></p>", "empty"), (Q, "Answer:", "empty"),
    (Q, "The report module reads it once at startup. It is called by the", "truncated"), (Q, A + "\n\n```python\ndef f(a):", "truncated"), (Q, A + "\n\n- `src/a.py`\n- `src/b", "truncated"), (Q, A + "\n\n- `src/a.py`\n- `src/b.py`", None), (Q, A + "\n\n```python\ndef f(a):\n    pass\n```", None), (Q, A + "\n\n| a | b |\n|---|---|\n| 1 | 2 |", None),
    (Q, "I'm sorry, but I can't help with that request.", "refusal"), (Q, "I can't assist with this one. Please ask a maintainer instead.", "refusal"), (Q, "I can't run the tests here, but the code shows that the cache is closed too early.", None), (Q, "The parser can't read an empty file, so it is skipped.", None),
    (Q, Q, "copied_question"), (Q, Q.lower(), "copied_question"), (Q, "> " + Q, "copied_question"), (Q, Q + " " + Q, "copied_question"), (Q, Q + " " + A, None),
    (Q, "Das Modul liest die Datei beim Start und niemand sonst benutzt sie.", "other_language"), (Q, "该函数读取记录并把它写入存储。", "other_language"), ("Please answer in German: " + Q, "Das Modul liest die Datei beim Start und niemand sonst benutzt sie.", None), ("Please answer in German: " + Q, A, "other_language"),
    ("Welche Dateien hängen von der Klasse ab und warum?", "Das Modul liest die Datei beim Start.", None), ("Welche Dateien hängen von der Klasse ab und warum?", "Es tut mir leid, dabei kann ich nicht helfen.", "refusal"), (None, A, None), ("", A, None),
]


@pytest.fixture(scope="module")
def field():
    rows = []
    for q, a, _ in CASES * 12:
        p = P.Pair(q, a)
        rows.append((p.features(), p.rule_tags()))
    return P.fit_field(rows)


def defect(field, q, a):
    return next(iter(P.defects(field, [(q, a)])))[0]


@pytest.mark.parametrize(("q", "a", "want"), CASES)
def test_cases(field, q, a, want):
    assert defect(field, q, a) == want


def test_viterbi_is_the_best_path(field):
    import itertools

    import numpy as np

    f = P.Pair(Q, A).features()[:3]
    s = P.Sequences([f]).scores(field.state)
    score = lambda t: field.start[t[0]] + sum(s[i, x] for i, x in enumerate(t)) + sum(field.trans[a, b] for a, b in zip(t, t[1:]))
    assert np.isclose(max(map(score, itertools.product(range(6), repeat=len(f)))), score(field.best([f])[0]))


def test_languages():
    assert [language(t) for t in (A, "La función lee el registro y lo entrega.", "La fonction lit le fichier et le transmet.", "A função lê o registro e o entrega.", "src/a.py", "")] == ["en", "es", "fr", "pt", None, None]
    assert asked_language("Reply in Spanish, please. What is it?") == "es" and asked_language(Q) is None


def test_table(spark):
    rows, n = [], 0
    for k, (q, a, _) in enumerate(CASES):
        rows += [(f"q{k}", f"s{k}", "User", q, T, 1, 0.0), (f"a{k}", f"s{k}", " ai", a, T, 1, 0.0)]
    rows += rows[:4] + [("x1", None, "user", Q, T, 1, 0.0), ("x2", None, "assistant", None, T, 1, 0.0), ("y1", "z", "assistant", None, T, 1, 0.0), ("w1", "v", "user", Q, T, 1, 0.0), ("w2", "v", "system", "note", T + dt.timedelta(1), 1, 0.0), ("w3", "v", "assistant", "very " * 30_000 + "long text. It is the", T + dt.timedelta(2), 1, 0.0)]
    m = spark.createDataFrame(rows, "id string, session_id string, role string, content string, created_at timestamp, defect int, answer double")
    got = {r["id"]: r["defect"] for r in P.defective_pairs(m).collect()}
    want = {f"a{k}": d for k, (_, _, d) in enumerate(CASES) if d} | {"w3": "truncated"}
    assert sum(got.get(k) == v for k, v in want.items()) >= 0.9 * len(want) and len(got.keys() - want.keys()) <= 2
    assert "x2" not in got and "y1" not in got
    assert P.defective_pairs(m.limit(0)).count() == 0


def test_all_words_of_a_long_clause_are_read():
    import numpy as np

    words = [a + b + c for a in "bdfg" for b in "aeiou" for c in "klmn"]
    one, two = (P.Pair(Q, " ".join([*words, w, "done."])).features() for w in ("zebra", "walrus"))
    assert len(one) == len(two) == 1 and not np.array_equal(one[0], two[0])


def test_many_answers_at_once_are_tagged_like_single_ones(field):
    both = [(q, a) for q, a, _ in CASES] + [(Q, "\n".join(f"Line {i} reads the cache." for i in range(300)))]
    assert [d for d, _ in P.defects(field, both, step=7)] == [defect(field, q, a) for q, a in both]


def _texts(r, nouns):
    """(question, answer, defect) over the given nouns: none of a defective answer's own words come again in other rows but those of its form."""
    a, b, c, d = (r.choice(nouns) for _ in range(4))
    q = r.choice([f"Which module calls the {a} and what does the {b} do with the {c}?", f"How does the {a} reach the {b}, and where is the {c} kept?", f"Why is the {a} slower than the {b} in the {c} test?"])
    body = [f"The {a} reads the {b} and hands it to the {d}.", f"After that the {c} waits for the {d} and closes it.", f"Every {b} has one {c}, which the {a} owns.", f"It was moved next to the {d} last year."]
    r.shuffle(body)
    body = body[: r.randint(1, 4)]
    kind = r.choice([None, None, None, "truncated", "refusal", "copied_question", "other_language", "empty"])
    if kind == "truncated":
        words = body[-1].split()
        body[-1] = " ".join(words[: r.randint(2, len(words) - 2)])
    if kind == "refusal":
        body = [r.choice([f"I'm sorry, but I can't help with the {a}.", "I would rather not answer that.", "That is outside of what I can talk about, please ask someone else.", f"I have no information about the {b}."])]
    if kind == "copied_question":
        body = [r.choice([q, q.lower(), "> " + q])]
    if kind == "other_language":
        body = [f"Das Modul liest die Datei {d} beim Start und gibt sie weiter.", "Danach wartet es auf die Antwort."][: r.randint(1, 2)]
    if kind == "empty":
        body = [r.choice(["", "...", "N/A", "<br>", "```\n```", " "])]
    return q, r.choice([" ", "\n"]).join(body), kind


def test_held_out_nouns():
    """Fitted on one set of nouns by the labelling rules, judged on another by what was really done to the answer."""
    import random

    r = random.Random(8)
    seen, new = ([f"{x}{y}" for x in xs for y in ("ledger", "cursor", "parcel", "beacon", "tariff")] for xs in (("dry", "red", "low"), ("wet", "blue", "tall")))
    rows = []
    for q, a, _ in (_texts(r, seen) for _ in range(1500)):
        p = P.Pair(q, a)
        rows.append((p.features(), p.rule_tags()))
    field = P.fit_field(rows)
    held = [_texts(r, new) for _ in range(600)]
    got = [d for d, _ in P.defects(field, [(q, a) for q, a, _ in held])]
    assert sum(g == w for g, (*_, w) in zip(got, held)) >= 0.97 * len(held)


def test_unbroken_runs_take_linear_time():
    p = P.Pair(Q, "x" * 300_000 + " `" + "<" * 200_000)
    assert len(p.features()) == 1 and p.rule_tags()
