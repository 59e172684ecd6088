import random

import pytest

from corvane.llm import handwritten as H

NAMES = "ledger cursor parcel beacon tariff garden walker sensor matrix folder".split()


def hand(r):
    return "import json\n\n" + "\n".join(f"def {r.choice(NAMES)}_{r.choice(NAMES)}(value, limit={r.randint(1, 50)}):\n    # keeps the order\n    if value is None:\n        return {r.randint(1, 9)}\n    return [x for x in value if x.{r.choice(NAMES)} < limit]\n" for _ in range(r.randint(2, 6)))


def minified(r):
    return "".join(f"function {chr(97 + r.randint(0, 25))}(e,t){{return e&&t?e[t]:{r.randint(0, 9)}}}var n={r.randint(0, 99)},o=!0;" for _ in range(r.randint(20, 40)))


def data(r):
    return f"{r.choice(NAMES).upper()} = [\n" + "\n".join("    " + ", ".join(str(r.randint(0, 65535)) for _ in range(12)) + "," for _ in range(40)) + "\n]\n"


def make(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        kind = r.choices(["hand", "minified", "data", "generated", "vendored"], [80, 6, 4, 5, 5])[0]
        repo, p = f"r{i % 23}", f"src/{r.choice(NAMES)}/{r.choice(NAMES)}_{i}.py"
        text = {"minified": minified, "data": data}.get(kind, hand)(r)
        if kind == "generated":
            text = r.choice(["# Code generated by Tool. DO NOT EDIT.\n", "# @generated by x from y\n", "# Autogenerated: manual edits are overwritten\n"]) + text
        if kind == "vendored":
            if r.random() < 0.5:
                p = f"third_party/lib{r.randint(0, 5)}/{r.choice(NAMES)}.py"
            else:
                text = "# Taken verbatim from lib 1.2.3, do not reformat\n" + text
        out.append((str(i), repo, p, len(text), max(1, text.count("\n")), text, True, kind))
    return out


SCHEMA = "id string, repository_id string, path string, size_bytes bigint, lines_of_code int, content string, is_text boolean, kind string"


def test_found_by_kind(spark):
    rows = make(900, 1)
    got = {r["id"] for r in H.classify(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {r[0] for r in rows if r[-1] != "hand"}
    assert len(got & want) >= 0.97 * len(want)
    assert len(got - want) <= 0.02 * len(rows)


def test_nulls_repeats_and_odd_rows(spark):
    rows = make(400, 2)
    odd = [("n1", "r", "web/app.min.js", 900, 1, None, True, "x"), ("n2", None, None, None, None, None, None, "x"), ("n3", "r", "a.png", 5, 0, None, False, "x"), ("n4", "r", "src/a/b_1.py", 0, -3, "", True, "x"), ("n5", "r", "src/a/c_2.py", 10, 1, hand(random.Random(9)) * 2000, True, "x")]
    twice = [("t1", *rows[0][1:]), ("t2", *rows[0][1:])]
    d = spark.createDataFrame(rows + odd + twice, SCHEMA)
    got = {r["id"] for r in H.classify(d).collect()}
    assert "n3" not in got and "n5" not in got
    assert ("t1" in got) == ("t2" in got) == (rows[0][0] in got)
    kept = H.handwritten(d)
    assert kept.columns == d.columns and kept.where("id = 'n3'").count() == 0 and kept.where("id = 'n5'").count() == 1


def test_empty_table(spark):
    d = spark.createDataFrame(make(3, 1), SCHEMA)
    assert H.classify(d.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "blocks"),
    [("# a\n# b\nx = 1\n", ["# a\n# b"]), ("/* a\n b */\n#include <x>\n", ["/* a\n b */"]), ("x = 1", []), ("", []), ("int a;\n\n  // one\n  // two\nint b; // no block\n/* open", ["// one\n  // two", "/* open"]), (";a=1\n;b=2", []), ("-- q\nselect 1", ["-- q"])],
)
def test_split_comments(text, blocks):
    got, code = H.split_comments(text)
    assert got == blocks and all(b not in code for b in blocks)


def test_many_open_comments_take_linear_time():
    text = "/* a\n" * 100_000 + '"' * 100_000
    assert len(H.split_comments(text)[0]) == 1


def test_masking_leaves_out_all_comments():
    t = "x = 1\n# Code generated by Tool. DO NOT EDIT.\ny = 2\n# plain\n"
    f = H.features("a.py", 5, 1, t)
    assert len(f.blocks) == 2 and all((i < H.DIMS["comment"]).all() for i, _ in f.blocks) and (f.code[0] >= H.DIMS["comment"]).all()


@pytest.mark.parametrize("text", ["// Code generated by protoc. DO NOT EDIT.", "# This file is auto-generated, never modify it by hand.", "/* built by the schema compiler */", "// changes here will be lost", "# regenerated from x.yaml", "// must not be edited manually"])
def test_banners_of_tools(text):
    assert H.banner_labels([text]) == {"generated"}


@pytest.mark.parametrize("text", ["/*! x v3.1.0 | https://x.example | Released under the MIT licence */", "// (c) The Example Authors", "# vendored from https://x.example at 3f2a", "/* @license y */", "# Copied verbatim from lib 2.0"])
def test_banners_of_third_parties(text):
    assert H.banner_labels([text]) == {"vendored"}


@pytest.mark.parametrize("text", ["# Writes the client. Never edit its output, edit the templates here.", "// Do not change the order of these calls without asking", "// replaces the old vendored copy of x", "// created by Ann on 2020-01-02", "# ids are generated later", "# needs version 3.2 or later", "# Copyright (c) our team."])
def test_comments_of_people(text):
    assert not H.banner_labels([text])


def test_banner_far_down_in_other_words(spark):
    """Rows for fitting have banners at the top only; rows that are judged have them anywhere, in words of their own."""
    r = random.Random(4)
    rows = [x for x in make(900, 3)]
    late = []
    for i in range(40):
        body = hand(r)
        at = body.index("\n\n", len(body) // 2)
        banner = r.choice(["# Code generated by Maker from model.xml. DO NOT EDIT.", "# @generated by maker", "# Autogenerated file: manual edits are overwritten by the next run"])
        late.append((f"late{i}", f"r{i % 23}", f"src/{r.choice(NAMES)}/{r.choice(NAMES)}_{i}.py", 900, 30, body[:at] + f"\n\n{banner}\n" + body[at:], True, "generated"))
    got = {x["id"] for x in H.classify(spark.createDataFrame(rows + late, SCHEMA)).collect()}
    assert sum(x[0] in got for x in late) >= 38
