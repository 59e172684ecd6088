import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import splitting as S

PLAN = S.Plan(limit=100, overlap=10, slack=20, cells=3)


def pieces(text, plan=PLAN):
    out = []
    for r in range(-(-len(text) // plan.range_size)):
        lo, hi = S._bounds(r, len(text), plan)
        out += list(S.pieces_of_range(text[lo:hi], lo, r, len(text), plan))
    return out


def check(text, out, plan=PLAN):
    assert out[0][0] == 0 and out[-1][1] == len(text)
    spare = 3 if isinstance(text, bytes) else 0
    for (_, z), (a, _) in zip(out, out[1:]):
        assert z - plan.overlap <= a <= z - plan.overlap + spare
    assert all(0 < z - a <= plan.limit for a, z in out)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n\r,é́中。{}\t" + "x" * 20, min_size=101, max_size=1500))
def test_pieces_cover_and_stay_within_the_limit(text):
    out = pieces(text)
    check(text, out)
    assert all(not (text[z - 1 : z] == "\r" and text[z : z + 1] == "\n") for _, z in out)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .\n\rßجمل中。😀{}\t", min_size=101, max_size=900))
def test_pieces_of_bytes_are_whole_characters(text):
    raw = text.encode()
    out = pieces(raw)
    check(raw, out)
    cuts = [0, *(z for _, z in out)]
    assert "".join(raw[a:z].decode() for a, z in zip(cuts, cuts[1:])) == text
    assert all(raw[a:z].decode() for a, z in out)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 130), min_size=8, max_size=40))
def test_runs_that_fit_are_never_cut(lengths):
    """Words of any length up to the largest that a piece can hold: no piece ends inside one that fits."""
    text = " ".join("w" * n for n in lengths) + " " + "end " * 30
    starts, at = set(), 0
    for n in lengths:
        starts |= set(range(at + 1, at + n)) if n <= PLAN.limit - PLAN.overlap - 2 else set()
        at += n + 1
    out = pieces(text)
    check(text, out)
    assert not [z for _, z in out if z in starts]


def test_natural_boundaries_come_first():
    random.seed(1)
    text = "\n".join("word " * random.randint(1, 3) for _ in range(300))
    assert all(text[z - 1] == "\n" for _, z in pieces(text)[:-1])
    text = "x" * 1000
    check(text, pieces(text))


@pytest.mark.parametrize("bad", [S.Plan(limit=100, overlap=60, slack=30), S.Plan(limit=10, overlap=-1, slack=1)])
def test_plans_are_checked(bad):
    with pytest.raises(ValueError):
        bad.check()


def table(spark, rows):
    return spark.createDataFrame(rows, "chunk_id string, content string, start_line int, body string, lines int, k string")


def test_table(spark):
    random.seed(3)
    long = "\r\n".join("some text, and more. " * random.randint(0, 6) for _ in range(400))
    very = "line\n" * 60_000
    rows = [("a", long, 11, "z", 1, "q"), ("a", long, 11, "z", 2, "q"), ("b", very, None, "z", 1, "q"), ("c", "short", 1, "z", 1, "q"), ("d", None, 1, "z", 1, "q"), (None, long, 1, "z", 1, "q"), ("e", "", -4, "z", 1, "q"), ("f", "中" * 3001, 0, "z", 1, "q")]
    out = S.split_texts(table(spark, rows), "chunk_id", "content", "start_line").collect()
    by = {}
    for r in sorted(out, key=lambda r: (r["chunk_id"], r["piece_no"])):
        by.setdefault(r["chunk_id"], []).append(r)
    assert set(by) == {"a", "b", "f"}
    texts = {"a": (long, 11), "b": (very, 1), "f": ("中" * 3001, 1)}
    for k, ps in by.items():
        t, first = texts[k]
        assert [p["piece_no"] for p in ps] == list(range(len(ps)))
        check(t, [(p["start_pos"], p["end_pos"]) for p in ps], S.Plan())
        for p in ps:
            assert p["content"] == t[p["start_pos"] : p["end_pos"]]
            assert p["start_line"] == first + t[: p["start_pos"]].count("\n")
            assert p["end_line"] == p["start_line"] + p["content"][:-1].count("\n")


def test_empty_table(spark):
    assert S.split_texts(table(spark, [("a", "x", 1, "", 1, "")]).limit(0), "chunk_id", "content", "start_line").count() == 0


@pytest.mark.parametrize("line", ["Zeile {i} mit Größe\n", "第{i}行的内容，没有空格。还有一句\n", "السطر {i} من النص؟ نعم.\n", "{i}😀👩‍👩‍👧😀", "{i}" + "中" * 7000])
def test_files_are_read_by_ranges(spark, tmp_path, line):
    text = "".join(line.format(i=i) for i in range(20 if len(line) > 99 else 30_000))
    raw = text.encode()
    (tmp_path / "big.txt").write_bytes(raw)
    (tmp_path / "small.txt").write_bytes(b"x")
    files = spark.read.format("binaryFile").load(str(tmp_path)).select("path", "length")
    out = sorted(S.split_files(spark, files.union(files)).collect(), key=lambda r: r["piece_no"])
    assert [p["piece_no"] for p in out] == list(range(len(out))) and len(raw) > S.Plan().range_size
    check(raw, [(p["start_pos"], p["end_pos"]) for p in out], S.Plan())
    assert all(raw[p["start_pos"] : p["end_pos"]].decode() == p["content"] and "\ufffd" not in p["content"] for p in out)
    assert all(p["start_line"] == 1 + raw[: p["start_pos"]].count(b"\n") for p in out[::7])
    at, joined = 0, b""
    for p in out:
        joined, at = joined + raw[at : p["end_pos"]], p["end_pos"]
    assert joined.decode() == text


def test_no_files(spark):
    assert S.split_files(spark, spark.createDataFrame([(None, 9000), ("x", None)], "path string, length long")).count() == 0
