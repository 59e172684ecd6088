import datetime as dt

import pytest

from corvane.operators import references as R

T = dt.datetime(2024, 3, 5)


@pytest.fixture
def refs(spark):
    d = spark.createDataFrame(
        [("1", "r", "a.py", T, "x"), ("2", "r", "b.py", T, "x"), ("2", "r", "b.py", T, "x"), ("3", None, "a.py", T, "x"), ("4", "r", None, T, "x"), ("5", "r", "a.py ", None, "x"), (None, "r", "zz", T, "x")],
        "id string, repository_id string, file_path string, created_at timestamp, target string",
    )
    return R.reference_rows(d, "issues", "files", "file_path", "repository_id", at="created_at")


@pytest.fixture
def targets(spark):
    d = spark.createDataFrame([("r", "a.py", 1), ("r", "a.py", 2), ("q", "b.py", 3), (None, "c", 4), ("r", None, 5)], "repository_id string, path string, key int")
    return R.existence(d, "files", "path", "repository_id")


def test_orphans(refs, targets):
    assert sorted(map(tuple, R.orphans(refs, targets).select("row_id", "key").collect()), key=repr) == sorted([("2", "b.py"), ("5", "a.py "), (None, "zz")], key=repr)


def test_report_counts_rows_once(refs, targets):
    out = {r["month"]: (r["n_refs"], r["n_orphans"]) for r in R.orphan_report(R.orphans(refs, targets), refs).collect()}
    assert out == {"2024-03": (3, 2), None: (1, 1)}


def test_empty_tables(refs, targets):
    assert R.orphans(refs.limit(0), targets).count() == 0
    assert R.orphans(refs, targets.limit(0)).count() == 4


def test_deltas_settle_and_take_back(spark):
    k = lambda *a: spark.createDataFrame([("f", "r", *a)], "target string, scope string, key string, refs int, exist int")
    state = R.merge_counts(k("a", 2, 0), k("b", 1, 0))
    assert {r["key"] for r in R.orphan_keys(state).collect()} == {"a", "b"}
    later = R.merge_counts(state, k("a", 0, 1), k("b", -1, 0))
    assert R.orphan_keys(later).count() == 0
    assert {r["key"] for r in later.collect()} == {"a"}
    gone = R.merge_counts(later, k("a", 0, -1))
    assert [r["key"] for r in R.orphan_keys(gone).collect()] == ["a"]


def test_hot_key(spark):
    d = spark.range(3000).selectExpr("cast(id as string) id", "'r' repository_id", "if(id % 3 = 0, 'hot', concat('p', id)) file_path")
    t = R.existence(spark.createDataFrame([("r", "p1")], "repository_id string, path string"), "files", "path", "repository_id")
    out = R.orphans(R.reference_rows(d, "s", "files", "file_path", "repository_id"), t)
    assert out.count() == 2999
