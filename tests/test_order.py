import datetime as dt
import random
from collections import defaultdict

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.operators import order as O


def test_any_rank_numbers_each_key(spark):
    data = [(random.choice("abc"), i) for i in range(500)] + [(None, i) for i in range(20)]
    out = O.any_rank(spark.createDataFrame(data, "k string, id long"), ["k"], ["id"], "r", salts=7).collect()
    by = defaultdict(list)
    for r in out:
        by[r["k"]].append(r["r"])
    assert len(out) == len(data)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_any_rank_repeated_rows_and_empty(spark):
    d = spark.createDataFrame([("a", 1)] * 5, "k string, id long")
    assert sorted(r["r"] for r in O.any_rank(d, ["k"], ["id"], "r").collect()) == [0, 1, 2, 3, 4]
    assert O.any_rank(d.limit(0), ["k"], ["id"], "r").count() == 0


def test_prefix_sum(spark):
    data = [("a", i, random.randint(0, 9)) for i in range(300)]
    d = spark.createDataFrame(data, "k string, id long, v long")
    out = {r["id"]: (r["p"], r["s"], r["v"]) for r in O.prefix_sum(d.withColumn("p", (F.col("id") * 7 % 300) / 300), ["k"], F.col("p"), ["id"], "v", "s", buckets=9).collect()}
    total = 0
    for i in sorted(out, key=lambda i: (out[i][0], i)):
        assert out[i][1] == total
        total += out[i][2]


T0 = dt.datetime(2024, 1, 1)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 40), st.integers(0, 3)), max_size=60))
def test_previous_and_number_in_order(spark, data):
    recs = [(k, T0 + dt.timedelta(seconds=t), r, i) for i, (k, t, r) in enumerate(data)]
    d = spark.createDataFrame(recs, "k string, at timestamp, r int, id long")
    got = {x["id"]: (x["prev_id"], x["prev_exists"]) for x in O.previous_in_order(d, "k", "at", ["r", "id"], ["id"], rows_a_part=5).collect()}
    num = {x["id"]: x["n"] for x in O.number_in_order(d, "k", "at", ["r", "id"], "n", rows_a_part=5).collect()}
    for key in "ab":
        prev = None
        for n, x in enumerate(sorted((x for x in recs if x[0] == key), key=lambda x: (x[1], x[2], x[3])), 1):
            assert got[x[3]] == (prev, prev is not None)
            assert num[x[3]] == n
            prev = x[3]


def test_one_hot_key_is_spread(spark):
    d = spark.range(2000).select(F.lit("hot").alias("k"), F.timestamp_seconds(F.col("id") * 10).alias("at"), F.col("id"))
    parts, several = O._in_parts(d, "k", ["at", "id"], 100)
    assert several and parts.groupBy("__part").count().agg(F.max("count"), F.count("*")).first()[0] < 400
    out = O.previous_in_order(d, "k", "at", ["id"], ["id"], rows_a_part=100)
    assert out.where("prev_id = id - 1").count() == 1999


@pytest.mark.parametrize("n", [0, 1])
def test_small_tables(spark, n):
    d = spark.createDataFrame([("a", T0, 1)][:n], "k string, at timestamp, id long")
    assert O.previous_in_order(d, "k", "at", ["id"], ["id"]).count() == n


def test_rank_spread(spark):
    data = [("hot", i % 97, i) for i in range(900)] + [("b", None, 1), (None, 3, 2), ("b", 5, 3)]
    d = spark.createDataFrame(data, "k string, v int, id long")
    got = {(r["k"], r["id"]): r["n"] for r in O.rank_spread(d, ["k"], [F.col("v"), F.col("id")], "n", parts=6).collect()}
    for key in ("hot", "b", None):
        rows = sorted((x for x in data if x[0] == key), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        assert [got[(key, x[2])] for x in rows] == list(range(1, len(rows) + 1))
    assert O.rank_spread(d.limit(0), ["k"], [F.col("v"), F.col("id")], "n").count() == 0


def test_rows_without_a_time_and_bursts_do_not_make_one_part(spark):
    """One row without a time, or all rows at one moment: parts stay small and nulls come last."""
    at = F.when(F.col("id") == 77, F.lit(None)).when(F.col("id") % 2 == 0, F.timestamp_seconds(F.lit(5))).otherwise(F.timestamp_seconds(F.col("id"))).cast("timestamp")
    d = spark.range(3000).select(F.lit("hot").alias("k"), at.alias("at"), F.col("id"))
    parts, _ = O._in_parts(d.withColumn("none", F.col("at").isNull()), "k", ["none", "at", "id"], 100)
    sizes = [r["count"] for r in parts.groupBy("__part").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 600
    num = {r["id"]: r["n"] for r in O.number_in_order(d, "k", "at", ["id"], "n", rows_a_part=100).collect()}
    assert num[77] == 3000 and sorted(num.values()) == list(range(1, 3001))
    prev = O.previous_in_order(d, "k", "at", ["id"], ["id"], rows_a_part=100)
    assert prev.where("not prev_exists").count() == 1 and prev.select("prev_id").distinct().count() == 3000


def test_shared_folder_only_for_local_sessions():
    from types import SimpleNamespace

    from corvane.session import shared_dir

    sc = SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None)
    with pytest.raises(RuntimeError):
        shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: d), sparkContext=sc))
