import datetime as dt

import pytest
from pyspark.sql import functions as F

from corvane.sources import repository as R
from corvane.streaming import incremental as I


@pytest.fixture
def tree(tmp_path):
    for p, b in {"r1/src/a.py": b"x = 1\n", "r1/node_modules/x.js": b"no", "r1/yarn.lock": b"", "r1/img.png": b"\x89", "r1/bin.dat": b"a\x00b", "r1/latin.txt": "é".encode("latin-1"), "r2/docs/deep/b.md": b"# t"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b)
    return tmp_path


def test_read_files(spark, tree):
    f = R.read_files(spark, str(tree))
    got = {(r["repository_id"], r["path"]): (r["is_text"], r["content"]) for r in f.collect()}
    assert got == {("r1", "src/a.py"): (True, "x = 1\n"), ("r1", "bin.dat"): (False, None), ("r1", "latin.txt"): (True, "é"), ("r2", "docs/deep/b.md"): (True, "# t")}
    assert {r["repository_id"]: r["n_folders"] for r in R.folder_count(f).collect()} == {"r1": 1, "r2": 2}


def test_manifests_and_stack(spark):
    items = {"requirements.txt": "a==1.0\n# c\nfastapi\n", "package.json": '{"dependencies": {"x": "1", "y": "1"}, "devDependencies": {"y": "2"}}', "go.mod": "module m\nrequire github.com/a/b v1.2.3\n", "Cargo.toml": '[package]\nname = "n"\n[dependencies]\nserde = "1.0"\n', "Gemfile": "gem 'rails', '7.0'\n", "pom.xml": "<dependency><groupId>g</groupId><artifactId>a</artifactId><version>2</version></dependency>", "pubspec.yaml": "dependencies:\n  http: ^1.0\n", "composer.json": "{broken"}
    d = spark.createDataFrame([("r", p, p, c) for p, c in items.items()], "repository_id string, id string, path string, content string")
    got = {(r["id"], r["package"], r["version"]) for r in R.manifest_dependencies(d).collect()}
    assert got == {("requirements.txt", "a", "1.0"), ("requirements.txt", "fastapi", "latest"), ("package.json", "x", "1"), ("package.json", "y", "2"), ("go.mod", "github.com/a/b", "v1.2.3"), ("Cargo.toml", "serde", "1.0"), ("Gemfile", "rails", "7.0"), ("pom.xml", "g:a", "2"), ("pubspec.yaml", "http", "^1.0")}
    t = R.tech_stack(d).first()
    assert t["frameworks"] == ["FastAPI", "Rails"] and t["package_manager"] == "npm"


def test_notebook(spark):
    nb = '{"metadata": {"kernelspec": {"language": "r"}}, "cells": [{"cell_type": "code", "source": ["ab", "c"]}, {"cell_type": "markdown", "source": "xxxx"}, {"cell_type": "code", "source": "de"}]}'
    d = spark.createDataFrame([(nb,), ("nope",)], "t string")
    lang, n = R.notebook_language(F.col("t"))
    assert [tuple(r) for r in d.select(lang, n).collect()] == [("R", 5), (None, 0)]


def test_incremental_index(spark, tmp_path):
    src, idx = str(tmp_path / "in"), str(tmp_path / "idx")
    schema = "repository_id string, path string, content_hash string, content string"
    put = lambda *rows: spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(src)
    run = lambda: I.index_new_files(I.file_stream(spark, src, schema), idx, lambda d: d.select("path", "content"), str(tmp_path / "cp")).awaitTermination()
    put(("r", "a", "1", "x"), ("r", "a", "1", "x"))
    run()
    put(("r", "a", "1", "x"), ("r", "a", "2", "y"))
    run()
    got = sorted(tuple(r) for r in spark.read.option("recursiveFileLookup", "true").parquet(f"{idx}/chunks").select("path", "content").collect())
    assert got == [("a", "x"), ("a", "y")]


def test_orphan_state_stream(spark, tmp_path):
    src, state = str(tmp_path / "in"), str(tmp_path / "state")
    schema = "target string, scope string, key string, refs long, exist long"
    for n, row in enumerate([("f", "r", "a", 1, 0), ("f", "r", "a", 0, 1)]):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(src)
        I.keep_orphan_state(I.file_stream(spark, src, schema), state, str(tmp_path / "cp")).awaitTermination()
        assert spark.read.parquet(f"{state}/state={n}").where("refs > 0 and exist = 0").count() == 1 - n


def test_event_streams(spark, tmp_path):
    src = str(tmp_path / "ev")
    t = dt.datetime(2024, 1, 1)
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    spark.createDataFrame([(i, t + dt.timedelta(minutes=20 * i), i % 2, "a", 1.0) for i in range(9)], schema).coalesce(1).write.parquet(src)
    stream = lambda: I.file_stream(spark, src, schema)

    def run(df, mode, name):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    assert run(I.windowed_counts(stream()), "complete", "w1").agg(F.sum("n")).first()[0] == 9
    assert run(I.once(stream(), ["event_id"]), "append", "w2").count() == 9
    assert run(I.sessions(stream(), "50 minutes"), "complete", "w3").count() == 2
    assert I.latest_state(spark.read.schema(schema).parquet(src), ["user_id"], "ts", ["event_id"]).count() == 2


def test_summaries_due(spark, tmp_path):
    src = str(tmp_path / "chat")
    spark.createDataFrame([("s1", "user")] * 11 + [("s2", "user")] * 11 + [("s2", "summary")] + [("s3", None)] * 20, "session_id string, role string").coalesce(1).write.parquet(src)
    q = I.summaries_due(I.file_stream(spark, src, "session_id string, role string")).writeStream.format("memory").queryName("due").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("due").collect()] == [("s1", 11)]
