from pyspark.sql import functions as F

from corvane import api
from corvane.operators import answers as W
from corvane.sources import sinks as K

FILES = {
    "src/process.py": "from src import helper\nimport src.helper\n\n\ndef run(a):\n    if a:\n        return eval(a)\n    return 7\n",
    "src/helper.py": "def clean(x, acc=[]):\n    return x\n",
    "src/Helper.java": "package a;\npublic class Helper {\n  public static int f(int a) {\n    return a;\n  }\n}\n",
    "package.json": '{"dependencies": {"react": "18"}}',
    "node_modules/x/index.js": "x",
}


def test_folder_to_tables(spark, tmp_path):
    for p, t in FILES.items():
        (tmp_path / "repo" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "repo" / p).write_text(t)
    a = api.analyze(spark, str(tmp_path))
    assert {r["path"] for r in a.files.collect()} == {"src/process.py", "src/helper.py", "src/Helper.java", "package.json"}
    m = {r["path"]: (r["code_lines"], r["file_complexity"], r["module_type"]) for r in a.metrics.collect()}
    assert m["src/process.py"] == (6, 2, "Unknown") and m["src/Helper.java"][2] == "Utility"
    assert {r["title"] for r in a.issues.collect()} == {"Unsafe Eval"}
    assert {r["smell_type"] for r in a.smells.collect()} == {"Mutable Defaults"}
    assert {(r["src"], r["dst"]) for r in a.edges.collect()} == {("src/process.py", "src/helper.py")}
    assert a.stack.first()["frameworks"] == ["React"]
    assert a.summary.first()["security_score"] == 75
    assert api.search(a, "def clean(x, acc=[]): return x", 1).first()["file_path"] == "src/helper.py"


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("r1", "a", 1), ("r1", "b", 2), ("r2", "c", 3)], "repository_id string, k string, v int")
    p = str(tmp_path / "t")
    K.write_by_repository(d, p)
    K.write_by_repository(d.where("repository_id = 'r1' and k = 'a'"), p)
    assert sorted(r["k"] for r in spark.read.parquet(p).collect()) == ["a", "c"]
    assert K.drop_repository(spark, p, "r1") == 1 and spark.read.parquet(p).count() == 1
    u = K.upsert(d, spark.createDataFrame([("r9", "a", 9), ("r9", None, 1)], d.schema), "k", ["v"])
    assert {r["k"]: r["v"] for r in u.collect()} == {"a": 9, "b": 2, "c": 3}
    assert K.without(d, d.where("k = 'a'"), ["repository_id", "k"]).count() == 2


def test_answers(spark):
    e = spark.createDataFrame([("q", 1, "a.py", 1, "x" * 7000), ("q", 2, "b.py", 2, "y" * 2000), ("p", 1, None, None, None)], "q string, n int, file_path string, start_line int, content string")
    out = {r["q"]: (r["n"], len(r["evidence"])) for r in W.evidence_text(e, ["q"], ["n"]).collect()}
    assert out["q"][0] == 1 and out["p"][0] == 1
    p = spark.createDataFrame([(1, "hi"), (2, None)], "id int, p string")
    assert {r["id"]: r["answer"] for r in W.answer(p, "p", ["id"], model=str.upper).collect()} == {1: "HI", 2: W.REFUSAL}
    assert spark.range(1).select(W.follow_up(F.lit("Where is the login?"))).first()[0] == "How are sessions checked?"
