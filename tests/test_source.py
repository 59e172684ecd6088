import pytest
from pyspark.sql import functions as F

from corvane.functions import code as X
from corvane.operators import lines as L
from corvane.operators import scanners as S


def files(spark, *items):
    return spark.createDataFrame([(str(i), "r", p, p[p.rfind(".") :], c) for i, (p, c) in enumerate(items)], "id string, repository_id string, path string, extension string, content string")


def one(spark, col, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(col(F.col("x"))).first()[0]


@pytest.mark.parametrize(("path", "want"), [("a/../b/./c", "b/c"), ("../a", "../a"), ("a/b/../../..", ".."), ("./x//y", "x/y"), ("", "")])
def test_normalise_path(spark, path, want):
    assert one(spark, X.normalise_path, path) == want


@pytest.mark.parametrize(("path", "ext", "want"), [("a/useThing.ts", ".ts", "Hook"), ("a/x.tsx", ".tsx", "Component"), ("a/controllers/x.py", ".py", "Controller"), ("services/x.py", ".py", "Unknown"), ("a/services/x.py", ".py", "Service"), (".env.local", "", "Configuration"), ("a/b.py", None, "Unknown")])
def test_module_type(spark, path, ext, want):
    assert spark.createDataFrame([(path, ext)], "p string, e string").select(X.module_type(F.col("p"), F.col("e"))).first()[0] == want


def test_extension_and_version(spark):
    assert [one(spark, X.extension, p) for p in ("a/B.PY", "a/.env", "a/b", "x.tar.gz")] == [".py", "", "", ".gz"]
    assert one(spark, X.version_parts, "1.20.x3") == [1, 20, 3]
    assert one(spark, X.valid_repository_url, " https://github.com/a/b.git ") is True
    assert one(spark, X.valid_repository_url, "ftp://x") is False


def test_lines_keep_trailing_empties(spark):
    d = files(spark, ("a.py", "x\n\n"), ("b.py", None), ("c.py", ""))
    assert [(r["id"], r["line_number"], r["line"]) for r in L.explode_lines(d, "content", ["id"]).orderBy("id", "line_number").collect()] == [("0", 1, "x"), ("0", 2, ""), ("0", 3, ""), ("2", 1, "")]
    d = files(spark, ("a.py", "x\r\ny\x0bz\u2028w\n"))
    assert [r["line"] for r in L.explode_any_lines(d, "content", ["id"]).orderBy("line_number").collect()] == "x\r\ny\x0bz\u2028w\n".splitlines()


def test_line_counts(spark):
    d = files(spark, ("a.js", "// c\nlet a = 1; /* b\n*/\n\nx()\n"), ("a.py", "# c\n\nx = 1"))
    out = {r["id"]: (r["total_lines"], r["blank_lines"], r["comment_lines"], r["code_lines"]) for r in L.line_counts(d).collect()}
    assert out == {"0": (6, 2, 2, 2), "1": (3, 1, 1, 1)}


def test_security_rules(spark):
    d = files(spark, ("a.py", 'password = "hunter2hunter2"\neval(x)\nhashlib.md5(b)\nsubprocess.run(c, shell=True)\ndb.execute("select * from t where a = " + x)'), ("package.json", "eval(x)"))
    assert sorted((r["line_number"], r["title"]) for r in S.security_issues(d).collect()) == [(1, "Hardcoded Generic Hardcoded Secret"), (2, "Unsafe Eval"), (3, "Weak Hashing (MD5)"), (4, "Dangerous Process Execution")] + []


def test_line_smells(spark):
    d = files(spark, ("a.py", "def f(a=[]): pass"), ("b.java", "try { x(); } catch (Exception e) { }"), ("c.c", "goto end;\nstrcpy(a, b); gets(c);"), ("d.go", "_, err := f()"), ("e.php", "global $x;"), ("f.py", "goto end;"))
    assert sorted((r["id"], r["line_number"], r["smell_type"]) for r in S.line_smells(d).collect()) == [("0", 1, "Mutable Defaults"), ("1", 1, "Empty Catch"), ("2", 1, "goto Usage"), ("2", 2, "Unsafe Memory Function"), ("2", 2, "Unsafe Memory Function"), ("3", 1, "Ignored Errors"), ("4", 1, "Global State")]


def test_magic_numbers(spark):
    d = files(spark, ("a.py", "x = 42 + 10\n# 99\ny = 3.5\nz1 = a.7"), ("b.py", "\n".join(f"v = {i}" for i in range(20, 60))))
    out = S.magic_numbers(d).collect()
    assert sorted((r["line_number"], r["literal"]) for r in out if r["id"] == "0") == [(1, "42"), (3, "3.5")]
    assert sum(r["id"] == "1" for r in out) == 15


def naive_callbacks(text):
    import re

    n, out = 0, []
    for i, line in enumerate(text.split("\n"), 1):
        if re.search(r"\bfunction\b|\(\s*\)\s*=>", line):
            n += 1
            if n >= 3:
                out.append((i, n))
        if "}" in line:
            n = max(0, n - 1)
    return out


def test_callbacks_and_promises(spark):
    import random

    random.seed(1)
    parts = ["f(function () {", "})", "x", "() => {", "}", "}{"]
    texts = ["\n".join(random.choice(parts) for _ in range(40)) for _ in range(12)]
    d = files(spark, *[(f"{i}.js", t) for i, t in enumerate(texts)])
    got = sorted((int(r["id"]), r["line_number"], r["measured_value"]) for r in S.callback_hell(d).collect())
    assert got == sorted((i, *x) for i, t in enumerate(texts) for x in naive_callbacks(t))
    d = files(spark, ("a.js", "a\n.then(x)\n.then(x)\n.then(x)\n.then(x)\n;\n.then(x)"))
    assert [(r["line_number"], r["measured_value"]) for r in S.promise_chains(d).collect()] == [(5, 4)]


def test_large_match(spark):
    arms = "\n".join(f"  {i} => x," for i in range(9))
    d = files(spark, ("a.rs", f"match v {{\n{arms}\n}}\nfn a() {{\n 1 => 2\n}}"), ("b.rs", "match v {\n 1 => x,\n}"))
    assert [(r["id"], r["line_number"], r["measured_value"]) for r in S.large_matches(d).collect()] == [("0", 1, 9)]


def test_duplication(spark):
    block = "\n".join(f"line {i}" for i in range(8))
    d = files(spark, ("a.py", block + "\nother"), ("b.py", "# c\n" + block), ("c.py", "x\ny"), ("d.py", None))
    r = L.duplicated_lines(d, "repository_id", "id", "content").first()
    assert (r["total_lines"], r["duplicated_lines"], r["duplication_percentage"]) == (19, 16, 84.21)
    assert L.duplicated_lines(d.limit(0), "repository_id", "id", "content").count() == 0
