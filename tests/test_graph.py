import pytest

from corvane.operators import graph as G


def edges(spark, *pairs, repo="r"):
    return spark.createDataFrame([(repo, a, b) for a, b in pairs], "repository_id string, src string, dst string")


def files(spark, items):
    return spark.createDataFrame([("r", p, p[p.rfind(".") :], c) for p, c in items.items()], "repository_id string, path string, extension string, content string")


def test_import_edges(spark):
    f = files(spark, {
        "a/b.py": "from c.d import x\nimport c.e, os\nfrom . import z\nfrom m import n", "c/d.py": "import b2", "c/e/__init__.py": "", "c/b2.py": None, "m/n.py": "",
        "src/x.ts": 'import { y } from "./y";\nimport z from "../lib";\nconst q = require("left-pad");', "src/y.tsx": "", "lib/index.js": 'export * from "../src/x"',
        "j/A.java": "import p.q.B;\nimport w.*;\nclass A extends C implements D {\n  private Foo foo;\n  A(Bar bar) {}\n}", "z/p/q/B.java": "", "k/C.java": "", "k/D.java": "", "k/Foo.java": "", "k/Bar.java": "", "w/E.java": "",
    })
    got = {(r["src"], r["dst"]) for r in G.import_edges(f).collect()}
    assert got == {("a/b.py", "c/d.py"), ("a/b.py", "c/e/__init__.py"), ("a/b.py", "m/n.py"), ("c/d.py", "c/b2.py"), ("src/x.ts", "src/y.tsx"), ("src/x.ts", "lib/index.js"), ("lib/index.js", "src/x.ts"), ("j/A.java", "z/p/q/B.java"), ("j/A.java", "k/C.java"), ("j/A.java", "k/D.java"), ("j/A.java", "k/Foo.java"), ("j/A.java", "k/Bar.java"), ("j/A.java", "w/E.java")}
    assert G.import_edges(f.limit(0)).count() == 0


def test_coupling(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("a", "zz"))
    n = spark.createDataFrame([("r", x) for x in "abcd"], "repository_id string, path string")
    out = {r["path"]: (r["fan_in"], r["fan_out"], r["coupling"], r["instability"]) for r in G.coupling(n, e).collect()}
    assert out == {"a": (0, 2, 2, 1.0), "b": (1, 1, 2, 0.5), "c": (1, 0, 1, 0.0), "d": (0, 0, 0, 0.0)}


@pytest.mark.parametrize(("pairs", "want"), [
    ([("a", "b"), ("b", "c")], {}), ([("a", "b"), ("b", "a"), ("b", "c")], {"a": "b", "b": "b"}), ([("a", "a"), ("a", "b")], {"a": "a"}),
    ([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "c"), ("d", "e"), ("x", "a")], dict.fromkeys("abcd", "d")), ([("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "c")], {"a": "b", "b": "b", "c": "d", "d": "d"}),
])
def test_strong_parts(spark, pairs, want):
    assert {r["path"]: r["part"] for r in G.strong_parts(edges(spark, *pairs)).collect()} == want


def test_longest_chain_and_cycles(spark):
    assert G.longest_chain(edges(spark, ("a", "b"), ("b", "c"))).first()["longest_chain"] == 3
    assert G.longest_chain(edges(spark, ("a", "b"), ("b", "a"), ("b", "c"))).first()["longest_chain"] == 2
    assert [r["cycle"] for r in G.cycle_list(edges(spark, ("b", "a"), ("a", "b"), ("b", "c"))).collect()] == ["a -> b -> a"]


def test_layer_violations(spark):
    t = spark.createDataFrame([("r", "a", "Repository"), ("r", "b", "Service"), ("r", "c", "Configuration")], "repository_id string, path string, module string")
    out = {(r["src"], r["kind"]) for r in G.layer_violations(edges(spark, ("a", "b"), ("b", "a"), ("c", "a")), t).collect()}
    assert out == {("a", "layer"), ("c", "configuration")}
