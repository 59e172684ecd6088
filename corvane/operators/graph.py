"""Import graphs: edges resolved by joins, coupling, strongly connected parts, chains, cycle lists, findings.

Everything but the listing of cycles is joins and aggregates on (repository_id, src, dst); loops run on the driver, one round
of joins each, with lineage cut to the shared folder. Cycles are listed inside strongly connected parts only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.code import basename, dirname, normalise_path, unix_path
from corvane.session import cut

SUFFIXES = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"]
PLAIN_TYPES = ["String", "Integer", "Long", "Double", "Float", "Boolean", "List", "Map", "Set", "Optional"]
ARROW = " -> "


def _matches(files: DataFrame, exts: list[str], patterns: list[tuple[str, int]], name: str) -> DataFrame:
    """(repository_id, path, name): each text that a pattern's group captures in the files of the endings."""
    found = F.concat(*[F.regexp_extract_all(F.col("content"), F.lit(p), g) for p, g in patterns])
    f = files.where(F.lower("extension").isin(exts) & F.col("content").isNotNull())
    return f.select("repository_id", F.col("path"), F.explode(F.array_distinct(found)).alias(name))


def python_candidates(files: DataFrame) -> DataFrame:
    """(repository_id, path, statement, rank, candidate) of import statements: the module as a file from the root, as a package, beside the
    importing file; after these, the same for module.name. Statements with no module (from . import x) are left out."""
    frm = _matches(files, [".py"], [(r"(?m)^[ \t]*(from[ \t]+[\w][\w.]*[ \t]+import[ \t]+(?:\([^)]*\)|[^\n(#]+))", 1)], "statement")
    module = F.regexp_extract("statement", r"^from[ \t]+([\w.]+)", 1)
    names = F.transform(F.split(F.regexp_replace(F.regexp_replace("statement", r"(?s)^from[ \t]+[\w.]+[ \t]+import", ""), r"[()\s]+", " "), ","), lambda n: F.regexp_extract(F.trim(n), r"^(\w+)", 1))
    subs = F.transform(F.filter(names, lambda n: n != ""), lambda n: F.concat(module, F.lit("."), n))
    a = frm.select("repository_id", "path", "statement", F.posexplode(F.concat(F.array(module), subs)).alias("alt", "m"))
    imp = _matches(files, [".py"], [(r"(?m)^[ \t]*import[ \t]+([^\n#;]+)", 1)], "list")
    one = F.transform(F.split("list", ","), lambda n: F.regexp_extract(F.trim(n), r"^([\w.]+)", 1))
    b = imp.select("repository_id", "path", F.explode(F.filter(one, lambda n: n != "")).alias("m")).select("repository_id", "path", F.concat(F.lit("import "), "m").alias("statement"), F.lit(0).alias("alt"), "m")
    d = a.unionByName(b)
    p = F.replace("m", F.lit("."), F.lit("/"))
    here = F.when(dirname(unix_path(F.col("path"))) == "", p).otherwise(F.concat_ws("/", dirname(unix_path(F.col("path"))), p))
    # a sub-module counts only where the module itself is found nowhere: its ranks come after
    cands = F.array(F.concat(p, F.lit(".py")), F.concat(p, F.lit("/__init__.py")), F.concat(normalise_path(here), F.lit(".py")))
    d = d.select("repository_id", "path", "statement", "alt", F.posexplode(cands).alias("k", "candidate"))
    return d.select("repository_id", "path", F.when(F.col("alt") > 0, F.concat("statement", F.lit("#"), "alt")).otherwise(F.col("statement")).alias("target"), "statement", (F.when(F.col("alt") > 0, 10).otherwise(0) + F.col("k")).alias("rank"), "candidate")


def script_candidates(files: DataFrame) -> DataFrame:
    """The same for relative imports of scripts: eight endings in order."""
    pats = [(r"(?:import|export)\s+[^;'\"]*?\s+from\s+['\"]([^'\"]+)['\"]", 1), (r"import\s+['\"]([^'\"]+)['\"]", 1), (r"require\(\s*['\"]([^'\"]+)['\"]\s*\)", 1), (r"import\(\s*['\"]([^'\"]+)['\"]\s*\)", 1)]
    m = _matches(files, [".js", ".jsx", ".ts", ".tsx"], pats, "target").where(F.col("target").rlike("^[./]"))
    base = normalise_path(F.when(F.startswith("target", F.lit("/")), F.col("target")).otherwise(F.concat_ws("/", dirname(unix_path(F.col("path"))), "target")))
    return m.select("repository_id", "path", "target", F.col("target").alias("statement"), F.posexplode(F.transform(F.array(*map(F.lit, SUFFIXES)), lambda s: F.concat(base, s))).alias("rank", "candidate"))


def java_types(files: DataFrame) -> DataFrame:
    """(repository_id, path, suffix): what a file that a Java file refers to ends with, from imports, parents, fields and constructors."""
    imports = _matches(files, [".java"], [(r"import\s+((?:\w+\.)*\w+);", 1)], "t").select("repository_id", "path", F.concat(F.replace("t", F.lit("."), F.lit("/")), F.lit(".java")).alias("suffix"))
    parents = _matches(files, [".java"], [(r"\bclass\s+\w+\s+extends\s+(\w+)", 1)], "t")
    faces = _matches(files, [".java"], [(r"\bimplements\s+([\w\s,]+)", 1)], "ts").select("repository_id", "path", F.explode(F.transform(F.split("ts", ","), lambda t: F.regexp_extract(F.trim(t), r"^(\w+)", 1))).alias("t"))
    fields = _matches(files, [".java"], [(r"(?:@Autowired|@Resource|@Inject|private|protected|public)\s+(?:final\s+)?([\w<>\[\]]+)\s+\w+\s*;", 1)], "f")
    fields = fields.select("repository_id", "path", F.explode(F.split(F.when(F.contains("f", F.lit("<")), F.regexp_extract("f", r"<([^>]+)>", 1)).otherwise(F.col("f")), r"\s*,\s*")).alias("t"))
    ctor = files.where(F.lower("extension") == ".java").select("repository_id", "path", F.explode(F.regexp_extract_all(F.col("content"), F.concat(F.lit(r"\b\Q"), F.regexp_replace(basename(F.col("path")), r"\.java$", ""), F.lit(r"\E\s*\(([^)]*)\)")), F.lit(1))).alias("ps"))
    ctor = ctor.select("repository_id", "path", F.explode(F.regexp_extract_all("ps", F.lit(r"(\w+)\s+\w+\s*(?:,|$)"), 1)).alias("t"))
    simple = reduce(DataFrame.unionByName, [parents, faces, fields, ctor]).where(~F.col("t").isin(PLAIN_TYPES) & (F.col("t") != ""))
    return imports.unionByName(simple.select("repository_id", "path", F.concat(F.lit("/"), "t", F.lit(".java")).alias("suffix"))).distinct()


def import_edges(files: DataFrame) -> DataFrame:
    """Distinct (repository_id, src, dst) of imports that resolve to a file of the same repository; a file is no target of itself in Java.

    Candidates are joined by equality with the paths, and the first that exists wins. Java types are joined by file name and then
    compared with the whole ending; the smallest path wins. Wildcard imports meet every file below a folder of that name.
    """
    files = files.where(F.col("path").isNotNull() & F.col("repository_id").isNotNull())
    paths = files.select("repository_id", unix_path(F.col("path")).alias("dst")).distinct()
    cands = python_candidates(files).unionByName(script_candidates(files))
    hit = cands.join(paths.withColumnRenamed("dst", "candidate"), ["repository_id", "candidate"])
    best = hit.groupBy("repository_id", "path", "statement", "target").agg(F.min(F.struct("rank", "candidate")).alias("b"))
    first = F.min(F.col("b.rank")).over(Window.partitionBy("repository_id", "path", "statement"))
    best = best.withColumn("least", first).where((F.col("least") >= 10) | (F.col("b.rank") < 10))
    e1 = best.select("repository_id", unix_path(F.col("path")).alias("src"), F.col("b.candidate").alias("dst"))
    t = java_types(files).withColumn("name", basename(F.col("suffix")))
    j = t.join(paths.withColumn("name", basename(F.col("dst"))), ["repository_id", "name"]).where(F.endswith(F.concat(F.lit("/"), "dst"), F.col("suffix")) | F.endswith("dst", F.col("suffix")))
    e2 = j.groupBy("repository_id", "path", "suffix").agg(F.min("dst").alias("dst")).select("repository_id", unix_path(F.col("path")).alias("src"), "dst").where("src <> dst")
    stars = _matches(files, [".java"], [(r"import\s+([\w.]+)\.\*;", 1)], "pkg").select("repository_id", unix_path(F.col("path")).alias("src"), F.concat(F.lit("/"), F.replace("pkg", F.lit("."), F.lit("/")), F.lit("/")).alias("folder"))
    depth = F.size(F.split(dirname(F.col("dst")), "/"))
    parts = F.split(dirname(F.col("dst")), "/")
    folders = paths.select("repository_id", "dst", F.explode(F.flatten(F.transform(F.sequence(F.lit(1), depth), lambda i: F.transform(F.sequence(i, depth), lambda k: F.concat(F.lit("/"), F.array_join(F.slice(parts, i, k - i + 1), "/"), F.lit("/")))))).alias("folder"))
    e3 = stars.join(folders, ["repository_id", "folder"]).select("repository_id", "src", "dst").where("src <> dst")
    return e1.unionByName(e2).unionByName(e3).distinct()


def coupling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repository_id, path, fan_in, fan_out, coupling, instability) of nodes (repository_id, path); edges to unknown targets count as fan_out only."""
    out = edges.groupBy("repository_id", F.col("src").alias("path")).agg(F.count(F.lit(1)).alias("fan_out"))
    into = edges.groupBy("repository_id", F.col("dst").alias("path")).agg(F.count(F.lit(1)).alias("fan_in"))
    j = nodes.join(into, ["repository_id", "path"], "left").join(out, ["repository_id", "path"], "left")
    a, b = F.coalesce("fan_in", F.lit(0)), F.coalesce("fan_out", F.lit(0))
    return j.select("repository_id", "path", a.alias("fan_in"), b.alias("fan_out"), (a + b).alias("coupling"), F.when(a + b > 0, b / (a + b)).otherwise(0.0).alias("instability"))


def trim(edges: DataFrame, most_rounds: int = 100_000) -> DataFrame:
    """Edges among nodes that can lie on a cycle: sources and sinks are taken off in rounds until none is left. Self loops stay."""
    e, n = cut(edges.select("repository_id", "src", "dst").distinct()), None
    for _ in range(most_rounds):
        m = e.count()
        if m == 0 or m == n:
            return e
        n = m
        has_in = e.select("repository_id", F.col("dst").alias("src")).distinct()
        has_out = e.select("repository_id", F.col("src").alias("dst")).distinct()
        e = cut(e.join(has_in, ["repository_id", "src"], "left_semi").join(has_out, ["repository_id", "dst"], "left_semi"))
    raise RuntimeError(f"no end after {most_rounds} rounds")


def strong_parts(edges: DataFrame, most_rounds: int = 100_000) -> DataFrame:
    """(repository_id, path, part): nodes on a cycle, with the largest path of their strongly connected part.

    Colouring: each node takes the largest label that reaches it; the nodes that reach a root back within its colour are the root's
    part, which is taken out, and the rest goes on. Each round is a join and an aggregate.
    """
    e, done = trim(edges, most_rounds), []
    for _ in range(most_rounds):
        if e.isEmpty():
            break
        nodes = e.select("repository_id", F.col("src").alias("path")).union(e.select("repository_id", "dst")).distinct()
        c = cut(nodes.withColumn("colour", F.col("path")))
        while True:
            best = e.join(c.withColumnRenamed("path", "src"), ["repository_id", "src"]).groupBy("repository_id", F.col("dst").alias("path")).agg(F.max("colour").alias("in"))
            n = cut(c.join(best, ["repository_id", "path"], "left").select("repository_id", "path", F.greatest("colour", "in").alias("colour"), (F.coalesce("in", F.lit("")) > F.col("colour")).alias("moved")))
            if n.where("moved").isEmpty():
                break
            c = n.drop("moved")
        inside = e.join(c.withColumnRenamed("path", "src").withColumnRenamed("colour", "cs"), ["repository_id", "src"]).join(c.withColumnRenamed("path", "dst").withColumnRenamed("colour", "cd"), ["repository_id", "dst"]).where("cs = cd").select("repository_id", "src", "dst", F.col("cs").alias("part"))
        inside = cut(inside)
        seen = front = cut(c.where("path = colour").select("repository_id", "path", F.col("colour").alias("part")))
        while not front.isEmpty():
            back = inside.join(front.withColumnRenamed("path", "dst"), ["repository_id", "dst", "part"]).select("repository_id", F.col("src").alias("path"), "part").distinct()
            front = cut(back.join(seen, ["repository_id", "path", "part"], "left_anti"))
            seen = cut(seen.unionByName(front))
        on = inside.join(seen.select("repository_id", F.col("path").alias("src"), "part"), ["repository_id", "src", "part"], "left_semi").join(seen.select("repository_id", F.col("path").alias("dst"), "part"), ["repository_id", "dst", "part"], "left_semi")
        done.append(cut(seen.join(on.select("repository_id", F.col("src").alias("path")).distinct(), ["repository_id", "path"], "left_semi")))
        rest = e.join(seen.select("repository_id", F.col("path").alias("src")), ["repository_id", "src"], "left_anti").join(seen.select("repository_id", F.col("path").alias("dst")), ["repository_id", "dst"], "left_anti")
        e = trim(rest, most_rounds)
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    return reduce(DataFrame.unionByName, done) if done else edges.select("repository_id", F.col("src").alias("path"), F.col("src").alias("part")).limit(0)


def longest_chain(edges: DataFrame, most_rounds: int = 100_000) -> DataFrame:
    """(repository_id, longest_chain): the most parts on a path through the graph whose strongly connected parts are single nodes. A chain beyond most_rounds is an error."""
    parts = strong_parts(edges)
    of = lambda c: parts.select("repository_id", F.col("path").alias(c), F.col("part").alias(f"{c}_part"))
    e = edges.join(of("src"), ["repository_id", "src"], "left").join(of("dst"), ["repository_id", "dst"], "left")
    e = cut(e.select("repository_id", F.coalesce("src_part", "src").alias("src"), F.coalesce("dst_part", "dst").alias("dst")).where("src <> dst").distinct())
    all_nodes = edges.select("repository_id", F.col("src").alias("path")).union(edges.select("repository_id", "dst"))
    repos = all_nodes.select("repository_id").distinct().withColumn("longest_chain", F.lit(1))
    front, best, n = e.select("repository_id", F.col("dst").alias("path")).distinct(), [], 1
    while n < most_rounds and not (front := cut(front)).isEmpty():
        n += 1
        best.append(front.select("repository_id").distinct().withColumn("longest_chain", F.lit(n)))
        front = e.join(front.withColumnRenamed("path", "src"), ["repository_id", "src"]).select("repository_id", F.col("dst").alias("path")).distinct()
    if n >= most_rounds and not front.isEmpty():
        raise RuntimeError(f"no end after {most_rounds} rounds")
    return reduce(DataFrame.unionByName, [repos, *best]).groupBy("repository_id").agg(F.max("longest_chain").alias("longest_chain"))


def lookups(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(repository_id, path, imports, imported_by, entry_point) of nodes: what a file imports, what imports it (sorted, joined by commas), and whether it imports something and nothing imports it."""
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    out = edges.groupBy("repository_id", F.col("src").alias("path")).agg(listed("dst").alias("imports"))
    into = edges.groupBy("repository_id", F.col("dst").alias("path")).agg(listed("src").alias("imported_by"))
    j = nodes.select("repository_id", "path").join(out, ["repository_id", "path"], "left").join(into, ["repository_id", "path"], "left")
    return j.select("repository_id", "path", F.coalesce("imports", F.lit("")).alias("imports"), F.coalesce("imported_by", F.lit("")).alias("imported_by"), (F.col("imports").isNotNull() & F.col("imported_by").isNull()).alias("entry_point"))


def open_cycles(edges: DataFrame) -> DataFrame:
    """(repository_id, cycle): the cycles of cycle_list as sets: without the first node at the end, each set of nodes once, in order of names."""
    c = F.split("cycle", ARROW)
    return cycle_list(edges).select("repository_id", F.array_join(F.array_sort(F.slice(c, 1, F.size(c) - 1)), ARROW).alias("cycle")).distinct()


def cycle_list(edges: DataFrame) -> DataFrame:
    """(repository_id, cycle): cycles closed by a back edge of a depth-first walk in sorted order, turned so that the smallest node is first and
    repeated at the end. A walk runs inside one strongly connected part; which cycles are listed depends on its order, as any such list does."""
    parts = strong_parts(edges)
    inner = edges.join(parts.select("repository_id", F.col("path").alias("src"), "part"), ["repository_id", "src"]).join(parts.select("repository_id", F.col("path").alias("dst"), F.col("part").alias("p2")), ["repository_id", "dst"]).where("part = p2")

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        adj: dict[str, list[str]] = {}
        for s, d in sorted(zip(pdf["src"], pdf["dst"])):
            adj.setdefault(s, []).append(d)
        state: dict[str, int] = {}
        found: set[tuple[str, ...]] = set()
        for root in sorted(adj):
            if root in state:
                continue
            path, stack = [root], [iter(adj[root])]
            state[root] = 1
            while stack:
                nxt = next(stack[-1], None)
                if nxt is None:
                    state[path.pop()] = 2
                    stack.pop()
                elif state.get(nxt) == 1:
                    c = path[path.index(nxt) :]
                    k = c.index(min(c))
                    found.add(tuple(c[k:] + c[:k] + [c[k]]))
                elif nxt not in state:
                    state[nxt] = 1
                    path.append(nxt)
                    stack.append(iter(adj.get(nxt, [])))
        return pd.DataFrame({"repository_id": pdf["repository_id"].iloc[0], "cycle": [ARROW.join(c) for c in sorted(found)]})

    return inner.groupBy("repository_id", "part").applyInPandas(walk, "repository_id string, cycle string")


def layer_violations(edges: DataFrame, types: DataFrame) -> DataFrame:
    """Edges that go upwards (Repository to Service, Controller or API; Service to Controller or API) or from configuration to logic: (repository_id, src, dst, kind)."""
    j = edges.join(types.select("repository_id", F.col("path").alias("src"), F.col("module").alias("a")), ["repository_id", "src"]).join(types.select("repository_id", F.col("path").alias("dst"), F.col("module").alias("b")), ["repository_id", "dst"])
    up = ((F.col("a") == "Repository") & F.col("b").isin("Service", "Controller", "API")) | ((F.col("a") == "Service") & F.col("b").isin("Controller", "API"))
    config = (F.col("a") == "Configuration") & F.col("b").isin("Controller", "Service", "Repository", "API")
    return j.select("repository_id", "src", "dst", F.when(up, "layer").when(config, "configuration").alias("kind")).where("kind is not null")


def architecture_score(cycles, coupled, config_violations, unknown_ratio):
    """100 less 15 for each cycle, 5 for each highly coupled module, 10 for each configuration violation, 20 times the share of unknown modules."""
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.bround(100 - 15 * cycles - 5 * coupled - 10 * config_violations - 20 * unknown_ratio, 0)))
