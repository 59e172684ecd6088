"""Chunks of source texts: fixed-stride windows, routing of files, merged functions, priority, evidence documents."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.code import basename, has_any
from corvane.session import cut

#: Points for what a chunk's path or content contains; fixed values.
SECRET_WORDS = ["api_key", "apikey", "secret", "password", "passwd", "token", "auth_token", "private_key"]
POINTS = [
    (12.0, ["rag", "prompt", "embedding", "fastembed", "openai", "gemini", "groq", "llm", "expert", "inference", "voicecoach"]),
    (11.5, ["auth", "login", "signup", "register", "session", "jwt", "cookie", "keyring", "oauth", "middleware"]),
    (11.0, ["db", "database", "schema", "prisma", "typeorm", "sqlalchemy", "migration", "postgres", "mysql", "sqlite"]),
]
ROUTE_WORDS = ["api/", "route.ts", "controller", "router", "handler"]
#: Endings of code and names of lock files; fixed values.
CODE_ENDINGS = [".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".go", ".c", ".cpp", ".h", ".cs", ".rs", ".php", ".rb", ".kt"]
LOCK_NAMES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock"]
CORE_FILES = ["dockerfile", "docker-compose.yml", "package.json", "requirements.txt", "next.config"]


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """Starts (from 0) of windows of `size` characters that overlap; the last one ends at the end. One window if the text fits; none if it is empty."""
    step = size if overlap >= size else size - overlap
    count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / step) + 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1), lambda i: i * step)).otherwise(F.array().cast("array<bigint>"))


def windows(df: DataFrame, text: str, keep: list[str], size: int, overlap: int) -> DataFrame:
    """keep, chunk_no, start_idx, end_idx, start_line, end_line, content of each window; lines are counted from 1.

    The line ends between two starts are counted once, in the window that begins at the first of them, and summed up over the array of a
    text's windows; only the windows themselves are multiplied, not the text.
    """
    step = size if overlap >= size else size - overlap
    t = F.col(text)
    nl = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    made = F.transform(window_starts(F.length(t), size, overlap), lambda i: F.struct(i.alias("start_idx"), t.substr((i + 1).cast("int"), F.lit(size)).alias("content"), nl(t.substr((i + 1).cast("int"), F.lit(step))).cast("bigint").alias("own")))
    d = df.where(t.isNotNull()).select(*keep, made.alias("__w"))
    run = F.aggregate("__w", F.array(F.lit(1).cast("bigint")), lambda acc, w: F.concat(acc, F.array(F.element_at(acc, -1) + w["own"])))
    d = d.select(*keep, F.posexplode(F.arrays_zip(F.col("__w").alias("w"), F.slice(run, 1, F.size("__w")).alias("l"))).alias("chunk_no", "__x"))
    w = F.col("__x.w")
    return d.select(*keep, F.col("chunk_no").cast("long").alias("chunk_no"), w["start_idx"].alias("start_idx"), (w["start_idx"] + F.length(w["content"])).alias("end_idx"), F.col("__x.l").alias("start_line"), (F.col("__x.l") + nl(w["content"])).alias("end_line"), w["content"].alias("content"))


def low_value(path: Column, content: Column) -> Column:
    """JSON and YAML but for three names, blank texts, and texts of imports, exports and comments alone."""
    n = basename(F.lower(path))
    data = n.rlike(r"\.(?:json|yaml|yml)$") & ~n.isin("package.json", "docker-compose.yml", "tsconfig.json")
    lines = F.filter(F.transform(F.split(content, "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s", " "))), lambda x: x != "")
    return data | F.forall(lines, lambda x: x.rlike(r"^(?:import |export |\} from |/\*|\*|//)") | (x == "}"))


def route(path: Column, ext: Column, content: Column) -> Column:
    """How a file is chunked: skip, readme, config, whole or code."""
    p, n = F.lower(path), basename(F.lower(path))
    skip = F.lower(F.coalesce(ext, F.lit(""))).isin(".css", ".scss", ".sass", ".less", ".map", ".ico", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".woff", ".woff2", ".ttf", ".eot") | has_any(p, ["test", "spec", "mocks"]) | (F.coalesce(content, F.lit("")) == "")
    small = (F.length(content) < 1500) | (F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) < 100)
    return (
        F.when(skip, "skip").when(low_value(path, content), "skip").when(n == "readme.md", "readme").when(n.isin("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock"), "skip")
        .when(n.isin("package.json", "requirements.txt", "docker-compose.yml", "dockerfile", ".env"), "config").when(small, "whole").otherwise("code")
    )


def readme_sections(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep, section, content: a read-me text split before each line that begins with #; blank sections are left out."""
    d = df.select(*keep, F.posexplode(F.split(F.col(text), "\n#", -1)).alias("section", "h"))
    return d.where(F.trim(F.regexp_replace("h", r"\s", " ")) != "").select(*keep, "section", F.trim(F.regexp_replace(F.concat(F.when(F.col("section") > 0, "#").otherwise(""), "h"), r"^\s+|\s+$", "")).alias("content"))


GROUPS = "array<struct<start_line:bigint,last_end:bigint,names:array<string>>>"


def is_accessor(name: Column, loc: Column) -> Column:
    return (loc <= 3) & (name.rlike("^(?:get|set)") | name.isin("toString", "toJSON", "constructor"))


def function_groups(fs: Column, gap: int, span: int) -> Column:
    """Groups of neighbouring functions, from an array of (line, loc, name) sorted by line.

    A function joins the group before it if the gap to that group's last function is small and the span from its first one stays within
    bounds; the fold depends on the group's begin, so it is an aggregate over the array.
    """

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        end = (x["line"] + x["loc"]).cast("bigint")
        new = F.struct(x["line"].cast("bigint").alias("start_line"), end.alias("last_end"), F.array(x["name"]).alias("names"))
        joined = F.struct(last["start_line"].alias("start_line"), end.alias("last_end"), F.concat(last["names"], F.array(x["name"])).alias("names"))
        fits = (F.size(acc) > 0) & (x["line"] - last["last_end"] <= gap) & (end - last["start_line"] <= span)
        return F.when(fits, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(acc, F.array(new))).cast(GROUPS)

    return F.aggregate(fs, F.array().cast(GROUPS), step)


def merge_functions(functions: DataFrame, keep: list[str], gap: int = 15, span: int = 80) -> DataFrame:
    """Groups of neighbouring functions of a file (see function_groups): keep, start_line, end_line, names, n. Accessors of up to three lines are left out.

    functions: keep, name, line, loc; the functions of one file are gathered, which its text already held together.
    """
    g = functions.where(~is_accessor(F.col("name"), F.col("loc"))).groupBy(*keep).agg(F.array_sort(F.collect_list(F.struct("line", "loc", "name"))).alias("fs"))
    groups = g.select(*keep, F.inline(function_groups(F.col("fs"), gap, span)))
    return groups.select(*keep, "start_line", F.col("last_end").alias("end_line"), F.array_join("names", ", ").alias("names"), F.size("names").alias("n"))


def code_chunks(files: DataFrame, known: DataFrame, key: str = "id", small_class: int = 60, header: int = 25, limit: int = 3000) -> DataFrame:
    """(key, chunk_type, names, start_line, end_line, part, content) of files of code; known: their facts (id, declarations, functions).

    Classes under small_class lines are chunks, larger ones give their first `header` lines. Functions inside a small class and accessors are
    left out, the others are merged with their neighbours. A file that declares neither is cut into windows of 800 that overlap by 150.
    Chunks of more than `limit` characters are cut into windows of 2,000 that overlap by 300, numbered by part from 0; part is null for whole
    ones. Everything is an expression over a file's own arrays: texts are shuffled once, to meet their facts, and written once.
    """
    d = files.where(F.col("content").isNotNull() & (F.col("content") != "")).select(F.col(key).alias("__id"), "content").join(known.select(F.col("id").alias("__k"), "declarations", "functions"), F.col("__id") == F.col("__k"), "left")
    none = lambda c, t: F.coalesce(c, F.array().cast(t))
    span = "array<struct<chunk_type:string,names:string,start_line:bigint,end_line:bigint>>"
    as_span = lambda kind, names, a, z: F.struct(kind.alias("chunk_type"), names.alias("names"), a.cast("bigint").alias("start_line"), z.cast("bigint").alias("end_line"))
    once = lambda c, f: F.element_at(F.transform(F.array(c), f), 1)  # noqa: E731 - binds a value, so that it is computed once for a row
    loc = lambda c: c["end_line"] - c["line"] + 1
    classes = F.transform(F.filter("declarations", lambda c: c["kind"].isin("class", "struct")), lambda c: F.when(loc(c) < small_class, as_span(F.lit("Class"), c["name"], c["line"], c["end_line"])).otherwise(as_span(F.lit("Class Header"), c["name"], c["line"], c["line"] + header - 1)))

    def with_functions(cs: Column) -> Column:
        inside = lambda f: F.exists(cs, lambda c: (c["chunk_type"] == "Class") & (c["start_line"] <= f["line"]) & (f["line"] + f["loc"] - 1 <= c["end_line"]))
        free = F.filter("functions", lambda f: ~inside(f) & ~is_accessor(f["name"], f["loc"]))
        fs = F.array_sort(F.transform(free, lambda f: F.struct(f["line"].alias("line"), f["loc"].alias("loc"), f["name"].alias("name"))))
        groups = F.transform(function_groups(fs, 15, 80), lambda g: as_span(F.when(F.size(g["names"]) > 1, "Merged Functions").otherwise("Function"), F.array_join(g["names"], ", "), g["start_line"], g["last_end"] - 1))
        return F.concat(cs, none(groups, span))

    def with_text(ls: Column) -> Column:
        text = lambda x: F.array_join(F.slice(ls, x["start_line"].cast("int"), F.greatest(F.lit(0), (x["end_line"] - x["start_line"] + 1).cast("int"))), "\n")
        return F.transform(once(none(classes, span), with_functions), lambda x: F.struct(x["chunk_type"].alias("chunk_type"), x["names"].alias("names"), x["start_line"].alias("start_line"), x["end_line"].alias("end_line"), text(x).alias("content")))

    d = d.select("__id", "content", once(F.split("content", "\n", -1), with_text).alias("__s"))
    d = cut(d.select("__id", "__s", F.when(F.size("__s") == 0, F.col("content")).alias("content")))
    named = d.select("__id", F.inline("__s"))
    plain = windows(d.where("content is not null").select("__id", "content"), "content", ["__id"], 800, 150)
    plain = plain.select("__id", F.lit("Window").alias("chunk_type"), F.col("chunk_no").cast("string").alias("names"), "start_line", "end_line", "content")
    u = named.unionByName(plain)
    whole = u.where(F.length("content") <= limit).withColumn("part", F.lit(None).cast("long"))
    large = u.where(F.length("content") > limit).withColumnRenamed("start_line", "__first").drop("end_line").withColumnRenamed("content", "__t")
    cut_up = windows(large, "__t", ["__id", "chunk_type", "names", "__first"], 2000, 300)
    cut_up = cut_up.select("__id", "chunk_type", "names", (F.col("__first") + F.col("start_line") - 1).alias("start_line"), (F.col("__first") + F.col("end_line") - 1).alias("end_line"), "content", F.col("chunk_no").alias("part"))
    return whole.unionByName(cut_up).withColumnRenamed("__id", key).select(key, "chunk_type", "names", "start_line", "end_line", "part", "content")


def indexed_files(path: Column, ext: Column) -> Column:
    """Whether a file is taken into the index of code: one of the endings of code, no lock file and not minified by name."""
    n = basename(F.lower(path))
    return F.lower(F.coalesce(ext, F.lit(""))).isin(*CODE_ENDINGS) & ~n.isin(*LOCK_NAMES) & ~F.contains(n, F.lit(".min.")) & ~F.contains(n, F.lit("-min."))


def priority(path: Column, content: Column, chunk_type: Column, start_line: Column, end_line: Column, has_issue: Column) -> Column:
    """Points by which chunks are kept when there are too many."""
    p, c = F.lower(F.coalesce(path, F.lit(""))), F.lower(F.coalesce(content, F.lit("")))
    loc = F.coalesce(end_line, F.lit(0)) - F.coalesce(start_line, F.lit(0))
    score = F.when((chunk_type == "README") | F.endswith(p, F.lit("readme.md")), 15.0).otherwise(0.0) + F.when(has_issue, 100.0).otherwise(0.0) + F.when(has_any(c, SECRET_WORDS), 18.0).otherwise(0.0)
    for v, words in POINTS:
        score = score + F.when(has_any(p, words) | has_any(c, words), v).otherwise(0.0)
    score = score + F.when(has_any(p, ROUTE_WORDS), 10.5).otherwise(0.0) + F.when(basename(p).isin(CORE_FILES), 10.0).otherwise(0.0) + F.when(has_any(p, ["src/", "app/"]), 5.0).otherwise(0.0)
    code = chunk_type.isin("Class", "Function", "Whole File", "Merged Functions")
    score = score + F.when(code, F.lit(2.0) + F.when(loc > 50, 1.5).when(loc > 20, 0.8).otherwise(0.0)).otherwise(0.0)
    return score + F.when(has_any(p, ["shared", "components/", "lib/"]), 1.0).otherwise(0.0) - F.when(F.length(F.coalesce(content, F.lit(""))) < 200, 3.0).otherwise(0.0)


def chunks_with_issues(chunks: DataFrame, issues: DataFrame) -> DataFrame:
    """Ids of chunks (id, repository_id, file_path, start_line, end_line) with an issue of the same repository on one of their lines, where one path contains the other.

    One path contains the other as its end, part by part: ends of both paths are joined by equality, and lines compared after.
    """
    ends = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda i: F.array_join(F.slice(F.split(c, "/"), i, F.size(F.split(c, "/")) - i + 1), "/"))
    p = F.lower("file_path")
    c = chunks.where("file_path is not null").select("id", "repository_id", p.alias("p"), F.coalesce("start_line", F.lit(0)).alias("a"), F.coalesce("end_line", F.lit(999999)).alias("z"))
    i = issues.where("file_path is not null and line_number is not null and file_path <> ''").select("repository_id", p.alias("q"), "line_number").distinct()
    one = c.join(i.select("repository_id", F.explode(ends(F.col("q"))).alias("p"), "line_number"), ["repository_id", "p"]).where("line_number between a and z")
    two = c.select("id", "repository_id", "a", "z", F.explode(ends(F.col("p"))).alias("q")).join(i, ["repository_id", "q"]).where("line_number between a and z")
    return one.select("id").union(two.select("id")).distinct()


def best_chunks(chunks: DataFrame, budget: int, score: str = "score", group: str = "repository_id", key: str = "id") -> DataFrame:
    """The `budget` chunks of each group with the highest score, ties by key; groups within the budget are kept whole."""
    w = Window.partitionBy(group).orderBy(F.desc(score), key)
    return chunks.withColumn("place", F.row_number().over(w)).where(F.col("place") <= budget)


def evidence_documents(rows: DataFrame, group: list[str], line: Column, order: list[str], size: int = 15) -> DataFrame:
    """group, part (from 1), n, evidence: the lines of each group in order, `size` to a document."""
    w = Window.partitionBy(*group).orderBy(*order)
    d = rows.withColumn("__r", F.row_number().over(w) - 1).withColumn("part", (F.floor(F.col("__r") / size) + 1).cast("int")).withColumn("__l", line)
    g = d.groupBy(*group, "part").agg(F.array_sort(F.collect_list(F.struct("__r", "__l"))).alias("a"))
    return g.select(*group, "part", F.size("a").alias("n"), F.array_join(F.transform("a", lambda x: x["__l"]), "\n").alias("evidence"))
