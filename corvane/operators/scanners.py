"""Line scanners: rules are data, one generic scan applies them; folds over lines are windows."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.lines import explode_any_lines, explode_lines

C_LIKE, SCRIPTS = [".c", ".h", ".cpp", ".hpp"], [".js", ".jsx", ".ts", ".tsx"]
NUMBER_FILES = [".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".c", ".h", ".cpp", ".hpp", ".cs", ".go", ".rs", ".kt", ".php"]


@dataclass(frozen=True)
class Rule:
    name: str
    category: str
    severity: str
    pattern: str
    extensions: tuple[str, ...] = ()


#: Security rules; fixed patterns.
SECURITY = [
    Rule("Hardcoded AWS API Key", "Secrets", "High", r"AKIA[0-9A-Z]{16}"),
    Rule("Hardcoded Private Key", "Secrets", "High", r"-----BEGIN [A-Z ]+ PRIVATE KEY-----"),
    Rule("Hardcoded GitHub Personal Access Token", "Secrets", "Critical", r"ghp_[a-zA-Z0-9]{36}"),
    Rule("Hardcoded Slack Webhook URL", "Secrets", "Critical", r"https://hooks\.slack\.com/services/T[a-zA-Z0-9_]+/B[a-zA-Z0-9_]+/[a-zA-Z0-9_]+"),
    Rule("Hardcoded Generic Hardcoded Secret", "Secrets", "Critical", r"(?i)(?:api_key|secret|password|db_pass|access_token|private_key)\s*=\s*['\"][^'\"]{8,}['\"]"),
    Rule("SQL Injection Risk", "Injection", "High", r"(?i)\.(?:execute|raw|query)\(\s*(?:f['\"]|['\"].*?%(?:\(.*?\))?[sdb]|['\"].*?\bformat\b|.*?\.format\(|.*?\+.*?\b(?:select|insert|update|delete|where)\b)"),
    Rule("Unsafe Eval", "Unsafe APIs", "Critical", r"\beval\s*\("),
    Rule("Unsafe Exec", "Unsafe APIs", "Critical", r"\bexec\s*\("),
    Rule("Dangerous Process Execution", "Unsafe APIs", "Medium", r"(?i)\bsubprocess\.(?:Popen|run|call)\(.*?\bshell\s*=\s*True"),
    Rule("Weak Hashing (MD5)", "Weak Cryptography", "Medium", r"hashlib\.md5|createHash\(['\"]md5['\"]\)"),
    Rule("Weak Hashing (SHA-1)", "Weak Cryptography", "Medium", r"hashlib\.sha1|createHash\(['\"]sha1['\"]\)"),
]
#: A stricter set that can be scanned instead; fixed patterns.
STRICT = [
    Rule("Command Injection", "Injection", "High", r"\bos\.(?:system|popen)\s*\("),
    Rule("Path Traversal", "Injection", "Medium", r"open\(\s*[^)]*\+\s*\w+|\.\./\.\./"),
    Rule("Java Process API", "Unsafe APIs", "Medium", r"Runtime\.getRuntime\(\)\.exec|new\s+ProcessBuilder"),
]
#: Smells that one line shows; fixed patterns.
LINE_SMELLS = [
    Rule("Mutable Defaults", "Correctness", "Medium", r"def\s+\w+\s*\(.*?\b\w+\s*=\s*(?:\[\]|\{\})\s*.*?\):", (".py",)),
    Rule("Empty Catch", "Error Handling", "Medium", r"catch\s*\(\s*[\w<>\[\]\s]+\s+\w+\s*\)\s*\{\s*\}", (".java",)),
    Rule("goto Usage", "Complexity", "Low", r"\bgoto\s+\w+;", tuple(C_LIKE)),
    *[Rule("Unsafe Memory Function", "Security", "High", rf"\b{f}\b\s*\(", tuple(C_LIKE)) for f in ("strcpy", "strcat", "sprintf", "gets")],
    Rule("Ignored Errors", "Error Handling", "Medium", r"\b_\s*,\s*err\s*:=|\b_\s*=\s*\w+\(.*?\)", (".go",)),
    Rule("Global State", "Design", "Medium", r"\bglobal\s+\$\w+|\$GLOBALS\s*\[", (".php",)),
]
MANIFESTS = ["requirements.txt", "package.json"]


def may_match(text: Column, rules: list[Rule]) -> Column:
    """Whether any rule can match somewhere in text: files without a hit are never split into lines. The patterns have no anchors, so what a line matches its text matches."""
    return reduce(lambda a, b: a | b, [text.rlike(r.pattern) for r in rules])


def scan_rules(lines: DataFrame, rules: list[Rule], line: str = "line", ext: str | None = None) -> DataFrame:
    """A row for each line and rule that matches: the columns of lines, rule_no, title, category, severity and matched text.

    The matching rules of a line are gathered in one array expression, so lines are read once and only hits are multiplied.
    """
    c = F.col(line)

    def hit(i: int, r: Rule) -> Column:
        ok = c.rlike(r.pattern)
        ok = ok & F.lower(F.col(ext)).isin(*r.extensions) if r.extensions and ext else ok
        return F.when(ok, F.struct(F.lit(i).alias("rule_no"), F.lit(r.name).alias("title"), F.lit(r.category).alias("category"), F.lit(r.severity).alias("severity"), F.regexp_extract(c, r.pattern, 0).alias("matched")))

    found = F.filter(F.array(*[hit(i, r) for i, r in enumerate(rules)]), lambda x: x.isNotNull())
    return lines.select("*", F.inline(found))


def security_issues(files: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """(id, repository_id, path, line_number, severity, category, title, evidence, snippet) of files with content; manifests are left out."""
    name = F.coalesce(F.lower(F.regexp_extract("path", r"([^/]*)$", 1)), F.lit(""))
    lines = explode_any_lines(files.where(~name.isin(MANIFESTS) & may_match(F.col("content"), rules or SECURITY)), "content", ["id", "repository_id", "path"])
    f = scan_rules(lines, rules or SECURITY)
    evidence = F.when(F.col("category") == "Secrets", F.concat(F.lit("Matched: "), F.substring("matched", 1, 15), F.lit("..."))).when(F.col("category") == "Injection", F.lit("Raw SQL string concatenation parameter executed.")).when(F.col("category") == "Unsafe APIs", F.concat(F.lit("Matched token: "), "matched")).otherwise(F.concat(F.lit("Matched cipher: "), "matched"))
    return f.select("id", "repository_id", "path", "line_number", "severity", "category", "title", evidence.alias("evidence"), F.substring("line", 1, 120).alias("snippet"))


def line_smells(files: DataFrame) -> DataFrame:
    """(id, path, line_number, smell_type, category, severity) of the one-line smells."""
    exts = sorted({e for r in LINE_SMELLS for e in r.extensions})
    lines = explode_lines(files.where(F.lower("extension").isin(exts) & may_match(F.col("content"), LINE_SMELLS)), "content", ["id", "path", "extension"])
    return scan_rules(lines, LINE_SMELLS, ext="extension").select("id", "path", "line_number", F.col("title").alias("smell_type"), "category", "severity", "matched")


SKIP_NUMBERS = r"^(?:#|//|/?\*|import\s|from\s|(?:export\s+)?const\s+[A-Z_]+|public\s+static\s+final\s+[A-Z_]+)"


def magic_numbers(files: DataFrame, most: int = 15) -> DataFrame:
    """(id, path, line_number, literal, value): standalone numbers other than 0, 1, -1, 2, 10 and 100, the first `most` of a file."""
    lines = explode_lines(files.where(F.lower("extension").isin(NUMBER_FILES)), "content", ["id", "path"]).withColumn("s", F.regexp_replace("line", r"^\s+|\s+$", ""))
    lits = lines.where((F.col("s") != "") & ~F.col("s").rlike(SKIP_NUMBERS)).select("id", "path", "line_number", F.posexplode(F.regexp_extract_all("s", F.lit(r"(?U)(?<![.\w])(-?\d+\.?\d*)(?![.\w])"), 1)).alias("pos", "literal"))
    v = lits.withColumn("value", F.col("literal").try_cast("double")).where(F.col("value").isNotNull() & ~F.col("value").isin(0.0, 1.0, -1.0, 2.0, 10.0, 100.0))
    w = Window.partitionBy("id").orderBy("line_number", "pos")
    return v.withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("id", "path", "line_number", "literal", "value")


def callback_hell(files: DataFrame, least: int = 3) -> DataFrame:
    """Lines of scripts that open a callback while at least `least` are open.

    The counter goes up by one on a line with a callback and down by one, not below 0, on a line with a closing brace: a walk
    reflected at 0, whose value is the running sum less its lowest point so far (if that is below 0).
    """
    l = explode_lines(files.where(F.lower("extension").isin(SCRIPTS)), "content", ["id", "path"])
    l = l.withColumn("c", F.col("line").rlike(r"\bfunction\b|\(\s*\)\s*=>").cast("int")).withColumn("d", F.contains("line", F.lit("}")).cast("int"))
    w = Window.partitionBy("id").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    l = l.withColumn("s", F.sum(F.col("c") - F.col("d")).over(w)).withColumn("low", F.min("s").over(w))
    depth = F.col("s") - F.least(F.lit(0), F.col("low"))
    before = F.coalesce(F.lag(depth).over(Window.partitionBy("id").orderBy("line_number")), F.lit(0))
    return l.withColumn("open", before + F.col("c")).where((F.col("c") == 1) & (F.col("open") >= least)).select("id", "path", "line_number", F.col("open").cast("long").alias("measured_value"))


def promise_chains(files: DataFrame, least: int = 4) -> DataFrame:
    """Lines with .then( that are at least the fourth since the last line with ; or } but without .then(."""
    l = explode_lines(files.where(F.lower("extension").isin(SCRIPTS)), "content", ["id", "path"])
    l = l.withColumn("t", F.col("line").rlike(r"\.then\s*\(")).withColumn("reset", (~F.col("t") & F.col("line").rlike("[;}]")).cast("int"))
    w = Window.partitionBy("id").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    l = l.withColumn("island", F.sum("reset").over(w))
    v = Window.partitionBy("id", "island").orderBy("line_number").rowsBetween(Window.unboundedPreceding, 0)
    return l.withColumn("n", F.sum(F.col("t").cast("int")).over(v)).where(F.col("t") & (F.col("n") >= least)).select("id", "path", "line_number", F.col("n").alias("measured_value"))


def large_matches(files: DataFrame, most_arms: int = 8) -> DataFrame:
    """Rust match blocks with more than most_arms arms: (id, path, line_number, measured_value).

    A match that opens on a line ends with the first later line where 1 + (lines with an opening brace) - (lines with a closing brace) is 0
    or less; arms are lines with => between, the last one included. One fold over a file's lines keeps the matches that are open; each is
    a row (line, depth, arms), so the work is lines times matches that are open at once.
    """
    kind = "struct<open:array<struct<line:bigint,depth:int,arms:bigint>>,done:array<struct<line:bigint,arms:bigint>>,n:bigint>"

    def step(acc: Column, line: Column) -> Column:
        d = F.contains(line, F.lit("{")).cast("int") - F.contains(line, F.lit("}")).cast("int")
        arm = F.contains(line, F.lit("=>")).cast("bigint")
        moved = F.transform(acc["open"], lambda m: F.struct(m["line"].alias("line"), (m["depth"] + d).alias("depth"), (m["arms"] + arm).alias("arms")))
        ended = F.transform(F.filter(moved, lambda m: m["depth"] <= 0), lambda m: F.struct(m["line"].alias("line"), m["arms"].alias("arms")))
        new = F.when(line.rlike(r"\bmatch\s+.*?\s*\{"), F.array(F.struct((acc["n"] + 1).alias("line"), F.lit(1).alias("depth"), F.lit(0).cast("bigint").alias("arms")))).otherwise(F.array())
        return F.struct(F.concat(F.filter(moved, lambda m: m["depth"] > 0), new).alias("open"), F.concat(acc["done"], ended).alias("done"), (acc["n"] + 1).alias("n")).cast(kind)

    zero = F.struct(F.array().alias("open"), F.array().alias("done"), F.lit(0).alias("n")).cast(kind)
    f = files.where((F.lower("extension") == ".rs") & F.contains("content", F.lit("match")))
    end = f.select("id", "path", F.aggregate(F.split("content", "\n", -1), zero, step).alias("a"))
    left = F.transform(F.col("a.open"), lambda m: F.struct(m["line"].alias("line"), m["arms"].alias("arms")))
    r = end.select("id", "path", F.inline(F.concat("a.done", left)))
    return r.where(F.col("arms") > most_arms).select("id", "path", F.col("line").alias("line_number"), F.col("arms").alias("measured_value"))
