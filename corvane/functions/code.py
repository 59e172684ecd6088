"""Scalar expressions over paths, names, versions, scores and source text. All run in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language labels by extension; fixed values.
LANGUAGES = {
    ".ts": "TypeScript", ".tsx": "TypeScript", ".js": "JavaScript", ".jsx": "JavaScript", ".mjs": "JavaScript", ".cjs": "JavaScript", ".py": "Python", ".go": "Go", ".rs": "Rust", ".java": "Java", ".kt": "Kotlin",
    ".kts": "Kotlin", ".swift": "Swift", ".cpp": "C++", ".cc": "C++", ".cxx": "C++", ".c": "C", ".h": "C/C++ Header", ".cs": "C#", ".rb": "Ruby", ".php": "PHP", ".html": "HTML", ".css": "CSS", ".sh": "Shell",
    ".bat": "Batch", ".ps1": "PowerShell", ".yaml": "YAML", ".yml": "YAML", ".json": "JSON", ".md": "Markdown", ".toml": "TOML", ".xml": "XML", ".sql": "SQL",
}
#: Folders, lock files and endings that a scan leaves out; fixed values.
SKIP_FOLDERS = [".git", "node_modules", "build", "dist", "vendor", "__pycache__", ".next", ".vscode", ".idea", "out", "target", "bin", "obj", "coverage", ".svelte-kit", ".nuxt"]
LOCK_FILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "composer.lock", "cargo.lock", "poetry.lock", "mix.lock", "pipfile.lock"]
SKIP_ENDINGS = [".jpg", ".jpeg", ".png", ".gif", ".svg", ".ico", ".mp4", ".zip", ".tar", ".gz", ".rar", ".pdf", ".woff", ".woff2", ".ttf", ".eot", ".exe", ".dll", ".so", ".dylib", ".class", ".pyc", ".pyo", ".db", ".sqlite", ".war", ".ear", ".jar", ".map", ".css", ".scss", ".sass", ".less"]
#: Module types and what marks them in a folder or a file name, first match wins; fixed values.
MODULES = [
    ("Controller", ["/controllers/"], ["controller"]),
    ("API", ["/api/", "/endpoints/", "/routes/"], ["route", "endpoint"]),
    ("Service", ["/services/"], ["service", "svc"]),
    ("Repository", ["/repositories/"], ["repository", "repo"]),
    ("Model", ["/models/", "/schemas/"], ["model", "schema", "entity"]),
    ("Middleware", ["/middleware/"], ["middleware"]),
    ("Configuration", ["/config/"], ["config", "settings"]),
    ("Utility", ["/utils/", "/helpers/"], ["util", "helper"]),
]
#: What a path must contain for a boost of its similarity; fixed values.
BOOSTS = [
    (0.35, ["rag", "pipeline", "agent", "embed", "prompt"]),
    (0.30, ["security", "secret", "keyring", "crypt", "auth"]),
    (0.25, ["schema", "model", "database", "session", "db."]),
    (0.20, ["main.py", "app.py", "server.ts", "index.ts", "route.ts", "routes.py", "docker-compose"]),
    (0.15, ["workout", "engine", "adaptive", "processor", "rule"]),
]
#: Intents of a question by what it contains, first match wins; fixed values.
INTENTS = [
    ("GENERAL_OVERVIEW", ["what is this", "purpose", "explain project", "overview", "about", "describe"]),
    ("TECH_STACK", ["tech", "languages", "frameworks", "libraries", "dependencies", "package", "npm", "requirements", "setup"]),
    ("ARCHITECTURE", ["architecture", "structure", "folder", "dependency", "layer", "module", "mvc", "controller", "service", "coupling", "relations"]),
    ("SECURITY", ["security", "vulnerability", "secret", "inject", "cve", "threat", "risk", "owasp", "key"]),
    ("MAINTAINABILITY", ["maintainability", "smell", "complexity", "duplicate", "refactor", "improve", "clean"]),
]
GRADES = [("A", 90), ("B", 80), ("C", 70), ("D", 60)]
FINE_GRADES = [("A+", 97), ("A", 93), ("A-", 90), ("B+", 87), ("B", 83), ("B-", 80), ("C+", 75), ("C", 70), ("D", 60)]


def has_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(w)) for w in words])


def unix_path(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def extension(path: Column) -> Column:
    """The ending with its dot in lower case, '' for none and for names that begin with their only dot."""
    return F.lower(F.regexp_extract(basename(path), r"^.+?(\.[^.]*)$", 1))


def normalise_path(path: Column) -> Column:
    """Folds away '.', '..' and empty parts; a '..' above the root stays, as normpath does for relative paths."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    step = lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (last(acc) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def language(ext: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return m[F.lower(ext)]


def module_type(path: Column, ext: Column) -> Column:
    p = F.lower(unix_path(path))
    name = basename(p)
    e = F.lower(F.coalesce(ext, F.lit("")))
    out = F.lit("Unknown")
    for kind, dirs, names in reversed(MODULES):
        hit = has_any(p, dirs) | has_any(name, names)
        out = F.when(hit | F.startswith(name, F.lit(".env")) if kind == "Configuration" else hit, kind).otherwise(out)
    script = e.isin(".ts", ".tsx", ".js", ".jsx")
    out = F.when(script & (e.isin(".tsx", ".jsx") | has_any(p, ["/components/", "/views/"])), "Component").otherwise(out)
    return F.when(script & F.startswith(name, F.lit("use")), "Hook").otherwise(out)


def priority(path: Column) -> Column:
    """0 README, 1 manifests, 2 src or app, 3 services, 4 controllers or routes, 5 models, 8 tests, 9 docs, 6 others; the first that applies."""
    p = F.lower(path)
    n = basename(p)
    return (
        F.when(n == "readme.md", 0)
        .when(n.isin("package.json", "pom.xml", "requirements.txt", "go.mod", "cargo.toml", "gemfile"), 1)
        .when(has_any(p, ["src/", "app/"]), 2)
        .when(F.contains(p, F.lit("services/")), 3)
        .when(has_any(p, ["controllers/", "routes/"]), 4)
        .when(F.contains(p, F.lit("models/")), 5)
        .when(has_any(p, ["test", "tests"]), 8)
        .when(F.contains(p, F.lit("docs/")), 9)
        .otherwise(6)
    )


def boost(path: Column) -> Column:
    p, out = F.lower(F.coalesce(path, F.lit(""))), F.lit(0.0)
    for v, words in reversed(BOOSTS):
        out = F.when(has_any(p, words), v).otherwise(out)
    return out


def intent(question: Column) -> Column:
    q, out = F.lower(question), F.lit("CODE_SEMANTIC")
    for name, words in reversed(INTENTS):
        out = F.when(has_any(q, words), name).otherwise(out)
    return out


def clamp(c: Column, lo: float = 0, hi: float = 100) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def grade(score: Column, bands: list[tuple[str, int]] = GRADES, rest: str = "F") -> Column:
    out = F.lit(rest)
    for name, least in reversed(bands):
        out = F.when(score >= least, name).otherwise(out)
    return out


def version_parts(version: Column) -> Column:
    """Leading numbers of the dotted parts of a version; parts without one are 0."""
    return F.transform(F.split(version, r"\."), lambda p: F.coalesce(F.regexp_extract(p, r"^\D*(\d+)", 1).try_cast("int"), F.lit(0)))


def valid_repository_url(url: Column) -> Column:
    return F.coalesce(F.trim(url).rlike(r"^https?://github\.com/[\w.-]+/[\w.-]+?(?:\.git)?/?$"), F.lit(False))
