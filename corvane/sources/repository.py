"""Repositories on storage as tables: files, folders, notebooks, manifests, frameworks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import code as X
from corvane.operators.lines import explode_lines

WHOLE_BYTES = 10 * 1024 * 1024


def read_files(spark: SparkSession, root: str, repository_id: str | None = None) -> DataFrame:
    """Files below root as (id, repository_id, path, extension, size_bytes, content_hash, is_text, content).

    Generated folders, lock files and binary endings are left out. Files under 10 MiB are read whole: a zero byte in the first
    1024 marks a binary file; other bytes are UTF-8, else Latin-1. Ids are hashes of repository and path. Without repository_id
    the first folder below root is the repository. An empty root gives no rows.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + _quoted(root), "")
    d = raw.select(rel.alias("rel"), "length", "content")
    if repository_id is None:
        d = d.withColumn("repository_id", F.regexp_extract("rel", "^([^/]+)/", 1)).withColumn("p", F.regexp_replace("rel", "^[^/]+/", ""))
    else:
        d = d.withColumn("repository_id", F.lit(repository_id)).withColumn("p", F.col("rel"))
    folders = F.slice(F.split("p", "/"), 1, F.size(F.split("p", "/")) - 1)
    name, ext = F.lower(X.basename(F.col("p"))), X.extension(F.col("p"))
    d = d.where(~F.arrays_overlap(folders, F.array(*map(F.lit, X.SKIP_FOLDERS))) & ~name.isin(X.LOCK_FILES) & ~ext.isin(X.SKIP_ENDINGS))
    small = F.col("length") < WHOLE_BYTES
    text = small & (F.locate("00", F.regexp_replace(F.hex(F.substring("content", 1, 1024)), "(..)", "$1,")) == 0)
    decoded = F.when(F.expr("is_valid_utf8(cast(content as string))"), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    return d.select(
        F.sha2(F.concat_ws("|", "repository_id", "p"), 256).alias("id"), "repository_id", F.col("p").alias("path"), ext.alias("extension"), F.col("length").alias("size_bytes"),
        F.when(small, F.sha2("content", 256)).otherwise("unknown_hash").alias("content_hash"), text.alias("is_text"), F.when(text, decoded).alias("content"),
    )


def _quoted(root: str) -> str:
    return "\\Q" + "/" + root.removeprefix("file:").strip("/") + "\\E/*"


def folder_count(files: DataFrame) -> DataFrame:
    """Distinct folders that hold scanned files, and their ancestors, per repository."""
    parts = F.split(X.dirname(F.col("path")), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    d = files.where(F.contains("path", F.lit("/"))).select("repository_id", F.explode(up).alias("folder")).distinct()
    return d.groupBy("repository_id").agg(F.count(F.lit(1)).alias("n_folders"))


NOTEBOOK = "struct<metadata:struct<kernelspec:struct<language:string>,language_info:struct<name:string>>,cells:array<struct<cell_type:string,source:string>>>"


def notebook_language(content: Column) -> tuple[Column, Column]:
    """(language, characters of code cells) of a notebook's text; language Python if none is named, 0 characters if it is no notebook."""
    j = F.from_json(content, NOTEBOOK)
    lang = F.initcap(F.coalesce(j["metadata"]["kernelspec"]["language"], j["metadata"]["language_info"]["name"], F.lit("python")))
    # a cell's source is a string or an array of strings; read as a string, an array keeps its JSON form
    code = F.filter(j["cells"], lambda c: c["cell_type"] == "code")
    lines = lambda s: F.coalesce(F.array_join(F.from_json(s, "array<string>"), ""), s)
    n = F.aggregate(code, F.lit(0), lambda a, c: a + F.coalesce(F.length(lines(c["source"])), F.lit(0)))
    return F.when(j["cells"].isNotNull(), lang), F.coalesce(n, F.lit(0))


def manifest_dependencies(files: DataFrame) -> DataFrame:
    """(id, package, version) of requirements.txt, package.json, go.mod, Cargo.toml, pubspec.yaml, Gemfile, composer.json and pom.xml.

    requirements.txt is split at ==, version latest if there is none; of package.json development versions win. In section files
    (Cargo.toml, pubspec.yaml) lines count while the last section head is one of dependencies. Manifests that do not parse give no rows.
    """
    name = F.lower(X.basename(F.col("path")))
    f = files.where(F.col("content").isNotNull()).withColumn("n", name)
    req = explode_lines(f.where("n = 'requirements.txt'"), "content", ["id"]).withColumn("s", F.trim(F.regexp_replace("line", r"\s", " "))).where((F.col("s") != "") & ~F.startswith("s", F.lit("#")))
    out = req.select("id", F.split("s", "==")[0].alias("package"), F.coalesce(F.try_element_at(F.split("s", "=="), F.lit(2)), F.lit("latest")).alias("version"))
    for file, keys in (("package.json", ("dependencies", "devDependencies")), ("composer.json", ("require", "require-dev"))):
        j = F.from_json("content", "struct<" + ",".join(f"`{k}`:map<string,string>" for k in keys) + ">")
        a, b = (F.coalesce(j[k], F.create_map().cast("map<string,string>")) for k in keys)
        both = F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b)
        out = out.unionByName(f.where(F.col("n") == file).select("id", F.explode(both).alias("package", "version")))
    go = f.where("n = 'go.mod'").select("id", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^\s*(?:require\s+)?([\w./-]+\.[\w./-]+\s+v[\w.+-]+)"), 1)).alias("r"))
    out = out.unionByName(go.select("id", F.split("r", r"\s+")[0].alias("package"), F.split("r", r"\s+")[1].alias("version")))
    gem = f.where("n = 'gemfile'").select("id", F.explode(F.regexp_extract_all("content", F.lit(r"""(?m)^\s*(gem\s+['"][^'"]+['"][^\n]*)"""), 1)).alias("r"))
    out = out.unionByName(gem.select("id", F.regexp_extract("r", r"""gem\s+['"]([^'"]+)['"]""", 1).alias("package"), F.coalesce(F.nullif(F.regexp_extract("r", r""",\s*['"]([^'"]+)['"]""", 1), F.lit("")), F.lit("latest")).alias("version")))
    pom = f.where("n = 'pom.xml'").select("id", F.explode(F.regexp_extract_all("content", F.lit(r"(?s)<dependency>(.*?)</dependency>"), 1)).alias("r"))
    out = out.unionByName(pom.select("id", F.concat(F.regexp_extract("r", r"<groupId>\s*([^<\s]+)", 1), F.lit(":"), F.regexp_extract("r", r"<artifactId>\s*([^<\s]+)", 1)).alias("package"), F.coalesce(F.nullif(F.regexp_extract("r", r"<version>\s*([^<\s]+)", 1), F.lit("")), F.lit("latest")).alias("version")))
    toml = f.where("n = 'cargo.toml'").select("id", F.explode(F.regexp_extract_all("content", F.lit(r"(?ms)^\[(?:[\w.]+\.)?(?:dev-|build-)?dependencies\]\s*\n(.*?)(?=^\[|\z)"), 1)).alias("content"))
    tl = explode_lines(toml, "content", ["id"]).where(F.col("line").rlike(r"^\s*[\w-]+\s*="))
    out = out.unionByName(tl.select("id", F.regexp_extract("line", r"^\s*([\w-]+)", 1).alias("package"), F.coalesce(F.nullif(F.regexp_extract("line", r"""=\s*(?:\{[^}]*version\s*=\s*)?['"]([^'"]+)['"]""", 1), F.lit("")), F.lit("latest")).alias("version")))
    pub = f.where("n = 'pubspec.yaml'").select("id", F.explode(F.regexp_extract_all("content", F.lit(r"(?ms)^(?:dev_)?dependencies:\s*\n(.*?)(?=^\S|\z)"), 1)).alias("content"))
    pl = explode_lines(pub, "content", ["id"]).where(F.col("line").rlike(r"^  [\w]+:"))
    return out.unionByName(pl.select("id", F.regexp_extract("line", r"^  (\w+):", 1).alias("package"), F.coalesce(F.nullif(F.trim(F.regexp_extract("line", r":\s*([^#\n]*)", 1)), F.lit("")), F.lit("any")).alias("version")))


#: Frameworks by a word in a root manifest; fixed values.
FRAMEWORKS = [("package.json", "next", "Next.js"), ("package.json", "react", "React"), ("package.json", "vue", "Vue"), ("package.json", "express", "Express"), ("requirements.txt", "fastapi", "FastAPI"), ("requirements.txt", "django", "Django"), ("requirements.txt", "flask", "Flask"), ("pom.xml", "spring-boot", "Spring Boot"), ("go.mod", "gin-gonic", "Gin"), ("cargo.toml", "actix", "Actix"), ("gemfile", "rails", "Rails"), ("composer.json", "laravel", "Laravel"), ("pubspec.yaml", "flutter", "Flutter")]
MANAGERS = [("yarn.lock", "yarn"), ("pnpm-lock.yaml", "pnpm"), ("package.json", "npm"), ("poetry.lock", "poetry"), ("pipfile.lock", "pipenv"), ("requirements.txt", "pip"), ("pom.xml", "maven"), ("go.mod", "go"), ("cargo.toml", "cargo"), ("gemfile", "bundler"), ("composer.json", "composer"), ("pubspec.yaml", "pub")]


def tech_stack(files: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """(repository_id, frameworks, package_manager) from root manifests; a lock file says more than a manifest. listing: all paths, with lock files."""
    name = F.lower(F.col("path"))
    f = files.where(~F.contains("path", F.lit("/")))
    words = F.filter(F.array(*[F.when((name == m) & F.contains(F.lower("content"), F.lit(w)), F.lit(fw)) for m, w, fw in FRAMEWORKS]), lambda x: x.isNotNull())
    g = f.groupBy("repository_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(words)))).alias("frameworks"))
    rank = F.coalesce(*[F.when(name == m, i) for i, (m, _) in enumerate(MANAGERS)])
    l = (listing or files).where(~F.contains("path", F.lit("/"))).select("repository_id", rank.alias("r")).where("r is not null").groupBy("repository_id").agg(F.min("r").alias("r"))
    names = F.element_at(F.array(*[F.lit(m) for _, m in MANAGERS]), F.col("r") + 1)
    return g.join(l, "repository_id", "left").select("repository_id", "frameworks", names.alias("package_manager"))
