"""Scores of repositories as column arithmetic over one row of totals for each repository."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.code import basename, clamp

SEVERITIES = ["Critical", "High", "Medium", "Low"]


def security_score(critical: Column, high: Column, medium: Column, low: Column) -> Column:
    return clamp(100 - 25 * critical - 15 * high - 10 * medium - 5 * low)


def health_parts(avg_complexity: Column, smells: Column, critical: Column, high: Column, medium: Column, low: Column, cycles: Column, coupled: Column, comment_ratio: Column, duplication: Column) -> dict[str, Column]:
    """The six parts of the health score, each rounded half to even: at most 25, 25, 20, 15, 10 and 5 points."""
    r = lambda c: F.bround(c, 0).cast("int")
    zero = F.lit(0)
    return {
        "complexity": r(25 - F.least(F.lit(15.0), F.greatest(F.lit(0.0), avg_complexity - 3) * 1.5)),
        "maintainability": r(25 - F.least(F.lit(20.0), smells * 1.5)),
        "security": F.greatest(zero, r(20.0 - (5 * critical + 5 * high + 2 * medium + low))),
        "architecture": F.greatest(zero, r(15.0 - (3 * cycles + coupled))),
        "documentation": F.greatest(zero, F.least(F.lit(10), r(comment_ratio * 50))),
        "duplication": F.greatest(zero, r(5 - duplication / 2)),
    }


def repository_totals(files: DataFrame) -> DataFrame:
    """Per repository: files, lines, mean and largest complexity (files with lines only), smells, large files, coupled files, layers and tests by path."""
    loc, cx, smells, coupling = (F.greatest(F.lit(0), F.coalesce(F.col(c), F.lit(0))) for c in ("lines_of_code", "complexity", "code_smells_count", "coupling_score"))
    p = F.lower(F.coalesce("path", F.lit("")))
    is_test = F.contains(p, F.lit("test")) | F.contains(p, F.lit("spec"))
    n = lambda c: F.sum(c.cast("long"))
    return files.groupBy("repository_id").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum(loc).cast("long").alias("total_loc"), F.coalesce(F.bround(F.avg(F.when(loc > 0, cx)), 2), F.lit(0.0)).alias("average_complexity"), F.coalesce(F.max(F.when(loc > 0, cx)), F.lit(0)).alias("max_complexity"),
        F.coalesce(F.avg(F.when(cx > 0, cx)), F.lit(0.0)).alias("mean_positive"), F.sum(smells).cast("long").alias("total_smells"), n(loc > 300).alias("over_300"), n(loc > 500).alias("over_500"), n(coupling > 8).alias("coupled"),
        n(F.coalesce("in_dependency_cycle", F.lit(False))).alias("in_cycle"), n(F.coalesce("module_type", F.lit("Unknown")) == "Unknown").alias("unknown"),
        n(F.contains(p, F.lit("/")) | F.contains(p, F.lit("\\"))).alias("nested"), n(F.size(F.split(F.replace(p, F.lit("\\"), F.lit("/")), "/")) > 5).alias("deep"),
        n(F.coalesce("module_type", F.lit("")).isin("Controller", "API")).alias("controllers"), n(F.coalesce("module_type", F.lit("")) == "Service").alias("services"), n(F.coalesce("module_type", F.lit("")) == "Repository").alias("repositories"),
        n(is_test).alias("tests"), F.sum(F.when(is_test, loc).otherwise(0)).cast("long").alias("test_loc"), F.max((F.contains(p, F.lit("/test/")) | F.contains(p, F.lit("/tests/"))).cast("int")).alias("test_folder"), F.max((basename(p) == "readme.md").cast("int")).alias("readme"),
    )


def dimension_scores(t: DataFrame) -> DataFrame:
    """Scores (0 to 100) of architecture, maintainability, organisation and testing from repository_totals."""
    c, r = F.col, lambda x: clamp(F.bround(x, 0)).cast("int")
    cut = lambda most, x: F.least(F.lit(float(most)), x)
    layered = (c("controllers") > 0) & (c("services") > 0) & (c("repositories") > 0)
    arch = 100 + F.when(layered, 5).otherwise(0) + F.when(c("repositories") > 0, 3).otherwise(0) - cut(15, 2.0 * c("coupled"))
    maint = 100 - F.when(c("mean_positive") > 3, cut(20, (c("mean_positive") - 3) * 3)).otherwise(0) - F.when(c("max_complexity") > 15, 10).otherwise(0) - cut(20, 1.5 * c("total_smells")) - cut(20, 5.0 * c("over_300"))
    org = 100 - cut(20, 5.0 * c("over_500")) - F.when((c("nested") == 0) & (c("n_files") > 4), 10).otherwise(0) - cut(15, 3.0 * c("deep"))
    ratio = c("test_loc") / F.greatest(F.lit(1), c("total_loc") - c("test_loc"))
    test = F.when(c("tests") > 0, 65 + cut(20, 5.0 * c("tests")) + F.when(ratio >= 0.1, 15).otherwise(0) + F.when(c("test_folder") == 1, 10).otherwise(0)).otherwise(30)
    return t.select("repository_id", r(arch).alias("architecture"), r(maint).alias("maintainability"), r(org).alias("organisation"), r(test).alias("testing"))


#: Weights of the dimensions, and what documentation must have: name, words in a path, points; fixed values.
WEIGHTS = {"architecture": 0.15, "maintainability": 0.25, "organisation": 0.15, "consistency": 0.10, "security": 0.20, "testing": 0.10, "documentation": 0.05}
DOCUMENTS = [("installation", ["install", "setup"], 15), ("architecture", ["architecture", "design", "docs/arch"], 15), ("api", ["api", "swagger", "openapi"], 15), ("contributing", ["contributing", "contrib"], 10), ("license", ["license", "copying"], 5)]


def documentation_scores(files: DataFrame, comment_ratio: DataFrame) -> DataFrame:
    """(repository_id, documentation): 100 less what is missing: a read-me file at the root, paths of the given words, and comments in 15 percent of the lines.

    comment_ratio: (repository_id, ratio); a repository that is not in it has no comments.
    """
    p = F.lower(F.coalesce("path", F.lit("")))
    has = {n: reduce(lambda a, b: a | b, [F.contains(p, F.lit(w)) for w in words]) for n, words, _ in DOCUMENTS}
    g = files.groupBy("repository_id").agg(F.max((p == "readme.md").cast("int")).alias("__readme"), *[F.max(c.cast("int")).alias(f"__{n}") for n, c in has.items()])
    missing = F.when(F.col("__readme") == 0, 30).otherwise(0) + sum((F.when(F.col(f"__{n}") == 0, v).otherwise(0) for n, _, v in DOCUMENTS), F.lit(0)) + F.when(F.coalesce("ratio", F.lit(0.0)) < 0.15, 10).otherwise(0)
    return g.join(comment_ratio, "repository_id", "left").select("repository_id", F.greatest(F.lit(0), 100 - missing).cast("int").alias("documentation"))


def consistency_score(languages: Column, camel: Column, snake: Column) -> Column:
    """100 less 5 for each language beyond three (at most 15) and 10 where file names are written in camel and in snake case."""
    return clamp(100 - F.least(F.lit(15), 5 * F.greatest(F.lit(0), languages - 3)) - F.when(camel & snake, 10).otherwise(0)).cast("int")


def assessment(files: DataFrame, languages: DataFrame, security: DataFrame, comment_ratio: DataFrame, compat: bool = False) -> DataFrame:
    """(repository_id, the seven dimensions, total): languages (repository_id, languages), security (repository_id, security); unknown ones count as one language and 100.

    compat gives what the rules come to where they are in use today: names are never found to be mixed, languages are never known, and
    layers are never known, so that architecture has no bonus.
    """
    name = basename(F.coalesce("path", F.lit("")))
    names = files.groupBy("repository_id").agg(F.max(name.rlike("[a-z][A-Z]").cast("int")).alias("camel"), F.max(F.contains(F.coalesce("path", F.lit("")), F.lit("_")).cast("int")).alias("snake"))
    totals = repository_totals(files)
    if compat:
        totals = totals.withColumns({c: F.lit(0).cast("long") for c in ("controllers", "services", "repositories")})
        names, languages = names.withColumn("camel", F.lit(0)), languages.withColumn("languages", F.lit(0))
    j = dimension_scores(totals).join(names, "repository_id").join(languages, "repository_id", "left").join(security, "repository_id", "left").join(documentation_scores(files, comment_ratio), "repository_id")
    j = j.withColumn("consistency", consistency_score(F.coalesce("languages", F.lit(1)), F.col("camel") == 1, F.col("snake") == 1)).withColumn("security", F.coalesce("security", F.lit(100)).cast("int"))
    total = sum((F.col(k) * v for k, v in WEIGHTS.items()), F.lit(0.0))
    return j.select("repository_id", *WEIGHTS, F.bround(total, 0).cast("int").alias("total"))


def simulate(score: Column, gain: Column) -> Column:
    return clamp(score + gain)
