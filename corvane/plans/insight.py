"""Queries that explain: ratios, layers, findings, principles, recommendations with a forecast, evidence for a question."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import code as X
from corvane.operators import lines as L
from corvane.operators import scoring as S
from corvane.operators import vectors as V
from corvane.operators.order import rank_spread
from corvane.plans.sql_parts import any_of, basename
from corvane.session import table

#: Layers by a word in the path, first match wins; fixed values.
LAYERS = [("controllers", ["controller"]), ("services", ["service"]), ("repositories", ["repository", "dao"]), ("entities", ["entity", "model", "dto"]), ("utilities", ["util", "helper", "common"]), ("configuration", ["config", "properties", "setting"])]
#: Recommendations: id, gain, difficulty, condition over the totals of a repository; fixed values.
ADVICE = [
    ("split_god_classes", 8, "Hard", "over_300 > 0"), ("reduce_coupling", 6, "Hard", "coupled > 0"), ("reduce_complexity", 4, "Medium", "max_complexity > 15"), ("reduce_file_sizes", 3, "Medium", "over_500 > 0"), ("extract_long_methods", 3, "Medium", "total_smells > 0"),
    ("rotate_secrets", 12, "Easy", "secrets > 0"), ("sanitize_inputs", 8, "Medium", "injections > 0"), ("add_tests", 10, "Medium", "tests = 0"), ("create_readme", 5, "Easy", "readme = 0"),
]


def _files(spark, d):
    return table(spark, d, "repository_files")


def _issues(spark, d):
    i = table(spark, d, "security_issues").dropDuplicates(["id"])
    return i.withColumn("severity", F.initcap(F.trim("severity"))).withColumn("category", F.lower(F.trim("category")))


def comment_ratios(spark, d):
    """Comment lines over lines, and the mean of the files' ratios, per repository."""
    c = L.line_counts(_files(spark, d).where("content is not null"))
    return c.groupBy("repository_id").agg(F.round(F.sum("comment_lines") / F.sum("total_lines"), 6).alias("of_lines"), F.round(F.avg(F.bround(F.col("comment_lines") / F.col("total_lines"), 2)), 6).alias("mean_of_files"), (F.sum("total_lines") * 5).alias("checks"))


def layers(spark, d):
    """Files per layer of each repository, with the smallest and largest path."""
    p = F.lower("path")
    out = F.lit(None).cast("string")
    for name, words in reversed(LAYERS):
        out = F.when(X.has_any(p, words), name).otherwise(out)
    f = _files(spark, d).where("path is not null").select("repository_id", "path", out.alias("layer")).where("layer is not null")
    return f.groupBy("repository_id", "layer").agg(F.countDistinct("path").alias("n"), F.min("path").alias("first"), F.max("path").alias("last"))


def packages(spark, d):
    """Distinct folders of files, and the files right in them."""
    f = _files(spark, d).where(F.contains("path", F.lit("/"))).select("repository_id", X.dirname(F.col("path")).alias("folder"), "path")
    return f.groupBy("repository_id", "folder").agg(F.countDistinct("path").alias("n"))


def architecture_findings(spark, d):
    """Pattern and confidence of each repository from its stored module types, and what speaks for and against it."""
    t = S.repository_totals(_files(spark, d))
    layered = (F.col("controllers") + F.col("services") + F.col("repositories")) > 0
    parts = _files(spark, d).where("module_type in ('Component', 'Hook')").select("repository_id").distinct().withColumn("ui", F.lit(True))
    j = t.join(parts, "repository_id", "left")
    ui = F.coalesce("ui", F.lit(False))
    return j.select("repository_id", F.when(layered, "Layered Architecture").when(ui, "Component-Based Architecture").otherwise("Module-Based Organization").alias("pattern"), F.when(layered, 95).when(ui, 90).otherwise(70).alias("confidence"), (F.col("in_cycle") > 0).alias("has_cycles"), (F.col("coupled") > 0).alias("has_coupled"))


def principles(spark, d):
    """Whether each repository keeps to: small simple units, layers, loose coupling."""
    t = S.repository_totals(_files(spark, d))
    rules = [("single_responsibility", (F.col("over_300") > 0) | (F.col("max_complexity") > 15)), ("layering", (F.col("n_files") > 5) & ((F.col("controllers") == 0) | (F.col("services") == 0))), ("loose_coupling", F.col("coupled") > 0), ("inversion", (F.col("coupled") > 0) & (F.col("n_files") > 5))]
    return t.select("repository_id", F.inline(F.array(*[F.struct(F.lit(n).alias("principle"), F.when(c, "violated").otherwise("passed").alias("status")) for n, c in rules])))


def _advice_rows(spark, d) -> DataFrame:
    i = _issues(spark, d).groupBy("repository_id").agg(F.sum((F.col("category") == "secrets").cast("long")).alias("secrets"), F.sum((F.col("category") == "injection").cast("long")).alias("injections"))
    t = S.repository_totals(_files(spark, d)).join(i, "repository_id", "left").na.fill(0, ["secrets", "injections"])
    hit = F.filter(F.array(*[F.when(F.expr(c), F.struct(F.lit(n).alias("advice"), F.lit(g).alias("gain"), F.lit(h).alias("difficulty"))) for n, g, h, c in ADVICE]), lambda x: x.isNotNull())
    return t.select("repository_id", F.inline(hit))


def recommendations(spark, d):
    """What would raise the score of each repository most, in order of gain."""
    w = Window.partitionBy("repository_id").orderBy(F.desc("gain"), "advice")
    return _advice_rows(spark, d).withColumn("place", F.row_number().over(w).cast("long"))


def forecast(spark, d):
    """The stored score of each repository after its easy, then medium, then hard recommendations, each at most 100."""
    r = _advice_rows(spark, d).groupBy("repository_id", "difficulty").agg(F.sum("gain").alias("gain"))
    stage = F.when(F.col("difficulty") == "Easy", 1).when(F.col("difficulty") == "Medium", 2).otherwise(3)
    w = Window.partitionBy("repository_id").orderBy("stage").rowsBetween(Window.unboundedPreceding, 0)
    s = table(spark, d, "repositories").select(F.col("id").alias("repository_id"), F.coalesce("health_score", F.lit(0)).alias("health"))
    g = r.withColumn("stage", stage).withColumn("total", F.sum("gain").over(w)).join(s, "repository_id")
    return g.select("repository_id", "stage", S.simulate(F.col("health"), F.col("total")).cast("int").alias("score"))


def score_waterfall(spark, d):
    """How the security score of each repository comes about: a row for each severity, running from 100."""
    n = {"Critical": 25, "High": 15, "Medium": 10, "Low": 5}
    i = _issues(spark, d).where(F.col("severity").isin(*n)).groupBy("repository_id", "severity").agg(F.count(F.lit(1)).alias("n"))
    rank = F.element_at(F.create_map(*[F.lit(x) for k, s in enumerate(n) for x in (s, k)]), F.col("severity"))
    cost = F.element_at(F.create_map(*[F.lit(x) for kv in n.items() for x in kv]), F.col("severity")) * F.col("n")
    w = Window.partitionBy("repository_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return i.withColumn("rank", rank).withColumn("cost", cost).select("repository_id", "severity", "n", F.greatest(F.lit(0), 100 - F.sum("cost").over(w)).cast("int").alias("left"))


def assessment_confidence(spark, d):
    """How far an assessment of each repository can be trusted: fewer files, no language, no read-me file take points; at least 10."""
    t = S.repository_totals(_files(spark, d)).join(table(spark, d, "repositories").select(F.col("id").alias("repository_id"), F.size("language_breakdown").alias("langs")), "repository_id")
    c = 100 - F.when(F.col("n_files") < 2, 50).when(F.col("n_files") < 10, 15).otherwise(0) - F.when(F.coalesce("langs", F.lit(0)) <= 0, 15).otherwise(0) - F.when(F.col("readme") == 0, 10).otherwise(0)
    return t.select("repository_id", F.greatest(F.lit(10), c).alias("confidence"))


def question_evidence(spark, d):
    """Evidence of a question, in three stages: the repository's own row, the reranked hits, their neighbours; a text counts once, where it came first."""
    from corvane.plans.knowledge import _once, _question

    c = _once(spark, d)
    hits = V.grounded(c, _question(spark, d), 4)
    repos = hits.select("repository_id").distinct()
    own = table(spark, d, "repositories").join(repos.withColumnRenamed("repository_id", "id"), "id", "left_semi").select(F.lit(0).alias("stage"), F.col("id").alias("chunk_id"), F.concat(F.lit("Repository "), F.coalesce("url", F.lit(""))).alias("content"), F.lit(1.0).alias("similarity"))
    first = hits.select(F.lit(1).alias("stage"), "chunk_id", "content", "similarity")
    near = V.neighbours(hits, c).select(F.lit(2).alias("stage"), "chunk_id", "content", "similarity")
    u = reduce(DataFrame.unionByName, [own, first, near])
    w = Window.partitionBy("content").orderBy("stage", "chunk_id")
    return u.withColumn("r", F.row_number().over(w)).where("r = 1").select("stage", "chunk_id", "similarity")


def vulnerable_packages(spark, d):
    """Packages pinned at or below a version: name equal, version parts compared one by one. The list of packages is a table of the reports' own: of
    each package that a dependency report of high severity names, the highest version that is reported."""
    known = _pinned(spark, d, "High").groupBy("package").agg(F.max("v").alias("upto"))
    p = _pinned(spark, d, None)
    return p.join(known, "package").where(F.col("v") <= F.col("upto")).select("id", "package").distinct()


def _pinned(spark, d, severity):
    """(id, package, v): the packages that dependency reports name, with the parts of their versions."""
    s = _issues(spark, d).where("category = 'dependencies' and snippet is not null")
    s = (s.where(F.col("severity") == severity) if severity else s).select("id", F.trim(F.regexp_replace("snippet", r"\s", " ")).alias("s"))
    return s.select("id", F.regexp_extract("s", r"([A-Za-z][\w-]*)", 1).alias("package"), X.version_parts(F.regexp_extract("s", r"(\d+(?:\.\d+)*)", 1)).alias("v"))


def layout(spark, d):
    """Places on a circle for the nodes of each repository's graph."""
    f = rank_spread(_files(spark, d).where("path is not null").select("id", "repository_id", "path"), ["repository_id"], [F.col("path"), F.col("id")], "r")
    n = f.groupBy("repository_id").agg(F.count(F.lit(1)).alias("n"))
    a = 2 * F.pi() * (F.col("r") - 1) / F.col("n")
    return f.join(n, "repository_id").select("id", F.round(200 + 150 * F.cos(a), 4).alias("x"), F.round(200 + 150 * F.sin(a), 4).alias("y"))


def line_ranges(spark, d):
    """The text of each issue's line in its file, where both are there."""
    i = table(spark, d, "security_issues").dropDuplicates(["id"]).where("line_number >= 1").select("id", "repository_id", F.col("file_path").alias("path"), "line_number")
    f = _files(spark, d).where("content is not null").groupBy("repository_id", "path").agg(F.min("content").alias("content"))
    return i.join(f, ["repository_id", "path"]).select("id", F.md5(F.coalesce(F.try_element_at(F.split("content", "\n", -1), F.col("line_number")), F.lit(""))).alias("digest"))


QUERIES = {f.__name__: f for f in (comment_ratios, layers, packages, architecture_findings, principles, recommendations, forecast, score_waterfall, assessment_confidence, question_evidence, vulnerable_packages, layout, line_ranges)}


def _sql() -> dict[str, str]:
    from corvane.plans import source as A
    from corvane.plans.knowledge import SQL as K
    from corvane.plans.overview import _I, _T

    lines = A.SQL["line_counts"].replace("select id, lower(", "select id, repository_id, lower(").replace("select id, total_lines", "select repository_id, id, total_lines")
    layer = "case " + " ".join(f"when {any_of('lower(path)', ws)} then '{n}'" for n, ws in LAYERS) + " end"
    totals = f"(select t.*, coalesce(secrets, 0) secrets, coalesce(injections, 0) injections, coalesce(rm, 0) readme from {_T} t left join (select repository_id, sum((category = 'secrets')::int) secrets, sum((category = 'injection')::int) injections from {_I} group by 1) using (repository_id) left join (select repository_id, max(({basename('lower(path)')} = 'readme.md')::int) rm from repository_files group by 1) using (repository_id))"
    advice = " union all ".join(f"select repository_id, '{n}' advice, {g} gain, '{h}' difficulty from {totals} where {c}" for n, g, h, c in ADVICE)
    stage = "case difficulty when 'Easy' then 1 when 'Medium' then 2 else 3 end"
    hits = K["grounded_search"].split("select chunk_id, similarity, round(")[0]
    grounded = f"{hits}, g as (select chunk_id, similarity from h order by similarity * (1 + {K['grounded_search'].split('round(similarity * (1 + ')[1].split('), 6)')[0]}) desc, chunk_id limit 4)"
    once = "(select distinct on (chunk_id) * from repository_embeddings order by chunk_id, id)"
    return {
        "comment_ratios": f"with x as ({lines}) select repository_id, round(sum(comment_lines) / sum(total_lines), 6) of_lines, round(avg(round_even(comment_lines / total_lines, 2)), 6) mean_of_files, (sum(total_lines) * 5)::bigint checks from x group by 1",
        "layers": f"select repository_id, layer, count(distinct path) n, min(path) as first, max(path) as last from (select repository_id, path, {layer} layer from repository_files where path is not null) where layer is not null group by 1, 2",
        "packages": "select repository_id, regexp_replace(path, '/?[^/]*$', '') as folder, count(distinct path) n from repository_files where contains(path, '/') group by 1, 2",
        "architecture_findings": f"with j as (select t.*, c.in_cycle, u.ui from {_T} t left join (select repository_id, sum(coalesce(in_dependency_cycle, false)::int) in_cycle from repository_files group by 1) c using (repository_id) left join (select distinct repository_id, true ui from repository_files where module_type in ('Component', 'Hook')) u using (repository_id)) select repository_id, case when controllers + services + repos > 0 then 'Layered Architecture' when coalesce(ui, false) then 'Component-Based Architecture' else 'Module-Based Organization' end as pattern, case when controllers + services + repos > 0 then 95 when coalesce(ui, false) then 90 else 70 end confidence, in_cycle > 0 has_cycles, coupled > 0 has_coupled from j",
        "principles": f"select repository_id, unnest(['single_responsibility', 'layering', 'loose_coupling', 'inversion']) principle, unnest([case when over_300 > 0 or max_complexity > 15 then 'violated' else 'passed' end, case when n_files > 5 and (controllers = 0 or services = 0) then 'violated' else 'passed' end, case when coupled > 0 then 'violated' else 'passed' end, case when coupled > 0 and n_files > 5 then 'violated' else 'passed' end]) status from {_T}",
        "recommendations": f"select *, row_number() over (partition by repository_id order by gain desc, advice) place from ({advice})",
        "forecast": f"with r as (select repository_id, {stage} as stage, sum(gain) gain from ({advice}) group by 1, 2), g as (select *, sum(gain) over (partition by repository_id order by stage) total from r) select g.repository_id, stage, greatest(0, least(100, coalesce(health_score, 0) + total))::int score from g join repositories p on p.id = g.repository_id",
        "score_waterfall": f"with i as (select repository_id, severity, count(*) n, case severity when 'Critical' then 0 when 'High' then 1 when 'Medium' then 2 else 3 end r, case severity when 'Critical' then 25 when 'High' then 15 when 'Medium' then 10 else 5 end * count(*) cost from {_I} where severity in ('Critical', 'High', 'Medium', 'Low') group by 1, 2) select repository_id, severity, n, greatest(0, 100 - sum(cost) over (partition by repository_id order by r))::int as left from i",
        "assessment_confidence": f"select t.repository_id, greatest(10, 100 - case when n_files < 2 then 50 when n_files < 10 then 15 else 0 end - case when coalesce(cardinality(language_breakdown), 0) <= 0 then 15 else 0 end - case when readme = 0 then 10 else 0 end) confidence from {totals} t join repositories p on p.id = t.repository_id",
        "question_evidence": f"""{grounded}, c as {once}, hit as (select c.*, g.similarity s from g join c using (chunk_id)), u as (select 0 stage, id chunk_id, 'Repository ' || coalesce(url, '') as content, 1.0::double similarity from repositories where id in (select repository_id from hit) union all select 1, chunk_id, content, s from hit
 union all select 2, min(chunk_id), content, 0.8 from c where file_path is not null and content not in (select content from hit where content is not null) and exists (select 1 from hit h where h.repository_id = c.repository_id and h.file_path = c.file_path and abs(h.start_line - c.start_line) > 0 and abs(h.start_line - c.start_line) < 150) group by repository_id, content)
 select stage, chunk_id, similarity from (select *, row_number() over (partition by content order by stage, chunk_id) r from u) where r = 1""",
        "layout": "with a as (select id, 2 * pi() * (row_number() over (partition by repository_id order by path, id) - 1) / count(*) over (partition by repository_id) a from repository_files where path is not null) select id, round(200 + 150 * cos(a), 4) x, round(200 + 150 * sin(a), 4) y from a",
        "line_ranges": "with i as (select distinct on (id) * from security_issues where line_number >= 1), f as (select repository_id, path, min(content) content from repository_files where content is not null group by 1, 2) select i.id, md5(coalesce(string_split(content, chr(10))[line_number], '')) digest from i join f on f.repository_id = i.repository_id and f.path = i.file_path",
        "vulnerable_packages": rf"""with s as (select id, severity, trim(regexp_replace(snippet, '\s', ' ', 'g')) s from {_I} where category = 'dependencies' and snippet is not null), p as (select id, severity, regexp_extract(s, '([A-Za-z][\w-]*)', 1) package, list_transform(string_split(regexp_extract(s, '(\d+(?:\.\d+)*)', 1), '.'), lambda x: coalesce(try_cast(x as int), 0)) v from s),
 known as (select package, max(v) upto from p where severity = 'High' group by 1) select distinct p.id, p.package from p join known k using (package) where p.v <= k.upto""",
    }


SQL = _sql()
