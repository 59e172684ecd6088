"""Queries over smells, dimensions, evidence documents, chunks of code, manifests, and evidence by intent."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions import code as X
from corvane.operators import analyzers as A
from corvane.operators import chunking as C
from corvane.operators import lines as L
from corvane.operators import scanners as R
from corvane.operators import scoring as S
from corvane.operators.order import rank_spread
from corvane.plans.graphs import _FOURS as FOURS_SQL
from corvane.plans.graphs import _G as GRAPH_SQL
from corvane.plans.knowledge import _once
from corvane.plans.overview import _I as ISSUE_SQL
from corvane.plans.overview import _INT as INTENT_SQL
from corvane.plans.overview import _SEV as SEVERITY_SQL
from corvane.plans.overview import _T as TOTALS_SQL
from corvane.plans.overview import SQL as OVERVIEW_SQL
from corvane.plans.overview import _issues, _severities
from corvane.plans.source import _SRC as SRC
from corvane.plans.source import SQL as SOURCE_SQL
from corvane.plans.source import _sources
from corvane.plans.sql_parts import quoted
from corvane.session import table
from corvane.sources.repository import folder_count, manifest_dependencies, tech_stack

DIMENSION_SQL = OVERVIEW_SQL["dimension_scores"]


def _files(spark, d):
    return table(spark, d, "repository_files")


def _line_smells(spark, d) -> DataFrame:
    """Smells of single lines and of large files in all sources: (id, path, line_number, smell_type, severity, measured_value, threshold)."""
    src = _sources(spark, d)
    one = R.line_smells(src).select("id", "line_number", "smell_type", "severity", F.lit(1.0).alias("measured_value"), F.lit(0.0).alias("threshold"))
    big = A.large_files(src.where(F.lower("extension").isin(".md", *C.CODE_ENDINGS)), 100)
    return one.unionByName(big.withColumn("line_number", F.col("line_number").cast("long"))).join(src.select("id", "repository_id", "path"), "id")


def large_files(spark, d):
    """Sources of more than 100 lines of code; twice what a file may have is the usual limit of 300."""
    return A.large_files(_sources(spark, d), 100).select("id", "smell_type", "severity", F.col("measured_value").cast("long").alias("lines"))


def smells_by_file(spark, d):
    return _line_smells(spark, d).groupBy("repository_id", "path").agg(F.count(F.lit(1)).alias("n_smells"))


def smells_page(spark, d):
    """The second page of fifty smells of medium severity, by severity, path, line and id."""
    s = _line_smells(spark, d).where("severity = 'Medium'").select("id", "path", "line_number", "smell_type")
    return s.orderBy("path", F.col("line_number").asc_nulls_first(), "id", "smell_type").offset(50).limit(50)


def assessments(spark, d):
    """The seven dimensions of each repository and their weighted total."""
    f = _files(spark, d)
    langs = table(spark, d, "repositories").select(F.col("id").alias("repository_id"), F.greatest(F.lit(0), F.coalesce(F.size("language_breakdown"), F.lit(0))).alias("languages"))
    sec = _severities(spark, d).select("repository_id", S.security_score(*(F.col(x.lower()) for x in S.SEVERITIES)).cast("int").alias("security"))
    c = L.line_counts(f.where("content is not null")).groupBy("repository_id").agg((F.sum("comment_lines") / F.sum("total_lines")).alias("ratio"))
    return S.assessment(f, langs, sec, c)


def overview_documents(spark, d):
    """One document for each repository and kind of figures: overview, technologies, metrics, architecture."""
    t = S.repository_totals(_files(spark, d))
    f = _files(spark, d).groupBy("repository_id").agg(F.sum(F.col("is_text").cast("long")).alias("texts"), F.sum(F.when(F.col("size_bytes") > 0, F.col("size_bytes")).otherwise(0)).alias("bytes"))
    r = table(spark, d, "repositories").select(F.col("id").alias("repository_id"), "health_score", "health_grade", F.coalesce(F.array_join(F.array_sort(F.map_keys("language_breakdown")), ", "), F.lit("")).alias("langs"))
    j = t.join(f, "repository_id").join(r, "repository_id")
    n = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    docs = [
        ("overview", F.concat(F.lit("Total Files: "), n("n_files"), F.lit(", Text Files: "), n("texts"), F.lit(", Bytes: "), n("bytes"))),
        ("technologies", F.concat(F.lit("Languages: "), F.col("langs"))),
        ("metrics", F.concat(F.lit("Total LOC: "), n("total_loc"), F.lit(", Max Complexity: "), n("max_complexity"), F.lit(", Smells: "), n("total_smells"), F.lit(", Health: "), n("health_score"), F.lit(" ("), n("health_grade"), F.lit(")"))),
        ("architecture", F.concat(F.lit("Modules: "), n("n_files"), F.lit(", Highly Coupled: "), n("coupled"), F.lit(", In Cycles: "), n("in_cycle"))),
    ]
    return j.select("repository_id", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), e.alias("evidence")) for k, e in docs])))


def smell_documents(spark, d):
    """Smells of each file but magic numbers, fifteen to a document."""
    s = _line_smells(spark, d).where("path is not null")
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    line = F.concat(F.lit("- Line "), part("line_number"), F.lit(": "), "smell_type", F.lit(" ("), "severity", F.lit(")"))
    e = C.evidence_documents(s, ["repository_id", "path"], line, ["line_number", "smell_type", "id"])
    return e.select("repository_id", "path", "part", "n", F.md5("evidence").alias("digest"))


def roadmap(spark, d):
    """What would raise a repository's score: items of the shorter road map with their gains, and how many files or issues each touches."""
    i = _issues(spark, d).groupBy("repository_id").agg(F.sum(((F.col("category") == "secrets") | F.contains(F.lower("title"), F.lit("secret"))).cast("long")).alias("secrets"), F.sum((F.col("category").isin("injection", "sql injection", "command injection") | F.contains(F.lower("title"), F.lit("inject"))).cast("long")).alias("injections"))
    f = _files(spark, d)
    loc, cx = F.coalesce("lines_of_code", F.lit(0)), F.coalesce("complexity", F.lit(0))
    p = F.lower(F.coalesce("path", F.lit("")))
    n = lambda c: F.sum(c.cast("long"))
    t = f.groupBy("repository_id").agg(n(loc > 300).alias("large"), n(cx > 10).alias("complex"), n(F.contains(p, F.lit("test")) | F.contains(p, F.lit("spec"))).alias("tests"), n(p == "readme.md").alias("readme"), n(F.coalesce("in_dependency_cycle", F.lit(False))).alias("cycles"))
    m = R.magic_numbers(f).join(f.select("id", "repository_id"), "id").groupBy("repository_id").agg(F.countDistinct("id").alias("magic"))
    j = t.join(i, "repository_id", "left").join(m, "repository_id", "left").na.fill(0)
    items = [("rotate_secrets", 12, F.col("secrets")), ("sanitize_inputs", 8, F.col("injections")), ("uncouple_dependencies", 6, F.col("cycles")), ("split_god_classes", 5, F.col("large")), ("reduce_complexity", 4, F.col("complex")), ("extract_magic_numbers", 2, F.col("magic")), ("add_tests", 10, (F.col("tests") == 0).cast("long")), ("create_readme", 5, (F.col("readme") == 0).cast("long"))]
    hit = F.filter(F.array(*[F.struct(F.lit(k).alias("item"), F.lit(g).alias("gain"), c.cast("long").alias("touches")) for k, g, c in items]), lambda x: x["touches"] > 0)
    return j.select("repository_id", F.inline(hit))


def roadmap_without_magic(spark, d):
    return roadmap(spark, d).where("item <> 'extract_magic_numbers'")


def repetition_principle(spark, d):
    """Whether each repository keeps from repeating itself: at most five percent of its lines are duplicated."""
    p = L.duplicated_lines(_files(spark, d), "repository_id", "id", "content")
    return p.select("repository_id", F.lit("no_repetition").alias("principle"), F.when(F.col("duplication_percentage") > 5, "violated").otherwise("passed").alias("status"))


def code_chunks(spark, d):
    """Files of code in classes, merged functions and windows."""
    f = _files(spark, d).where("content is not null and path is not null")
    c = C.code_chunks(f, A.facts(f))
    return c.select("id", "chunk_type", "names", "start_line", "end_line", "part", F.md5("content").alias("digest"))


def fallback_chunks(spark, d):
    """Sources that declare nothing by their ending, in windows of 800 that overlap by 150; a window has no parts."""
    f = table(spark, d, "documents").where("text is not null and text <> ''").select(F.col("doc_id").cast("string").alias("id"), F.lit(".md").alias("extension"), F.col("text").alias("content"))
    c = C.code_chunks(f, A.facts(f))
    return c.select("id", F.col("names").cast("long").alias("no"), "start_line", "end_line", F.md5("content").alias("digest"))


def indexed_files(spark, d):
    f = _files(spark, d).where("path is not null")
    return f.where(C.indexed_files(F.col("path"), F.col("extension"))).select("id")


def declared_lines(spark, d):
    """Declarations of C, C# and Go, whose patterns stand on one line: id, line, kind and name."""
    f = _files(spark, d).where(F.lower("extension").isin(".c", ".cs", ".go"))
    return A.declarations(f).select("id", "line", "kind", "name")


def dependency_lines_of_code(spark, d):
    """What C, C# and Java files include, use, import or belong to."""
    f = _files(spark, d).where(F.lower("extension").isin(".c", ".cs", ".java"))
    return A.dependencies(f).select("id", "line", "type", "target")


def folders(spark, d):
    return folder_count(_files(spark, d).where("path is not null"))


def _manifests(spark, d) -> DataFrame:
    """A requirements.txt and a package.json for each repository, over its id's hash."""
    r = table(spark, d, "repositories").select(F.col("id").alias("repository_id"), F.pmod(F.ascii(F.substring("id", -1, 1)), F.lit(3)).alias("k"))
    req = F.concat(F.lit("# pinned\nfastapi=="), F.col("k").cast("string"), F.lit(".1\n\npandas\n"))
    js = F.concat(F.lit('{"dependencies": {"react": "1.'), F.col("k").cast("string"), F.lit('", "left": "2"}, "devDependencies": {"left": "3"}}'))
    both = F.array(F.struct(F.lit("requirements.txt").alias("path"), req.alias("content")), F.struct(F.lit("package.json").alias("path"), js.alias("content")))
    return r.where("repository_id is not null").select("repository_id", F.inline(both)).withColumn("id", F.concat("repository_id", F.lit("/"), "path"))


def manifest_packages(spark, d):
    return manifest_dependencies(_manifests(spark, d))


def stacks(spark, d):
    return tech_stack(_manifests(spark, d)).select("repository_id", F.array_join("frameworks", ",").alias("frameworks"), "package_manager")


def routed_evidence(spark, d):
    """Evidence of the questions of chats by their intent: the repository's own row and its root read-me where the question is general, then its chunks with the
    longest contents (four for code, else two); a text counts once, where it came first."""
    m = table(spark, d, "chat_messages").where("content is not null and session_id is not null and lower(trim(role)) in ('user', 'human')").dropDuplicates(["id"])
    s = table(spark, d, "chat_sessions").where("repository_id is not null").select(F.col("id").alias("session_id"), "repository_id").dropDuplicates(["session_id"])
    q = m.select("id", "session_id", X.intent(F.col("content")).alias("intent")).join(s, "session_id").drop("session_id")
    general = q.where(F.col("intent").isin("GENERAL_OVERVIEW", "TECH_STACK", "ARCHITECTURE"))
    own = general.select("id", F.lit(0).alias("stage"), F.lit(1).alias("place"), F.col("repository_id").alias("chunk_id"), F.lit(1.0).alias("similarity"), F.concat(F.lit("Repository "), "repository_id").alias("content"), "repository_id")
    c = _once(spark, d, "repository_id", "file_path", "content").where("content is not null and content <> ''").drop("id")
    readme = c.where("lower(file_path) = 'readme.md'").groupBy("repository_id").agg(F.min("chunk_id").alias("chunk_id"), F.min_by("content", "chunk_id").alias("content"))
    root = general.select("id", "repository_id").join(readme, "repository_id").select("id", F.lit(0).alias("stage"), F.lit(2).alias("place"), "chunk_id", F.lit(1.0).alias("similarity"), "content", "repository_id")
    w = Window.partitionBy("repository_id").orderBy(F.desc(F.length("content")), "chunk_id")
    top = c.withColumn("r", F.row_number().over(w)).where("r <= 4")
    hits = q.join(top, "repository_id").where(F.col("r") <= F.when(F.col("intent") == "CODE_SEMANTIC", 4).otherwise(2)).select("id", F.lit(1).alias("stage"), F.col("r").alias("place"), "chunk_id", F.lit(0.9).alias("similarity"), "content", "repository_id")
    u = reduce(DataFrame.unionByName, [own, root, hits])
    one = Window.partitionBy("id", "content").orderBy("stage", "place")  # at most six rows of a question
    return u.withColumn("n", F.row_number().over(one)).where("n = 1").select("id", "stage", "place", "chunk_id", "similarity")


def readme_sections(spark, d):
    """Read-me texts cut before each heading."""
    r = table(spark, d, "documents").where("text is not null").where(F.regexp_replace(F.lower(F.trim("source")), r"[\s-]+", "_") == "readme")
    c = C.readme_sections(r, "text", ["doc_id"])
    return c.select("doc_id", F.col("section").cast("long").alias("section"), F.md5("content").alias("digest"))


def best_chunks(spark, d):
    """The twenty longest chunks of each repository."""
    c = _once(spark, d, "repository_id", F.length(F.coalesce("content", F.lit(""))).alias("score"))
    return C.best_chunks(c.where("repository_id is not null"), 20).select("repository_id", "id", F.col("place").cast("long").alias("place"))


def fine_grades(spark, d):
    """The stored score of each repository in finer grades; none without a score."""
    s = F.col("health_score")
    return table(spark, d, "repositories").select("id", F.when(s.isNotNull(), X.grade(s, X.FINE_GRADES)).alias("grade"))


def graph_scores(spark, d):
    """Architecture scores of the linked sources (see plans/graphs.py): cycles, highly coupled files, violations by configuration, share of unknown modules."""
    from corvane.operators import graph as G
    from corvane.plans.graphs import _edges

    f, e = _edges(spark, d)
    coupled = G.coupling(f.select("repository_id", "path"), e).groupBy("repository_id").agg(F.sum((F.col("coupling") > 3).cast("long")).alias("coupled"))
    bad = G.layer_violations(e, f.select("repository_id", "path", F.col("module_type").alias("module"))).where("kind = 'configuration'").groupBy("repository_id").agg(F.count(F.lit(1)).alias("bad"))
    cycles = G.cycle_list(e).groupBy("repository_id").agg(F.count(F.lit(1)).alias("cycles"))
    unknown = f.groupBy("repository_id").agg(F.avg((F.col("module_type") == "Unknown").cast("double")).alias("unknown"))
    j = unknown.join(coupled, "repository_id", "left").join(bad, "repository_id", "left").join(cycles, "repository_id", "left").na.fill(0)
    return j.select("repository_id", G.architecture_score(F.col("cycles"), F.col("coupled"), F.col("bad"), F.col("unknown")).cast("int").alias("score"))


def files_and_count(spark, d):
    """The first ten files of each repository by path, with the number of all its files."""
    f = _files(spark, d).where("path is not null").select("id", "repository_id", "path")
    n = f.groupBy("repository_id").agg(F.count(F.lit(1)).alias("total"))
    r = rank_spread(f, ["repository_id"], [F.col("path"), F.col("id")], "r").where("r <= 10")
    return r.join(n, "repository_id").select("repository_id", "id", "r", "total")


QUERIES = {f.__name__: f for f in (large_files, smells_by_file, smells_page, assessments, overview_documents, smell_documents, roadmap, roadmap_without_magic, repetition_principle, code_chunks, fallback_chunks, indexed_files, declared_lines, dependency_lines_of_code, folders, manifest_packages, stacks, routed_evidence, files_and_count, readme_sections, best_chunks, fine_grades, graph_scores)}

_CODE = ", ".join(quoted(e) for e in [".md", *C.CODE_ENDINGS])
_LARGE = rf"""(select id, code from (select id, filled - case when e in ('.py', '.rb') then hashed else greatest(0, filled - code_left) end code from (select id, lower(extension) e, len(list_filter(string_split(content, chr(10)), lambda x: trim(regexp_replace(x, '\s', ' ', 'g')) <> '')) filled,
 len(list_filter(string_split(regexp_replace(regexp_replace(content, '(?s)/\*.*?\*/', '', 'g'), '//[^\n]*', '', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '\s', ' ', 'g')) <> '')) code_left, len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '^\s*#'))) hashed
 from {SRC} where content is not null and lower(extension) in ({_CODE}))) where code > 100)"""
_SMELLS = f"(select x.*, s.repository_id, s.path from (select id, line_number, smell_type, severity from ({SOURCE_SQL['line_smells']}) union all select id, null, 'Large File', case when code < 150 then 'Medium' else 'High' end from {_LARGE}) x join {SRC} s using (id))"
_LOW, _HAS = "lower(coalesce(path, ''))", lambda ws: "max((" + " or ".join(f"contains(lower(coalesce(path, '')), '{w}')" for w in ws) + ")::int)"
_DECLARED = lambda ext, kinds, skip="('')": f"select id, line_number::int as line, case {' '.join(f'when regexp_matches(line, {quoted(p)}) then {quoted(k)}' for k, p, _ in kinds)} end kind, case {' '.join(f'when regexp_matches(line, {quoted(p)}) then regexp_extract(line, {quoted(p)}, {g})' for _, p, g in kinds)} end as name, {skip} skip from l where e = '{ext}'"
_LINES_OF_CODE = "l as (select id, lower(extension) e, unnest(string_split(content, chr(10))) as line, unnest(range(1, len(string_split(content, chr(10))) + 1)) line_number from repository_files where content is not null and lower(extension) in ('.c', '.cs', '.go', '.java'))"
_ONE_CHUNK = "(select chunk_id, repository_id, file_path, content from (select distinct on (chunk_id) * from repository_embeddings order by chunk_id, id) where content is not null and content <> '')"

SQL = {
    "large_files": f"select id, 'Large File' smell_type, case when code < 150 then 'Medium' else 'High' end severity, code as lines from {_LARGE}",
    "smells_by_file": f"select repository_id, path, count(*) n_smells from {_SMELLS} group by 1, 2",
    "smells_page": f"select id, path, line_number, smell_type from {_SMELLS} where severity = 'Medium' order by path nulls first, line_number nulls first, id, smell_type limit 50 offset 50",
    "smell_documents": f"""with r as (select *, row_number() over (partition by repository_id, path order by line_number nulls first, smell_type, id) - 1 r, '- Line ' || coalesce(line_number::varchar, 'None') || ': ' || smell_type || ' (' || severity || ')' l from {_SMELLS} where path is not null)
 select repository_id, path, (r // 15 + 1)::int part, count(*)::int n, md5(string_agg(l, chr(10) order by r)) digest from r group by 1, 2, 3""",
    "assessments": f"""with names as (select repository_id, max(regexp_matches(regexp_extract(coalesce(path, ''), '([^/]*)$', 1), '[a-z][A-Z]')::int) camel, max(contains(coalesce(path, ''), '_')::int) snake, max(({_LOW} = 'readme.md')::int) rm, {_HAS(['install', 'setup'])} a, {_HAS(['architecture', 'design', 'docs/arch'])} b, {_HAS(['api', 'swagger', 'openapi'])} c, {_HAS(['contributing', 'contrib'])} d, {_HAS(['license', 'copying'])} e from repository_files group by 1),
 ratio as (select repository_id, sum(comment_lines) / sum(total_lines) ratio from ({SOURCE_SQL['line_counts']}) join repository_files using (id) group by 1), sec as (select repository_id, greatest(0, least(100, 100 - 25 * critical - 15 * high - 10 * medium - 5 * low))::int as security from {SEVERITY_SQL}),
 j as (select t.*, coalesce(sec.security, 100) as security, greatest(0, least(100, 100 - least(15, 5 * greatest(0, coalesce(cardinality(language_breakdown)::int, case when r.id is null then 1 else 0 end) - 3)) - case when camel = 1 and snake = 1 then 10 else 0 end))::int consistency,
  greatest(0, 100 - 30 * (1 - rm) - 15 * (1 - a) - 15 * (1 - b) - 15 * (1 - c) - 10 * (1 - d) - 5 * (1 - e) - case when coalesce(ratio, 0) < 0.15 then 10 else 0 end)::int documentation from ({DIMENSION_SQL}) t join names using (repository_id) left join sec using (repository_id) left join ratio using (repository_id) left join repositories r on r.id = t.repository_id)
 select repository_id, architecture, maintainability, organisation, consistency, security, testing, documentation, round_even(0.15::double * architecture + 0.25::double * maintainability + 0.15::double * organisation + 0.10::double * consistency + 0.20::double * security + 0.10::double * testing + 0.05::double * documentation, 0)::int total from j""",
    "overview_documents": f"""with f as (select repository_id, sum(is_text::int)::bigint texts, sum(case when size_bytes > 0 then size_bytes else 0 end)::bigint bytes, sum(coalesce(in_dependency_cycle, false)::int)::bigint in_cycle from repository_files group by 1),
 j as (select t.*, f.texts, f.bytes, f.in_cycle, health_score, health_grade, coalesce(array_to_string(list_sort(map_keys(language_breakdown)), ', '), '') langs from {TOTALS_SQL} t join f using (repository_id) join repositories r on r.id = t.repository_id)
 select repository_id, unnest(['overview', 'technologies', 'metrics', 'architecture']) kind, unnest(['Total Files: ' || n_files || ', Text Files: ' || coalesce(texts::varchar, 'None') || ', Bytes: ' || bytes, 'Languages: ' || langs,
  'Total LOC: ' || total_loc || ', Max Complexity: ' || max_complexity || ', Smells: ' || total_smells || ', Health: ' || coalesce(health_score::varchar, 'None') || ' (' || coalesce(health_grade, 'None') || ')', 'Modules: ' || n_files || ', Highly Coupled: ' || coupled || ', In Cycles: ' || in_cycle]) evidence from j""",
    "roadmap_without_magic": f"""with i as (select repository_id, sum((coalesce(category = 'secrets', false) or coalesce(contains(lower(title), 'secret'), false))::int)::bigint secrets, sum((coalesce(category in ('injection', 'sql injection', 'command injection'), false) or coalesce(contains(lower(title), 'inject'), false))::int)::bigint injections from {ISSUE_SQL} group by 1),
 t as (select repository_id, sum((coalesce(lines_of_code, 0) > 300)::int)::bigint as large, sum((coalesce(complexity, 0) > 10)::int)::bigint complex_files, sum((contains({_LOW}, 'test') or contains({_LOW}, 'spec'))::int)::bigint tests, sum(({_LOW} = 'readme.md')::int)::bigint readme, sum(coalesce(in_dependency_cycle, false)::int)::bigint cycles from repository_files group by 1),
 j as (select t.*, coalesce(secrets, 0) secrets, coalesce(injections, 0) injections from t left join i using (repository_id)),
 u as (select repository_id, unnest(['rotate_secrets', 'sanitize_inputs', 'uncouple_dependencies', 'split_god_classes', 'reduce_complexity', 'add_tests', 'create_readme']) item, unnest([12, 8, 6, 5, 4, 10, 5]) gain, unnest([secrets, injections, cycles, large, complex_files, (tests = 0)::bigint, (readme = 0)::bigint]) touches from j)
 select * from u where touches > 0""",
    "repetition_principle": f"select repository_id, 'no_repetition' principle, case when duplication_percentage > 5 then 'violated' else 'passed' end status from ({SOURCE_SQL['duplication']})",
    "fallback_chunks": """with w as (select doc_id::varchar id, text, unnest(range(0, case when length(text) <= 800 then 1 else ceil((length(text) - 800) / 650)::bigint + 1 end)) no from documents where text <> ''), x as (select *, text[no * 650 + 1:no * 650 + 800] c, length(text[1:no * 650]) - length(replace(text[1:no * 650], chr(10), '')) + 1 first from w)
 select id, no, first start_line, first + length(c) - length(replace(c, chr(10), '')) end_line, md5(c) digest from x""",
    "indexed_files": f"select id from repository_files where path is not null and lower(coalesce(extension, '')) in ({', '.join(quoted(e) for e in C.CODE_ENDINGS)}) and regexp_extract(lower(path), '([^/]*)$', 1) not in ('package-lock.json', 'yarn.lock', 'pnpm-lock.yaml', 'poetry.lock') and not contains(regexp_extract(lower(path), '([^/]*)$', 1), '.min.') and not contains(regexp_extract(lower(path), '([^/]*)$', 1), '-min.')",
    "declared_lines": f"""with {_LINES_OF_CODE}, d as ({_DECLARED('.c', [('struct', r'\bstruct\s+(\w+)\s*\{', 1), ('macro', r'^\s*#\s*define\s+(\w+)\b', 1), ('function', r'^[A-Za-z_]\w*(?:\s+[A-Za-z_]\w*)*\s+(\w+)\s*\(([^)]*)\)\s*\{', 1)], "['if', 'for', 'while', 'switch', 'catch']")}
 union all {_DECLARED('.cs', [('namespace', r'\bnamespace\s+([\w.]+)', 1), ('class', r'\bclass\s+(\w+)\b', 1), ('interface', r'\binterface\s+(\w+)\b', 1), ('enum', r'\benum\s+(\w+)\b', 1), ('method', r'\b(?:public|protected|private|internal|static|virtual|override|async|final)*\s*(?:[\w<>\[\]]+\s+)?(\w+)\s*\(([^)]*)\)\s*\{', 1)], "['if', 'for', 'while', 'switch', 'catch', 'using']")}
 union all {_DECLARED('.go', [('struct', r'\btype\s+(\w+)\s+struct\b', 1), ('interface', r'\btype\s+(\w+)\s+interface\b', 1), ('method', r'\bfunc\s*\(([^)]+)\)\s*(\w+)\s*\(([^)]*)\)', 2), ('function', r'\bfunc\s+(\w+)\s*\(([^)]*)\)', 1)], "['']")})
 select id, line, kind, name from d where kind is not null and not (kind in ('function', 'method') and list_contains(skip, name))""",
    "dependency_lines_of_code": rf"""with {_LINES_OF_CODE} select id, line_number::int as line, 'include' as type, regexp_extract(line, '^\s*#\s*include\s+["<]([^">]+)[">]', 1) target from l where e = '.c' and regexp_matches(line, '^\s*#\s*include\s+["<]([^">]+)[">]')
 union all select id, line_number::int, 'import', regexp_extract(line, '^\s*using\s+([\w.]+)\s*;', 1) from l where e = '.cs' and regexp_matches(line, '^\s*using\s+([\w.]+)\s*;')
 union all select id, line_number::int, 'package', regexp_extract(line, '^\s*package\s+([\w.]+)\s*;', 1) from l where e = '.java' and regexp_matches(line, '^\s*package\s+([\w.]+)\s*;')
 union all select id, line_number::int, 'import', regexp_extract(line, '^\s*import\s+(?:static\s+)?([\w.*]+)\s*;', 1) from l where e = '.java' and regexp_matches(line, '^\s*import\s+(?:static\s+)?([\w.*]+)\s*;')""",
    "folders": "with p as (select repository_id, string_split(regexp_replace(path, '/?[^/]*$', ''), '/') a from repository_files where contains(path, '/')), f as (select distinct repository_id, unnest(list_transform(range(1, len(a) + 1), lambda i: array_to_string(a[1:i], '/'))) folder from p) select repository_id, count(*) n_folders from f group by 1",
    "manifest_packages": "with r as (select id, ascii(right(id, 1)) % 3 k from repositories where id is not null) select id || '/requirements.txt' id, unnest(['fastapi', 'pandas']) package, unnest([k || '.1', 'latest']) as version from r union all select id || '/package.json', unnest(['react', 'left']), unnest(['1.' || k, '3']) from r",
    "stacks": "select distinct id repository_id, 'FastAPI,React' frameworks, 'npm' package_manager from repositories where id is not null",
    "routed_evidence": f"""with q as (select m.id, s.repository_id, {INTENT_SQL} intent from (select distinct on (id) * from chat_messages where content is not null and session_id is not null and lower(trim(role)) in ('user', 'human')) m join (select distinct on (id) * from chat_sessions where repository_id is not null) s on s.id = m.session_id),
 c as {_ONE_CHUNK}, rm as (select repository_id, min(chunk_id) chunk_id, min_by(content, chunk_id) as content from c where lower(file_path) = 'readme.md' group by 1), t as (select *, row_number() over (partition by repository_id order by length(content) desc, chunk_id) r from c),
 u as (select id, 0 stage, 1 place, repository_id chunk_id, 1.0::double similarity, 'Repository ' || repository_id as content from q where intent in ('GENERAL_OVERVIEW', 'TECH_STACK', 'ARCHITECTURE') union all select q.id, 0, 2, rm.chunk_id, 1.0, rm.content from q join rm using (repository_id) where intent in ('GENERAL_OVERVIEW', 'TECH_STACK', 'ARCHITECTURE')
  union all select q.id, 1, r, t.chunk_id, 0.9, t.content from q join t using (repository_id) where r <= case when intent = 'CODE_SEMANTIC' then 4 else 2 end)
 select id, stage, place, chunk_id, similarity from (select *, row_number() over (partition by id, content order by stage, place) n from u) where n = 1""",
    "readme_sections": r"""with s as (select doc_id, string_split(text, chr(10) || '#') a from documents where text is not null and regexp_replace(lower(trim(source)), '[\s-]+', '_', 'g') = 'readme'), h as (select doc_id, unnest(a) h, unnest(range(0, len(a))) section from s)
 select doc_id, section, md5(regexp_replace(case when section > 0 then '#' else '' end || h, '^\s+|\s+$', '', 'g')) digest from h where trim(regexp_replace(h, '\s', ' ', 'g')) <> ''""",
    "best_chunks": "select repository_id, id, place from (select repository_id, id, row_number() over (partition by repository_id order by length(coalesce(content, '')) desc, id) place from (select distinct on (chunk_id) * from repository_embeddings order by chunk_id, id) where repository_id is not null) where place <= 20",
    "fine_grades": "select id, case when health_score is null then null when health_score >= 97 then 'A+' when health_score >= 93 then 'A' when health_score >= 90 then 'A-' when health_score >= 87 then 'B+' when health_score >= 83 then 'B' when health_score >= 80 then 'B-' when health_score >= 75 then 'C+' when health_score >= 70 then 'C' when health_score >= 60 then 'D' else 'F' end grade from repositories",
    "graph_scores": f"""with {GRAPH_SQL}{FOURS_SQL}, v as (select e.repository_id, count(*) bad from e join one a on a.repository_id = e.repository_id and a.path = e.src join one b on b.repository_id = e.repository_id and b.path = e.dst where a.module_type = 'Configuration' and b.module_type in ('Controller', 'Service', 'Repository', 'API') group by 1),
 u as (select repository_id, avg((module_type = 'Unknown')::int) unknown_share from one group by 1), h as (select repository_id, sum((coupling > 3)::int) coupled from c group by 1), y as (select repository_id, count(*) cycles from k group by 1)
 select repository_id, greatest(0, least(100, round_even(100 - 15 * coalesce(cycles, 0) - 5 * coalesce(coupled, 0) - 10 * coalesce(bad, 0) - 20 * unknown_share, 0)))::int score from u left join h using (repository_id) left join y using (repository_id) left join v using (repository_id)""",
    "files_and_count": "select repository_id, id, r, total from (select repository_id, id, row_number() over (partition by repository_id order by path, id) r, count(*) over (partition by repository_id) total from repository_files where path is not null) where r <= 10",
}
