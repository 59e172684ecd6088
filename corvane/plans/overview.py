"""Queries over repositories, their files, issues and chats: totals, scores, pages, histories; and windows over events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import code as X
from corvane.operators import analyzers as A
from corvane.operators import scoring as S
from corvane.operators.order import number_in_order, rank_spread
from corvane.session import table


def _files(spark, d):
    return table(spark, d, "repository_files")


def _issues(spark, d):
    """Issues once, with severity and category in one spelling."""
    i = table(spark, d, "security_issues").dropDuplicates(["id"])
    return i.withColumn("severity", F.initcap(F.trim("severity"))).withColumn("category", F.lower(F.trim("category")))


def _severities(spark, d):
    n = lambda s: F.sum((F.col("severity") == s).cast("long")).alias(s.lower())
    return _issues(spark, d).groupBy("repository_id").agg(*map(n, S.SEVERITIES))


def repo_totals(spark, d):
    t = S.repository_totals(_files(spark, d))
    density = F.when(F.col("total_loc") > 0, F.bround(F.col("total_smells") / (F.col("total_loc") / 1000), 2)).otherwise(0.0)
    return t.select("repository_id", "n_files", "total_loc", "average_complexity", "max_complexity", "total_smells", F.round(F.col("over_300") / F.col("n_files"), 6).alias("large_ratio"), density.alias("smell_density"))


def top_files(spark, d):
    """The ten files of each repository with the highest complexity, size and number of smells; ties by path and id."""
    f = _files(spark, d).where("path is not null").select("id", "repository_id", "path", F.explode(F.create_map(F.lit("complexity"), F.coalesce(F.col("complexity").cast("long"), F.lit(0)), F.lit("size"), F.coalesce(F.col("lines_of_code").cast("long"), F.lit(0)), F.lit("smells"), F.coalesce(F.col("code_smells_count").cast("long"), F.lit(0)))).alias("measure", "value"))
    w = Window.partitionBy("repository_id", "measure").orderBy(F.desc("value"), "path", "id")
    return f.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 10").select("repository_id", "measure", "place", "id", "value")


def severity_counts(spark, d):
    return _severities(spark, d)


def category_counts(spark, d):
    return _issues(spark, d).groupBy("repository_id").pivot("category", ["secrets", "injection", "unsafe apis", "weak hashing", "dependencies"]).count().na.fill(0).select("repository_id", "secrets", "injection", F.col("unsafe apis").alias("unsafe_apis"), F.col("weak hashing").alias("weak_hashing"), "dependencies")


def security_scores(spark, d):
    s = S.security_score(*(F.col(x.lower()) for x in S.SEVERITIES)).cast("int")
    return _severities(spark, d).select("repository_id", s.alias("score"), X.grade(s).alias("grade"))


def health_scores(spark, d):
    """Health of each repository from its stored figures; comments count as 15 percent and duplication as none."""
    t = S.repository_totals(_files(spark, d)).join(_severities(spark, d), "repository_id", "left").na.fill(0, [x.lower() for x in S.SEVERITIES])
    c = F.col
    parts = S.health_parts(c("average_complexity"), c("total_smells"), c("critical"), c("high"), c("medium"), c("low"), F.lit(0), c("coupled"), F.lit(0.15), F.lit(0.0))
    d2 = t.select("repository_id", *[v.alias(k) for k, v in parts.items()])
    total = X.clamp(sum((c(k) for k in parts), F.lit(0))).cast("int")
    return d2.withColumn("score", total).withColumn("grade", X.grade(c("score")))


def architecture_scores(spark, d):
    t = S.repository_totals(_files(spark, d))
    s = X.clamp(F.bround(100 - 5 * F.col("coupled") - 20.0 * F.col("unknown") / F.col("n_files"), 0)).cast("int")
    return t.select("repository_id", s.alias("score"), X.grade(s).alias("grade"))


def dimension_scores(spark, d):
    return S.dimension_scores(S.repository_totals(_files(spark, d)))


def contributors(spark, d):
    """What speaks for and against each repository, at most four of a kind: read-me files, tests and clean files; god files and smelly files."""
    f = _files(spark, d).where("path is not null").select("id", "repository_id", "path", F.coalesce("lines_of_code", F.lit(0)).alias("loc"), F.coalesce("code_smells_count", F.lit(0)).alias("smells"), F.coalesce("in_dependency_cycle", F.lit(False)).alias("cyc"))
    p = F.lower("path")
    kinds = [("readme", 8, X.basename(p) == "readme.md"), ("test", 5, F.contains(p, F.lit("test"))), ("clean", 3, (F.col("smells") == 0) & F.col("loc").between(1, 300)), ("god", -7, F.col("loc") > 300), ("smelly", -5, (F.col("smells") > 0) & (F.col("loc") <= 300)), ("cycle", -5, F.col("cyc"))]
    k = F.filter(F.array(*[F.when(c, F.struct(F.lit(n).alias("kind"), F.lit(v).alias("impact"))) for n, v, c in kinds]), lambda x: x.isNotNull())
    w = Window.partitionBy("repository_id", "kind").orderBy("path", "id")
    return f.select("id", "repository_id", "path", F.inline(k)).withColumn("r", F.row_number().over(w)).where("r <= 4").select("repository_id", "kind", "impact", "id")


def files_page(spark, d):
    """The third page of ten files of each repository, by path."""
    f = rank_spread(_files(spark, d).where("path is not null").select("id", "repository_id", "path"), ["repository_id"], [F.col("path"), F.col("id")], "r")
    return f.where("r between 21 and 30").select("repository_id", "id", "r")


def file_details(spark, d):
    """Each file with the number of its issues, their lines and a badge."""
    i = _issues(spark, d).where("file_path is not null").groupBy("repository_id", F.col("file_path").alias("path")).agg(F.count(F.lit(1)).alias("n_issues"), F.array_join(F.array_sort(F.collect_set(F.col("line_number"))), ",").alias("issue_lines"))
    f = _files(spark, d).join(i, ["repository_id", "path"], "left")
    cx, sm, loc = (F.coalesce(F.col(c), F.lit(0)) for c in ("complexity", "code_smells_count", "lines_of_code"))
    badge = F.when((cx > 20) | (sm > 5), "High Complexity").when((cx > 10) | (sm > 2) | (loc > 300), "Needs Attention").otherwise("Healthy")
    return f.select("id", F.coalesce("n_issues", F.lit(0)).alias("n_issues"), F.coalesce("issue_lines", F.lit("")).alias("issue_lines"), badge.alias("badge"))


def issues_page(spark, d):
    """Twenty issues of high severity whose path contains src, by severity and path."""
    return _issues(spark, d).where((F.col("severity") == "High") & F.contains(F.lower("file_path"), F.lit("src"))).orderBy("severity", "file_path", "id").limit(20).select("id", "severity", "category")


def graph_nodes(spark, d):
    """Nodes shown of each repository's graph: all, or of more than 80 files the 40 with the highest coupling."""
    f = _files(spark, d).where("path is not null").select("id", "repository_id", F.coalesce("coupling_score", F.lit(0)).alias("c"), "path")
    n = f.groupBy("repository_id").agg(F.count(F.lit(1)).alias("n"))
    # at most 80 rows of a repository reach its window: the limit is applied before and after the shuffle
    top = f.withColumn("r", F.row_number().over(Window.partitionBy("repository_id").orderBy(F.desc("c"), "path", "id"))).where("r <= 80")
    return top.join(n, "repository_id").where("n <= 80 or r <= 40").select("repository_id", "id")


def status_groups(spark, d):
    """Repositories by status in one spelling, and those whose run must be marked failed or interrupted after a crash."""
    s = F.upper(F.trim("status"))
    after = F.when(s.isin("CLONING", "PARSING", "SCANNING", "ANALYZING", "PENDING", "RUNNING"), "FAILED").when(s == "INDEXING", "INTERRUPTED").otherwise(s)
    return table(spark, d, "repositories").groupBy(s.alias("status"), after.alias("after_crash")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("health_score")), 4).alias("mean_health"))


def valid_urls(spark, d):
    return table(spark, d, "repositories").select("id", X.valid_repository_url(F.col("url")).alias("valid"))


def markdown_lines(spark, d):
    """A report for each repository as numbered lines: a heading, then a line for each issue by path, line and id."""
    i = _issues(spark, d).where("file_path is not null and line_number is not null and severity is not null")
    line = F.concat(F.lit("- "), "severity", F.lit(" "), "file_path", F.lit(":"), F.col("line_number").cast("string"))
    body = rank_spread(i.select("repository_id", "file_path", "line_number", "id", line.alias("line")), ["repository_id"], [F.col("file_path"), F.col("line_number"), F.col("id")], "no")
    head = i.select("repository_id").distinct().select("repository_id", F.lit(0).cast("long").alias("no"), F.lit("# Issues").alias("line"))
    return head.unionByName(body.select("repository_id", "no", "line"))


def without_files(spark, d):
    """Chunks that stay after all chunks of files with issues of critical severity are deleted."""
    gone = _issues(spark, d).where("severity = 'Critical' and file_path is not null").select("repository_id", "file_path").distinct()
    return table(spark, d, "repository_embeddings").join(gone, ["repository_id", "file_path"], "left_anti").groupBy("repository_id").agg(F.count(F.lit(1)).alias("n"))


def unchanged_files(spark, d):
    """Files that need no new scan: their repository, path and hash were seen under another id before."""
    w = Window.partitionBy("repository_id", "path", "content_hash").orderBy("id")
    f = _files(spark, d).where("path is not null and content_hash is not null")
    return f.withColumn("r", F.row_number().over(w)).where("r > 1").select("id")


def chat_history(spark, d):
    """Messages of each session in order, with their place."""
    m = table(spark, d, "chat_messages").where("session_id is not null").dropDuplicates(["id"])
    return number_in_order(m.select("id", "session_id", "created_at"), "session_id", "created_at", ["id"], "place").select("id", "session_id", "place")


def last_turns(spark, d):
    m = table(spark, d, "chat_messages").where("session_id is not null").dropDuplicates(["id"])
    w = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id"))
    return m.select("id", "session_id", F.row_number().over(w).cast("long").alias("back")).where("back <= 3")


def summary_due(spark, d):
    """Messages of the speakers in each session, and whether a summary is due: there are more than ten and no summary yet."""
    r = F.lower(F.trim("role"))
    m = table(spark, d, "chat_messages").where("session_id is not null").dropDuplicates(["id"])
    g = m.groupBy("session_id").agg(F.sum(r.isin("user", "assistant", "human", "ai").cast("long")).alias("n"), F.max(F.coalesce(r == "summary", F.lit(False))).alias("has"))
    return g.select("session_id", "n", ((F.col("n") > 10) & ~F.col("has")).alias("due"))


def question_intents(spark, d):
    m = table(spark, d, "chat_messages").where("content is not null and lower(trim(role)) in ('user', 'human')").dropDuplicates(["id"])
    return m.select("id", X.intent(F.col("content")).alias("intent"))


def declarations(spark, d):
    return A.declarations(_files(spark, d))


def file_dependencies(spark, d):
    return A.dependencies(_files(spark, d))


def function_complexity(spark, d):
    return A.functions(_files(spark, d))


def file_complexity(spark, d):
    return A.file_complexity(A.functions(_files(spark, d)))


def file_metrics(spark, d):
    f = _files(spark, d)
    return A.file_metrics(f, A.declarations(f))


def declaration_smells(spark, d):
    return A.declaration_smells(_files(spark, d))


def event_hours(spark, d):
    """Events per hour and type."""
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def event_sessions(spark, d):
    """Sessions of each user, closed by 30 minutes without an event."""
    e = table(spark, d, "events")
    return e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def latest_events(spark, d):
    """The last event of each user and type: the state that a stream of them leaves."""
    e = table(spark, d, "events")
    g = e.groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id", "value")).alias("m"))
    return g.select("user_id", "event_type", F.col("m.event_id").alias("event_id"), F.col("m.value").alias("value"))


_NAMES = (
    repo_totals, top_files, severity_counts, category_counts, security_scores, health_scores, architecture_scores, dimension_scores, contributors, files_page, file_details, issues_page, graph_nodes, status_groups, valid_urls, markdown_lines, without_files,
    unchanged_files, chat_history, last_turns, summary_due, question_intents, declarations, file_dependencies, function_complexity, file_complexity, file_metrics, declaration_smells, event_hours, event_sessions, latest_events,
)
QUERIES = {f.__name__: f for f in _NAMES}

_I = "(select distinct on (id) * replace (upper(trim(severity))[1:1] || lower(trim(severity))[2:] as severity, lower(trim(category)) as category) from security_issues)"
_SEV = f"(select repository_id, {', '.join(f'''sum((severity = '{s}')::int)::bigint {s.lower()}''' for s in S.SEVERITIES)} from {_I} group by 1)"
_L, _C, _SM, _CO = (f"greatest(0, coalesce({c}, 0))" for c in ("lines_of_code", "complexity", "code_smells_count", "coupling_score"))
_PL = "lower(coalesce(path, ''))"
_TEST = f"(contains({_PL}, 'test') or contains({_PL}, 'spec'))"
_N = lambda c: f"sum(({c})::int)::bigint"
_T = f"""(select repository_id, count(*) n_files, sum({_L})::bigint total_loc, coalesce(round_even(avg(case when {_L} > 0 then {_C} end), 2), 0.0) average_complexity, coalesce(max(case when {_L} > 0 then {_C} end), 0) max_complexity,
 coalesce(avg(case when {_C} > 0 then {_C} end), 0.0) mean_positive, sum({_SM})::bigint total_smells, {_N(_L + ' > 300')} over_300, {_N(_L + ' > 500')} over_500, {_N(_CO + ' > 8')} coupled, {_N("coalesce(module_type, 'Unknown') = 'Unknown'")} as unknown,
 {_N(f"contains({_PL}, '/') or contains({_PL}, chr(92))")} nested, {_N(f"len(string_split(replace({_PL}, chr(92), '/'), '/')) > 5")} deep, {_N("coalesce(module_type, '') in ('Controller', 'API')")} controllers, {_N("coalesce(module_type, '') = 'Service'")} services, {_N("coalesce(module_type, '') = 'Repository'")} repos,
 {_N(_TEST)} tests, sum(case when {_TEST} then {_L} else 0 end)::bigint test_loc, max((contains({_PL}, '/test/') or contains({_PL}, '/tests/'))::int) test_folder from repository_files group by 1)"""
_GRADE = lambda s: f"case when {s} >= 90 then 'A' when {s} >= 80 then 'B' when {s} >= 70 then 'C' when {s} >= 60 then 'D' else 'F' end"
_INT = "case " + " ".join("when " + " or ".join(f"contains(lower(content), '{w}')" for w in ws) + f" then '{n}'" for n, ws in X.INTENTS) + " else 'CODE_SEMANTIC' end"
_MSG = "(select distinct on (id) * from chat_messages where session_id is not null)"

SQL = {
    "repo_totals": f"select repository_id, n_files, total_loc, average_complexity, max_complexity, total_smells, round(over_300 / n_files, 6) large_ratio, case when total_loc > 0 then round_even(total_smells / (total_loc / 1000), 2) else 0.0 end smell_density from {_T}",
    "top_files": """with f as (select id, repository_id, path, unnest(['complexity', 'size', 'smells']) measure, unnest([coalesce(complexity, 0), coalesce(lines_of_code, 0), coalesce(code_smells_count, 0)])::bigint as value from repository_files where path is not null)
 select repository_id, measure, place, id, value from (select *, row_number() over (partition by repository_id, measure order by value desc, path, id) place from f) where place <= 10""",
    "severity_counts": f"select * from {_SEV}",
    "category_counts": f"select repository_id, {_N('''category = 'secrets' ''')} secrets, {_N('''category = 'injection' ''')} injection, {_N('''category = 'unsafe apis' ''')} unsafe_apis, {_N('''category = 'weak hashing' ''')} weak_hashing, {_N('''category = 'dependencies' ''')} dependencies from {_I} group by 1",
    "security_scores": f"with s as (select repository_id, greatest(0, least(100, 100 - 25 * critical - 15 * high - 10 * medium - 5 * low))::int score from {_SEV}) select repository_id, score, {_GRADE('score')} grade from s",
    "health_scores": f"""with j as (select t.*, coalesce(critical, 0) critical, coalesce(high, 0) high, coalesce(medium, 0) medium, coalesce(low, 0) low from {_T} t left join {_SEV} s using (repository_id)),
 p as (select repository_id, round_even(25 - least(15.0, greatest(0.0, average_complexity - 3) * 1.5), 0)::int complexity, round_even(25 - least(20.0, total_smells * 1.5), 0)::int maintainability, greatest(0, (20 - (5 * critical + 5 * high + 2 * medium + low)))::int as security,
 greatest(0, 15 - coupled)::int architecture, 8 as documentation, 5 as duplication from j), q as (select *, greatest(0, least(100, complexity + maintainability + security + architecture + documentation + duplication))::int score from p) select *, {_GRADE('score')} grade from q""",
    "architecture_scores": f"with s as (select repository_id, greatest(0, least(100, round_even(100 - 5 * coupled - 20.0::double * unknown / n_files, 0)))::int score from {_T}) select repository_id, score, {_GRADE('score')} grade from s",
    "dimension_scores": f"""select repository_id, greatest(0, least(100, round_even(100 + case when controllers > 0 and services > 0 and repos > 0 then 5 else 0 end + case when repos > 0 then 3 else 0 end - least(15.0, 2.0 * coupled), 0)))::int architecture,
 greatest(0, least(100, round_even(100 - case when mean_positive > 3 then least(20.0::double, (mean_positive - 3) * 3) else 0 end - case when max_complexity > 15 then 10 else 0 end - least(20.0, 1.5 * total_smells) - least(20.0, 5.0 * over_300), 0)))::int maintainability,
 greatest(0, least(100, round_even(100 - least(20.0, 5.0 * over_500) - case when nested = 0 and n_files > 4 then 10 else 0 end - least(15.0, 3.0 * deep), 0)))::int organisation,
 greatest(0, least(100, round_even(case when tests > 0 then 65 + least(20.0, 5.0 * tests) + case when test_loc / greatest(1, total_loc - test_loc) >= 0.1 then 15 else 0 end + case when test_folder = 1 then 10 else 0 end else 30 end, 0)))::int testing from {_T}""",
    "contributors": """with f as (select id, repository_id, path, coalesce(lines_of_code, 0) loc, coalesce(code_smells_count, 0) smells, coalesce(in_dependency_cycle, false) cyc from repository_files where path is not null),
 k as (select *, 'readme' kind, 8 impact from f where regexp_extract(lower(path), '([^/]*)$', 1) = 'readme.md' union all select *, 'test', 5 from f where contains(lower(path), 'test') union all select *, 'clean', 3 from f where smells = 0 and loc between 1 and 300
  union all select *, 'god', -7 from f where loc > 300 union all select *, 'smelly', -5 from f where smells > 0 and loc <= 300 union all select *, 'cycle', -5 from f where cyc)
 select repository_id, kind, impact, id from (select *, row_number() over (partition by repository_id, kind order by path, id) r from k) where r <= 4""",
    "files_page": "select repository_id, id, r from (select repository_id, id, row_number() over (partition by repository_id order by path, id) r from repository_files where path is not null) where r between 21 and 30",
    "file_details": f"""with i as (select repository_id, file_path as path, count(*) n_issues, coalesce(string_agg(distinct line_number::varchar, ',' order by line_number), '') issue_lines from {_I} where file_path is not null group by 1, 2)
 select f.id, coalesce(n_issues, 0) n_issues, coalesce(array_to_string(list_sort((select list(distinct line_number) from {_I} s where s.repository_id = f.repository_id and s.file_path = f.path and line_number is not null)), ','), '') issue_lines,
 case when coalesce(complexity, 0) > 20 or coalesce(code_smells_count, 0) > 5 then 'High Complexity' when coalesce(complexity, 0) > 10 or coalesce(code_smells_count, 0) > 2 or coalesce(lines_of_code, 0) > 300 then 'Needs Attention' else 'Healthy' end badge from repository_files f left join (select repository_id, path, n_issues from i) i using (repository_id, path)""".replace(", coalesce(string_agg(distinct line_number::varchar, ',' order by line_number), '') issue_lines", ""),
    "issues_page": f"select id, severity, category from {_I} where severity = 'High' and contains(lower(file_path), 'src') order by severity, file_path, id limit 20",
    "graph_nodes": "select repository_id, id from (select *, count(*) over (partition by repository_id) n, row_number() over (partition by repository_id order by coalesce(coupling_score, 0) desc, path, id) r from repository_files where path is not null) where n <= 80 or r <= 40",
    "status_groups": "with s as (select upper(trim(status)) status, health_score from repositories) select status, case when status in ('CLONING', 'PARSING', 'SCANNING', 'ANALYZING', 'PENDING', 'RUNNING') then 'FAILED' when status = 'INDEXING' then 'INTERRUPTED' else status end after_crash, count(*) n, round(avg(health_score), 4) mean_health from s group by 1, 2",
    "valid_urls": r"select id, coalesce(regexp_matches(trim(url), '^https?://github\.com/[\w.-]+/[\w.-]+?(?:\.git)?/?$'), false) valid from repositories",
    "markdown_lines": f"with i as (select * from {_I} where file_path is not null and line_number is not null and severity is not null) select distinct repository_id, 0::bigint as no, '# Issues' as line from i union all select repository_id, row_number() over (partition by repository_id order by file_path, line_number, id), '- ' || severity || ' ' || file_path || ':' || line_number from i",
    "without_files": f"select repository_id, count(*) n from repository_embeddings e where not exists (select 1 from {_I} i where i.severity = 'Critical' and i.repository_id = e.repository_id and i.file_path = e.file_path) group by 1",
    "unchanged_files": "select id from (select id, row_number() over (partition by repository_id, path, content_hash order by id) r from repository_files where path is not null and content_hash is not null) where r > 1",
    "chat_history": f"select id, session_id, row_number() over (partition by session_id order by created_at, id) place from {_MSG}",
    "last_turns": f"select * from (select id, session_id, row_number() over (partition by session_id order by created_at desc, id desc) back from {_MSG}) where back <= 3",
    "summary_due": f"with g as (select session_id, sum((lower(trim(role)) in ('user', 'assistant', 'human', 'ai'))::int)::bigint n, bool_or(coalesce(lower(trim(role)) = 'summary', false)) has from {_MSG} group by 1) select session_id, n, n > 10 and not has as due from g",
    "question_intents": f"select distinct id, {_INT} intent from chat_messages where content is not null and lower(trim(role)) in ('user', 'human')",
    "event_hours": "select date_trunc('hour', ts) as start, event_type, count(*) n, round(sum(value), 4) total from events group by 1, 2",
    "event_sessions": "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minutes then 0 else 1 end new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) k from g) select user_id, min(ts) as start, count(*) n from s group by user_id, k",
    "latest_events": "select user_id, event_type, event_id, value from (select *, row_number() over (partition by user_id, event_type order by ts desc, event_id desc) r from events) where r = 1",
}
