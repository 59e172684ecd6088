"""Queries over source files: census, languages, modules, lines, scanners, duplication."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvane.functions import code as X
from corvane.operators import lines as L
from corvane.operators import scanners as S
from corvane.operators.order import rank_spread
from corvane.plans.sql_parts import ANY_SPLIT, LINES, any_of, basename, quoted
from corvane.session import table


def _files(spark, d):
    return table(spark, d, "repository_files")


#: Lines that scanners look for, put below the text of each document as a file of this ending; fixed values.
PLANTED = [
    (".js", "load(function (a) {\nsave(() => {\nsend(function (c) {\nstop(() => {\n});\nget(x)\n.then(a)\n.then(b)\n.then(c)\n.then(d)\n.then(e);\nconst h = createHash('md5');\neval (x)"),
    (".rs", "match kind {\nA => 1,\nB => { 2 }\nC => match x {\nD => 3,\nE => 4,\n},\nF => 5,\nG => 6,\nH => 7,\nI => 8,\n_ => 9,\n}"),
    (".c", "goto out;\nstrcpy(a, b);\nsprintf (c, d);"),
    (".go", "_, err := open(name)\n_ = close(f)"),
    (".java", "try { run(); } catch (IOException e) { }"),
    (".py", "def add(item, seen=[]):\n    return hashlib.sha1(item)\npassword = 'swordfish-11'\ncur.execute(f'select {x}')\nsubprocess.run(cmd, shell=True)\nos.system(cmd)\nopen(base + name)"),
    (".php", "global $state;\n$GLOBALS['a'] = 1;"),
]


def _sources(spark, d):
    """Files, stored chunks, and documents with planted lines as source texts: id, repository_id, path, extension, content."""
    f = _files(spark, d).select("id", "repository_id", "path", "extension", "content")
    c = table(spark, d, "repository_embeddings").select("id", "repository_id", F.col("file_path").alias("path"), X.extension(F.col("file_path")).alias("extension"), "content")
    at = (F.col("doc_id") % len(PLANTED)).cast("int") + 1
    pick = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in PLANTED]), at)
    docs = table(spark, d, "documents").where("text is not null").select(F.concat(F.lit("doc-"), "doc_id").alias("id"), "repository_id", F.concat(F.lit("docs/"), "doc_id", pick(0)).alias("path"), pick(0).alias("extension"), F.concat("text", F.lit("\n"), pick(1)).alias("content"))
    return f.unionByName(c).unionByName(docs)


def text_census(spark, d):
    docs = table(spark, d, "documents").where(F.col("text").isNotNull())
    c = docs.select(X.F.regexp_replace(F.lower(F.trim("source")), r"[\s-]+", "_").alias("source"), L.n_lines(F.col("text")).alias("n"), L.n_filled(F.col("text")).alias("filled"))
    g = c.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("total_lines"), F.sum(F.col("n") - F.col("filled")).alias("blank_lines"), F.sum((F.col("n") > 300).cast("long")).alias("large_docs"))
    return g.withColumn("is_large", F.col("total_lines") > 5000)


def file_census(spark, d):
    f = _files(spark, d)
    g = f.groupBy("repository_id").agg(
        F.count(F.lit(1)).alias("total_files"), F.sum(F.when(F.col("is_text"), 1).otherwise(0)).alias("text_files"), F.sum(F.when(~F.col("is_text"), 1).otherwise(0)).alias("binary_files"),
        F.countDistinct(X.dirname(F.col("path"))).alias("n_folders"), F.sum(F.when(F.col("size_bytes") > 0, F.col("size_bytes")).otherwise(0)).alias("total_bytes"),
    )
    return g


def language_mix(spark, d):
    """Share of bytes per language of the mapped text files of each repository, in whole percent; shares of 0 are left out."""
    f = _files(spark, d).where("is_text and size_bytes > 0").select("repository_id", X.language(F.col("extension")).alias("language"), "size_bytes").where("language is not null")
    g = f.groupBy("repository_id", "language").agg(F.sum("size_bytes").alias("b"))
    p = g.withColumn("percent", F.bround(F.col("b") / F.sum("b").over(Window.partitionBy("repository_id")) * 100, 0).cast("int"))
    return p.where("percent > 0").select("repository_id", "language", "percent")


def module_types(spark, d):
    return _files(spark, d).select("id", X.module_type(F.col("path"), F.col("extension")).alias("module"))


def file_priority(spark, d):
    """Rank of files within their repository by priority and path."""
    p = _files(spark, d).where("path is not null").select("id", "repository_id", "path", X.priority(F.col("path")).alias("priority"))
    return rank_spread(p, ["repository_id"], [F.col("priority"), F.col("path"), F.col("id")], "place").select("id", "priority", "place")


def scanned_files(spark, d):
    """Files that a scan keeps: not in a generated folder, no lock file, no binary or style ending."""
    p = F.col("path")
    parts = F.split(X.dirname(p), "/")
    keep = ~F.arrays_overlap(parts, F.array(*map(F.lit, X.SKIP_FOLDERS))) & ~F.lower(X.basename(p)).isin(X.LOCK_FILES) & ~X.extension(p).isin(X.SKIP_ENDINGS)
    return _files(spark, d).where(p.isNotNull() & keep).select("id", X.extension(p).alias("ending"))


def content_hashes(spark, d):
    """SHA-256 of contents; files of 10 MiB or more get a fixed mark."""
    return _files(spark, d).where("content is not null").select("id", F.when(F.octet_length("content") < 10485760, F.sha2("content", 256)).otherwise("unknown_hash").alias("sha256"))


def line_counts(spark, d):
    return L.line_counts(_files(spark, d).where("content is not null")).select("id", "total_lines", "blank_lines", "comment_lines", "code_lines")


def security_scan(spark, d):
    return S.security_issues(_sources(spark, d))


def line_smells(spark, d):
    return S.line_smells(_sources(spark, d)).select("id", "line_number", "smell_type", "category", "severity", "matched")


def strict_scan(spark, d):
    """The stricter security rules over all sources."""
    return S.security_issues(_sources(spark, d), S.STRICT).select("id", "line_number", "severity", "category", "title")


def snippet_scan(spark, d):
    """Security rules over the snippets of reported issues, line by line."""
    i = table(spark, d, "security_issues").select("id", "repository_id", F.lit("snippet").alias("path"), F.col("snippet").alias("content")).distinct()
    return S.security_issues(i).select("id", "line_number", "severity", "category", "title", "evidence")


def magic_numbers(spark, d):
    return S.magic_numbers(_sources(spark, d))


def callback_hell(spark, d):
    return S.callback_hell(_sources(spark, d)).select("id", "line_number", "measured_value")


def promise_chains(spark, d):
    return S.promise_chains(_sources(spark, d)).select("id", "line_number", "measured_value")


def large_matches(spark, d):
    return S.large_matches(_sources(spark, d)).select("id", "line_number", "measured_value")


def duplication(spark, d):
    return L.duplicated_lines(_files(spark, d), "repository_id", "id", "content")


def dependency_lines(spark, d):
    """Requirement lines (name==version) and other lines that look like one in the security table's snippets: package and version."""
    s = table(spark, d, "security_issues").where("lower(trim(category)) = 'dependencies' and snippet is not null").select("id", F.trim(F.regexp_replace("snippet", r"\s", " ")).alias("s")).distinct()
    parts = F.split("s", "==")
    return s.where(F.contains("s", F.lit("==")) & ~F.startswith("s", F.lit("#"))).select("id", parts[0].alias("package"), F.coalesce(parts[1], F.lit("latest")).alias("version"))


QUERIES = {
    "text_census": text_census, "file_census": file_census, "language_mix": language_mix, "module_types": module_types, "file_priority": file_priority, "scanned_files": scanned_files, "content_hashes": content_hashes,
    "line_counts": line_counts, "security_scan": security_scan, "strict_scan": strict_scan, "snippet_scan": snippet_scan, "line_smells": line_smells, "magic_numbers": magic_numbers, "callback_hell": callback_hell, "promise_chains": promise_chains, "large_matches": large_matches,
    "duplication": duplication, "dependency_lines": dependency_lines,
}

_LANG = "case lower(extension) " + " ".join(f"when '{k}' then '{v}'" for k, v in X.LANGUAGES.items()) + " end"
_P, _B = "lower(replace(path, chr(92), '/'))", basename("lower(replace(path, chr(92), '/'))")
_MODULE = (
    f"case when lower(coalesce(extension, '')) in ('.ts', '.tsx', '.js', '.jsx') and starts_with({_B}, 'use') then 'Hook' when lower(coalesce(extension, '')) in ('.ts', '.tsx', '.js', '.jsx') and (lower(coalesce(extension, '')) in ('.tsx', '.jsx') or {any_of(_P, ['/components/', '/views/'])}) then 'Component' "
    + " ".join(f"when {any_of(_P, dirs)} or {any_of(_B, names)}{' or starts_with(' + _B + ', ' + chr(39) + '.env' + chr(39) + ')' if kind == 'Configuration' else ''} then '{kind}'" for kind, dirs, names in X.MODULES)
    + " else 'Unknown' end"
)
_LB = basename("lower(path)")
_PRIORITY = f"case when {_LB} = 'readme.md' then 0 when {_LB} in ('package.json', 'pom.xml', 'requirements.txt', 'go.mod', 'cargo.toml', 'gemfile') then 1 when {any_of('lower(path)', ['src/', 'app/'])} then 2 when contains(lower(path), 'services/') then 3 when {any_of('lower(path)', ['controllers/', 'routes/'])} then 4 when contains(lower(path), 'models/') then 5 when contains(lower(path), 'test') then 8 when contains(lower(path), 'docs/') then 9 else 6 end"
_EXT = "lower(regexp_extract(" + basename("path") + r", '^.+?(\.[^.]*)$', 1))"
_FILLED = r"len(list_filter(string_split({0}, chr(10)), lambda x: trim(regexp_replace(x, '\s', ' ', 'g')) <> ''))"
_STRIPPED = r"regexp_replace(regexp_replace(content, '(?s)/\*.*?\*/', '', 'g'), '//[^\n]*', '', 'g')"
_RULES = " union all ".join(f"select {i} rule_no, {quoted(r.name)} title, {quoted(r.category)} category, {quoted(r.severity)} severity, {quoted(r.pattern)} pattern" for i, r in enumerate(S.SECURITY))


def _rule_hits(rules, source: str, ext: bool) -> str:
    """One select for each rule: patterns must be constants."""
    cond = lambda r: f" and lower(extension) in ({', '.join(quoted(e) for e in r.extensions)})" if ext and r.extensions else ""
    return " union all ".join(f"select *, {quoted(r.name)} title, {quoted(r.category)} category, {quoted(r.severity)} severity, regexp_extract(line, {quoted(r.pattern)}, 0) matched from {source} where regexp_matches(line, {quoted(r.pattern)}){cond(r)}" for r in rules)


_PICK = lambda k: "[" + ", ".join(quoted(x[k]) for x in PLANTED) + f"][doc_id % {len(PLANTED)} + 1]"
_SRC = f"(select id, repository_id, path, extension, content from repository_files union all select id, repository_id, file_path, {_EXT.replace('path', 'file_path')}, content from repository_embeddings union all select 'doc-' || doc_id, repository_id, 'docs/' || doc_id || {_PICK(0)}, {_PICK(0)}, text || chr(10) || {_PICK(1)} from documents where text is not null)"
_SCRIPT_LINES = LINES.format(keep="id").replace("repository_files", _SRC) + " and lower(extension) in ('.js', '.jsx', '.ts', '.tsx')"
_ANY = ANY_SPLIT.format("content")
_NORMAL = r"list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(regexp_replace(x, '^\s+|\s+$', '', 'g'))), lambda x: x <> '' and not regexp_matches(x, '^(?:#|//|/\*|\*)'))"

SQL = {
    "text_census": f"""with c as (select regexp_replace(lower(trim(source)), '[\\s-]+', '_', 'g') as source, length(text) - length(replace(text, chr(10), '')) + 1 as n, {_FILLED.format('text')} filled from documents where text is not null)
 select source, count(*) n_docs, sum(n)::bigint total_lines, sum(n - filled)::bigint blank_lines, sum((n > 300)::int)::bigint large_docs, sum(n) > 5000 is_large from c group by 1""",
    "file_census": r"""select repository_id, count(*) total_files, sum(case when is_text then 1 else 0 end)::bigint text_files, sum(case when not is_text then 1 else 0 end)::bigint binary_files,
 count(distinct regexp_replace(path, '/?[^/]*$', '')) n_folders, sum(case when size_bytes > 0 then size_bytes else 0 end)::bigint total_bytes from repository_files group by 1""",
    "language_mix": f"""with g as (select repository_id, {_LANG} as language, sum(size_bytes) b from repository_files where is_text and size_bytes > 0 group by 1, 2),
 p as (select repository_id, language, round_even(b / sum(b) over (partition by repository_id) * 100, 0)::int percent from g where language is not null) select * from p where percent > 0""",
    "module_types": f"select id, {_MODULE} as module from repository_files",
    "file_priority": f"select id, {_PRIORITY} as priority, row_number() over (partition by repository_id order by {_PRIORITY}, path, id) place from repository_files where path is not null",
    "scanned_files": f"select id, {_EXT} ending from repository_files where path is not null and not list_has_any(string_split(regexp_replace(path, '/?[^/]*$', ''), '/'), [{', '.join(quoted(x) for x in X.SKIP_FOLDERS)}]) and {basename('lower(path)')} not in ({', '.join(quoted(x) for x in X.LOCK_FILES)}) and {_EXT} not in ({', '.join(quoted(x) for x in X.SKIP_ENDINGS)})",
    "content_hashes": "select id, case when strlen(content) < 10485760 then sha256(content) else 'unknown_hash' end as sha256 from repository_files where content is not null",
    "line_counts": rf"""with f as (select id, lower(coalesce(extension, '')) e, content, length(content) - length(replace(content, chr(10), '')) + 1 as total_lines, {_FILLED.format('content')} as filled,
 {_FILLED.format(_STRIPPED)} as code_left, len(list_filter(string_split(content, chr(10)), lambda x: regexp_matches(x, '^\s*#'))) hashed from repository_files where content is not null),
 c as (select *, total_lines - filled as blank_lines, case when e in ('.py', '.rb') then hashed else greatest(0, filled - code_left) end as comment_lines from f)
 select id, total_lines, blank_lines, comment_lines, total_lines - blank_lines - comment_lines as code_lines from c""",
    "security_scan": rf"""with f as (select id, repository_id, path, {_ANY} a from {_SRC} where content is not null and {basename("lower(coalesce(path, ''))")} not in ('requirements.txt', 'package.json')),
 g as (select id, repository_id, path, case when a[len(a)] = '' then a[:len(a) - 1] else a end a from f), l as (select id, repository_id, path, unnest(a) line, unnest(range(1, len(a) + 1)) line_number from g), h as ({_rule_hits(S.SECURITY, 'l', False)})
 select id, repository_id, path, line_number, severity, category, title, case category when 'Secrets' then 'Matched: ' || matched[:15] || '...' when 'Injection' then 'Raw SQL string concatenation parameter executed.' when 'Unsafe APIs' then 'Matched token: ' || matched else 'Matched cipher: ' || matched end evidence, line[:120] snippet from h""",
    "strict_scan": rf"""with f as (select id, {_ANY} a from {_SRC} where content is not null and {basename("lower(coalesce(path, ''))")} not in ('requirements.txt', 'package.json')), g as (select id, case when a[len(a)] = '' then a[:len(a) - 1] else a end a from f),
 l as (select id, unnest(a) line, unnest(range(1, len(a) + 1)) line_number from g), h as ({_rule_hits(S.STRICT, 'l', False)}) select id, line_number, severity, category, title from h""",
    "line_smells": f"with l as ({LINES.format(keep='id, extension').replace('repository_files', _SRC)}), h as ({_rule_hits(S.LINE_SMELLS, 'l', True)}) select id, line_number, title as smell_type, category, severity, matched from h",
    "snippet_scan": rf"""with f as (select distinct id, snippet, {ANY_SPLIT.format('snippet')} a from security_issues where snippet is not null), g as (select id, case when a[len(a)] = '' then a[:len(a) - 1] else a end a from f),
 l as (select id, unnest(a) line, unnest(range(1, len(a) + 1)) line_number from g), h as ({_rule_hits(S.SECURITY, 'l', False)})
 select id, line_number, severity, category, title, case category when 'Secrets' then 'Matched: ' || matched[:15] || '...' when 'Injection' then 'Raw SQL string concatenation parameter executed.' when 'Unsafe APIs' then 'Matched token: ' || matched else 'Matched cipher: ' || matched end evidence from h""",
    "callback_hell": rf"""with l as ({_SCRIPT_LINES}), x as (select id, line_number, regexp_matches(line, '\bfunction\b|\(\s*\)\s*=>')::int c, contains(line, '}}')::int d from l), s as (select *, sum(c - d) over (partition by id order by line_number) s from x),
 n as (select *, s - least(0, min(s) over (partition by id order by line_number)) depth from s), o as (select *, coalesce(lag(depth) over (partition by id order by line_number), 0) + c as open from n) select id, line_number, open::bigint measured_value from o where c = 1 and open >= 3""",
    "promise_chains": rf"""with l as ({_SCRIPT_LINES}), x as (select id, line_number, regexp_matches(line, '\.then\s*\(') t, (not regexp_matches(line, '\.then\s*\(') and regexp_matches(line, '[;}}]'))::int r from l), i as (select *, sum(r) over (partition by id order by line_number) island from x),
 n as (select *, sum(t::int) over (partition by id, island order by line_number) n from i) select id, line_number, n::bigint measured_value from n where t and n >= 4""",
    "large_matches": rf"""with l as ({LINES.format(keep='id').replace('repository_files', _SRC)} and lower(extension) = '.rs'), st as (select id, line_number as m from l where regexp_matches(line, '\bmatch\s+.*?\s*\{{')),
 x as (select st.id, m, line_number n, contains(line, '=>')::int arm, sum(contains(line, '{{')::int - contains(line, '}}')::int) over (partition by st.id, m order by line_number) + 1 depth from st join l on l.id = st.id and l.line_number > m),
 y as (select *, coalesce(max((depth <= 0)::int) over (partition by id, m order by n rows between unbounded preceding and 1 preceding), 0) ended from x) select id, m as line_number, sum(arm)::bigint measured_value from y where ended = 0 group by 1, 2 having sum(arm) > 8""",
    "duplication": f"""with f as (select repository_id, id, {_NORMAL} l from repository_files where content is not null), total as (select repository_id, sum(len(l))::bigint total_lines from f group by 1),
 st as (select repository_id, id, l, unnest(range(0, len(l) - 5)) as st from f where len(l) >= 6), h as (select repository_id, id, st, md5(array_to_string(l[st + 1:st + 6], chr(10))) h from st),
 often as (select repository_id, h from h group by 1, 2 having count(*) >= 2), hit as (select repository_id, id, unnest(range(st, st + 6)) n from h join often using (repository_id, h)), dup as (select repository_id, count(distinct (id, n)) duplicated_lines from hit group by 1)
 select repository_id, total_lines, coalesce(duplicated_lines, 0) duplicated_lines, round_even(coalesce(duplicated_lines, 0) / greatest(total_lines, 1) * 100, 2) duplication_percentage from total left join dup using (repository_id)""",
    "dependency_lines": r"""with s as (select distinct id, trim(regexp_replace(snippet, '\s', ' ', 'g')) s from security_issues where lower(trim(category)) = 'dependencies' and snippet is not null)
 select id, string_split(s, '==')[1] as package, coalesce(string_split(s, '==')[2], 'latest') as version from s where contains(s, '==') and not starts_with(s, '#')""",
}
