"""Queries over chunks, vectors and imports."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import code as X
from corvane.operators import chunking as C
from corvane.operators import graph as G
from corvane.operators import vectors as V
from corvane.operators.order import rank_spread
from corvane.plans.sql_parts import any_of, basename
from corvane.session import table


def _chunks(spark, d):
    return table(spark, d, "repository_embeddings")


def _once(spark, d, *columns):
    """Chunks, each chunk_id once (its row with the smallest id); columns are computed before rows are shuffled."""
    from pyspark.sql import Window

    w = Window.partitionBy("chunk_id").orderBy("id")
    c = _chunks(spark, d).select("id", "chunk_id", *columns) if columns else _chunks(spark, d)
    return c.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def fixed_windows(spark, d):
    """Documents of more than 3,000 characters in windows of 2,000 that overlap by 300."""
    docs = table(spark, d, "documents").where(F.length("text") > 3000)
    return C.windows(docs, "text", ["doc_id"], 2000, 300).select("doc_id", "chunk_no", "start_idx", "end_idx", "start_line", "end_line", F.md5("content").alias("digest"))


def file_routes(spark, d):
    f = table(spark, d, "repository_files")
    return f.where("path is not null").select("id", C.route(F.col("path"), F.col("extension"), F.col("content")).alias("route"))


def chunk_priority(spark, d):
    """Priority of every chunk and its place in its repository."""
    c = _once(spark, d)
    hot = C.chunks_with_issues(c, table(spark, d, "security_issues")).select(F.col("id").alias("hot"))
    j = c.join(hot, F.col("id") == F.col("hot"), "left")
    s = j.select("id", "repository_id", C.priority(F.col("file_path"), F.col("content"), F.col("chunk_type"), F.col("start_line"), F.col("end_line"), F.col("hot").isNotNull()).alias("score"))
    return rank_spread(s, ["repository_id"], [F.desc("score"), F.col("id")], "place").select("id", F.round("score", 1).alias("score"), "place")


def evidence_documents(spark, d):
    """Security issues of each file, fifteen to a document."""
    i = table(spark, d, "security_issues").where("file_path is not null").select("id", "repository_id", "file_path", "line_number", "title", "reason", "evidence").distinct()
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    line = F.concat(F.lit("- Line "), part("line_number"), F.lit(": "), part("title"), F.lit(" - "), part("reason"), F.lit(" (Evidence: "), part("evidence"), F.lit(")"))
    e = C.evidence_documents(i, ["repository_id", "file_path"], line, ["line_number", "id"])
    return e.select("repository_id", "file_path", "part", "n", F.md5("evidence").alias("digest"))


def _question(spark, d):
    r = table(spark, d, "embeddings").where("vec_id = 0").select("embedding").first()
    return [float(x) for x in r[0]] if r else [1.0] + [0.0] * 63


def vector_search(spark, d):
    return V.search(_once(spark, d), _question(spark, d), 10).select("chunk_id", "similarity")


def vector_neighbours(spark, d):
    """For every row of embeddings whose id is divisible by 50: its 5 most similar rows of all."""
    e = table(spark, d, "embeddings")
    return V.search_many(e, e.where("vec_id % 50 = 0"), 5, "vec_id", "embedding", 64)


def grounded_search(spark, d):
    """The reranked hits of a question."""
    return V.grounded(_once(spark, d), _question(spark, d), 5).select("chunk_id", "similarity", F.round("boosted", 6).alias("boosted"))


def neighbour_expansion(spark, d):
    c = _once(spark, d)
    hits = c.where("chunk_type = 'Function'")
    return V.neighbours(hits, c).select("chunk_id", "similarity")


def evidence_budget(spark, d):
    """Chunks of each repository, by path and line, as long as their contents fit into 8,000 characters."""
    c = _once(spark, d, "repository_id", F.coalesce("file_path", F.lit("")).alias("p"), F.coalesce("start_line", F.lit(0)).alias("l"), F.length("content").alias("n")).where("n is not null")
    return V.within_budget(c, ["p", "l", "id"], F.col("n"), 8000, ["repository_id"]).select("id")


def answer_confidence(spark, d):
    """Confidence of evidence made of each answer's cited chunks, all with the answer's own confidence as similarity."""
    m = table(spark, d, "chat_messages").where("cited_chunks is not null and confidence between 0 and 100").dropDuplicates(["id"])
    e = m.select("id", (F.col("confidence") / 100).alias("similarity"), F.inline("cited_chunks"))
    return V.confidence(e, ["id"])


def upserted_chunks(spark, d):
    """The stored state after all inserts: of each chunk_id the row that came last."""
    from pyspark.sql import Window

    w = Window.partitionBy("chunk_id").orderBy(F.desc("created_at"), F.desc("id"))
    return _chunks(spark, d).where("chunk_id is not null").withColumn("r", F.row_number().over(w)).where("r = 1").select("chunk_id", "id")


def chunk_stats(spark, d):
    c = _once(spark, d, "chunk_type", "source_phase", F.length("content").alias("chars"))
    return c.groupBy("chunk_type", "source_phase").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("chars"), 6).alias("mean_chars"), F.max("chars").alias("most_chars"))


def chunks_by_file(spark, d):
    c = _once(spark, d).where("file_path is not null")
    return c.groupBy("repository_id", "file_path").agg(F.count(F.lit(1)).alias("n"), F.min("start_line").alias("first_line"), F.max("end_line").alias("last_line"), F.min("chunk_id").alias("first_chunk"))


def import_names(spark, d):
    """How often and from how many files each module is imported, by language."""
    f = table(spark, d, "repository_files").where("content is not null")
    py = F.regexp_extract_all(F.col("content"), F.lit(r"(?m)^(?:from|import) ([\w.]+)"), 1)
    js = F.regexp_extract_all(F.col("content"), F.lit(r"(?m)^import [^'\"\n]*['\"]([^'\"\n]+)['\"]"), 1)
    c = F.regexp_extract_all(F.col("content"), F.lit(r"(?m)^#include [<\"]([^>\"\n]+)[>\"]"), 1)
    e = F.lower("extension")
    names = F.when(e == ".py", py).when(e.isin(".js", ".ts"), js).when(e == ".c", c)
    g = f.select("id", e.alias("ending"), F.explode(names).alias("module"))
    return g.groupBy("ending", "module").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("n_files"))


def supply_coupling(spark, d):
    """Coupling of a larger graph that stands in: parts to suppliers."""
    l = table(spark, d, "lineitem")
    e = l.select(F.lit("tpch").alias("repository_id"), F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst")).distinct()
    nodes = e.select("repository_id", F.col("src").alias("path")).union(e.select("repository_id", "dst")).distinct()
    return G.coupling(nodes, e).select("path", "fan_in", "fan_out", "coupling", F.round("instability", 6).alias("instability"))


def coupling_summary(spark, d):
    """Stored coupling per repository: highly coupled files, the most coupled one (ties by path), share of unknown modules."""
    f = table(spark, d, "repository_files").where("path is not null")
    g = f.groupBy("repository_id").agg(
        F.sum((F.coalesce("coupling_score", F.lit(0)) > 8).cast("long")).alias("highly_coupled"),
        F.min_by("path", F.struct((-F.coalesce("coupling_score", F.lit(0))).alias("c"), "path")).alias("most_coupled"),
        F.round(F.avg((F.coalesce("module_type", F.lit("Unknown")) == "Unknown").cast("double")), 6).alias("unknown_ratio"),
    )
    return g


QUERIES = {f.__name__: f for f in (fixed_windows, file_routes, chunk_priority, evidence_documents, vector_search, vector_neighbours, grounded_search, neighbour_expansion, evidence_budget, answer_confidence, upserted_chunks, chunk_stats, chunks_by_file, import_names, supply_coupling, coupling_summary)}

_ONCE = "(select distinct on (chunk_id) * from repository_embeddings order by chunk_id, id)"
_Q = "(select embedding::double[] q from embeddings where vec_id = 0)"
_COS = "list_dot_product(embedding::double[], q) / (sqrt(list_dot_product(embedding::double[], embedding::double[])) * sqrt(list_dot_product(q, q)))"
_HITS = f"select chunk_id, file_path, {_COS} s from {_ONCE}, {_Q} where len(embedding) = 64 and list_dot_product(embedding::double[], embedding::double[]) > 0"
_BOOST = "case " + " ".join(f"when {any_of('lower(coalesce(file_path, chr(32)))', ws)} then {v}" for v, ws in X.BOOSTS) + " else 0.0 end"
_FP, _CT = "lower(coalesce(file_path, ''))", "lower(coalesce(content, ''))"
_SCORE = (
    f"case when chunk_type = 'README' or ends_with({_FP}, 'readme.md') then 15.0 else 0 end + case when hot then 100.0 else 0 end + case when {any_of(_CT, C.SECRET_WORDS)} then 18.0 else 0 end"
    + "".join(f" + case when {any_of(_FP, ws)} or {any_of(_CT, ws)} then {v} else 0 end" for v, ws in C.POINTS)
    + f" + case when {any_of(_FP, C.ROUTE_WORDS)} then 10.5 else 0 end + case when {basename(_FP)} in ({', '.join(repr(x) for x in C.CORE_FILES)}) then 10.0 else 0 end + case when {any_of(_FP, ['src/', 'app/'])} then 5.0 else 0 end"
    + " + case when chunk_type in ('Class', 'Function', 'Whole File', 'Merged Functions') then 2.0 + case when coalesce(end_line, 0) - coalesce(start_line, 0) > 50 then 1.5 when coalesce(end_line, 0) - coalesce(start_line, 0) > 20 then 0.8 else 0 end else 0 end"
    + f" + case when {any_of(_FP, ['shared', 'components/', 'lib/'])} then 1.0 else 0 end - case when length(coalesce(content, '')) < 200 then 3.0 else 0 end"
)
_TRIMMED = r"list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(regexp_replace(x, '\s', ' ', 'g'))), lambda x: x <> '')"
_LOW = rf"(regexp_matches({basename('lower(path)')}, '\.(?:json|yaml|yml)$') and {basename('lower(path)')} not in ('package.json', 'docker-compose.yml', 'tsconfig.json') or len(list_filter({_TRIMMED}, lambda x: not (regexp_matches(x, '^(?:import |export |\}} from |/\*|\*|//)') or x = '}}'))) = 0)"
_NONE = lambda c: f"coalesce({c}::varchar, 'None')"

SQL = {
    "fixed_windows": """with w as (select doc_id, text, unnest(range(0, ceil((length(text) - 2000) / 1700)::bigint + 1)) chunk_no from documents where length(text) > 3000), x as (select *, chunk_no * 1700 start_idx, text[chunk_no * 1700 + 1:chunk_no * 1700 + 2000] c from w)
 select doc_id, chunk_no, start_idx, start_idx + length(c) end_idx, length(text[1:start_idx]) - length(replace(text[1:start_idx], chr(10), '')) + 1 start_line, length(text[1:start_idx]) - length(replace(text[1:start_idx], chr(10), '')) + 1 + length(c) - length(replace(c, chr(10), '')) end_line, md5(c) digest from x""",
    "file_routes": f"""select id, case when lower(coalesce(extension, '')) in ('.css', '.scss', '.sass', '.less', '.map', '.ico', '.png', '.jpg', '.jpeg', '.gif', '.svg', '.woff', '.woff2', '.ttf', '.eot') or {any_of('lower(path)', ['test', 'spec', 'mocks'])} or coalesce(content, '') = '' then 'skip'
 when {_LOW} then 'skip' when {basename('lower(path)')} = 'readme.md' then 'readme' when {basename('lower(path)')} in ('package-lock.json', 'yarn.lock', 'pnpm-lock.yaml', 'poetry.lock') then 'skip' when {basename('lower(path)')} in ('package.json', 'requirements.txt', 'docker-compose.yml', 'dockerfile', '.env') then 'config'
 when length(content) < 1500 or length(content) - length(replace(content, chr(10), '')) < 100 then 'whole' else 'code' end route from repository_files where path is not null""",
    "chunk_priority": f"""with c as (select *, exists(select 1 from security_issues i where i.repository_id = c.repository_id and i.line_number between coalesce(c.start_line, 0) and coalesce(c.end_line, 999999) and i.file_path <> '' and c.file_path is not null
   and (ends_with('/' || lower(c.file_path), '/' || lower(i.file_path)) or ends_with('/' || lower(i.file_path), '/' || lower(c.file_path)))) hot from {_ONCE} c), s as (select id, repository_id, {_SCORE} as score from c)
 select id, round(score, 1)::double score, row_number() over (partition by repository_id order by score desc, id) place from s""",
    "evidence_documents": f"""with i as (select distinct id, repository_id, file_path, line_number, title, reason, evidence from security_issues where file_path is not null),
 r as (select *, row_number() over (partition by repository_id, file_path order by line_number nulls first, id) - 1 r, '- Line ' || {_NONE('line_number')} || ': ' || {_NONE('title')} || ' - ' || {_NONE('reason')} || ' (Evidence: ' || {_NONE('evidence')} || ')' l from i)
 select repository_id, file_path, (r // 15 + 1)::int part, count(*)::int n, md5(string_agg(l, chr(10) order by r)) digest from r group by 1, 2, 3""",
    "vector_search": f"select chunk_id, round(s, 4) similarity from ({_HITS}) order by s desc, chunk_id limit 10",
    "vector_neighbours": """with e as (select vec_id, embedding::double[] v, sqrt(list_dot_product(embedding::double[], embedding::double[])) n from embeddings where len(embedding) = 64), p as (select a.vec_id as query, b.vec_id, list_dot_product(a.v, b.v) / (a.n * b.n) s from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0 and a.n > 0 and b.n > 0),
 r as (select *, row_number() over (partition by query order by s desc, vec_id) as rank from p) select query, vec_id, round(s, 4) similarity, rank from r where rank <= 5""",
    "grounded_search": f"with h as (select *, round(s, 4) similarity from ({_HITS}) order by s desc, chunk_id limit 10) select chunk_id, similarity, round(similarity * (1 + {_BOOST}), 6) boosted from h order by similarity * (1 + {_BOOST}) desc, chunk_id limit 5",
    "neighbour_expansion": f"""with c as {_ONCE}, h as (select * from c where chunk_type = 'Function'), j as (select c.repository_id, c.chunk_id, c.content from c where c.file_path is not null and c.content not in (select content from h where content is not null)
   and exists(select 1 from h where h.repository_id = c.repository_id and h.file_path = c.file_path and abs(h.start_line - c.start_line) > 0 and abs(h.start_line - c.start_line) < 150))
 select min(chunk_id) chunk_id, 0.8::double similarity from j group by repository_id, content""",
    "evidence_budget": f"""with c as (select id, repository_id, coalesce(file_path, '') p, coalesce(start_line, 0) l, length(content) n from {_ONCE} where content is not null), s as (select *, row_number() over w r, sum(n) over w s from c window w as (partition by repository_id order by p, l, id rows between unbounded preceding and current row))
 select id from s where r = 1 or s <= 8000""",
    "answer_confidence": """with m as (select distinct on (id) * from chat_messages where cited_chunks is not null and confidence between 0 and 100), e as (select id, confidence / 100 s, unnest(cited_chunks) c from m), g as (select id, max(s) best, count(*) n, count(distinct c.file_path) f from e group by 1)
 select id, greatest(10, least(100, floor(least(65.0, best * 65) + least(20, n * 4) + least(15, f * 5))))::int confidence, best >= 0.15 citable from g""",
    "upserted_chunks": "select chunk_id, id from (select *, row_number() over (partition by chunk_id order by created_at desc, id desc) r from repository_embeddings where chunk_id is not null) where r = 1",
    "chunk_stats": f"select chunk_type, source_phase, count(*) n, round(avg(length(content)), 6) mean_chars, max(length(content))::int most_chars from {_ONCE} group by 1, 2",
    "chunks_by_file": f"select repository_id, file_path, count(*) n, min(start_line) first_line, max(end_line) last_line, min(chunk_id) first_chunk from {_ONCE} where file_path is not null group by 1, 2",
    "import_names": r"""with n as (select id, lower(extension) ending, unnest(case when lower(extension) = '.py' then regexp_extract_all(content, '(?m)^(?:from|import) ([\w.]+)', 1) when lower(extension) in ('.js', '.ts') then regexp_extract_all(content, '(?m)^import [^''"\n]*[''"]([^''"\n]+)[''"]', 1)
   when lower(extension) = '.c' then regexp_extract_all(content, '(?m)^#include [<"]([^>"\n]+)[>"]', 1) end) as module from repository_files where content is not null) select ending, module, count(*) n, count(distinct id) n_files from n group by 1, 2""",
    "supply_coupling": """with e as (select distinct 'p' || l_partkey src, 's' || l_suppkey dst from lineitem), o as (select src p, count(*) fan_out from e group by 1), i as (select dst p, count(*) fan_in from e group by 1)
 select coalesce(o.p, i.p) as path, coalesce(fan_in, 0) fan_in, coalesce(fan_out, 0) fan_out, coalesce(fan_in, 0) + coalesce(fan_out, 0) coupling, round(coalesce(fan_out, 0) / (coalesce(fan_in, 0) + coalesce(fan_out, 0)), 6) instability from o full join i on o.p = i.p""",
    "coupling_summary": """select repository_id, sum((coalesce(coupling_score, 0) > 8)::int)::bigint highly_coupled, (array_agg(path order by coalesce(coupling_score, 0) desc, path))[1] most_coupled, round(avg((coalesce(module_type, 'Unknown') = 'Unknown')::int), 6) unknown_ratio from repository_files where path is not null group by 1""",
}
