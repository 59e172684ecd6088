"""Queries over import graphs.

The imports in repository_files name no file of the table. The files' paths are kept, and their contents are replaced by imports of one another
by a rule: within a repository and ending, in order of paths and in groups of 50, each file imports the next, and every fifth the one three before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators import graph as G
from corvane.operators.order import rank_spread
from corvane.session import cut, table

GROUP, EVERY, BACK = 50, 5, 3
#: Paths that can be written as a module: letters, digits and underscores, one dot.
MODULE = r"^[A-Za-z0-9_/]+\.(?:py|js|ts|java)$"


def linked_files(spark, d) -> DataFrame:
    """(repository_id, path, extension, module_type, content): files that import each other, see above."""
    f = table(spark, d, "repository_files").where(F.col("path").rlike(MODULE) & F.col("repository_id").isNotNull())
    f = f.groupBy("repository_id", "path").agg(F.min(F.coalesce("module_type", F.lit("Unknown"))).alias("module_type"))
    stem, ext = F.regexp_extract("path", r"^(.*)\.\w+$", 1), F.regexp_extract("path", r"(\.\w+)$", 1)
    f = f.withColumn("stem", stem).withColumn("extension", ext)
    one = f.groupBy("repository_id", "stem").agg(F.count(F.lit(1)).alias("n")).where("n = 1")  # a stem with two endings would be two answers to one import
    f = rank_spread(f.join(one.select("repository_id", "stem"), ["repository_id", "stem"]), ["repository_id", "extension"], [F.col("path")], "r")
    f = cut(f)
    other = lambda step: f.select("repository_id", "extension", (F.col("r") - step).alias("r"), F.col("stem").alias(f"to{step}".replace("-", "_")))
    j = f.join(other(1), ["repository_id", "extension", "r"], "left").join(other(-BACK), ["repository_id", "extension", "r"], "left")
    here = F.col("r") % GROUP

    def line(to):
        dots = F.replace(to, F.lit("/"), F.lit("."))
        return F.when(F.col("extension") == ".py", F.concat(F.lit("import "), dots)).when(F.col("extension") == ".java", F.concat(F.lit("import "), dots, F.lit(";"))).otherwise(F.concat(F.lit("import x from '/"), to, F.lit("'")))

    following, back = F.when(here != 0, line(F.col("to1"))), F.when((F.col("r") % EVERY == 0), line(F.col("to_3")))
    return j.select("repository_id", "path", "extension", "module_type", F.concat_ws("\n", following, back, F.lit("x = 1")).alias("content"))


def _edges(spark, d) -> tuple[DataFrame, DataFrame]:
    f = cut(linked_files(spark, d))
    return f, cut(G.import_edges(f))


def import_edges(spark, d):
    return _edges(spark, d)[1].select("repository_id", "src", "dst")


def coupling(spark, d):
    f, e = _edges(spark, d)
    return G.coupling(f.select("repository_id", "path"), e).where("coupling > 0").withColumn("instability", F.round("instability", 6))


def dependency_cycles(spark, d):
    """Files on a cycle, with the largest path of their strongly connected part."""
    return G.strong_parts(_edges(spark, d)[1])


def cycles_listed(spark, d):
    return G.cycle_list(_edges(spark, d)[1])


def cycle_sets(spark, d):
    return G.open_cycles(_edges(spark, d)[1])


def longest_chains(spark, d):
    return G.longest_chain(_edges(spark, d)[1])


def layer_violations(spark, d):
    f, e = _edges(spark, d)
    return G.layer_violations(e, f.select("repository_id", "path", F.col("module_type").alias("module")))


def import_lookups(spark, d):
    f, e = _edges(spark, d)
    return G.lookups(f.select("repository_id", "path"), e)


def shown_edges(spark, d):
    """Edges of the graph that is shown: of a repository with more than 20 files, those whose ends are among its 10 most coupled ones."""
    f, e = _edges(spark, d)
    c = G.coupling(f.select("repository_id", "path"), e)
    from pyspark.sql import Window

    n = f.groupBy("repository_id").agg(F.count(F.lit(1)).alias("n"))
    top = c.withColumn("r", F.row_number().over(Window.partitionBy("repository_id").orderBy(F.desc("coupling"), "path"))).where("r <= 20")
    kept = top.join(n, "repository_id").where("n <= 20 or r <= 10").select("repository_id", "path")
    return e.join(kept.withColumnRenamed("path", "src"), ["repository_id", "src"], "left_semi").join(kept.withColumnRenamed("path", "dst"), ["repository_id", "dst"], "left_semi").select("repository_id", "src", "dst")


QUERIES = {f.__name__: f for f in (import_edges, coupling, dependency_cycles, cycles_listed, cycle_sets, longest_chains, layer_violations, import_lookups, shown_edges)}

_G = """
 f as (select repository_id, path, min(coalesce(module_type, 'Unknown')) module_type, regexp_extract(path, '^(.*)\\.\\w+$', 1) stem, regexp_extract(path, '(\\.\\w+)$', 1) ext from repository_files where repository_id is not null and regexp_matches(path, '^[A-Za-z0-9_/]+\\.(?:py|js|ts|java)$') group by 1, 2),
 one as (select * from f qualify count(*) over (partition by repository_id, stem) = 1),
 r as (select *, row_number() over (partition by repository_id, ext order by path) r from one),
 links as (select a.*, b.path as meant from r a join r b on a.repository_id = b.repository_id and a.ext = b.ext and (b.r = a.r + 1 and a.r % 50 <> 0 or b.r = a.r - 3 and a.r % 5 = 0)),
 e as (select distinct repository_id, path src, case when ext = '.java' then (select min(x.path) from r x where x.repository_id = links.repository_id and (x.path = meant or ends_with(x.path, '/' || meant))) else meant end dst from links),
 o as (select repository_id, src as path, count(*) fan_out, string_agg(dst, ',' order by dst) imports from e group by 1, 2), i as (select repository_id, dst as path, count(*) fan_in, string_agg(src, ',' order by src) imported_by from e group by 1, 2),
 c as (select repository_id, path, coalesce(fan_in, 0) fan_in, coalesce(fan_out, 0) fan_out, coalesce(fan_in, 0) + coalesce(fan_out, 0) coupling from one left join o using (repository_id, path) left join i using (repository_id, path))"""
#: A cycle of the rule: a fifth file of a group and the three before it, in order of paths.
_FOURS = ", k as (select a.repository_id, b3.path p1, b2.path p2, b1.path p3, a.path p4 from r a join r b1 on b1.repository_id = a.repository_id and b1.ext = a.ext and b1.r = a.r - 1 join r b2 on b2.repository_id = a.repository_id and b2.ext = a.ext and b2.r = a.r - 2 join r b3 on b3.repository_id = a.repository_id and b3.ext = a.ext and b3.r = a.r - 3 where a.r % 5 = 0)"
SQL = {
    "import_edges": f"with {_G} select repository_id, src, dst from e",
    "coupling": f"with {_G} select repository_id, path, fan_in, fan_out, coupling, round(fan_out / coupling, 6) instability from c where coupling > 0",
    "dependency_cycles": f"with recursive {_G}, reach as (select repository_id, src, dst from e union select reach.repository_id, reach.src, e.dst from reach join e on e.repository_id = reach.repository_id and e.src = reach.dst) select a.repository_id, a.src as path, max(a.dst) part from reach a join reach b on b.repository_id = a.repository_id and b.src = a.dst and b.dst = a.src group by 1, 2",
    "cycles_listed": f"with {_G}{_FOURS} select repository_id, p1 || ' -> ' || p2 || ' -> ' || p3 || ' -> ' || p4 || ' -> ' || p1 as cycle from k",
    "cycle_sets": f"with {_G}{_FOURS} select repository_id, p1 || ' -> ' || p2 || ' -> ' || p3 || ' -> ' || p4 as cycle from k",
    "longest_chains": f"with {_G}, g as (select repository_id, ext, (r - 1) // 50 g, count(*) n from r group by 1, 2, 3) select repository_id, max(n - 3 * (n // 5))::int longest_chain from g where n > 1 group by 1",
    "layer_violations": f"""with {_G}, j as (select e.*, a.module_type a, b.module_type b from e join one a on a.repository_id = e.repository_id and a.path = e.src join one b on b.repository_id = e.repository_id and b.path = e.dst)
 select repository_id, src, dst, case when a = 'Configuration' then 'configuration' else 'layer' end kind from j where a = 'Repository' and b in ('Service', 'Controller', 'API') or a = 'Service' and b in ('Controller', 'API') or a = 'Configuration' and b in ('Controller', 'Service', 'Repository', 'API')""",
    "import_lookups": f"with {_G} select repository_id, path, coalesce(imports, '') imports, coalesce(imported_by, '') imported_by, imports is not null and imported_by is null entry_point from one left join o using (repository_id, path) left join i using (repository_id, path)",
    "shown_edges": f"with {_G}, t as (select *, row_number() over (partition by repository_id order by coupling desc, path) r, count(*) over (partition by repository_id) n from c), kept as (select repository_id, path from t where n <= 20 or r <= 10) select e.* from e where (repository_id, src) in (select (repository_id, path) from kept) and (repository_id, dst) in (select (repository_id, path) from kept)",
}
