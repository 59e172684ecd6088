"""Queries of problem 6: references to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.operators import references as R
from corvane.session import table


def all_references(spark: SparkSession, d: str) -> DataFrame:
    issues = R.reference_rows(table(spark, d, "security_issues"), "security_issues", "repository_files", "file_path", "repository_id", at="created_at")
    chunks = R.reference_rows(table(spark, d, "repository_embeddings"), "repository_embeddings", "repository_files", "file_path", "repository_id", at="created_at")
    chats = R.reference_rows(table(spark, d, "chat_messages"), "chat_messages", "chat_sessions", "session_id", at="created_at")
    return issues.unionByName(chunks).unionByName(chats)


def all_targets(spark: SparkSession, d: str) -> DataFrame:
    files = R.existence(table(spark, d, "repository_files"), "repository_files", "path", "repository_id")
    return files.unionByName(R.existence(table(spark, d, "chat_sessions"), "chat_sessions", "id"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return R.orphans(all_references(spark, d), all_targets(spark, d)).select("src_table", "row_id")


def p6_orphan_report(spark: SparkSession, d: str) -> DataFrame:
    refs = all_references(spark, d)
    return R.orphan_report(R.orphans(refs, all_targets(spark, d)), refs)


_REFS = """
 refs as (
  select 'security_issues' src_table, id row_id, 'f' target, repository_id scope, file_path k, created_at ts from security_issues where file_path is not null and repository_id is not null
  union all select 'repository_embeddings', id, 'f', repository_id, file_path, created_at from repository_embeddings where file_path is not null and repository_id is not null
  union all select 'chat_messages', id, 's', '', session_id, created_at from chat_messages where session_id is not null),
 targets as (
  select distinct 'f' target, repository_id scope, path k from repository_files where path is not null and repository_id is not null
  union select distinct 's', '', id from chat_sessions where id is not null),
 found as (select distinct on (src_table, row_id) * from refs where not exists (select 1 from targets t where t.target = refs.target and t.scope = refs.scope and t.k = refs.k))
"""

QUERIES = {"p6_found": p6_found, "p6_orphan_report": p6_orphan_report}
SQL = {
    "p6_found": f"with {_REFS} select src_table, row_id from found",
    "p6_orphan_report": f"""with {_REFS},
 n as (select src_table, strftime(ts at time zone 'UTC', '%Y-%m') as month, count(*) n_refs from (select distinct on (src_table, row_id) * from refs) group by 1, 2),
 o as (select src_table, strftime(ts at time zone 'UTC', '%Y-%m') as month, count(*) n_orphans, count(distinct (scope, k)) n_keys from found group by 1, 2)
 select n.src_table, n.month, n.n_refs, coalesce(o.n_orphans, 0) n_orphans, coalesce(o.n_keys, 0) n_keys from n left join o on n.src_table = o.src_table and n.month is not distinct from o.month""",
}
