"""References to records that do not exist, kept as signed counts per key.

A *delta* says that a key gained (+) or lost (-) references or existence. Deltas are added up per key; a key whose references
are positive while its existence is zero is an orphan. Counts of several batches add up, so a state table and the deltas of a
day give the next state without the older rows, and a target that arrives after its references settles them by itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["target", "scope", "key"]


def reference_rows(df: DataFrame, src_table: str, target: str, key: str, scope: str | None = None, row_id: str = "id", at: str | None = None) -> DataFrame:
    """Rows that refer to target: (src_table, row_id, target, scope, key, at). A null key (or scope, if one is named) is no reference."""
    d = df.where(F.col(key).isNotNull() & (F.col(scope).isNotNull() if scope else F.lit(True)))
    when = F.col(at).cast("timestamp") if at else F.lit(None).cast("timestamp")
    return d.select(F.lit(src_table).alias("src_table"), F.col(row_id).cast("string").alias("row_id"), F.lit(target).alias("target"), (F.col(scope).cast("string") if scope else F.lit("")).alias("scope"), F.col(key).cast("string").alias("key"), when.alias("at"))


def deltas(df: DataFrame, refs: int | Column, exist: int | Column) -> DataFrame:
    """Change deltas (target, scope, key, refs, exist) of rows that have the key columns; negative counts take back."""
    as_col = lambda x: (x if isinstance(x, Column) else F.lit(x)).cast("long")
    return df.select(*KEY, as_col(refs).alias("refs"), as_col(exist).alias("exist"))


def existence(df: DataFrame, target: str, key: str, scope: str | None = None) -> DataFrame:
    """Existing keys (target, scope, key), one row for each row of df; null keys are left out."""
    d = df.where(F.col(key).isNotNull() & (F.col(scope).isNotNull() if scope else F.lit(True)))
    return d.select(F.lit(target).alias("target"), (F.col(scope).cast("string") if scope else F.lit("")).alias("scope"), F.col(key).cast("string").alias("key"))


def merge_counts(*parts: DataFrame) -> DataFrame:
    """The sum of states and deltas per key. Keys whose two counts are both zero vanish. Summing is associative: sums are taken before the shuffle."""
    u = reduce(DataFrame.unionByName, [p.select(*KEY, "refs", "exist") for p in parts])
    return u.groupBy(*KEY).agg(F.sum("refs").alias("refs"), F.sum("exist").alias("exist")).where((F.col("refs") != 0) | (F.col("exist") != 0))


def orphan_keys(state: DataFrame) -> DataFrame:
    return state.where((F.col("refs") > 0) & (F.col("exist") <= 0)).select(*KEY, "refs")


def orphans(refs: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows of refs whose key has positive references and no existence: (src_table, row_id, target, scope, key, at), repeated rows once.

    refs comes from reference_rows, targets from existence. References and existence are added up per key first, so a key that
    a third of all rows name is one row of the state; joining it back to its rows is left to the adaptive skew join.
    Empty tables: no references gives no rows, no targets makes every reference an orphan.
    """
    # a repeated row must not count twice, but for the sign of the sum that does not matter here: no need to make rows distinct before
    state = merge_counts(deltas(refs, 1, 0), deltas(targets, 0, 1))
    found = refs.join(orphan_keys(state).select(*KEY), KEY, "left_semi")
    return found.select("src_table", "row_id", "target", "scope", "key", "at").dropDuplicates(["src_table", "row_id"])


def orphan_report(orphan_rows: DataFrame, all_refs: DataFrame) -> DataFrame:
    """Per table and month of the referring row: references, orphans, distinct orphan keys. Rows without a time fall under a null month."""
    month = lambda d: d.withColumn("month", F.date_format("at", "yyyy-MM"))
    n = month(all_refs.dropDuplicates(["src_table", "row_id"])).groupBy("src_table", "month").agg(F.count(F.lit(1)).alias("n_refs"))
    o = month(orphan_rows).groupBy(F.col("src_table").alias("t"), F.col("month").alias("m")).agg(F.count(F.lit(1)).alias("n_orphans"), F.countDistinct("scope", "key").alias("n_keys"))
    j = n.join(o, (n.src_table == o.t) & n.month.eqNullSafe(o.m), "left")
    return j.select("src_table", "month", "n_refs", F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"), F.coalesce("n_keys", F.lit(0)).alias("n_keys"))
