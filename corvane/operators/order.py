"""Ranks, prefix sums and neighbours in an order, without one task per group.

A window over a group runs in a single task. The functions here cut a group into parts that keep the order (or, where the
order is free, into salts), solve each part by itself, and carry the few figures of whole parts over the cuts. A group that
holds a third of all rows is so spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parts_for(df: DataFrame, rows_a_part: int = 1_000_000, least: int = 64) -> int:
    """Into how many salts or buckets the rows of df are to be dealt, so that one of a third of all rows has about rows_a_part; counts df."""
    return max(least, -(-df.count() // rows_a_part))


def any_rank(df: DataFrame, keys: list[str], id_cols: list[str], out: str, salts: int = 64) -> DataFrame:
    """Adds out: numbers 0, 1, 2 ... within keys, each once, in an order of no meaning that is the same in each run.

    Rows are dealt to salts by a hash of id_cols, numbered within key and salt, and moved up by the counts of the salts before.
    The table of counts has at most salts rows for each key. Null keys form one group; repeated rows get numbers of their own.
    """
    s, n0, o = "__salt", "__n", "__off"
    d = df.withColumn(s, F.pmod(F.xxhash64(*id_cols), F.lit(salts)).cast("int"))
    w = Window.partitionBy(*keys, s).orderBy(*id_cols)
    counts = d.groupBy(*keys, s).agg(F.count(F.lit(1)).alias(n0))
    before = Window.partitionBy(*keys).orderBy(s).rowsBetween(Window.unboundedPreceding, -1)
    off = counts.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col(s).alias("__s2"), F.coalesce(F.sum(n0).over(before), F.lit(0)).alias(o))
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] + [F.col(s) == F.col("__s2")]
    r = d.withColumn(out, F.row_number().over(w).cast("long") - 1).join(off, on, "left")
    return r.withColumn(out, F.col(out) + F.col(o)).drop(s, "__s2", o, *[f"__k_{k}" for k in keys])


def prefix_sum(df: DataFrame, keys: list[str], position: Column, id_cols: list[str], value: str, out: str, buckets: int = 64) -> DataFrame:
    """Adds out: the sum of value over the rows of the same keys before this one, in order of position (in [0, 1)) and id_cols.

    position is cut into equal buckets; sums of whole buckets are carried. Meant for positions spread evenly, such as hashes.
    """
    p, b, o = "__pos", "__b", "__off"
    d = df.withColumn(p, position).withColumn(b, F.least(F.lit(buckets - 1), F.floor(F.col(p) * buckets)).cast("int"))
    sums = d.groupBy(*keys, b).agg(F.sum(value).alias("__v"))
    before = Window.partitionBy(*keys).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    off = sums.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col(b).alias("__b2"), F.coalesce(F.sum("__v").over(before), F.lit(0)).alias(o))
    w = Window.partitionBy(*keys, b).orderBy(p, *id_cols).rowsBetween(Window.unboundedPreceding, -1)
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] + [F.col(b) == F.col("__b2")]
    r = d.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0))).join(off, on, "left")
    return r.withColumn(out, F.col(out) + F.col(o)).drop(p, b, "__b2", o, *[f"__k_{k}" for k in keys])


def _in_parts(df: DataFrame, key: str, order: list[str], rows_a_part: int) -> tuple[DataFrame, bool]:
    """(df with __part, whether any key has several parts).

    Keys of up to rows_a_part rows have the one part 0. The rows of larger keys are put into ranges of key and order, whose bounds are
    quantiles: neither bursts nor a few rows far away make a large part. Each range is written with its number before it is used.
    """
    from corvane.session import cut

    big = df.groupBy(F.col(key).alias("__k")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows_a_part)
    n = big.agg(F.sum("__n")).first()[0]
    if not n:
        return df.withColumn("__part", F.lit(0)), False
    is_big = df[key] == F.col("__k")
    hot = df.join(big, is_big, "left_semi").repartitionByRange(max(2, -(-n // rows_a_part)), key, *order)
    return df.join(big, is_big, "left_anti").withColumn("__part", F.lit(0)).unionByName(cut(hot.withColumn("__part", F.spark_partition_id()))), True


def previous_in_order(df: DataFrame, key: str, at: str, then: list[str], carry: list[str], prefix: str = "prev_", rows_a_part: int = 1_000_000) -> DataFrame:
    """Adds prefix + c for each c of carry: its value in the row before, within key, in order of at (nulls last) and then.

    Within a part (see _in_parts) the row before is found by a window; the first row of a part takes the last row of the part
    before, from a table that has one row for each part of a large key. prefix + "exists" says whether there is a row before.
    """
    d, order = df.withColumn("__none", F.col(at).isNull()), ["__none", at, *then]
    d, several = _in_parts(d, key, order, rows_a_part)
    w = Window.partitionBy(key, "__part").orderBy(*order)
    packed = F.struct(*[F.col(c).alias(c) for c in carry])
    r = d.withColumn("__prev", F.lag(packed).over(w))
    if several:
        last = d.groupBy(F.col(key).alias("__k"), F.col("__part").alias("__p")).agg(F.max_by(packed, F.struct(*order)).alias("__last"))
        last = last.select("__k", "__p", F.lag("__last").over(Window.partitionBy("__k").orderBy("__p")).alias("__before")).where(F.col("__before").isNotNull())
        r = r.withColumn("__first", F.row_number().over(w) == 1).join(last, (F.col(key) == F.col("__k")) & (F.col("__part") == F.col("__p")), "left")
        r = r.withColumn("__prev", F.when(F.col("__first"), F.col("__before")).otherwise(F.col("__prev"))).drop("__first", "__k", "__p", "__before")
    for c in carry:
        r = r.withColumn(prefix + c, F.col("__prev")[c])
    return r.withColumn(prefix + "exists", F.col("__prev").isNotNull()).drop("__none", "__part", "__prev")


def number_in_order(df: DataFrame, key: str, at: str, then: list[str], out: str, rows_a_part: int = 1_000_000) -> DataFrame:
    """Adds out: 1, 2, 3 ... within key in order of at (nulls last) and then; parts as in previous_in_order, whose counts are carried."""
    d, order = df.withColumn("__none", F.col(at).isNull()), ["__none", at, *then]
    d, several = _in_parts(d, key, order, rows_a_part)
    r = d.withColumn(out, F.row_number().over(Window.partitionBy(key, "__part").orderBy(*order)).cast("long"))
    if several:
        n = d.groupBy(F.col(key).alias("__k"), F.col("__part").alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
        before = Window.partitionBy("__k").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
        off = n.select("__k", "__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
        r = r.join(off, (F.col(key) == F.col("__k")) & (F.col("__part") == F.col("__p")), "left").withColumn(out, F.col(out) + F.coalesce("__off", F.lit(0))).drop("__k", "__p", "__off")
    return r.drop("__none", "__part")


def rank_spread(df: DataFrame, keys: list[str], order: list[Column], out: str, parts: int | None = None) -> DataFrame:
    """Adds out: 1, 2, 3 ... within keys in the given order, which must be total; no task holds a whole group.

    Rows are put into ranges of (keys, order), so that a large group lies in several; each range is written with its number, then
    rows are numbered within key and range, and the counts of the key's ranges before are added. Nulls come first or last as the order says.
    """
    from corvane.session import cut

    n = parts or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    d = cut(df.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn("__part", F.spark_partition_id()))
    counts = d.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    off = counts.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__part").alias("__p2"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    r = d.withColumn(out, F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order)).cast("long"))
    on = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys] + [F.col("__part") == F.col("__p2")]
    return r.join(off, on, "left").withColumn(out, F.col(out) + F.col("__off")).drop("__part", "__p2", "__off", *[f"__k_{k}" for k in keys])
