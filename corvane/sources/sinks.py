"""Tables on storage: writing by repository, upserts, deletes, exports. A write goes to a new folder or replaces whole partitions, so that a repeated task leaves the same files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_by_repository(df: DataFrame, path: str, files_a_repository: int = 8) -> None:
    """Replaces the partitions of the repositories in df; a large repository is spread over several files."""
    salt = F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in df.columns[:3]]), F.lit(files_a_repository))
    df.repartition("repository_id", salt).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repository_id").parquet(path)


def upsert(stored: DataFrame, new: DataFrame, key: str, version: list[str]) -> DataFrame:
    """Stored and new rows together, of each key the row with the highest version. Null keys are left out."""
    u = stored.unionByName(new, allowMissingColumns=True).where(F.col(key).isNotNull())
    w = Window.partitionBy(key).orderBy(*[F.desc(v) for v in version])
    return u.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def without(df: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys gone does not have: a delete by repository, file or list of files."""
    return df.join(gone.select(*keys).distinct(), keys, "left_anti")


def drop_repository(spark: SparkSession, path: str, repository_id: str) -> int:
    """Removes a repository's partition of a table; the number of rows that went."""
    n = spark.read.parquet(path).where(F.col("repository_id") == repository_id).count()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    p = hadoop.Path(f"{path}/repository_id={repository_id}")
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    return n


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
