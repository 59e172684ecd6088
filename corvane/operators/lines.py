"""Texts as rows of lines, and counts of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ends of lines as in Unicode's line breaking; fixed values.
ANY_LINE_END = r"\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


def explode_lines(df: DataFrame, text: str, keep: list[str], out: str = "line", number: str = "line_number") -> DataFrame:
    """A row for each line (split at LF, as kept in the text), numbered from 1. Null texts give no rows, empty ones one empty line."""
    return df.where(F.col(text).isNotNull()).select(*keep, F.posexplode(F.split(F.col(text), "\n", -1)).alias("__p", out)).withColumn(number, (F.col("__p") + 1).cast("long")).drop("__p")


def explode_any_lines(df: DataFrame, text: str, keep: list[str], out: str = "line", number: str = "line_number") -> DataFrame:
    """As explode_lines, but split at any line end and without an empty last line."""
    a = F.split(F.col(text), ANY_LINE_END, -1)
    a = F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a)
    d = df.where(F.col(text).isNotNull()).select(*keep, a.alias("__a"))
    return d.select(*keep, F.posexplode("__a").alias("__p", out)).withColumn(number, (F.col("__p") + 1).cast("long")).drop("__p")


def strip_comments(text: Column, hash_comments: bool = False) -> Column:
    """text without block comments, then without the rest of a line from //; addresses in strings are cut too."""
    t = F.regexp_replace(text, r"(?s)/\*.*?\*/", "")
    t = F.regexp_replace(t, r"//[^\n]*", "")
    return F.regexp_replace(t, r"#[^\n]*", "") if hash_comments else t


def n_lines(text: Column) -> Column:
    return (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long")


def n_filled(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"\s", " ")) != ""))


def line_counts(df: DataFrame, text: str = "content", ext: str = "extension") -> DataFrame:
    """Adds total_lines, blank_lines, comment_lines and code_lines.

    Files in Python and Ruby count lines that begin with # as comments; others count what is neither blank nor left over after
    comments are stripped, at least 0. Null texts have nulls.
    """
    t, e = F.col(text), F.lower(F.coalesce(F.col(ext), F.lit("")))
    filled = n_filled(t)
    hashed = F.size(F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"^\s*#")))
    comments = F.when(e.isin(".py", ".rb"), hashed).otherwise(F.greatest(F.lit(0), filled - n_filled(strip_comments(t))))
    d = df.withColumn("total_lines", n_lines(t)).withColumn("blank_lines", F.col("total_lines") - filled).withColumn("comment_lines", comments.cast("long"))
    return d.withColumn("code_lines", F.col("total_lines") - F.col("blank_lines") - F.col("comment_lines"))


def duplicated_lines(df: DataFrame, group: str, file: str, text: str, block: int = 6) -> DataFrame:
    """Per group: total_lines, duplicated_lines and duplication_percentage (two digits).

    Lines are trimmed; blank lines and those that begin with #, //, /* or * are dropped. A line is duplicated if it lies in a run of
    `block` lines whose hash comes twice or more in the group. Hashes are counted before blocks are joined back, so a block that
    a third of all files share is one row of the counts.
    """
    from pyspark.sql import Window

    d = df.where(F.col(text).isNotNull()).select(group, file, F.filter(F.transform(F.split(F.col(text), "\n", -1), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", ""))), lambda x: (x != "") & ~x.rlike(r"^(?:#|//|/\*|\*)")).alias("__l"))
    n = F.size("__l")
    total = d.groupBy(group).agg(F.sum(n).alias("total_lines"))
    # blocks are hashed inside the array, so that only numbers and hashes are multiplied
    blocks = F.transform(F.sequence(F.lit(0), n - block), lambda i: F.md5(F.array_join(F.slice("__l", i + 1, block), "\n")))
    hashed = d.where(n >= block).select(group, file, F.posexplode(blocks).alias("at", "h"))
    often = hashed.groupBy(group, "h").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select(group, "h")
    hit = hashed.join(often, [group, "h"], "left_semi")
    # each start covers block lines: starts of one file are merged by their gaps, which needs no row for each line
    w = Window.partitionBy(group, file).orderBy("at")
    step = F.least(F.lit(block), F.coalesce(F.lead("at").over(w) - F.col("at"), F.lit(block)))
    dup = hit.select(group, file, "at").distinct().withColumn("step", step).groupBy(group).agg(F.sum("step").alias("duplicated_lines"))
    j = total.join(dup, group, "left").withColumn("duplicated_lines", F.coalesce("duplicated_lines", F.lit(0)))
    return j.withColumn("duplication_percentage", F.bround(F.col("duplicated_lines") / F.greatest("total_lines", F.lit(1)) * 100, 2))
