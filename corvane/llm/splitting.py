"""Items over a size limit cut into pieces at natural boundaries, by ranges.

Cuts belong to a grid of points `stride` apart. The cut of a point is the best boundary among the `slack` positions before it. If
there is none, the point lies in an unbroken run: the run's begin and end are cuts then, so that it stays whole; only a run too long
for a piece is cut at the point itself. A point's cuts so depend on the text within `limit` of it only. Every range of an item (a slice
with a halo on either side) finds all cuts that fall into it by itself, however long the item is. The tables of the ranges' cuts and
line ends are added up per item (prefix sums), and pieces are emitted by offset. A piece starts `overlap` before its cut and ends
at the next one: neighbouring cuts are at most limit - overlap apart. Positions are code points for texts in columns, bytes for files.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.operators.order import prefix_sum
from corvane.session import cut

#: Strongest first: an empty line, a line's end before one that is not indented, a line's end, a sentence's end, a clause's end, white space.
BOUNDARIES = [re.compile(p) for p in (r"\n[ \t]*\r?\n", r"\n(?=[^\s})\]])|\r(?=[^\s\n})\]])", r"\n|\r(?!\n)", r"[.!?;…](?=\s)[^\S\r\n]?|[。！？；؟]|(?<=[;}])", r"[,:](?=\s)[^\S\r\n]?|[，、：]", r"\s(?!\n)")]
#: The same over bytes of UTF-8: all of them end with a whole character.
BYTE_BOUNDARIES = [
    re.compile(p)
    for p in (
        rb"\n[ \t]*\r?\n", rb"\n(?=[^\s})\]])|\r(?=[^\s\n})\]])", rb"\n|\r(?!\n)", rb"(?:[.!?;]|\xe2\x80\xa6)(?=\s)[^\S\r\n]?|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f|\xef\xbc\x9b|\xd8\x9f|(?<=[;}])",
        rb"[,:](?=\s)[^\S\r\n]?|\xef\xbc\x8c|\xe3\x80\x81|\xef\xbc\x9a", rb"\s(?!\n)",
    )
]


@dataclass(frozen=True)
class Plan:
    limit: int = 3000
    overlap: int = 200
    slack: int = 400
    cells: int = 80  # grid points in a range

    @property
    def stride(self) -> int:
        return self.limit - self.overlap - self.slack

    @property
    def range_size(self) -> int:
        return self.stride * self.cells

    @property
    def halo(self) -> int:
        return 3 * self.limit + 2

    def check(self) -> Plan:
        if self.overlap < 0 or self.slack < 1 or self.stride < self.slack or self.stride <= self.overlap or self.slack < 8:
            raise ValueError("limit must exceed 2 * slack + overlap and slack + 2 * overlap, and slack be at least 8")
        return self


Text = str | bytes


def _inside(text: Text, c: int) -> bool:
    """Whether position c parts what belongs together: CR LF, a mark or joined sign and its base, the bytes of one character."""
    if not 0 < c < len(text):
        return False
    if isinstance(text, bytes):
        return 0x80 <= text[c] <= 0xBF or text[c - 1 : c + 1] == b"\r\n"
    return text[c - 1 : c + 1] == "\r\n" or bool(unicodedata.combining(text[c])) or text[c] in "\u200d\ufe0f" or text[c - 1] == "\u200d"


def _ends(p: re.Pattern, text: Text, lo: int, hi: int) -> Iterator[int]:
    """Ends of the matches of p that lie in (lo, hi]; what follows hi is seen."""
    for m in p.finditer(text, max(0, lo)):
        if m.end() > hi:
            return
        if m.end() > lo and not _inside(text, m.end()):
            yield m.end()


def cuts_of_point(k: int, text: Text, base: int, size: int, plan: Plan) -> list[int]:
    """The cuts of grid point k of an item of the given size; text is the part of the item that begins at base."""
    kinds = BYTE_BOUNDARIES if isinstance(text, bytes) else BOUNDARIES
    at, most = k * plan.stride - base, plan.limit - plan.overlap
    for p in kinds:
        last = None
        for last in _ends(p, text, at - plan.slack, at):
            pass
        if last is not None:
            return [base + last]
    left = [x for p in kinds for x in _ends(p, text, at - most, at - plan.slack)]
    r0 = max(left, default=-base if at - most <= -base else None)
    if r0 is not None:
        stop = r0 + most
        right = [x for p in kinds if (x := next(_ends(p, text, at, stop), None)) is not None]
        r1 = min(right, default=size - base if size - base <= stop else None)
        if r1 is not None:
            return [base + x for x in (r0, r1) if plan.overlap < base + x < size]  # a run near the item's begin goes into its first piece
    c = at
    while at - c < plan.slack and _inside(text, c):
        c -= 1
    return [base + c]


def cuts_between(lo: int, hi: int, text: Text, base: int, size: int, plan: Plan) -> list[int]:
    """All cuts from lo to before hi, in order; text must hold what lies within 2 * limit of them."""
    first, last = max(1, math.ceil((lo - plan.limit) / plan.stride)), min((size - 1) // plan.stride, (hi + plan.limit) // plan.stride)
    return sorted({c for k in range(first, last + 1) for c in cuts_of_point(k, text, base, size, plan) if lo <= c < hi})


def pieces_of_range(text: Text, base: int, range_no: int, size: int, plan: Plan) -> Iterator[tuple[int, int]]:
    """(start, end) of the pieces whose cut belongs to the range; that of the first piece is 0."""
    lo, hi = range_no * plan.range_size, min(size, (range_no + 1) * plan.range_size)
    cuts = ([0] if range_no == 0 else []) + cuts_between(max(lo, 1), hi + plan.limit, text, base, size, plan) + [size]
    for a, z in zip(cuts, cuts[1:]):
        if a >= hi:
            break
        start = max(0, a - plan.overlap) if a else 0
        while isinstance(text, bytes) and start < a and _inside(text, start - base):
            start += 1
        yield start, z


def _bounds(range_no: int, size: int, plan: Plan) -> tuple[int, int]:
    return max(0, range_no * plan.range_size - plan.halo), min(size, (range_no + 1) * plan.range_size + plan.halo)


def _rows(key: str, first_line: int, before: int, first_piece: int, text: Text, base: int, range_no: int, size: int, plan: Plan) -> Iterator[tuple]:
    """Pieces of a range as rows. before: line ends before the range; first_piece: number of its first piece."""
    lf = b"\n" if isinstance(text, bytes) else "\n"
    own = range_no * plan.range_size
    for no, (a, z) in enumerate(pieces_of_range(text, base, range_no, size, plan), first_piece):
        at = text.count(lf, own - base, a - base) if a >= own else -text.count(lf, a - base, own - base)  # a piece may begin before its range
        body, first = text[a - base : z - base], first_line + before + at
        yield key, no, a, z, first, first + body.count(lf, 0, max(0, len(body) - 1)), body.decode("utf-8", "replace") if isinstance(body, bytes) else body


COLUMNS = ["__key", "piece_no", "start_pos", "end_pos", "start_line", "end_line", "content"]
PIECE = "__key string, piece_no long, start_pos long, end_pos long, start_line long, end_line long, content string"


def split_texts(df: DataFrame, key: str, text: str, line: str | None = None, plan: Plan = Plan()) -> DataFrame:
    """Pieces of the texts longer than plan.limit: (key, piece_no from 0, start_pos, end_pos, start_line, end_line, content).

    Pieces cover the text in order; each begins plan.overlap code points before the end of the one before. A key counts once
    (repeated rows hold the same text). Null keys and texts, and texts within the limit, give no rows. A first line that is
    null or below 1 counts as 1; end lines of the input are not trusted but counted. An empty table gives no rows. A text lies in
    one row and so in one task, which walks over its ranges and carries the sums of cuts and line ends from one to the next.
    """
    plan.check()
    long = df.where(F.col(key).isNotNull() & (F.length(text) > plan.limit)).select(*dict.fromkeys([key, text, *([line] if line else [])])).dropDuplicates([key])
    line0 = F.when(F.col(line) >= 1, F.col(line)).otherwise(1) if line else F.lit(1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for pdf in batches:
            for k, s, l in zip(pdf["k"], pdf["s"], pdf["l"]):
                before = no = 0
                for r in range(math.ceil(len(s) / plan.range_size)):
                    lo, hi = _bounds(r, len(s), plan)
                    got = list(_rows(k, int(l), before, no, s[lo:hi], lo, r, len(s), plan))
                    before, no = before + s.count("\n", r * plan.range_size, (r + 1) * plan.range_size), no + len(got)
                    rows += got
                    if len(rows) >= 2000:
                        yield pd.DataFrame(rows, columns=COLUMNS)
                        rows = []
        yield pd.DataFrame(rows, columns=COLUMNS)

    d = long.select(F.col(key).cast("string").alias("k"), F.col(text).alias("s"), line0.cast("int").alias("l")).mapInPandas(run, PIECE)
    return d.withColumnRenamed("__key", key)


def read_range(path: str, lo: int, hi: int) -> bytes:
    """Bytes lo to hi of a file on any storage that pyarrow's file systems reach (folders that are mounted, HDFS, object stores)."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
    with store.open_input_file(name) as f:
        return f.read_at(hi - lo, lo)


def split_files(spark: SparkSession, files: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """Pieces of the files (path, length) with more than plan.limit bytes, as split_texts; positions in bytes, contents decoded from UTF-8.

    No file is loaded whole: a task reads a range and its halos. A first pass counts each range's cuts and line ends, prefix sums over the
    ranges of a file give the number and line of each range's first piece, and a second pass reads the ranges again and emits pieces.
    Texts are never shuffled. Pieces begin and end with whole characters, so an overlap may be up to three bytes shorter. Bytes that are no
    UTF-8 are decoded as U+FFFD. Null paths and lengths give no rows; a path that comes twice counts once.
    """
    plan.check()
    n = F.ceil(F.col("length") / plan.range_size).cast("long")
    once = files.where(F.col("path").isNotNull() & (F.col("length") > plan.limit)).groupBy("path").agg(F.max("length").alias("length"))
    ranges = once.select("path", "length", n.alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("range_no")).repartition("path", "range_no")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, size, k, r in zip(pdf["path"], pdf["length"], pdf["n"], pdf["range_no"]):
                lo, hi = _bounds(r, size, plan)
                b = read_range(path, lo, hi)
                own = r * plan.range_size
                cuts = cuts_between(max(own, 1), min(size, own + plan.range_size), b, lo, size, plan)
                yield pd.DataFrame([(path, size, k, r, len(cuts) + (r == 0), b.count(b"\n", own - lo, own + plan.range_size - lo))], columns=["path", "length", "n", "range_no", "cuts", "lines"])

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, size, r, no, before in zip(pdf["path"], pdf["length"], pdf["range_no"], pdf["first_piece"], pdf["before"]):
                lo, hi = _bounds(r, size, plan)
                yield pd.DataFrame(list(_rows(path, 1, before, no, read_range(path, lo, hi), lo, r, size, plan)), columns=COLUMNS)

    counted = cut(ranges.mapInPandas(count, "path string, length long, n long, range_no long, cuts long, lines long"))
    at = F.col("range_no") / F.col("n")
    summed = prefix_sum(prefix_sum(counted, ["path"], at, ["range_no"], "cuts", "first_piece"), ["path"], at, ["range_no"], "lines", "before")
    return summed.select("path", "length", "range_no", "first_piece", "before").repartition("path", "range_no").mapInPandas(emit, PIECE).withColumnRenamed("__key", "path")
