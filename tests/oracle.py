"""Runs queries beside their SQL in DuckDB on the smallest tables, if they are there."""

import math
from collections import Counter
from pathlib import Path

DATA = Path("/root/testdata/sf0.001")


def connect():
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        con.sql(f"create view {p.stem} as from '{p}'")
    return con


def plain(v):
    if v is None or isinstance(v, (str, bool, int)):
        return v
    if hasattr(v, "isoformat"):
        return v.isoformat().replace("+00:00", "")
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return "nan" if math.isnan(v) else float(f"{float(v):.9g}")


def compare(spark, con, query, sql):
    df = query(spark, str(DATA))
    cols = sorted(df.columns)
    got = Counter(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    rel = con.sql(sql)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    want = Counter(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())
    num = lambda c: Counter({k.replace(".0,", ",").replace(".0)", ")"): n for k, n in c.items()})  # noqa: E731 - 1 and 1.0 are equal
    assert num(got) == num(want)
