"""python -m tests.compare [SF_DIR] [NAME...]: queries against their SQL in DuckDB."""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb


def views(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(sf).glob("*.parquet")):
        files = f"{p}/*.parquet" if p.is_dir() else p
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{files}')")
    return con


def norm(x):
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    if isinstance(x, float):
        return "nan" if x != x else round(x, 9)
    if isinstance(x, list):
        return tuple(norm(y) for y in x)
    return x


def differences(spark, con, name: str, sf: str) -> tuple[int, Counter, Counter]:
    """Rows of the query; rows only it has; rows only the SQL has."""
    import __spark_entry__ as e

    df = e.queries()[name](spark, sf)
    columns = sorted(df.columns)
    have = Counter(tuple(norm(x) for x in r) for r in df.select(*columns).collect())
    rel = con.sql(e.oracle_sql()[name])
    assert sorted(rel.columns) == columns, (rel.columns, columns)
    want = Counter(tuple(norm(x) for x in r) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({e.oracle_sql()[name]})").fetchall())
    return sum(have.values()), have - want, want - have


if __name__ == "__main__":
    import __spark_entry__ as e
    from tideline.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = views(sf)
    for name in sys.argv[2:] or list(e.queries()):
        began = time.time()
        if name in e.oracle_sql():
            n, more, less = differences(spark, con, name, sf)
            print(f"{name}: {n} rows, {sum(more.values())} too many, {sum(less.values())} missing, {time.time() - began:.1f} s", list(more)[:2], list(less)[:2], flush=True)
        else:
            print(f"{name}: {e.queries()[name](spark, sf).count()} rows, no SQL, {time.time() - began:.1f} s", flush=True)
