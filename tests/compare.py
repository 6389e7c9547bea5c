"""Run registered queries against their SQL twins: python tests/compare.py [sf] [name ...]."""

import datetime
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages"
          " benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(table, key=lambda r: tuple((v is None, str(v)) for v in r))


def close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def compare(spark_side, sql_side):
    """'' when equal bit by bit, 'close' when floats differ in the last digits, else why."""
    (cols_a, a), (cols_b, b) = spark_side, sql_side
    if cols_a != cols_b:
        return f"columns {cols_a} / {cols_b}"
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    bits = True
    for x, y in zip(a, b):
        for name, u, v in zip(cols_a, x, y):
            if not close(u, v):
                return f"{name}: {u!r} / {v!r} in {x} / {y}"
            bits &= u == v and type(u) is type(v)
    return "" if bits else "close"


def run(spark, folder, names=None, report=print):
    import __spark_entry__ as entry

    queries, twins = entry.queries(), entry.oracle_sql()
    assert set(twins) <= set(queries), set(twins) - set(queries)
    con, bad = connect(folder), {}
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            got = rows_of(df.columns, df.collect())
            spark_time = time.time() - start
            if name not in twins:
                report(f"{name:28s} rows-only {len(got[1])} rows {spark_time:.1f}s")
                continue
            start = time.time()
            cursor = con.execute(twins[name])
            want = rows_of([d[0] for d in cursor.description], cursor.fetchall())
            verdict = compare(got, want)
        except Exception as error:
            verdict = f"{type(error).__name__}: {str(error)[:1500]}"
            got, spark_time = ([], []), time.time() - start
        report(f"{name:28s} {verdict or 'equal'} {len(got[1])} rows {spark_time:.1f}s sql {time.time() - start:.1f}s")
        if verdict not in ("", "close"):
            bad[name] = verdict
    return bad


if __name__ == "__main__":
    from tidemark.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    spark = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false",
                          spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    failures = run(spark, f"/root/testdata/sf{sf}", sys.argv[2:] or None, lambda t: print(t, flush=True))
    print("failures:", sorted(failures))
