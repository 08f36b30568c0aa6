"""Compare registered queries with their DuckDB statements: python tests/check_oracle.py [sf] [name ...]"""
from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "to_pydatetime"):
        v = v.to_pydatetime()
    return v


def compare(spark_rows, spark_cols, duck_rows, duck_cols):
    """Exact comparison after sorting columns by name and rows by value."""
    if sorted(spark_cols) != sorted(duck_cols):
        return f"columns {sorted(set(spark_cols) ^ set(duck_cols))}"
    si = [spark_cols.index(c) for c in sorted(spark_cols)]
    di = [duck_cols.index(c) for c in sorted(duck_cols)]
    key = lambda row: tuple(repr(x) for x in row)
    a = sorted((tuple(cell(x[i]) for i in si) for x in spark_rows), key=key)
    b = sorted((tuple(cell(x[i]) for i in di) for x in duck_rows), key=key)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if key(x) != key(y)]
    if not bad:
        return ""
    x, y = bad[0]
    diff = {c: (p, q) for c, p, q in zip(sorted(spark_cols), x, y) if repr(p) != repr(q)}
    return f"{len(bad)} of {len(a)} rows differ, first {diff}"


def main():
    import duckdb

    import __spark_entry__ as entry
    from tapelens.session import build_session

    args = sys.argv[1:]
    root = f"/root/testdata/sf{args[0] if args else '0.01'}"
    spark = build_session(cpus="8")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    queries, oracle = entry.queries(), entry.oracle_sql()
    names = args[1:] or list(queries)
    fails = []
    for name in names:
        t0 = time.time()
        try:
            df = queries[name](spark, root)
            rows = [tuple(x) for x in df.collect()]
            t1 = time.time()
            if name not in oracle:
                print(f"{name:28s} rows={len(rows)} no oracle {t1 - t0:.1f}s", flush=True)
                continue
            cur = con.execute(oracle[name])
            cols = [c[0] for c in cur.description]
            msg = compare(rows, df.columns, cur.fetchall(), cols)
            print(f"{name:28s} {'OK' if not msg else 'DIFF'} rows={len(rows)} spark {t1 - t0:.1f}s duck {time.time() - t1:.1f}s {msg[:600]}", flush=True)
            if msg:
                fails.append(name)
        except Exception as exc:  # report and go on
            fails.append(name)
            print(f"{name:28s} ERROR {type(exc).__name__}: {str(exc)[:700]}", flush=True)
    print("failed:", fails)


if __name__ == "__main__":
    main()
