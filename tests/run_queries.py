"""Run registered queries and, where there is one, their SQL; report differences.

    python tests/run_queries.py [folder] [name ...]
"""

import hashlib
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v != v:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(round(v, 6))
    return str(v)


def rows_of(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in at) for r in rows)


def compare(df, con, sql):
    """None when equal, else a short account of the difference."""
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} / {sorted(names)}"
    if got != want:
        a, b = set(got), set(want)
        return f"rows {len(got)} / {len(want)}; only here {sorted(a - b)[:2]}; only there {sorted(b - a)[:2]}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as e
    from poolwright.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sqls = e.oracle_sql()
    for name, run in e.queries().items():
        if len(sys.argv) > 2 and not any(a in name for a in sys.argv[2:]):
            continue
        t = time.time()
        try:
            df = run(spark, folder)
            if name in sqls:
                bad = compare(df, con, sqls[name])
                print(f"{'ok  ' if bad is None else 'DIFF'} {name} {time.time() - t:.1f}s {bad or ''}", flush=True)
            else:
                print(f"rows {name} {df.count()} {time.time() - t:.1f}s", flush=True)
        except Exception as x:
            print(f"FAIL {name} {type(x).__name__} {str(x)[:600]}", flush=True)
