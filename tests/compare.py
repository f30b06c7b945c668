"""Run registered queries beside their SQL twins and compare rows (order-free).

    python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    fix = lambda v: repr(float(v)) if isinstance(v, float) else repr(v)
    return sorted(tuple(fix(r[i]) for i in order) for r in rows)


def compare(spark, con, run, sql, sf):
    """(ok, message, seconds of the Spark side, seconds of the SQL side)."""
    t = time.time()
    df = run(spark, sf)
    got = [tuple(r) for r in df.collect()]
    t_spark = time.time() - t
    if sql is None:
        return True, f"rows only: {len(got)}", t_spark, 0.0
    t = time.time()
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    t_sql = time.time() - t
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}", t_spark, t_sql
    a, b = canonical(got, df.columns), canonical(want, names)
    odd = [(c, k, types[c]) for c, k in df.dtypes if (k in ("bigint", "int") and types[c] not in ("BIGINT", "INTEGER", "NUMBER")) or (k == "double" and types[c] not in ("DOUBLE", "NUMBER"))]
    if a != b:
        sa, sb = set(a), set(b)
        return False, f"rows {len(a)} vs {len(b)}; only spark {sorted(sa - sb)[:3]}; only sql {sorted(sb - sa)[:3]}; types {odd}", t_spark, t_sql
    return True, f"{len(a)} rows" + (f" types {odd}" if odd else ""), t_spark, t_sql


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tidegauge.session import local_session

    args = sys.argv[1:]
    sf = args[0] if args else "/root/testdata/sf0.01"
    runs, sqls = queries(), oracle_sql()
    names = args[1:] or list(runs)
    names = [n for n in names if n in runs] if len(args) > 1 else names
    spark, con = local_session("8"), connect(sf)
    bad = 0
    for n in names:
        try:
            ok, msg, ts, td = compare(spark, con, runs[n], sqls.get(n), sf)
        except Exception as e:  # noqa: BLE001
            ok, msg, ts, td = False, f"{type(e).__name__}: {str(e)[:1500]}", 0, 0
        bad += not ok
        print(f"{'ok  ' if ok else 'BAD '} {n:32s} spark {ts:6.2f}s sql {td:6.2f}s {msg}", flush=True)
    print(f"{len(names)} queries, {bad} bad")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
