"""Side-by-side run of registered queries and their DuckDB counterparts."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(0.0 if v == 0 else v)
    if isinstance(v, int):
        return str(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    t1 = time.time()
    if sql is None:
        return f"rows-only n={len(got[1])}", t1 - t0, len(got[1]) > 0
    rel = con.execute(sql)
    want = rows_of([x[0] for x in rel.description], rel.fetchall())
    if got[0] != want[0]:
        return f"COLUMNS {got[0]} != {want[0]}", t1 - t0, False
    if len(got[1]) != len(want[1]):
        return f"ROWS {len(got[1])} != {len(want[1])}", t1 - t0, False
    if got[1] != want[1]:
        bad = [(a, b) for a, b in zip(got[1], want[1]) if a != b]
        return f"VALUES {len(bad)} differ, first {bad[0]}", t1 - t0, False
    return f"ok n={len(got[1])}", t1 - t0, True


def main(names, sf_dir="/root/testdata/sf0.01"):
    sys.path.insert(0, ".")
    import __spark_entry__ as e
    from flowloom.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, q, o = connect(sf_dir), e.queries(), e.oracle_sql()
    bad = []
    for n in q:
        if names and n not in names:
            continue
        try:
            msg, sec, ok = compare(spark, con, n, q[n], o.get(n), sf_dir)
        except Exception as x:  # noqa: BLE001
            msg, sec, ok = f"ERROR {type(x).__name__}: {str(x)[:600]}", 0.0, False
        if not ok:
            bad.append(n)
        print(f"{'PASS' if ok else 'FAIL'} {n} {sec:.2f}s {msg[:900]}", flush=True)
    print(len(q), "queries,", len(bad), "failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
