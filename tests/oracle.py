"""Run registered queries on Spark and their SQL on DuckDB, and compare whole results."""

from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return f"{v:.9g}" if v != 0 else "0"
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 10**9 else str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v) if v is not None else "<null>"


def duck(sf_dir):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def compare(spark, con, name, fn, sql, sf_dir):
    t = time.time()
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = Counter(tuple(norm(x) for x in row) for row in df.select(*cols).collect())
    took = f"spark {time.time() - t:.1f}s"
    if sql is None:
        return f"{took} rows={sum(got.values())}", None
    rel = con.sql(sql)
    if sorted(rel.columns) != cols:
        return f"COLUMNS spark={cols} sql={sorted(rel.columns)}", False
    order = [rel.columns.index(c) for c in cols]
    want = Counter(tuple(norm(row[i]) for i in order) for row in rel.fetchall())
    if got == want:
        return f"{took} ok rows={sum(got.values())}", True
    a, b = got - want, want - got
    return (
        f"DIFF spark={sum(got.values())} sql={sum(want.values())} cols={cols}\n    only spark {sum(a.values())}: {list(a)[:3]}\n    only sql   {sum(b.values())}: {list(b)[:3]}",
        False,
    )


def main(argv):
    import os

    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries
    from sigweave.session import build_session

    sf = "/root/testdata/sf0.01"
    pats = [a for a in argv if not a.startswith("--")]
    for a in argv:
        if a.startswith("--sf="):
            sf = f"/root/testdata/sf{a[5:]}"
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    qs, os_ = queries(), oracle_sql()
    bad = 0
    for n, fn in qs.items():
        if pats and not any(n.startswith(p) for p in pats):
            continue
        t = time.time()
        try:
            msg, ok = compare(spark, con, n, fn, os_.get(n), sf)
        except Exception as e:  # noqa: BLE001
            msg, ok = f"ERROR {type(e).__name__}: {str(e)[:700]}", False
        bad += ok is False
        print(f"{n:28} {time.time() - t:5.1f}s {msg}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
