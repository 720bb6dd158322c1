"""Run registered queries against their DuckDB oracles (dev tool and test helper).

usage: python tests/oracle_check.py [sf_dir] [key ...]
"""
from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "asDict"):
        return tuple(norm(x) for x in v)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), norm(x)) for k, x in v.items()))
    return v


def compare(spark, con, key, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = sdf.collect()
    t1 = time.time()
    scols = sdf.columns
    if sql is None:
        return dict(key=key, ok=None, rows=len(srows), sec=round(t1 - t0, 2), note="no oracle")
    rel = con.sql(sql)
    dcols = rel.columns
    drows = rel.fetchall()
    if sorted(scols) != sorted(dcols):
        return dict(key=key, ok=False, note=f"cols spark={scols} duck={dcols}")
    order = sorted(scols)
    si = [scols.index(c) for c in order]
    di = [dcols.index(c) for c in order]
    a = sorted((tuple(norm(r[i]) for i in si) for r in srows), key=repr)
    b = sorted((tuple(norm(r[i]) for i in di) for r in drows), key=repr)
    if len(a) != len(b):
        return dict(key=key, ok=False, note=f"rows spark={len(a)} duck={len(b)}")
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return dict(key=key, ok=False, note=f"{len(bad)} rows differ, e.g. {repr(bad[0])[:600]}")
    return dict(key=key, ok=True, rows=len(a), sec=round(t1 - t0, 2))


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    keys = argv[2:]
    import __spark_entry__ as E
    from textlab.session import get_session
    spark = get_session("local[8]")
    con = duck(sf_dir)
    qs, os_ = E.queries(), E.oracle_sql()
    keys = keys or sorted(qs)
    bad = 0
    for k in keys:
        try:
            res = compare(spark, con, k, qs[k], os_.get(k), sf_dir)
        except Exception as e:  # report and go on
            res = dict(key=k, ok=False, note=f"{type(e).__name__}: {str(e)[:800]}")
        bad += res.get("ok") is False
        print(res, flush=True)
    print(f"{len(keys)} keys, {bad} failing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
