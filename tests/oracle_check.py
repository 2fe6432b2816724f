"""Run registered queries against their DuckDB oracles (as the driver does).

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query: name, rows (spark/oracle), match.
"""

from __future__ import annotations

import math
import os
import sys
import time
from datetime import datetime
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if v is None:
        return "<null>"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, Decimal)):
        f = float(v)
        if math.isnan(f):
            return "nan"
        return f"{f:.6g}"
    if isinstance(v, int):
        return str(v)
    if isinstance(v, datetime):
        return v.isoformat(sep=" ")
    return str(v)


def canon(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows), sorted(cols)


def duck_conn(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"create view {t} as select * from read_parquet('{p}')")
    return con


def compare(spark, name, fn, sql, sf_dir, con):
    t = time.time()
    sdf = fn(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    st = time.time() - t
    if sql is None:
        return dict(name=name, spark_rows=len(srows), oracle_rows=None, match=None, sec=st)
    t = time.time()
    res = con.execute(sql)
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    ot = time.time() - t
    a, ac = canon(scols, srows)
    b, bc = canon(ocols, orows)
    ok = ac == bc and a == b
    out = dict(name=name, spark_rows=len(srows), oracle_rows=len(orows), match=ok, sec=round(st, 2), osec=round(ot, 2))
    if not ok:
        out["cols"] = (ac, bc)
        diff_a = [r for r in a if r not in set(b)][:3]
        diff_b = [r for r in b if r not in set(a)][:3]
        out["spark_only"] = diff_a
        out["oracle_only"] = diff_b
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as entry
    from callroute import get_spark

    spark = get_spark("local[8]", **{"spark.sql.shuffle.partitions": "8"})
    qs = entry.queries()
    oracles = entry.oracle_sql()
    con = duck_conn(sf_dir)
    bad = 0
    for name in names or list(qs):
        try:
            r = compare(spark, name, qs[name], oracles.get(name), sf_dir, con)
        except Exception as e:  # report and continue
            r = dict(name=name, error=repr(e)[:600])
        if r.get("match") is False or "error" in r:
            bad += 1
        print(r, flush=True)
    print("FAILED" if bad else "ALL OK", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
