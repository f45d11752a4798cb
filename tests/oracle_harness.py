"""Run catalog queries in Spark and their oracle SQL in DuckDB and compare.

Usage: python tests/oracle_harness.py [sf_dir] [query ...]
Compares column names (sorted), row count and the order-insensitive multiset
of rows (exact values; rows are normalised like the driver's value hash).
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return v
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in records), key=repr)


def compare(spark, sf_dir, name, build, sql, con):
    t0 = time.time()
    sdf = build(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    ts = time.time() - t0
    res = {"query": name, "spark_rows": len(s_rows), "spark_sec": round(ts, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    d = con.execute(sql)
    d_cols = [c[0] for c in d.description]
    d_rows = d.fetchall()
    res["oracle_rows"] = len(d_rows)
    if sorted(s_cols) != sorted(d_cols):
        res["status"] = f"COLUMNS {sorted(s_cols)} vs {sorted(d_cols)}"
        return res
    a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
    if a == b:
        res["status"] = "match"
    else:
        diff_a = [x for x in a if x not in set(b)][:3]
        diff_b = [x for x in b if x not in set(a)][:3]
        res["status"] = "MISMATCH"
        res["cols"] = sorted(s_cols)
        res["spark_only"] = diff_a
        res["oracle_only"] = diff_b
    return res


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    only = set(args[1:])
    from mmcohort.session import local_session
    import __spark_entry__ as E

    spark = local_session(8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, build in qs.items():
        if only and name not in only:
            continue
        try:
            res = compare(spark, sf_dir, name, build, sqls.get(name), con)
        except Exception as exc:  # report and go on
            res = {"query": name, "status": f"ERROR {type(exc).__name__}: {str(exc)[:400]}"}
        if res["status"] not in ("match", "rows-only"):
            bad += 1
        print(res, flush=True)
    print(f"{len(qs) if not only else len(only)} queries, {bad} not matching")
    spark.stop()


if __name__ == "__main__":
    main()
