"""Run registered queries in Spark and their oracle SQL in DuckDB, compare results.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Prints one line per query: status, row counts, first differing row if any.
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from quire.plans.driver import TABLES  # noqa: E402


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return v
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    return v


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr), [cols[i] for i in order]


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    df = fn(spark, sf_dir)
    srows = [tuple(r) for r in df.collect()]
    scols = df.columns
    t1 = time.time()
    if sql is None:
        return f"ROWS  {name}: spark={len(srows)} ({t1 - t0:.1f}s, no oracle)"
    dtypes = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    bad_types = [(c, t, dtypes.get(c)) for c, t in df.dtypes if SPARK_TO_DUCK.get(t, t) != dtypes.get(c)]
    if bad_types:
        return f"FAIL  {name}: column types differ (spark, duck): {bad_types}"
    res = con.execute(sql)
    dcols = [d[0] for d in res.description]
    drows = res.fetchall()
    a, ac = rows_of(scols, srows)
    b, bc = rows_of(dcols, drows)
    if ac != bc:
        return f"FAIL  {name}: columns spark={ac} duck={bc}"
    if a == b:
        return f"OK    {name}: {len(a)} rows ({t1 - t0:.1f}s)"
    diff = next(((x, y) for x, y in zip(a, b) if x != y), None)
    return f"FAIL  {name}: spark={len(a)} duck={len(b)} cols={ac}\n   first diff spark={diff[0] if diff else None}\n              duck ={diff[1] if diff else None}"


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    import __spark_entry__ as E
    from quire.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in sorted(qs.items()):
        if names and name not in names:
            continue
        try:
            line = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as e:  # report and go on
            line = f"ERROR {name}: {type(e).__name__}: {str(e)[:600]}"
        if not line.startswith(("OK", "ROWS")):
            bad += 1
        print(line, flush=True)
    print(f"done: {len(qs)} queries, {bad} not ok")


if __name__ == "__main__":
    main()
