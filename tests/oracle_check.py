"""Run registered queries on Spark and their SQL twins on DuckDB and compare.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
Mirrors the driver's gate: row count, column names, and values (rows sorted,
doubles compared to a relative tolerance; exact-equality is reported too).
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return (0, "")
    if isinstance(v, bool):
        return (1, int(v))
    if isinstance(v, float):
        if math.isnan(v):
            return (0, "nan")
        return (1, v)
    if isinstance(v, int):
        return (1, float(v))
    if hasattr(v, "isoformat"):
        return (2, v.isoformat()[:10] if type(v).__name__ == "date" else v.isoformat())
    if isinstance(v, (list, tuple)):
        return (3, tuple(_norm(x) for x in v))
    return (4, str(v))


def _close(a, b, rel=1e-9, abs_=1e-9):
    if a[0] != b[0]:
        return False
    if a[0] == 1:
        return math.isclose(a[1], b[1], rel_tol=rel, abs_tol=abs_)
    if a[0] == 3:
        return len(a[1]) == len(b[1]) and all(_close(x, y, rel, abs_) for x, y in zip(a[1], b[1]))
    return a == b


def compare(spark, con, name, fn, sql, sf_dir, rel=1e-9):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = con.execute(sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    t2 = time.time()
    out = {"name": name, "spark_s": round(t1 - t0, 2), "duck_s": round(t2 - t1, 2),
           "rows": (len(s_rows), len(d_rows))}
    if sorted(s_cols) != sorted(d_cols):
        out["status"] = f"COLUMNS {sorted(s_cols)} vs {sorted(d_cols)}"
        return out
    order = sorted(range(len(s_cols)), key=lambda i: s_cols[i])
    d_idx = {c: i for i, c in enumerate(d_cols)}
    srows = sorted(tuple(_norm(r[i]) for i in order) for r in s_rows)
    drows = sorted(tuple(_norm(r[d_idx[s_cols[i]]]) for i in order) for r in d_rows)
    if len(srows) != len(drows):
        out["status"] = "ROWCOUNT"
        return out
    exact = srows == drows
    bad = [(a, b) for a, b in zip(srows, drows) if not all(_close(x, y, rel) for x, y in zip(a, b))]
    out["status"] = "OK" if not bad else f"VALUES {len(bad)} rows differ, e.g. {bad[0]}"
    out["exact"] = exact
    return out


def main(argv):
    sys.path.insert(0, ".")
    import __spark_entry__ as E
    from pricewise.session import build_session
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    spark = build_session("local[8]", shuffle_partitions=8)
    con = duck(sf_dir)
    qs, sqls = E.queries(), E.oracle_sql()
    for name in names or sorted(qs):
        if name not in sqls:
            n = qs[name](spark, sf_dir).count()
            print({"name": name, "status": "NO-SQL", "rows": n}, flush=True)
            continue
        try:
            print(compare(spark, con, name, qs[name], sqls[name], sf_dir), flush=True)
        except Exception as e:  # report and go on
            print({"name": name, "status": f"ERROR {type(e).__name__}: {str(e)[:400]}"}, flush=True)


if __name__ == "__main__":
    main(sys.argv)
