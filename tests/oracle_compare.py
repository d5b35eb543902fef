"""Run registered Spark queries next to their DuckDB oracle SQL and compare.

Usage: ``python tests/oracle_compare.py [sf_dir] [name ...]``. Comparison is
order-insensitive over rows, columns sorted by name (as the driver does).
"""
from __future__ import annotations

import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck_connect(sf_dir: str):
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
            return "nan"
        return round(v, 6)
    if hasattr(v, "item"):
        return v.item()
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark, con, name: str, fn, sql: str | None, sf_dir: str) -> dict:
    t0 = time.time()
    df = fn(spark, sf_dir)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    res = {"name": name, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    if not sql:
        res["status"] = "rows-only"
        return res
    rel = con.execute(sql)
    d_cols = [d[0] for d in rel.description]
    d_rows = rel.fetchall()
    res["duck_rows"] = len(d_rows)
    if sorted(s_cols) != sorted(d_cols):
        res["status"] = "COLUMNS " + str(sorted(set(s_cols) ^ set(d_cols)))
        return res
    a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
    if a == b:
        res["status"] = "ok"
    else:
        res["status"] = "VALUES"
        cols = sorted(s_cols)
        diffs = [(x, y) for x, y in zip(a, b) if x != y][:2]
        for x, y in diffs:
            res.setdefault("diff", []).append(
                {c: (p, q) for c, p, q in zip(cols, x, y) if p != q})
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    from creditlake.session import get_spark
    import __spark_entry__ as E
    spark = get_spark("local[8]", shuffle_partitions=8, extra={"spark.driver.memory": "8g"})
    q = E.queries()
    o = E.oracle_sql()
    con = duck_connect(sf_dir)
    bad = 0
    for name in (names or sorted(q)):
        try:
            r = compare(spark, con, name, q[name], o.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            r = {"name": name, "status": "ERROR " + str(e).splitlines()[0][:300]}
        bad += r["status"] not in ("ok", "rows-only")
        print(r, flush=True)
    print(f"{len(names or q) - bad}/{len(names or q)} fine")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
