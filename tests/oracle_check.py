"""Compare catalog queries with their DuckDB oracle (like the driver does).

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, dt.datetime):
        return v.isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and v.is_integer() and abs(v) < 2**53:
        return float(v)
    return v


def rows_of(cols, records):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in records]
    return sorted(out, key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0)
                                           for x in t))


def compare(spark, sf_dir, name, fn, sql, con):
    t0 = time.time()
    df = fn(spark, sf_dir)
    srows = df.collect()
    t1 = time.time()
    scols = df.columns
    rel = con.sql(sql)
    dcols = rel.columns
    drows = rel.fetchall()
    res = {"name": name, "spark_rows": len(srows), "oracle_rows": len(drows),
           "spark_sec": round(t1 - t0, 2)}
    if sorted(scols) != sorted(dcols):
        res["error"] = f"columns differ: {scols} vs {dcols}"
        return res
    a = rows_of(scols, [tuple(r) for r in srows])
    b = rows_of(dcols, drows)
    res["match"] = a == b
    if not res["match"]:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:3]
        res["first_diffs"] = diff
    return res


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    import __spark_entry__ as E
    from tillroll.session import build_session
    spark = build_session("local[8]", shuffle_partitions=8)
    # e.g. TILLROLL_SESSION_TZ=America/Sao_Paulo: results must not depend on it
    if os.environ.get("TILLROLL_SESSION_TZ"):
        spark.conf.set("spark.sql.session.timeZone", os.environ["TILLROLL_SESSION_TZ"])
    # e.g. TILLROLL_BUCKET_ROWS=200 ranks in many small buckets
    if os.environ.get("TILLROLL_BUCKET_ROWS"):
        spark.conf.set("tillroll.ranking.bucketRows", os.environ["TILLROLL_BUCKET_ROWS"])
    con = duck(sf_dir)
    qs, ors = E.queries(), E.oracle_sql()
    bad = 0
    for name in names or sorted(qs):
        if name not in ors:
            print({"name": name, "oracle": "none"})
            continue
        r = compare(spark, sf_dir, name, qs[name], ors[name], con)
        bad += not r.get("match")
        print(r, flush=True)
    print("mismatches:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
