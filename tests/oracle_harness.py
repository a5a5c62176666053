"""Run registered queries in Spark and their DuckDB oracle side by side and compare.

Comparison mirrors the driver's gate: same column names (sorted), same row count, same
order-insensitive multiset of rows (doubles compared after rounding to 6 places).

    python tests/oracle_harness.py /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _canon(v):
    if v is None:
        return "null"
    if isinstance(v, float):
        if math.isnan(v):
            return "null"
        return repr(round(v, 6) + 0.0)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_canon(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{_canon(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, bool):
        return str(v).lower()
    return str(v)


def canon_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(_canon(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf):
    t0 = time.time()
    sdf = fn(spark, sf)
    srows = [tuple(r) for r in sdf.collect()]
    scols = sdf.columns
    t1 = time.time()
    if sql is None:
        return {"name": name, "status": "rows-only", "rows": len(srows), "spark_s": round(t1 - t0, 2)}
    res = con.sql(sql)
    dcols = res.columns
    drows = res.fetchall()
    t2 = time.time()
    out = {"name": name, "rows": len(srows), "oracle_rows": len(drows), "spark_s": round(t1 - t0, 2), "duck_s": round(t2 - t1, 2)}
    if sorted(scols) != sorted(dcols):
        out["status"] = f"SCHEMA {sorted(scols)} vs {sorted(dcols)}"
        return out
    dmap = [dcols.index(c) for c in scols]
    drows = [tuple(r[i] for i in dmap) for r in drows]
    a, b = canon_rows(scols, srows), canon_rows(scols, drows)
    if len(a) != len(b):
        out["status"] = "ROWCOUNT"
    elif a != b:
        diff = [(x, y) for x, y in zip(a, b) if x != y][:2]
        out["status"] = f"VALUES {diff}"
    else:
        out["status"] = "ok"
    return out


def main(argv):
    sf = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:]
    from tonegauge.session import get_spark
    from tonegauge.plans import registry
    registry.load_all()
    spark = get_spark(master="local[8]", shuffle_partitions=8)
    con = duck(sf)
    bad = 0
    for name, fn in registry.QUERIES.items():
        if names and name not in names and not any(name.startswith(n.rstrip("*")) for n in names if n.endswith("*")):
            continue
        try:
            r = compare(spark, con, name, fn, registry.ORACLE.get(name), sf)
        except Exception as e:  # report and continue
            r = {"name": name, "status": "ERROR " + repr(e)[:400]}
            traceback.print_exc()
        if r["status"] not in ("ok", "rows-only"):
            bad += 1
        print(r, flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
