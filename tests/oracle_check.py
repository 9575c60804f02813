"""Side-by-side check of every registered query against its DuckDB oracle.

Usage: python tests/oracle_check.py [sf_dir] [key ...]
Prints one line per key: OK / MISMATCH with row counts and column names.
"""
from __future__ import annotations

import datetime
import decimal
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return v


def canon(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 and os.path.isdir(sys.argv[1]) else "/root/testdata/sf0.01"
    keys = [a for a in sys.argv[1:] if not os.path.isdir(a)]
    import __spark_entry__ as E
    from auditspark.session import build_session
    spark = build_session("local[8]", 8)
    qs, sql = E.queries(), E.oracle_sql()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    bad = 0
    for k in keys or sorted(qs):
        t0 = time.time()
        try:
            df = qs[k](spark, sf)
            cols = df.columns
            rows = [tuple(r) for r in df.collect()]
            ts = time.time() - t0
            if k not in sql:
                print(f"ROWS-ONLY {k}: {len(rows)} rows {ts:.1f}s", flush=True)
                continue
            res = con.execute(sql[k])
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
            ok = sorted(cols) == sorted(dcols) and canon(rows, cols) == canon(drows, dcols)
            spark_t = dict(df.dtypes)
            duck_t = {d[0]: str(d[1]).upper() for d in res.description}
            fam = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
                   "boolean": "BOOLEAN", "smallint": "SMALLINT", "float": "FLOAT"}
            tdiff = [(c, spark_t[c], duck_t.get(c)) for c in cols
                     if spark_t[c] in fam and duck_t.get(c) and fam[spark_t[c]] != duck_t[c]]
            if tdiff:
                print(f"   TYPES {k}: {tdiff}")
            print(f"{'OK' if ok else 'MISMATCH'} {k}: spark={len(rows)} duck={len(drows)} {ts:.1f}s", flush=True)
            if not ok:
                bad += 1
                if sorted(cols) != sorted(dcols):
                    print("   cols", sorted(cols), sorted(dcols))
                else:
                    a, b = canon(rows, cols), canon(drows, dcols)
                    sa, sb = set(a), set(b)
                    print("   spark-only", list(sa - sb)[:3])
                    print("   duck-only ", list(sb - sa)[:3])
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"ERROR {k}: {type(e).__name__}: {str(e)[:600]}", flush=True)
    print("bad", bad)


if __name__ == "__main__":
    main()
