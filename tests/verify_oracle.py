"""Compare queries with their SQL in DuckDB: python tests/verify_oracle.py SF_DIR [NAME...]"""

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import numpy as np  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from tideline.session import get_spark  # noqa: E402


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if hasattr(v, "asDict"):
        return tuple(plain(x) for x in v)
    if isinstance(v, bytearray):
        return bytes(v)
    if hasattr(v, "isoformat"):
        return str(v)[:26]
    return v


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        at = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{at}'")
    return con


def compare(spark, con, sf_dir, name, sql):
    began = time.time()
    df = entry.queries()[name](spark, sf_dir)
    got = df.collect()
    took = time.time() - began
    if sql is None:
        return f"rows {len(got)} (no SQL) {took:.1f}s", True
    rel = con.sql(sql)
    want, columns = rel.fetchall(), rel.columns
    if sorted(df.columns) != sorted(columns):
        return f"columns differ: {df.columns} {columns}", False
    a, b = bag(df.columns, got), bag(columns, want)
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return f"DIFFER rows {len(a)} {len(b)}; first {bad}"[:1500], False
    types = {d.name: d.dataType.simpleString() for d in df.schema}
    return f"ok rows {len(a)} {took:.1f}s {[(c, types[c], str(t)) for c, t in zip(columns, rel.types) if ('HUGE' in str(t))] or ''}", True


if __name__ == "__main__":
    sf = sys.argv[1]
    spark = get_spark("verify")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connect(sf), entry.oracle_sql(), []
    for name in sys.argv[2:] or entry.queries():
        try:
            said, ok = compare(spark, con, sf, name, sqls.get(name))
        except Exception as e:  # noqa: BLE001
            said, ok = f"ERROR {type(e).__name__} {str(e)[:1500]}", False
        print(name, said, flush=True)
        failed += [name] * (not ok)
    print("failed:", failed)
