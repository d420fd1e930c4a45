"""Run a registered Spark query and its DuckDB oracle side by side and compare
row count, column names and the order-insensitive multiset of values.

Usage: python tests/oracle_compare.py [sf_dir] [key ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
from collections import Counter

import duckdb

HERE = os.path.dirname(os.path.abspath(__file__))
ROOT = os.path.dirname(HERE)
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"create view {t} as select * from read_parquet('{path}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v) if os.environ.get("EXACT_FLOATS") else float(f"{v:.12g}")
    if isinstance(v, decimal.Decimal):
        return format(v.normalize(), "f") if v == v.to_integral() else str(v.normalize())
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


def rows_of(columns: list[str], records) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_norm(r[i]) for i in order) for r in records)


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "float": "FLOAT", "string": "VARCHAR",
                 "date": "DATE", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP WITH TIME ZONE",
                 "timestamp_ntz": "TIMESTAMP", "smallint": "SMALLINT", "tinyint": "TINYINT"}


def spark_type_as_duck(simple: str) -> str:
    if simple.startswith("decimal"):
        return simple.upper()
    return SPARK_TO_DUCK.get(simple, simple.upper())


def compare(spark, key: str, sf_dir: str, con=None) -> dict:
    from marginkit import catalog, oracle

    t0 = time.time()
    sdf = catalog.queries()[key](spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    sql = oracle.oracle_sql().get(key)
    out = {"key": key, "spark_rows": len(s_rows), "spark_sec": round(t1 - t0, 2)}
    if sql is None:
        out["status"] = "rows-only"
        return out
    con = con or duck(sf_dir)
    res = con.execute(sql)
    o_cols = [d[0] for d in res.description]
    o_rows = res.fetchall()
    out["oracle_rows"] = len(o_rows)
    s_types = {f.name: spark_type_as_duck(f.dataType.simpleString()) for f in sdf.schema.fields}
    o_types = dict(zip(o_cols, (str(t) for t in con.sql(f"select * from ({sql}) limit 0").types)))
    type_diff = {c: (s_types.get(c), o_types.get(c)) for c in o_cols if s_types.get(c) != o_types.get(c)}
    if type_diff:
        out["type_diff"] = type_diff
    same_cols = sorted(s_cols) == sorted(o_cols)
    same = same_cols and rows_of(s_cols, s_rows) == rows_of(o_cols, o_rows)
    out["status"] = "match" if same else "MISMATCH"
    if not same_cols:
        out["columns"] = (sorted(s_cols), sorted(o_cols))
    elif not same:
        a, b = rows_of(s_cols, s_rows), rows_of(o_cols, o_rows)
        out["only_spark"] = list((a - b).elements())[:3]
        out["only_oracle"] = list((b - a).elements())[:3]
    return out


def main(argv: list[str]) -> int:
    from marginkit import build_session, catalog

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    keys = argv[1:] or list(catalog.queries())
    spark = build_session("local[8]", 8)
    con = duck(sf_dir)
    bad = 0
    for k in keys:
        try:
            r = compare(spark, k, sf_dir, con)
        except Exception as e:  # report and continue with the next key
            r = {"key": k, "status": "ERROR", "error": repr(e)[:400]}
        bad += r["status"] in ("MISMATCH", "ERROR")
        print(r, flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
