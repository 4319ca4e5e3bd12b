"""Compare queries with their SQL on one data folder: ``python tests/verify.py [DIR] [NAME...]``."""

import hashlib
import math
import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def cell(x):
    if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
        return "∅"
    if isinstance(x, bool):
        return str(x)
    if hasattr(x, "item"):
        return cell(x.item())
    if isinstance(x, float):
        return f"{x:.6g}" if x != int(x) or abs(x) > 1e15 else str(int(x))
    if isinstance(x, (list, tuple)):
        return "[" + ",".join(map(cell, x)) + "]"
    if hasattr(x, "to_pydatetime"):
        x = x.to_pydatetime()
    return str(x)


def digest(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(cell(r[i]) for i in order) for r in rows)
    return hashlib.md5("\n".join(lines).encode()).hexdigest(), lines


def connect(d):
    con = duckdb.connect()
    for p in Path(d).glob("*.parquet"):
        files = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{files}'")
    return con


def compare(spark, con, d, name, query, sql, verbose=True):
    began = time.time()
    df = query(spark, d)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - began
    if sql is None:
        return True, f"{name}: {len(rows)} rows, {took:.1f} s, no SQL"
    res = con.execute(sql)
    columns = [c[0] for c in res.description]
    want = res.fetchall()
    if sorted(columns) != sorted(df.columns):
        return False, f"{name}: columns {sorted(df.columns)} against {sorted(columns)}"
    (a, x), (b, y) = digest(rows, df.columns), digest(want, columns)
    if a != b and verbose:
        only = [sorted(set(x) - set(y))[:3], sorted(set(y) - set(x))[:3]]
        return False, f"{name}: DIFFERS, {len(rows)} and {len(want)} rows; only here {only[0]}, only SQL {only[1]}"
    return a == b, f"{name}: {len(rows)} rows, {took:.1f} s, {'equal' if a == b else 'DIFFERS'}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    d = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(d), e.oracle_sql(), 0
    for name, query in e.queries().items():
        if len(sys.argv) > 2 and not any(name.startswith(n) for n in sys.argv[2:]):
            continue
        try:
            ok, text = compare(spark, con, d, name, query, sqls.get(name))
        except Exception as x:  # noqa: BLE001
            ok, text = False, f"{name}: {type(x).__name__} {str(x)[:600]}"
        bad += not ok
        print(("ok   " if ok else "FAIL ") + text, flush=True)
    print("failed:", bad)
