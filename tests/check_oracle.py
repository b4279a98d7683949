"""Compare registered queries with their SQL in DuckDB: `python tests/check_oracle.py [sf] [name ...]`."""

import glob
import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def canonical(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if hasattr(v, "tolist") and not isinstance(v, (int, float)):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(canonical(x) for x in v) + "]"
    if isinstance(v, float):
        return repr(v + 0.0) if v != int(v) else str(int(v))
    return str(v)


def lines(frame):
    cols = sorted(frame.columns)
    return sorted("|".join(canonical(v) for v in row) for row in frame[cols].astype(object).itertuples(index=False))


def kind(dtype_frame, c):
    return str(dtype_frame[c].dtype)


def compare(spark_df, sql, con):
    got = spark_df.toPandas()
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(set(got.columns) ^ set(want.columns))}", len(got)
    a, b = lines(got), lines(want)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}", len(got)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ, first\n   {bad[0][0]}\n   {bad[0][1]}", len(got)
    return None, len(got)


if __name__ == "__main__":
    from wavelark.plans import ORACLES, QUERIES
    from pyspark.sql import SparkSession

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    names = sys.argv[2:] or list(QUERIES)
    names = [q for q in QUERIES if any(q == n or (n.endswith("*") and q.startswith(n[:-1])) for n in names)]
    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config(
        "spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"/root/testdata/sf{sf}"
    con = duck(sf_dir)
    failed = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                problem, n = compare(df, ORACLES[name], con)
            else:
                n = df.count()
                problem = None if n else "no rows"
        except Exception as e:
            problem, n = f"{type(e).__name__}: {str(e)[:600]}", 0
        failed += problem is not None
        mark = "ok  " if problem is None else "FAIL"
        print(f"{mark} {name} rows={n} {time.time() - start:.1f}s {'' if name in ORACLES else '(rows only)'} {(problem or '')[:900]}", flush=True)
    print("failed", failed, "of", len(names))
