"""Run queries and their SQL twins side by side and compare rows as values.

    python tests/oracle_check.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import datetime as dt
import decimal
import math
import os
import sys
import tempfile
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations").split()


def make_spark(cores: str = "8"):
    from pyspark.sql import SparkSession

    scratch = os.environ.get("FINEGRID_SCRATCH") or tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("finegrid-check").config("spark.sql.shuffle.partitions", "8")
             .config("spark.checkpoint.dir", scratch).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None if v is None else "NaN"
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return ("dec", str(v))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (dt.date, str, int, float)):
        return v.isoformat() if isinstance(v, dt.date) else v
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return repr(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((repr([plain(r[i]) for i in order]) for r in rows)), sorted(cols)


def compare(spark, con, query, sf_dir):
    """Empty text when both sides agree, else what differs; also row count and seconds."""
    t = time.time()
    df = query.run(spark, sf_dir)
    got, cols = rows_of(df.columns, [tuple(r) for r in df.collect()])
    sec = time.time() - t
    if query.sql is None:
        return "", len(got), sec
    rel = con.execute(query.sql)
    want, wcols = rows_of([d[0] for d in rel.description], rel.fetchall())
    if cols != wcols:
        return f"columns {cols} != {wcols}", len(got), sec
    if got != want:
        only_s, only_d = [r for r in got if r not in set(want)], [r for r in want if r not in set(got)]
        return f"rows {len(got)} vs {len(want)}; spark only {len(only_s)}: {only_s[:3]}; sql only {len(only_d)}: {only_d[:3]}", len(got), sec
    return "", len(got), sec


def connect(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def main():
    from finegrid.plans.catalog import all_queries

    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--module", default=None)
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    spark, con, bad, total = make_spark(), connect(a.sf), 0, 0.0
    for name, q in all_queries().items():
        if a.names and name not in a.names:
            continue
        try:
            diff, n, sec = compare(spark, con, q, a.sf)
        except Exception as exc:  # noqa: BLE001
            diff, n, sec = f"{type(exc).__name__}: {str(exc)[:900]}", -1, 0.0
            if os.environ.get("TRACE"):
                traceback.print_exc()
        total += sec
        bad += bool(diff)
        print(f"{'BAD ' if diff else 'ok  '}{name:32s} rows={n:<8d} {sec:6.2f}s {'' if q.sql else '(rows only) '}{diff}", flush=True)
    print(f"{bad} bad, {total:.1f}s")


if __name__ == "__main__":
    main()
