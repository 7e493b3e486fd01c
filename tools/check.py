"""Run registered queries and their SQL side by side: check.py [sf_dir] [name-part ...]."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from suite import REGISTRY  # noqa: E402
from suite.common import TABLES  # noqa: E402


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(normal(r[i]) for i in order)) for r in rows)


def connect(sf_dir):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def compare(spark, db, sf_dir, name):
    """(ok, message, spark seconds, SQL seconds)."""
    q = REGISTRY[name]
    start = time.time()
    df = q.run(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - start
    if q.sql is None:
        return True, f"rows only, {len(got)} rows", took, 0.0
    start = time.time()
    cursor = db.execute(q.sql)
    columns = [d[0] for d in cursor.description]
    want = rows_of(columns, cursor.fetchall())
    sql_took = time.time() - start
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}", took, sql_took
    if got == want:
        return True, f"{len(got)} rows", took, sql_took
    a, b = [x for x in got if x not in set(want)], [x for x in want if x not in set(got)]
    return False, f"{len(got)} vs {len(want)} rows; ours {a[:3]} theirs {b[:3]}", took, sql_took


def main():
    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [n for n in REGISTRY if not args or any(a in n for a in args)]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    db, failed = connect(sf_dir), []
    for name in names:
        try:
            ok, message, took, sql_took = compare(spark, db, sf_dir, name)
        except Exception:
            ok, message, took, sql_took = False, traceback.format_exc()[-1500:], 0.0, 0.0
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {took:6.2f}s sql {sql_took:6.2f}s  {message[:1500]}", flush=True)
    print(f"{len(names) - len(failed)} of {len(names)} agree", failed)
    spark.stop()


if __name__ == "__main__":
    main()
