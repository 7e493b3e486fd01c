"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from suite import REGISTRY  # noqa: E402
from lakeweave.plans import jobs  # noqa: E402
from lakeweave.session import release  # noqa: E402
from suite import common as C  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# profile_store builds the stores that the queries after it read, as ingest would.
QUERIES = (
    "catalog_tables",
    "column_ratios",
    "numeric_stats",
    "top_values",
    "document_terms",
    "document_neighbours",
    "vector_top_k",
    "l1_candidates",
    "l2_candidates",
    "discover_join",
    "discover_union",
    "column_pairs_top",
    "match_one_to_one",
    "integrate_union",
    "ingest_dedup",
    "timeline",
    "graph_edges",
)


def run(spark, name: str) -> None:
    """Compute every row of a query without bringing it to the driver."""
    REGISTRY[name].run(spark, SF_DIR).write.format("noop").mode("overwrite").save()


def one_of_each(spark) -> dict[str, float]:
    """Seconds of a single warm query of each job."""
    store = C.store(spark, SF_DIR)
    table = store.tables.filter("table_id = 'orders_0'").selectExpr("table_id AS query_id", "tenant_id", "'JOIN' AS subtask")
    pair = store.tables.filter("table_id = 'orders_0'").selectExpr(
        "table_id AS source_table_id", "'orders_1' AS target_table_id"
    )
    runs = {
        "one_discover": lambda: jobs.discover(table, store).ranking,
        "one_integrate": lambda: jobs.integrate(table, store)[1],
        "one_match": lambda: jobs.match(pair, store),
    }
    times = {}
    for name, make in runs.items():
        for _ in range(2):  # the second one is warm
            start = time.time()
            make().write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    return times


def main() -> None:
    work = tempfile.mkdtemp(prefix="lakeweave-bench-")
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("lakeweave-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", work)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    start = time.time()
    stores = C.store(spark, SF_DIR), C.base_store(spark, SF_DIR)
    times["profile_store"] = round(time.time() - start, 3)
    tables = sum(s.tables.count() for s in stores)
    for name in QUERIES:
        start = time.time()
        run(spark, name)
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    profiling = times.pop("profile_store")
    single = one_of_each(spark)
    print(
        json.dumps(
            {
                "metric": "total time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "profile_store": profiling,
                "single_queries": single,
                "tables_profiled_per_minute": round(tables / profiling * 60),
                "lake_tables": tables,
            }
        )
    )
    release(spark)
    spark.stop()


if __name__ == "__main__":
    main()
