"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default /root/testdata/sf0.1), ``BENCH_CPUS`` the local cores.
Every query runs completely into a sink that discards rows; the median of ``BENCH_RUNS`` is taken.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import functions as F

from asofkit.catalog import common, streams
from asofkit.catalog.common import WIDE, clicks, purchases
from asofkit.catalog.registry import QUERIES
from asofkit.plans.features import backfill
from asofkit.session import build_session, scratch_path
from asofkit.sources.messages import encode, read_files
from asofkit.streaming.ingest import ingest
from asofkit.streaming.store import OnlineStore

HEADLINE = (
    "t1_backfill",
    "t1_backfill_wide",
    "t1_backfill_orders",
    "t2_user_features",
    "t3_item_features",
    "t4_user_histories",
    "e6_histories",
    "e7_event_index",
    "a2_clean",
    "d1_d6_summary",
    "d9_share_curve",
    "f1_popular_top",
    "f2_recent_items",
    "t7_recent_then_popular",
    "t9_sample_requests",
    "t16_evaluate",
    "t26_ranker_table",
    "f5_exact_top_k",
    "t21_cell_index",
    "i1_parse",
    "i9_late_data_dedup",
    "i11_online_user_features",
)


def uncached() -> None:
    """Sampling and ingest belong to the queries that use them, so nothing is kept between runs."""
    for kept in (common.requests, streams.filled_store, streams.compacted_store):
        kept.cache_clear()


def large_backfill(spark, folder):
    """All 14 features of five shifted copies of the order lines: 3,000,000 events at sf0.1."""
    events = purchases(spark, folder).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(4))))
    shifted = F.col("user_id") * 5 + F.col("copy")
    events = events.withColumn("ts_ms", F.col("ts_ms") + F.col("copy") * 3_600_000).withColumn("user_id", shifted)
    return backfill(events.drop("copy"))


def stream_ingest(spark, folder, source):
    """Message files into the online store, by the streaming job."""
    ingest(read_files(spark, source), OnlineStore(spark, scratch_path(spark, "store"), WIDE), scratch_path(spark, "offsets"))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(min(8, os.cpu_count() or 1)))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = os.environ.get("BENCH_QUERIES", "").split()
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["d1_event_counts"](spark, folder).collect()  # start the engine before timing
    times, rates = {}, {}
    for name in only or HEADLINE:
        samples = []
        for _ in range(runs):
            uncached()
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            samples.append(time.perf_counter() - start)
        times[name] = round(statistics.median(samples), 3)
    total = sum(times.values())
    if not only:
        lines = spark.read.parquet(f"{folder}/lineitem.parquet").count()
        source = scratch_path(spark, "messages")
        events = clicks(spark, folder)
        encode(events).select("value").repartition(8).write.text(source)
        cases = {
            "backfill_3m": (5 * lines, lambda: large_backfill(spark, folder).write.format("noop").mode("overwrite").save()),
            "stream_ingest": (events.count(), lambda: stream_ingest(spark, folder, source)),
        }
        for name, (rows, case) in cases.items():
            samples = []
            for _ in range(2):
                start = time.perf_counter()
                case()
                samples.append(time.perf_counter() - start)
            times[name] = round(min(samples), 3)
            rates[name] = round(rows / times[name])
    sizes = {"t1_backfill": "d1_event_counts", "t1_backfill_orders": None}
    for name, counter in sizes.items():
        if name in times:
            rows = (
                QUERIES[counter](spark, folder).first().events
                if counter
                else spark.read.parquet(f"{folder}/lineitem.parquet").count()
            )
            rates[name] = round(rows / times[name])
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(total, 3),
                "unit": "sec",
                "queries": times,
                "rows_per_sec": rates,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
