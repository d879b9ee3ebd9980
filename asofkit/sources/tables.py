"""Adapters that present the star-schema tables as canonical click events."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Source event names and the canonical type each stands for.
EVENT_NAMES = {"view": "view", "error": "view", "click": "addtocart", "signup": "addtocart", "purchase": "transaction"}
RETURN_FLAGS = {"N": "view", "A": "addtocart", "R": "transaction"}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def _renamed(column: str, names: dict[str, str]):
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.create_map(*pairs)[F.col(column)]


def click_events(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical events from all rows of the ``events`` table."""
    return _table(spark, folder, "events").select(
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        "user_id",
        F.get_json_object("props", "$.k").cast("long").alias("item_id"),
        _renamed("event_type", EVENT_NAMES).alias("event"),
        F.when(F.col("event_type") == "purchase", F.col("event_id")).alias("transaction_id"),
    )


def order_events(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical events from ``lineitem`` and ``orders``: day-granular times, many ties."""
    lines = _table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_returnflag", "l_shipdate"
    )
    buyers = _table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    return lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("ts_ms"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        _renamed("l_returnflag", RETURN_FLAGS).alias("event"),
        F.when(F.col("l_returnflag") == "R", F.col("l_orderkey")).alias("transaction_id"),
    )


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"), "label"
    )
