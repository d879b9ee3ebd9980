"""Event table: raw CSV, cleaning, Parquet cache and slicing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from asofkit.functions.columns import checked_event
from asofkit.schema import EVENT_COLUMNS, EVENT_SCHEMA, RAW_CSV_SCHEMA, RAW_TO_CANONICAL
from asofkit.session import checkpointed
from asofkit.sources.paths import path_exists


def canonical_order() -> list[Column]:
    """Total order of events: time first, then the remaining columns."""
    return [F.col(c).asc_nulls_first() for c in EVENT_COLUMNS]



def read_raw_csv(spark: SparkSession, path: str) -> DataFrame:
    """Raw export with forced types; a malformed number or a wrong header fails the read."""
    options = {"header": True, "mode": "FAILFAST", "enforceSchema": False}
    raw = spark.read.schema(RAW_CSV_SCHEMA).options(**options).csv(path)
    return clean(raw.withColumnsRenamed(RAW_TO_CANONICAL))


def to_schema(df: DataFrame) -> DataFrame:
    """Project and cast to the canonical schema; unknown event types are an error."""
    types = {f.name: f.dataType for f in EVENT_SCHEMA}
    return df.select(
        *[
            checked_event(F.col(c).cast("string")).alias(c)
            if c == "event"
            else F.col(c).cast(types[c]).alias(c)
            for c in EVENT_COLUMNS
        ]
    )


def clean(df: DataFrame) -> DataFrame:
    """Canonical schema without exact duplicates. Order with ``in_order`` only where it is used."""
    return to_schema(df).dropDuplicates(EVENT_COLUMNS)


def in_order(events: DataFrame) -> DataFrame:
    return events.orderBy(*canonical_order())


def build_cache(spark: SparkSession, csv_path: str, out_path: str) -> DataFrame:
    if not path_exists(spark, csv_path):
        raise FileNotFoundError(csv_path)
    read_raw_csv(spark, csv_path).write.mode("overwrite").parquet(out_path)
    return spark.read.schema(EVENT_SCHEMA).parquet(out_path)


def load_events(spark: SparkSession, path: str, csv_path: str | None = None) -> DataFrame:
    """The cached table, built from ``csv_path`` on first use."""
    if not path_exists(spark, path):
        if csv_path is None:
            raise FileNotFoundError(path)
        return build_cache(spark, csv_path, path)
    return to_schema(spark.read.schema(EVENT_SCHEMA).parquet(path))


def from_date(events: DataFrame, iso_date: str) -> DataFrame:
    """Events at or after midnight UTC of ``iso_date``; the bound folds to a literal."""
    start = F.unix_millis(F.to_timestamp(F.lit(iso_date), "yyyy-MM-dd"))
    return events.where(F.col("ts_ms") >= start)


def first_n(events: DataFrame, n: int) -> DataFrame:
    return events.orderBy(*canonical_order()).limit(n)


def order_violations(arrivals: DataFrame, sequence: str) -> DataFrame:
    """Rows older than the first row of the stream or than their predecessor in ``sequence``.

    The stream is range-sorted once, so blocks are equal shares of its rows however the numbers are spread; each block also
    receives the last row of the one before. Only one row per block meets in one task.
    """
    placed = arrivals.select(sequence, "ts_ms").repartitionByRange(sequence)
    rows = checkpointed(placed.withColumn("_block", F.spark_partition_id()))
    lasts = rows.groupBy("_block").agg(F.max_by("ts_ms", sequence).alias("_ts"))  # one row per sort partition
    carried = lasts.select("_block", F.lag("_ts").over(Window.orderBy("_block")).alias("_carried"))
    w = Window.partitionBy("_block").orderBy(sequence)
    first_ts = rows.agg(F.min_by("ts_ms", sequence)).first()[0]
    return (
        rows.join(carried, "_block")
        .withColumn("prev_ts", F.coalesce(F.lag("ts_ms").over(w), F.col("_carried")))
        .select(
            F.col(sequence),
            "ts_ms",
            (F.col("ts_ms") < F.lit(first_ts)).alias("before_first"),
            F.coalesce(F.col("ts_ms") < F.col("prev_ts"), F.lit(False)).alias("inversion"),
        )
        .where("before_first OR inversion")
    )


def assert_ordered(arrivals: DataFrame, sequence: str) -> None:
    if not order_violations(arrivals, sequence).isEmpty():
        raise ValueError("events must be sorted by timestamp")
