"""Feature log: date-partitioned Parquet, queried in SQL as ``event_features``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asofkit.functions.columns import event_date
from asofkit.sources.paths import path_exists

VIEW = "event_features"


def write_feature_log(df: DataFrame, root: str) -> None:
    """Overwrite the log. Rows are gathered by date; adaptive execution splits a crowded date."""
    balanced = df.hint("rebalance", F.col("date"))
    balanced.write.mode("overwrite").partitionBy("date").parquet(root)


class FeatureLog:
    def __init__(self, spark: SparkSession, root: str) -> None:
        if not path_exists(spark, root):
            raise FileNotFoundError(root)
        # A session of its own keeps the view apart from those of other logs.
        self.spark = spark.newSession()
        for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
            self.spark.conf.set(key, spark.conf.get(key))
        self.spark.read.parquet(root).createOrReplaceTempView(VIEW)

    def query(self, sql: str, params: list[object] | None = None) -> DataFrame:
        """The rows of a statement over ``event_features``, this log's rows whatever other logs are open."""
        return self.spark.sql(sql, args=params or [])

    def between(self, start_ms: int, end_ms: int, ordered: bool = True) -> DataFrame:
        """Rows with ``start_ms <= ts_ms < end_ms``. The date bounds prune partitions."""
        dates = F.col("date").between(event_date(F.lit(start_ms)), event_date(F.lit(end_ms)))
        rows = (
            self.spark.table(VIEW)
            .where(dates)
            .where((F.col("ts_ms") >= start_ms) & (F.col("ts_ms") < end_ms))
            .drop("date")
        )
        return rows.orderBy("event_idx") if ordered and "event_idx" in rows.columns else rows
