"""What a stream has delivered: rows accepted and rejected per batch, and the latest event time."""

from __future__ import annotations

from threading import Event, Lock

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from asofkit.sources.file_topic import publish_to_file_topic, read_file_topic

METRIC = "ingest"
COUNTS = "batch_id long, delivered long, rejected long, watermark_ms long"


def observed(decoded: DataFrame) -> DataFrame:
    """Count the rows of every micro-batch as they pass; nothing is read twice."""
    return decoded.observe(
        METRIC,
        F.count_if("accepted").alias("delivered"),
        F.count_if(~F.col("accepted")).alias("rejected"),
        F.max(F.when(F.col("accepted"), F.col("ts_ms"))).alias("watermark_ms"),
    )


class IngestListener(StreamingQueryListener):
    """Collects the counts of every batch; several queries may be listened to, and restarts go on."""

    def __init__(self) -> None:
        self.batches: dict[tuple[str, int], tuple[int, int, int | None]] = {}
        self.lock, self.ended = Lock(), {}

    def onQueryStarted(self, event) -> None:
        with self.lock:
            self.ended[str(event.runId)] = Event()

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(METRIC)
        if row is not None and (row.delivered or row.rejected):
            with self.lock:
                self.batches[str(event.progress.id), event.progress.batchId] = (row.delivered, row.rejected, row.watermark_ms)

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            self.ended.setdefault(str(event.runId), Event()).set()

    def wait(self, run_id: str, seconds: float = 60) -> bool:
        """Listeners hear of a query's end after those who wait for it."""
        with self.lock:
            end = self.ended.setdefault(run_id, Event())
        return end.wait(seconds)

    def rows(self, spark: SparkSession) -> DataFrame:
        with self.lock:
            found = [(batch, *counts) for (_, batch), counts in sorted(self.batches.items())]
        return spark.createDataFrame(found, COUNTS)

    def check(self, watermark_ms: int | None) -> None:
        """The stream is complete if the latest event time it delivered is the source's."""
        with self.lock:
            seen = max((w for _, _, w in self.batches.values() if w is not None), default=None)
        if seen != watermark_ms:
            raise RuntimeError(f"the stream ends at {seen}, its source at {watermark_ms}")


def publish_counted(events: DataFrame, path: str, partitions: int = 4) -> DataFrame:
    """Publish and compare what was sent with what the topic holds more than before: (sent, delivered, errors)."""
    spark = events.sparkSession
    before = read_file_topic(spark, path).count()
    sent = Observation("published")
    publish_to_file_topic(events.observe(sent, F.count(F.lit(1)).alias("sent")), path, partitions)
    delivered = read_file_topic(spark, path).count() - before
    n = sent.get["sent"]
    return spark.createDataFrame([(n, delivered, n - delivered)], "sent long, delivered long, errors long")
