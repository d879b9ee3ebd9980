"""The streaming job: messages in, online store out."""

from __future__ import annotations

from collections.abc import Callable
from threading import Event

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from asofkit.sources.messages import decode
from asofkit.streaming.progress import observed
from asofkit.streaming.store import OnlineStore

BatchSink = Callable[[DataFrame, int], None]


def start_ingest(
    messages: DataFrame,
    sink: OnlineStore | BatchSink,
    checkpoint: str,
    bounded: bool = True,
    interval: str = "10 seconds",
    compact_every: int | None = 100,
    keep: int = 0,
) -> StreamingQuery:
    """Start the query. ``bounded`` processes what is available and stops.

    Source offsets are checkpointed and batches are rewritten on retry, so a restart neither loses
    nor double counts events. A store's batches are filed under the stream's id, which a checkpoint
    keeps; several workers, and replays with new checkpoints, can share a store. Every
    ``compact_every`` batches of a worker the store is compacted and vacuumed; if two do so at a time, one gives way. ``keep``
    commits stay for readers that started from them. Each batch's counts are observed, see ``progress``.
    """
    known, ids = Event(), {}

    def store_batch(batch: DataFrame, batch_id: int) -> None:
        known.wait()
        sink.write_batch(batch, batch_id, ids["stream"])
        if compact_every and batch_id % compact_every == compact_every - 1:
            sink.compact()
            sink.vacuum(keep)

    write = store_batch if isinstance(sink, OnlineStore) else sink
    writer = (
        observed(decode(messages))
        .writeStream.foreachBatch(lambda batch, batch_id: write(batch, batch_id))
        .option("checkpointLocation", checkpoint)
    )
    trigger = {"availableNow": True} if bounded else {"processingTime": interval}
    query = writer.trigger(**trigger).start()
    ids["stream"] = query.id
    known.set()
    return query


def ingest(messages: DataFrame, sink: OnlineStore | BatchSink, checkpoint: str) -> None:
    start_ingest(messages, sink, checkpoint).awaitTermination()
