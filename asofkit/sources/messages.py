"""Event messages: JSON values keyed by user, on a Kafka-API topic or in text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from asofkit.schema import EVENT_COLUMNS, EVENT_SCHEMA, EVENT_TYPES

# Producer settings of the topic.
PRODUCER_OPTIONS = {
    "kafka.linger.ms": "5",
    "kafka.compression.type": "lz4",
    "kafka.enable.idempotence": "true",
}


def encode(events: DataFrame) -> DataFrame:
    """(key, value): decimal user id and compact JSON with an explicit null transaction id."""
    payload = F.to_json(F.struct(*EVENT_COLUMNS), {"ignoreNullFields": "false"})
    return events.select(F.col("user_id").cast("string").alias("key"), payload.alias("value"))


def decode(messages: DataFrame) -> DataFrame:
    """Parse the ``value`` column into event columns plus ``accepted``.

    Rejected: null, invalid JSON, non-objects, unknown keys, missing required keys, wrong types and
    unknown event types. A rejected row keeps its raw ``value`` and never stops the stream.
    """
    value = F.col("value").cast("string")
    parsed = F.from_json(value, EVENT_SCHEMA)
    extra_keys = F.array_except(
        F.json_object_keys(value), F.array(*[F.lit(c) for c in EVENT_COLUMNS])
    )
    transaction = F.get_json_object(value, "$.transaction_id")
    rows = messages.select(
        value.alias("value"),
        parsed.alias("_e"),
        F.coalesce(F.size(extra_keys) == 0, F.lit(False)).alias("_known_keys"),
        (transaction.isNull() | F.try_to_number(transaction, F.lit("S9999999999999999999")).isNotNull()).alias("_txn_ok"),
    ).select("value", "_e.*", "_known_keys", "_txn_ok")
    accepted = (
        F.col("_known_keys")
        & F.col("ts_ms").isNotNull()
        & F.col("user_id").isNotNull()
        & F.col("item_id").isNotNull()
        & F.coalesce(F.col("event").isin(*EVENT_TYPES), F.lit(False))
        & F.col("_txn_ok")
    )
    return rows.select("value", *EVENT_COLUMNS, accepted.alias("accepted"))


def read_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """Unbounded source; bound it with ``trigger(availableNow=True)`` when starting the query."""
    return (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .load()
        .select("value")
    )


def read_files(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """The same stream from a folder of JSON-lines files."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def publish(events: DataFrame, servers: str, topic: str) -> None:
    """Batch write to a topic. Delivery errors fail the task, which Spark retries."""
    writer = encode(events).write.format("kafka").options(**PRODUCER_OPTIONS)
    writer.option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def publish_stream(
    events: DataFrame, servers: str, topic: str, checkpoint: str
) -> StreamingQuery:
    writer = encode(events).writeStream.format("kafka").options(**PRODUCER_OPTIONS)
    return (
        writer.option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .start()
    )
