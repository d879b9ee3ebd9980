"""The streaming job and the online store, driven by message files written from the tables."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.catalog.common import (
    EV,
    WIDE,
    clicks,
    item_features_sql,
    user_features_sql,
    utc,
    with_,
)
from asofkit.plans.features import item_features, user_features
from asofkit.schema import CHECK_OFFSETS_MS, EVENT_COLUMNS
from asofkit.session import scratch_path
from asofkit.sources.messages import decode, encode, read_files
from asofkit.sources.file_topic import publish_to_file_topic, read_file_topic, stream_file_topic
from asofkit.streaming.ingest import ingest, start_ingest
from asofkit.streaming.keyed import KeyedStore
from asofkit.streaming.progress import IngestListener, publish_counted
from asofkit.streaming.skew_check import compare_store, differences, moments, report
from asofkit.streaming.store import OnlineStore


def messages(spark, sf) -> DataFrame:
    """One message per row of ``events``, and a broken copy of some.

    ``signup`` rows also come with an unknown event type or an extra key, ``error`` rows as no JSON, without
    a key or with a wrong type.
    """
    good = encode(clicks(spark, sf)).select("value")
    raw = utc(spark).read.parquet(f"{sf}/events.parquet")
    n = F.col("event_id").cast("string")
    kind = F.col("event_id") % 3
    start = F.concat(F.lit('{"ts_ms":'), n, F.lit(',"user_id":1,'))
    signup = (
        F.when(kind == 0, F.concat(start, F.lit('"item_id":2,"event":"signup"}')))
        .when(kind == 1, F.concat(start, F.lit('"item_id":2,"event":"view","extra":1}')))
        .otherwise(F.concat(start, F.lit('"item_id":2,"event":"view","transaction_id":"x"}')))
    )
    error = (
        F.when(kind == 0, F.concat(F.lit("{not json "), n))
        .when(kind == 1, F.concat(start, F.lit('"event":"view"}')))
        .otherwise(F.concat(start, F.lit('"item_id":"two","event":"view"}')))
    )
    bad = raw.where("event_type IN ('signup', 'error')").select(
        F.when(F.col("event_type") == "signup", signup).otherwise(error).alias("value")
    )
    return good.unionByName(bad)


@cache
def filled_store(spark, sf) -> OnlineStore:
    """A store fed by the streaming job in several batches, with all messages delivered twice."""
    source = scratch_path(spark, "messages")
    late_first = messages(spark, sf).repartition(4, "value")
    late_first.write.text(source)
    messages(spark, sf).repartition(3).write.mode("append").text(source)
    store = OnlineStore(spark, scratch_path(spark, "store"), WIDE)
    ingest(read_files(spark, source, files_per_batch=3), store, scratch_path(spark, "offsets"))
    return store


@cache
def compacted_store(spark, sf) -> OnlineStore:
    """Two thirds of the events by batch hash, compacted and vacuumed, then the rest, replayed."""
    store = OnlineStore(spark, scratch_path(spark, "store"), WIDE)
    events = clicks(spark, sf).withColumn("_slot", F.pmod(F.xxhash64(*EVENT_COLUMNS), F.lit(3)))
    store.append(events.where("_slot = 0").drop("_slot"), 0)
    store.append(events.where("_slot = 1").drop("_slot"), 1)
    store.compact()
    store.vacuum()
    store.append(events.drop("_slot"), 2)
    store.compact()
    store.append(events.where("_slot = 2").drop("_slot"), 3)
    return store


def i1_parse(spark, sf) -> DataFrame:
    found = decode(messages(spark, sf))
    return found.groupBy(F.col("accepted").cast("string").alias("accepted"), "event").agg(
        F.count("*").alias("n")
    ).where("accepted = 'true'").unionByName(
        found.where("NOT accepted").agg(
            F.lit("false").alias("accepted"), F.lit("").alias("event"), F.count("*").alias("n")
        )
    )


def i2_stream_to_log(spark, sf) -> DataFrame:
    return filled_store(spark, sf).merged("users")


def i3_rejected_messages(spark, sf) -> DataFrame:
    """Each broken message arrives twice and is kept for inspection."""
    return filled_store(spark, sf).rejected().groupBy("value").agg(F.count("*").alias("n"))


def i5_user_retention(spark, sf) -> DataFrame:
    return filled_store(spark, sf).user_events()


def i6_item_retention(spark, sf) -> DataFrame:
    return filled_store(spark, sf).item_events()


def i7_history_tail(spark, sf) -> DataFrame:
    return filled_store(spark, sf).history_log()


def i8_watermark(spark, sf) -> DataFrame:
    return spark.createDataFrame([(filled_store(spark, sf).watermark(),)], "watermark long")


def _user_points(spark, sf, store: OnlineStore | KeyedStore | None = None) -> DataFrame:
    end = (store or filled_store(spark, sf)).watermark()
    times = [end + offset for offset in CHECK_OFFSETS_MS]
    return moments(clicks(spark, sf).select("user_id").distinct(), times)


def _item_points(spark, sf, store: OnlineStore | None = None) -> DataFrame:
    end = (store or filled_store(spark, sf)).watermark()
    times = [end + offset for offset in CHECK_OFFSETS_MS]
    return moments(clicks(spark, sf).select("item_id").distinct(), times)


def i11_online_user_features(spark, sf) -> DataFrame:
    return filled_store(spark, sf).user_features(_user_points(spark, sf))


def i11_compacted_user_features(spark, sf) -> DataFrame:
    store = compacted_store(spark, sf)
    return store.user_features(_user_points(spark, sf, store))


def i12_online_histories(spark, sf) -> DataFrame:
    found = filled_store(spark, sf).user_histories(_user_points(spark, sf))
    return found.select(
        "user_id", "as_of_ms", F.array_join(F.col("hist_items").cast("array<string>"), ",").alias("items")
    )


def i13_online_item_features(spark, sf) -> DataFrame:
    return filled_store(spark, sf).item_features(_item_points(spark, sf))


def i13_compacted_item_subset(spark, sf) -> DataFrame:
    store = compacted_store(spark, sf)
    return store.item_features(_item_points(spark, sf, store), ["item_views_24h"])


def _ordered_thirds(spark, sf) -> list[DataFrame]:
    """Messages in three parts, the latest events first."""
    events = clicks(spark, sf)
    low, high = events.approxQuantile("ts_ms", [1 / 3, 2 / 3], 0.01)
    ts = F.col("ts_ms")
    return [encode(events.where(c)).select("value") for c in (ts >= high, (ts >= low) & (ts < high), ts < low)]


def i9_late_data_dedup(spark, sf) -> DataFrame:
    """Each micro-batch is older than the one before, and the latest is delivered again: nothing is lost or doubled."""
    source = scratch_path(spark, "messages")
    store = OnlineStore(spark, scratch_path(spark, "store"), WIDE)
    offsets = scratch_path(spark, "offsets")
    parts = _ordered_thirds(spark, sf)
    for part in [*parts, parts[0]]:
        part.write.mode("append").text(source)
        ingest(read_files(spark, source), store, offsets)
    return store.merged("users")


def i9_late_after_compaction(spark, sf) -> DataFrame:
    """Late events that arrive after compaction and vacuum still count."""
    source = scratch_path(spark, "messages")
    store = OnlineStore(spark, scratch_path(spark, "store"), WIDE)
    offsets = scratch_path(spark, "offsets")
    for part in _ordered_thirds(spark, sf):
        part.write.mode("append").text(source)
        ingest(read_files(spark, source), store, offsets)
        store.compact()
        store.vacuum()
    return store.user_events()


def i2_two_writers(spark, sf) -> DataFrame:
    """Two workers with half of the messages each, both numbering their batches from 0."""
    store = OnlineStore(spark, scratch_path(spark, "store"), WIDE)
    half = F.pmod(F.xxhash64("value"), F.lit(2))
    for worker in (0, 1):
        source = scratch_path(spark, "messages")
        messages(spark, sf).where(half == worker).repartition(2).write.text(source)
        ingest(read_files(spark, source, files_per_batch=1), store, scratch_path(spark, "offsets"))
    return store.merged("users")


def i3_replay_new_offsets(spark, sf) -> DataFrame:
    """After compaction a stream with a new checkpoint replays all and brings new events in batches from 0."""
    store = OnlineStore(spark, scratch_path(spark, "store"), WIDE)
    latest, *rest = _ordered_thirds(spark, sf)
    source = scratch_path(spark, "messages")
    for part in rest:
        part.write.mode("append").text(source)
    ingest(read_files(spark, source), store, scratch_path(spark, "offsets"))
    store.compact()
    store.vacuum()
    latest.write.mode("append").text(source)
    ingest(read_files(spark, source), store, scratch_path(spark, "offsets"))
    return store.user_events()


def i10_compaction(spark, sf) -> DataFrame:
    """The ingest job compacts after every batch; the histories are those of the whole log."""
    source = scratch_path(spark, "messages")
    messages(spark, sf).repartition(3, "value").write.text(source)
    store = OnlineStore(spark, scratch_path(spark, "store"), WIDE)
    start_ingest(
        read_files(spark, source, files_per_batch=1), store, scratch_path(spark, "offsets"), compact_every=1
    ).awaitTermination()
    if store.batches():
        raise RuntimeError("compacted batches are still there")
    return store.history_log()


def i10_two_compactors(spark, sf) -> DataFrame:
    """One worker has written its snapshot when a batch arrives that another one compacts and cleans up; both then go on."""
    root = scratch_path(spark, "store")
    one, two = OnlineStore(spark, root, WIDE), OnlineStore(spark, root, WIDE)
    events = clicks(spark, sf).withColumn("_slot", F.pmod(F.xxhash64(*EVENT_COLUMNS), F.lit(3)))
    one.append(events.where("_slot = 0").drop("_slot"), 0, "one")
    late = two.prepare()
    one.append(events.where("_slot = 1").drop("_slot"), 0, "two")
    if not one.compact():
        raise RuntimeError("nothing stood in the way of the first commit")
    one.vacuum()
    if two.commit(late):
        raise RuntimeError("a snapshot without the newest events was committed")
    one.append(events.where("_slot = 2").drop("_slot"), 1, "one")
    two.compact()
    two.vacuum()
    return one.history_log()


@cache
def keyed_store(spark, sf) -> KeyedStore:
    """Keyed state fed with the latest third first and that third again, the queries restarted each time."""
    source = scratch_path(spark, "messages")
    store = KeyedStore(spark, scratch_path(spark, "keyed"), WIDE)
    parts = _ordered_thirds(spark, sf)
    for part in [*parts, parts[0]]:
        part.write.mode("append").text(source)
        store.ingest(read_files(spark, source))
    return store


def i3_keyed_user_events(spark, sf) -> DataFrame:
    return keyed_store(spark, sf).user_events()


def i4_keyed_sessions(spark, sf) -> DataFrame:
    return keyed_store(spark, sf).sessions()


def i6_keyed_item_events(spark, sf) -> DataFrame:
    return keyed_store(spark, sf).item_events()


def i7_keyed_history(spark, sf) -> DataFrame:
    return keyed_store(spark, sf).history_log()


def i11_keyed_user_features(spark, sf) -> DataFrame:
    store = keyed_store(spark, sf)
    return store.user_features(_user_points(spark, sf, store))


def a12_topic_offsets(spark, sf) -> DataFrame:
    """Events published in two writes and read back: every message once, offsets without gaps, keys in one partition."""
    path = scratch_path(spark, "topic")
    events = clicks(spark, sf)
    odd = F.pmod("ts_ms", F.lit(2)) == 1
    publish_to_file_topic(events.where(odd), path)
    publish_to_file_topic(events.where(~odd), path)
    found = read_file_topic(spark, path)
    ends = found.groupBy("partition").agg((F.max("offset") + 1 == F.count("*")).alias("dense"))
    keys = found.groupBy("key").agg(F.count_distinct("partition").alias("places"))
    per_key = found.groupBy("key").agg(F.count("*").alias("messages"))
    alone = per_key.join(keys, "key").withColumn("in_one_partition", F.col("places") == 1).drop("places")
    return alone.crossJoin(F.broadcast(ends.agg(F.bool_and("dense").alias("offsets_dense"))))  # one row


def a11_delivery_counts(spark, sf) -> DataFrame:
    return publish_counted(clicks(spark, sf), scratch_path(spark, "topic"))


def i2_topic_to_log(spark, sf) -> DataFrame:
    """The store fed from a topic in two runs of one query, the second one with what was published in between."""
    path, offsets = scratch_path(spark, "topic"), scratch_path(spark, "offsets")
    store = OnlineStore(spark, scratch_path(spark, "store"), WIDE)
    first, second, third = _ordered_thirds(spark, sf)
    for part in (first.unionByName(second), third):
        publish_to_file_topic(decode(part).select(*EVENT_COLUMNS), path)
        ingest(stream_file_topic(spark, path).select("value"), store, offsets)
    return store.merged("users")


def i18_batch_counts(spark, sf) -> DataFrame:
    """Rows delivered and rejected and the latest event time per batch, heard by a listener; a third of the messages per batch."""
    source, offsets = scratch_path(spark, "messages"), scratch_path(spark, "offsets")
    store = OnlineStore(spark, scratch_path(spark, "store"), WIDE)
    listener = IngestListener()
    spark.streams.addListener(listener)
    try:
        for length in range(3):
            part = messages(spark, sf).where(F.length("value") % 3 == length)
            part.write.mode("append").text(source)
            query = start_ingest(read_files(spark, source), store, offsets, compact_every=None)
            query.awaitTermination()
            listener.wait(str(query.runId))
    finally:
        spark.streams.removeListener(listener)
    listener.check(store.watermark())
    return listener.rows(spark)


def d25_skew_report(spark, sf) -> DataFrame:
    return report(compare_store(filled_store(spark, sf), clicks(spark, sf)))


def d25_compacted_skew_report(spark, sf) -> DataFrame:
    return report(compare_store(compacted_store(spark, sf), clicks(spark, sf)))


def t33_parity(spark, sf) -> DataFrame:
    """Retained user and item tables give the same values as the full log."""
    store, events = compacted_store(spark, sf), clicks(spark, sf)
    users, items = _user_points(spark, sf), _item_points(spark, sf)
    pairs = differences(
        user_features(store.user_events(), users, WIDE), user_features(events, users, WIDE),
        "user_id", WIDE.user_features,
    ).unionByName(
        differences(
            item_features(store.item_events(), items, WIDE), item_features(events, items, WIDE),
            "item_id", WIDE.item_features,
        )
    )
    return report(pairs)


QUERIES = {
    f.__name__: f
    for f in (
        i1_parse, i2_stream_to_log, i3_rejected_messages, i5_user_retention, i6_item_retention,
        i7_history_tail, i8_watermark, i9_late_data_dedup, i9_late_after_compaction,
        i2_two_writers, i3_replay_new_offsets, i10_compaction, i10_two_compactors,
        a11_delivery_counts, a12_topic_offsets, i2_topic_to_log, i18_batch_counts,
        i3_keyed_user_events, i4_keyed_sessions, i6_keyed_item_events, i7_keyed_history, i11_keyed_user_features, i11_online_user_features,
        i11_compacted_user_features, i12_online_histories, i13_online_item_features,
        i13_compacted_item_subset, d25_skew_report, d25_compacted_skew_report, t33_parity,
    )
}

_TIMES = ", ".join(f"({o})" for o in CHECK_OFFSETS_MS)
_UPTS = f"""upts AS (SELECT user_id, m + o AS as_of_ms FROM (SELECT DISTINCT user_id FROM ev),
  (SELECT max(ts_ms) AS m FROM ev), (VALUES {_TIMES}) t(o))"""
_IPTS = f"""ipts AS (SELECT item_id, m + o AS as_of_ms FROM (SELECT DISTINCT item_id FROM ev),
  (SELECT max(ts_ms) AS m FROM ev), (VALUES {_TIMES}) t(o))"""
_USERS = with_(EV, _UPTS, user_features_sql("upts", WIDE)) + "SELECT * FROM uf"
_LAST_SESSION = f"""prevs AS (SELECT *, lag(ts_ms) OVER (PARTITION BY user_id ORDER BY ts_ms) AS prev FROM ev),
ends AS (SELECT user_id, max(ts_ms) AS last_ts,
  max(CASE WHEN prev IS NULL OR ts_ms - prev > {WIDE.session_gap_ms} THEN ts_ms END) AS start_ms FROM prevs GROUP BY 1)"""
_BAD = """SELECT CASE
    WHEN event_type = 'signup' AND event_id % 3 = 0 THEN '{"ts_ms":' || event_id || ',"user_id":1,"item_id":2,"event":"signup"}'
    WHEN event_type = 'signup' AND event_id % 3 = 1 THEN '{"ts_ms":' || event_id || ',"user_id":1,"item_id":2,"event":"view","extra":1}'
    WHEN event_type = 'signup' THEN '{"ts_ms":' || event_id || ',"user_id":1,"item_id":2,"event":"view","transaction_id":"x"}'
    WHEN event_id % 3 = 0 THEN '{not json ' || event_id
    WHEN event_id % 3 = 1 THEN '{"ts_ms":' || event_id || ',"user_id":1,"event":"view"}'
    ELSE '{"ts_ms":' || event_id || ',"user_id":1,"item_id":"two","event":"view"}' END AS value, 2::BIGINT AS n
  FROM events WHERE event_type IN ('signup', 'error')"""


def _n_values(users: int, items: int) -> str:
    return f"""SELECT {len(CHECK_OFFSETS_MS)} * ({users} * (SELECT count(DISTINCT user_id) FROM ev)
  + {items} * (SELECT count(DISTINCT item_id) FROM ev)) AS values_compared, 0::BIGINT AS mismatches"""


_RETAINED = (
    with_(EV, _LAST_SESSION)
    + f"SELECT DISTINCT ev.* FROM ev JOIN ends USING (user_id) WHERE ts_ms >= least(last_ts - {WIDE.user_retention_ms}, start_ms)"
)
_TAIL = with_(EV) + """SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms DESC, item_id DESC, event DESC,
  transaction_id DESC NULLS LAST) AS r FROM (SELECT DISTINCT * FROM ev)) WHERE r <= 50"""

ORACLES = {
    "i2_two_writers": with_(EV) + "SELECT DISTINCT * FROM ev",
    "i3_replay_new_offsets": _RETAINED,
    "i9_late_after_compaction": _RETAINED,
    "i10_compaction": _TAIL,
    "i10_two_compactors": _TAIL,
    "i3_keyed_user_events": _RETAINED,
    "a11_delivery_counts": with_(EV) + "SELECT count(*) AS sent, count(*) AS delivered, 0::BIGINT AS errors FROM ev",
    "a12_topic_offsets": with_(EV)
    + "SELECT user_id::VARCHAR AS key, count(*) AS messages, true AS in_one_partition, true AS offsets_dense FROM ev GROUP BY 1",
    "i2_topic_to_log": with_(EV) + "SELECT DISTINCT * FROM ev",
    "i18_batch_counts": with_(EV)
    + f"""SELECT length(value) % 3 AS batch_id, count(ts_ms) AS delivered, count(*) - count(ts_ms) AS rejected, max(ts_ms) AS watermark_ms
  FROM (SELECT '{{"ts_ms":' || ts_ms || ',"user_id":' || user_id || ',"item_id":' || item_id || ',"event":"' || event || '","transaction_id":'
    || coalesce(transaction_id::VARCHAR, 'null') || '}}' AS value, ts_ms FROM ev
    UNION ALL SELECT value, NULL FROM ({_BAD})) GROUP BY 1""",
    "i4_keyed_sessions": with_(EV, _LAST_SESSION) + "SELECT user_id, last_ts AS last_ms, start_ms FROM ends",
    "i7_keyed_history": _TAIL,
    "i11_keyed_user_features": _USERS,
    "i1_parse": with_(EV)
    + "SELECT 'true' AS accepted, event, count(*) AS n FROM ev GROUP BY 2 UNION ALL"
    " SELECT 'false', '', count(*) FROM events WHERE event_type IN ('signup', 'error')",
    "i2_stream_to_log": with_(EV) + "SELECT DISTINCT * FROM ev",
    "i3_rejected_messages": _BAD,
    "i5_user_retention": with_(EV, _LAST_SESSION)
    + f"SELECT DISTINCT ev.* FROM ev JOIN ends USING (user_id) WHERE ts_ms >= least(last_ts - {WIDE.user_retention_ms}, start_ms)",
    "i6_item_retention": with_(EV)
    + f"""SELECT DISTINCT * FROM ev WHERE ts_ms >= (SELECT max(o.ts_ms) FROM ev o WHERE o.item_id = ev.item_id AND o.event = ev.event)
  - {WIDE.item_retention_ms}""",
    "i7_history_tail": with_(EV)
    + """SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms DESC, item_id DESC, event DESC,
  transaction_id DESC NULLS LAST) AS r FROM (SELECT DISTINCT * FROM ev)) WHERE r <= 50""",
    "i8_watermark": with_(EV) + "SELECT max(ts_ms) AS watermark FROM ev",
    "i9_late_data_dedup": with_(EV) + "SELECT DISTINCT * FROM ev",
    "i11_online_user_features": _USERS,
    "i11_compacted_user_features": _USERS,
    "i12_online_histories": with_(EV, _UPTS)
    + """SELECT user_id, as_of_ms, string_agg(item_id, ',' ORDER BY r DESC) AS items FROM upts JOIN (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms DESC, item_id DESC, event DESC, transaction_id DESC NULLS LAST) AS r
  FROM ev) USING (user_id) WHERE r <= 50 GROUP BY 1, 2""",
    "i13_online_item_features": with_(EV, _IPTS, item_features_sql("ipts", WIDE)) + "SELECT * FROM itf",
    "i13_compacted_item_subset": with_(EV, _IPTS, item_features_sql("ipts", WIDE))
    + "SELECT item_id, as_of_ms, item_views_24h FROM itf",
    "d25_skew_report": with_(EV) + _n_values(11, 6),
    "d25_compacted_skew_report": with_(EV) + _n_values(11, 6),
    "t33_parity": with_(EV) + _n_values(8, 6),
}
ORACLES["i6_keyed_item_events"] = ORACLES["i6_item_retention"]
