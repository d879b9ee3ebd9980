"""The file topic as batch and stream source and sink, and the counts of what passes."""

from __future__ import annotations

import json

import pytest
from conftest import bursty_rows, events_of

from asofkit.sources.file_topic import Topic, TopicStreamWriter, TopicWriter, publish_to_file_topic, read_file_topic, stream_file_topic
from asofkit.sources.messages import decode, encode, read_files
from asofkit.streaming.ingest import ingest, start_ingest
from asofkit.streaming.progress import IngestListener, publish_counted
from asofkit.streaming.store import OnlineStore


def _values(df):
    return sorted(r.value for r in df.collect())


def test_batch_write_and_read_keep_keys_together_and_offsets_dense(spark, tmp_path):
    path = str(tmp_path / "topic")
    events = events_of(spark, bursty_rows(71, n=200))
    publish_to_file_topic(events, path, 3)
    publish_to_file_topic(events.limit(20), path, 7)  # the topic keeps its three partitions
    rows = read_file_topic(spark, path).collect()
    assert len(rows) == events.count() + 20
    places = {}
    for r in rows:
        places.setdefault(r.partition, []).append(r.offset)
    assert set(places) <= {0, 1, 2}
    assert all(sorted(o) == list(range(len(o))) for o in places.values())
    assert all(len({r.partition for r in rows if r.key == key}) == 1 for key in {r.key for r in rows})
    assert _values(read_file_topic(spark, path)) == sorted(_values(encode(events)) + _values(encode(events.limit(20))))


def test_a_topic_feeds_the_store_and_restarts_where_it_stopped(spark, tmp_path):
    path, offsets = str(tmp_path / "topic"), str(tmp_path / "offsets")
    events = events_of(spark, bursty_rows(72, n=150))
    store = OnlineStore(spark, str(tmp_path / "store"))
    cut = sorted(r.ts_ms for r in events.collect())[70]
    for n, part in enumerate((events.where(f"ts_ms >= {cut}"), events.where(f"ts_ms < {cut}"))):
        publish_to_file_topic(part, path, 2)
        ingest(stream_file_topic(spark, path).select("value"), store, offsets)
        assert len(store.batches()) == n + 1
    ingest(stream_file_topic(spark, path).select("value"), store, offsets)
    assert store.merged("users").count() == events.count() and len(store.batches()) == 2


def test_a_stream_writes_to_a_topic(spark, tmp_path):
    path, source = str(tmp_path / "topic"), tmp_path / "messages"
    source.mkdir()
    lines = [r.value for r in encode(events_of(spark, bursty_rows(73, n=90))).collect()]
    publish_to_file_topic(events_of(spark, []), str(tmp_path / "other"))
    for n in (0, 1):
        (source / f"{n}.json").write_text("\n".join(lines[n::2]) + "\n")
        rows = decode(read_files(spark, str(source))).selectExpr("cast(user_id as string) AS key", "value")
        query = (
            rows.writeStream.format("file_topic").option("stream", "copy").option("partitions", 2)
            .option("checkpointLocation", str(tmp_path / "offsets")).trigger(availableNow=True).start(path)
        )
        query.awaitTermination()
    assert _values(read_file_topic(spark, path)) == sorted(lines)


def test_a_retried_batch_is_published_once_and_finished(tmp_path):
    options = {"path": str(tmp_path / "topic"), "partitions": "2", "stream": "s"}
    rows = [{"key": str(k), "value": f"v{k}"} for k in range(10)]
    first = TopicStreamWriter(options)
    staged = first.write(iter(rows))
    topic = Topic(options)
    moves = topic.plan("s", 0, staged.parts)  # lost after the plan and one move
    for partition in (0, 1):
        topic.fs.create_dir(f"{topic.root}/p={partition}")
    topic.fs.move(moves[0][1], moves[0][2])
    again = TopicStreamWriter(options)
    again.commit([again.write(iter(rows))], 0)
    again.commit([again.write(iter(rows))], 0)
    assert sum(Topic(options).ends()) == 10
    TopicWriter(options).abort([])
    failed = TopicWriter(options)
    failed.write(iter(rows))
    failed.abort([None])
    assert sum(Topic(options).ends()) == 10


def test_delivery_is_counted(spark, tmp_path):
    events = events_of(spark, bursty_rows(74, n=60))
    n = events.count()
    for _ in range(2):
        assert tuple(publish_counted(events, str(tmp_path / "topic")).first()) == (n, n, 0)


def test_listener_counts_batches_and_notices_what_is_missing(spark, tmp_path):
    source = tmp_path / "messages"
    source.mkdir()
    lines = [r.value for r in encode(events_of(spark, [(t, 1, t, "view") for t in range(1, 7)])).collect()]
    listener = IngestListener()
    spark.streams.addListener(listener)
    try:
        for n, part in enumerate((lines[:4] + ["{broken", json.dumps({"ts_ms": 10**15})], lines[4:])):
            (source / f"{n}.json").write_text("\n".join(part) + "\n")
            query = start_ingest(read_files(spark, str(source)), OnlineStore(spark, str(tmp_path / "s")), str(tmp_path / "o"))
            query.awaitTermination()
            assert listener.wait(str(query.runId))
    finally:
        spark.streams.removeListener(listener)
    assert [tuple(r) for r in listener.rows(spark).orderBy("batch_id").collect()] == [(0, 4, 2, 4), (1, 2, 0, 6)]
    listener.check(6)
    with pytest.raises(RuntimeError):
        listener.check(7)
