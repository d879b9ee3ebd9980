"""The keyed state against the log form on the same files, with late events, repeats and restarts."""

from __future__ import annotations

import random
import time

from conftest import bursty_rows, events_of

from asofkit.sources.messages import encode, read_files
from asofkit.streaming.ingest import start_ingest
from asofkit.streaming.keyed import KeyedStore
from asofkit.streaming.store import OnlineStore


def _rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def _lines(spark, rows):
    return [r.value for r in encode(events_of(spark, rows)).collect()]


def test_both_forms_hold_the_same_events(spark, tmp_path):
    lines = _lines(spark, bursty_rows(61, n=260))
    random.Random(3).shuffle(lines)
    source = tmp_path / "messages"
    source.mkdir()
    log, keyed = OnlineStore(spark, str(tmp_path / "log")), KeyedStore(spark, str(tmp_path / "keyed"))
    parts = [lines[:150], lines[150:190] + ["{broken"], lines[120:]]  # the last one repeats some
    for n, part in enumerate(parts):
        (source / f"{n}.json").write_text("\n".join(part) + "\n")
        start_ingest(read_files(spark, str(source), 1), log, str(tmp_path / "offsets"), compact_every=1).awaitTermination()
        keyed.ingest(read_files(spark, str(source), 1))
        for table in ("user_events", "item_events", "history_log"):
            assert _rows(getattr(keyed, table)()) == _rows(getattr(log, table)()), (n, table)
    assert keyed.watermark() == log.watermark()
    end = keyed.watermark() + 1
    users = spark.createDataFrame([(u, end) for u in range(14)], "user_id long, as_of_ms long")
    items = spark.createDataFrame([(i, end) for i in range(11)], "item_id long, as_of_ms long")
    assert _rows(keyed.user_features(users)) == _rows(log.user_features(users))
    assert _rows(keyed.user_histories(users)) == _rows(log.user_histories(users))
    assert _rows(keyed.item_features(items)) == _rows(log.item_features(items))


def test_counts_are_observed_and_repeats_change_nothing(spark, tmp_path):
    source = tmp_path / "messages"
    source.mkdir()
    lines = _lines(spark, [(0, 1, 1, "view"), (5, 1, 2, "view"), (9, 2, 1, "addtocart")])
    (source / "a.json").write_text("\n".join(lines) + "\n")
    store = KeyedStore(spark, str(tmp_path / "keyed"))
    seen = []
    for name in ("first", "again"):
        queries = store.start(read_files(spark, str(source)))
        for query in queries:
            query.awaitTermination()
        seen.append([sum((p.observedMetrics["keyed"].kept or 0) for p in q.recentProgress if "keyed" in p.observedMetrics) for q in queries])
        (source / f"{name}.json").write_text("\n".join(lines) + "\n")
    assert seen == [[3, 3], [0, 0]]
    assert store.user_events().count() == 3


def test_quiet_keys_are_forgotten_only_if_asked(spark, tmp_path):
    source = tmp_path / "messages"
    source.mkdir()
    store = KeyedStore(spark, str(tmp_path / "keyed"), ttl_ms=1)
    (source / "a.json").write_text("\n".join(_lines(spark, [(0, 1, 1, "view"), (5, 2, 2, "view")])) + "\n")
    queries = store.start(read_files(spark, str(source)), interval="0 seconds")
    deadline = time.time() + 60
    while time.time() < deadline and not all(
        sum((p.observedMetrics["keyed"].expired or 0) for p in q.recentProgress if "keyed" in p.observedMetrics) == 2 for q in queries
    ):
        time.sleep(0.5)
    for query in queries:
        query.stop()
    assert store.user_events().count() == 0 and store.history_log().count() == 0
