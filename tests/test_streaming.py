import json
import random

import pytest
from conftest import MINUTE, as_dicts, bursty_rows, events_of
from pyspark.sql import functions as F

from asofkit.plans.features import item_features, user_features, user_histories
from asofkit.sources.messages import encode, read_files
from asofkit.streaming.ingest import ingest
from asofkit.streaming.skew_check import compare_store, differences, examples, report
from asofkit.streaming.store import OnlineStore


def _store(spark, tmp_path, name="store"):
    return OnlineStore(spark, str(tmp_path / name))


def _values(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def _at(spark, key, ids, t):
    return spark.createDataFrame([(i, t) for i in ids], f"{key} long, as_of_ms long")


def test_stream_matches_batch_with_broken_messages(spark, tmp_path):
    rows = bursty_rows(51)
    events = events_of(spark, rows)
    lines = [r.value for r in encode(events).collect()]
    random.Random(0).shuffle(lines)
    lines[10:10] = ["{not json", "", json.dumps({"ts_ms": 10**15, "user_id": 1})]
    source = tmp_path / "messages"
    source.mkdir()
    for n in range(4):
        (source / f"{n}.json").write_text("\n".join(lines[n::4]) + "\n")
    store = _store(spark, tmp_path)
    checkpoint = str(tmp_path / "offsets")
    ingest(read_files(spark, str(source), 1), store, checkpoint)
    assert [n for _, n in store.batches()] == [0, 1, 2, 3]
    assert store.watermark() == max(r[0] for r in rows)
    assert store.rejected().count() == 3
    found = compare_store(store, events)
    total = report(found).first()
    assert total.values_compared == 6 * (11 * 12 + 6 * 9) and total.mismatches == 0
    assert examples(found).count() == 0
    # a restart finds nothing new; a full replay into further batches changes nothing
    ingest(read_files(spark, str(source), 1), store, checkpoint)
    assert len(store.batches()) == 4
    (source / "again.json").write_text("\n".join(lines) + "\n")
    ingest(read_files(spark, str(source), 1), store, checkpoint)
    assert [n for _, n in store.batches()] == [0, 1, 2, 3, 4]
    assert report(compare_store(store, events)).first().mismatches == 0


def test_differences_are_reported(spark, tmp_path):
    store = _store(spark, tmp_path)
    store.append(events_of(spark, [(0, 1, 1, "view"), (5, 1, 2, "view")]), 0)
    wrong = events_of(spark, [(0, 1, 1, "view"), (4, 1, 2, "view"), (5, 1, 2, "view")])
    found = compare_store(store, wrong, (1,))
    assert report(found).first().mismatches > 0
    assert {r.feature for r in examples(found, 50).collect()} >= {"user_events_5m", "hist_ts"}
    with pytest.raises(RuntimeError):
        compare_store(store, events_of(spark, [(99, 1, 1, "view")]))
    one = spark.createDataFrame([(1, 2, 3)], "user_id long, as_of_ms long, a long")
    two = spark.createDataFrame([(2, 2, 3)], "user_id long, as_of_ms long, a long")
    assert report(differences(one, two, "user_id", ["a"])).first().mismatches == 2


def test_values_while_streaming(spark, tmp_path):
    """Before the events at t arrive, the online value at t equals the offline value at t."""
    rows = bursty_rows(52, n=240)
    events = events_of(spark, rows)
    store = _store(spark, tmp_path)
    cuts = [rows[i][0] for i in (60, 120, 180)]
    bounds = [0, *cuts]
    for batch, (lo, hi) in enumerate(zip(bounds, cuts)):
        ts = F.col("ts_ms")
        store.append(events.where((ts >= lo) & (ts < hi)), batch)
        if batch == 1:
            store.compact()
            store.vacuum()
        users, items = _at(spark, "user_id", range(12), hi), _at(spark, "item_id", range(9), hi)
        assert _values(store.user_features(users)) == _values(user_features(events, users))
        assert _values(store.item_features(items)) == _values(item_features(events, items))
        assert _values(store.user_histories(users)) == _values(user_histories(events, users))


def test_retried_batch_is_rewritten(spark, tmp_path):
    store = _store(spark, tmp_path)
    events = events_of(spark, [(0, 1, 1, "view"), (5, 1, 2, "view")])
    store.append(events.limit(1), 0)
    store.append(events, 0)
    store.append(events.unionByName(events), 1)
    assert store.merged("users").count() == 2


def test_long_session_survives_trimming(spark, tmp_path):
    store = _store(spark, tmp_path)
    events = events_of(spark, [(20 * MINUTE * i, 1, i, "view") for i in range(10)])
    store.append(events, 0)
    store.compact()
    store.vacuum()
    assert store.batches() == []
    [r] = as_dicts(store.user_features(_at(spark, "user_id", [1], 181 * MINUTE)))
    assert r["session_events"] == 10 and r["user_events_1h"] == 3


def test_old_sessions_are_trimmed_but_history_is_kept(spark, tmp_path):
    store = _store(spark, tmp_path)
    store.append(events_of(spark, [(0, 1, 1, "view"), (300 * MINUTE, 1, 2, "view")]), 0)
    assert store.user_events().count() == 1 and store.history_log().count() == 2
    day_later = events_of(spark, [(3000 * MINUTE, 2, 1, "view")])
    store.append(day_later, 1)
    assert {r.ts_ms for r in store.item_events().where("item_id = 1").collect()} == {3000 * MINUTE}


def test_late_event_bridges_sessions(spark, tmp_path):
    store = _store(spark, tmp_path)
    rows = [(0, 1, 1, "view"), (50 * MINUTE, 1, 2, "view"), (25 * MINUTE, 1, 3, "view")]
    for n, row in enumerate(rows):
        store.append(events_of(spark, [row]), n)
    [r] = as_dicts(store.user_features(_at(spark, "user_id", [1], 51 * MINUTE)))
    assert r["session_events"] == 3 and r["session_duration_ms"] == 50 * MINUTE
    assert store.watermark() == 50 * MINUTE


def test_history_keeps_fifty_with_ordered_ties(spark, tmp_path):
    store = _store(spark, tmp_path)
    rows = [(3 * n, 8, 1000 - n, "view") for n in range(70)] + [(500, 8, i, "addtocart") for i in (33, 31, 32)]
    store.append(events_of(spark, rows[:40]), 0)
    store.append(events_of(spark, rows[20:]), 1)
    store.compact()
    store.append(events_of(spark, rows), 2)
    [r] = as_dicts(store.user_histories(_at(spark, "user_id", [8], 501)))
    assert r["hist_items"] == [1000 - n for n in range(23, 70)] + [31, 32, 33]


def test_unknown_entities_and_feature_subsets(spark, tmp_path):
    store = _store(spark, tmp_path)
    assert store.watermark() is None
    store.append(events_of(spark, [(0, 1, 1, "view")]), 0)
    found = as_dicts(store.item_features(_at(spark, "item_id", [1, 5], 10), ["item_views_1h"]))
    assert {r["item_id"]: r["item_views_1h"] for r in found} == {1: 1, 5: 0}
    assert set(found[0]) == {"item_id", "as_of_ms", "item_views_1h"}


def test_clear_removes_only_this_store(spark, tmp_path):
    a, b = _store(spark, tmp_path, "a"), _store(spark, tmp_path, "b")
    events = events_of(spark, [(0, 1, 1, "view")])
    a.append(events, 0)
    b.append(events, 0)
    assert a.clear() and a.batches() == [] and b.watermark() == 0
    with pytest.raises(ValueError):
        OnlineStore(spark, "/")


def test_any_sink_function_can_take_the_batches(spark, tmp_path):
    source = tmp_path / "m"
    source.mkdir()
    (source / "0.json").write_text('{"ts_ms":1,"user_id":2,"item_id":3,"event":"view"}\n')
    seen = []
    ingest(read_files(spark, str(source)), lambda df, n: seen.append((n, df.count())), str(tmp_path / "c"))
    assert seen == [(0, 1)]


def test_writers_with_equal_batch_numbers_do_not_meet(spark, tmp_path):
    store = _store(spark, tmp_path)
    store.append(events_of(spark, [(1, 1, 1, "view")]), 0, "a")
    store.append(events_of(spark, [(2, 1, 2, "view")]), 0, "b")
    assert store.merged("users").count() == 2
    store.compact()
    assert store.vacuum() > 0 and store.batches() == []
    store.append(events_of(spark, [(3, 1, 3, "view")]), 0, "c")
    assert store.watermark() == 3 and store.merged("users").count() == 3
    store.compact()
    assert store.pending() == [] and store.merged("users").count() == 3


def test_rejected_messages_outlive_vacuum(spark, tmp_path):
    store = _store(spark, tmp_path)
    source = tmp_path / "m"
    source.mkdir()
    (source / "0.json").write_text('{"ts_ms":1,"user_id":2,"item_id":3,"event":"view"}\n{broken\n')
    ingest(read_files(spark, str(source)), store, str(tmp_path / "c"))
    store.compact()
    store.vacuum()
    assert store.batches() == [] and [r.value for r in store.rejected().collect()] == ["{broken"]
    assert store.merged("users").count() == 1


def test_two_compactors_lose_nothing(spark, tmp_path):
    """A worker that was overtaken gives way; a batch is deleted only once a commit holds its events."""
    one, two = _store(spark, tmp_path), _store(spark, tmp_path)
    first, second, third = (events_of(spark, [(t, 1, t, "view")]) for t in (1000, 2000, 3000))
    one.append(first, 0, "one")
    late = two.prepare()
    one.append(second, 0, "two")
    assert one.compact() and one.vacuum() >= 2
    assert not two.commit(late)
    assert sorted(r.ts_ms for r in two.merged("history").collect()) == [1000, 2000]
    one.append(third, 1, "one")
    assert two.compact() and not two.compact()
    two.vacuum()
    assert one.commits() == [1, 2] and one.batches() == []
    assert sorted(r.ts_ms for r in one.merged("history").collect()) == [1000, 2000, 3000]


def test_only_one_of_many_gets_a_number(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from asofkit.sources.paths import child_names, create_new, read_text

    (tmp_path / "c").mkdir()
    path = str(tmp_path / "c/000000000001")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda n: create_new(spark, path, str(n)), range(8)))
    assert sum(won) == 1 and read_text(spark, path) == str(won.index(True))
    assert child_names(spark, str(tmp_path / "c")) == ["000000000001"]


def test_readers_of_the_last_commit_can_finish(spark, tmp_path):
    store = _store(spark, tmp_path)
    store.append(events_of(spark, [(1, 1, 1, "view")]), 0)
    store.compact()
    reading = store.merged("history")  # planned against the first commit
    store.append(events_of(spark, [(2, 1, 2, "view")]), 1)
    store.compact()
    store.vacuum(keep=1)
    assert reading.count() == 1 and store.merged("history").count() == 2
    store.vacuum()
    assert len([p for p in (tmp_path / "store/snapshot").iterdir()]) == 1
    assert store.merged("history").count() == 2


def test_unfinished_snapshots_stay_and_overtaken_ones_go(spark, tmp_path):
    store = _store(spark, tmp_path)
    store.append(events_of(spark, [(1, 1, 1, "view")]), 0)
    left = store.prepare()  # its worker was lost before the commit
    store.vacuum()
    assert store.commits() == [] and (tmp_path / "store/snapshot" / left.snapshot).exists()
    store.compact()
    store.vacuum()
    assert not (tmp_path / "store/snapshot" / left.snapshot).exists()
    assert store.merged("users").count() == 1
