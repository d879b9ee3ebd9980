import random

import pytest
from conftest import (
    MINUTE,
    as_dicts,
    bursty_rows,
    events_of,
    slow_history,
    slow_item_features,
    slow_user_features,
)
from pyspark.sql import functions as F

from asofkit.definitions import ITEM_FEATURES, STANDARD, USER_FEATURES, WindowCount
from asofkit.operators.order import dense_index
from asofkit.operators.skew import scan_before, split_hot
from asofkit.operators.timeline import preceding_events, ranked_positions, window_counts
from asofkit.plans.features import (
    backfill,
    item_features,
    user_features,
    user_histories,
    with_event_index,
)
from asofkit.schema import DAY_MS, SESSION_GAP_MS

HOT = [None, 1_000_000, 25]  # no check, check without hot keys, most keys hot


def _points(rows, column, seed, n=120):
    rng = random.Random(seed)
    end = max(r[0] for r in rows) + 60 * MINUTE
    ids = [r[column] for r in rows]
    exact = [(r[column], r[0]) for r in rng.sample(rows, n // 2)]
    anywhere = [(rng.choice(ids), rng.randrange(end)) for _ in range(n // 2)]
    return sorted(set(exact + anywhere) | {(10**6, end)})  # and an unknown entity


@pytest.mark.parametrize("hot_rows", HOT)
@pytest.mark.parametrize("seed", [1, 2])
def test_user_features_match_the_slow_version(spark, seed, hot_rows):
    rows = bursty_rows(seed)
    points = _points(rows, 1, seed)
    queries = spark.createDataFrame(points, "user_id long, as_of_ms long")
    found = as_dicts(user_features(events_of(spark, rows), queries, hot_rows=hot_rows))
    assert len(found) == len(points)
    for r in found:
        want = slow_user_features(rows, r["user_id"], r["as_of_ms"])
        assert {f: r[f] for f in USER_FEATURES} == want, r


@pytest.mark.parametrize("hot_rows", HOT)
def test_item_features_match_the_slow_version(spark, hot_rows):
    rows = bursty_rows(3)
    points = _points(rows, 2, 3)
    queries = spark.createDataFrame(points, "item_id long, as_of_ms long")
    found = as_dicts(item_features(events_of(spark, rows), queries, hot_rows=hot_rows))
    assert len(found) == len(points)
    for r in found:
        want = slow_item_features(rows, r["item_id"], r["as_of_ms"])
        assert {f: r[f] for f in ITEM_FEATURES} == want, r


@pytest.mark.parametrize("hot_rows", HOT)
def test_histories_match_the_slow_version(spark, hot_rows):
    rows = bursty_rows(4)
    points = _points(rows, 1, 4)
    queries = spark.createDataFrame(points, "user_id long, as_of_ms long")
    found = as_dicts(user_histories(events_of(spark, rows), queries, hot_rows=hot_rows))
    assert len(found) == len(points)
    lengths = set()
    for r in found:
        got = list(zip(r["hist_ts"], r["hist_items"], r["hist_events"]))
        assert got == slow_history(rows, r["user_id"], r["as_of_ms"])
        lengths.add(len(got))
    assert {0, 50} <= lengths


@pytest.mark.parametrize("hot_rows", [None, 25])
def test_backfill_gives_every_event_its_own_features(spark, hot_rows):
    rows = bursty_rows(5)
    found = as_dicts(backfill(events_of(spark, rows), hot_rows=hot_rows))
    assert len(found) == len(rows)
    for r in found:
        want = slow_user_features(rows, r["user_id"], r["ts_ms"])
        want |= slow_item_features(rows, r["item_id"], r["ts_ms"])
        assert {f: r[f] for f in want} == want


def test_one_key_with_a_third_of_all_rows_in_one_millisecond(spark):
    """Equal times of a hot key collapse to one point and still count fully."""
    rows = [(1000, 1, i % 7, "view", i) for i in range(300)]
    rows += [(2000 + i, 2 + i, i, "view") for i in range(600)]
    events = events_of(spark, rows)
    queries = spark.createDataFrame([(1, 1000), (1, 1001)], "user_id long, as_of_ms long")
    found = {r["as_of_ms"]: r for r in as_dicts(user_features(events, queries, hot_rows=50))}
    assert found[1000]["user_events_5m"] == 0
    assert found[1001]["user_events_5m"] == 300 and found[1001]["session_distinct_items"] == 7


def test_hand_computed_example(spark):
    minutes = [(0, 1, "view"), (1, 2, "addtocart"), (2, 1, "view"), (40, 3, "view"), (41, 3, "addtocart")]
    events = events_of(spark, [(m * MINUTE, 1, i, e) for m, i, e in minutes])
    queries = spark.createDataFrame(
        [(1, 41 * MINUTE), (1, 42 * MINUTE)], "user_id long, as_of_ms long"
    )
    at41, at42 = sorted(as_dicts(user_features(events, queries)), key=lambda r: r["as_of_ms"])
    assert (at41["user_events_5m"], at41["user_events_1h"], at41["user_carts_1h"]) == (1, 4, 1)
    assert at42["session_events"] == 2 and at42["session_distinct_items"] == 1
    assert at42["session_carts"] == 1 and at42["session_duration_ms"] == 60_000


def test_a_gap_of_exactly_thirty_minutes_stays_in_the_session(spark):
    events = events_of(spark, [(0, 1, 1, "view"), (SESSION_GAP_MS, 1, 2, "view")])
    last = 2 * SESSION_GAP_MS
    queries = spark.createDataFrame([(1, last), (1, last + 1)], "user_id long, as_of_ms long")
    on, after = sorted(as_dicts(user_features(events, queries)), key=lambda r: r["as_of_ms"])
    assert on["session_events"] == 2 and after["session_events"] == 0


@pytest.mark.parametrize("hot_rows", [None, 25])
def test_later_events_change_nothing(spark, hot_rows):
    rows = bursty_rows(6)
    t = rows[len(rows) // 2][0]
    past = [r for r in rows if r[0] < t]
    users = spark.createDataFrame([(u, t) for u in range(12)], "user_id long, as_of_ms long")
    items = spark.createDataFrame([(i, t) for i in range(9)], "item_id long, as_of_ms long")
    full, cut = events_of(spark, rows), events_of(spark, past)

    def both(job, queries):
        a, b = job(full, queries, hot_rows=hot_rows), job(cut, queries, hot_rows=hot_rows)
        return sorted(map(str, a.collect())), sorted(map(str, b.collect()))

    for job, queries in ((user_features, users), (item_features, items), (user_histories, users)):
        a, b = both(job, queries)
        assert a == b


def test_repeated_query_points_are_answered_each(spark):
    events = events_of(spark, [(0, 1, 1, "view")])
    queries = spark.createDataFrame([(7, 1, 5), (8, 1, 5)], "q long, user_id long, as_of_ms long")
    assert sorted(r["q"] for r in as_dicts(user_features(events, queries))) == [7, 8]


def test_empty_log(spark):
    events = events_of(spark, [(0, 1, 1, "view")]).limit(0)
    queries = spark.createDataFrame([(1, 5)], "user_id long, as_of_ms long")
    [r] = as_dicts(user_features(events, queries))
    assert r["user_events_1h"] == 0 and r["last_event_age_ms"] == STANDARD.last_event_cap_ms


def test_backfill_needs_one_exchange_per_entity(spark, tmp_path):
    events_of(spark, bursty_rows(7)).write.parquet(str(tmp_path / "ev"))
    events = spark.read.parquet(str(tmp_path / "ev"))
    plan = backfill(events)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "Join" not in plan


def test_unused_features_are_not_computed(spark, tmp_path):
    events_of(spark, bursty_rows(7)).write.parquet(str(tmp_path / "ev"))
    events = spark.read.parquet(str(tmp_path / "ev"))
    plan = backfill(events).select("user_id", "item_views_5m")._jdf.queryExecution().optimizedPlan()
    text = plan.toString().split("Relation")[0]  # the scan lists every column it could read
    assert text.count("Window [") == 1 and "session" not in text and "transaction_id" not in text


def test_scan_before_crosses_buckets(spark):
    rng = random.Random(0)
    times = sorted(rng.sample(range(2000), 120))
    rows = [(rng.randrange(2), t, rng.randrange(5), rng.choice([None, t])) for t in times]
    df = spark.createDataFrame(rows, "k long, ts_ms long, n long, m long")
    found = as_dicts(scan_before(df, ["k"], 100, sums=["n"], maxes=["m"]))
    assert len(found) == 120
    for r in found:
        past = [x for x in rows if x[0] == r["k"] and x[1] < r["ts_ms"]]
        assert r["before_n"] == sum(x[2] for x in past)
        assert r["before_m"] == max((x[3] for x in past if x[3] is not None), default=None)


def test_split_hot_parts_cover_everything_once(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    df = df.withColumn("k", F.when(F.col("id") % 3 == 0, 99).otherwise(F.col("k")))
    cold, hot = split_hot(df, "k", 300)
    assert {r.k for r in hot.select("k").distinct().collect()} == {99}
    assert cold.count() + hot.count() == 1000
    assert split_hot(df, "k", 2000)[1] is None


def test_dense_index_is_dense_and_ordered(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x")).repartition(7)
    found = dense_index(df, ["x"], "i", start=5).orderBy("i").collect()
    assert [r.i for r in found] == list(range(5, 1005))
    assert [r.x for r in found] == sorted(r.x for r in found)


def test_event_index_follows_the_canonical_order(spark):
    rows = bursty_rows(8)
    found = sorted(as_dicts(with_event_index(events_of(spark, rows))), key=lambda r: r["event_idx"])
    got = [(r["ts_ms"], r["user_id"], r["item_id"], r["event"]) for r in found]
    assert got == [r[:4] for r in rows]


def test_preceding_rows_stay_with_the_user(spark):
    rows = bursty_rows(9, n=200)
    placed = ranked_positions(events_of(spark, rows))
    ends = placed.select("user_id", (F.col("pos") - 1).alias("end"), F.col("pos").alias("at"))
    found = as_dicts(preceding_events(placed, ends, ["at"], 3))
    by_user = {}
    for r in as_dicts(placed):
        by_user.setdefault(r["user_id"], {})[r["pos"]] = r["item_id"]
    want = {
        (u, at, p): item
        for u, seq in by_user.items()
        for at in seq
        for p, item in seq.items()
        if at - 3 <= p < at
    }
    assert {(r["user_id"], r["at"], r["pos"]): r["item_id"] for r in found} == want


def test_windows_longer_than_a_bucket_on_hot_keys(spark):
    """A year of events and windows up to a year: both paths agree, and no window group is longer than a day."""
    rng = random.Random(12)
    rows = sorted({(rng.randrange(400) * DAY_MS // 3 + rng.choice((0, 1, 5)), u, 3, rng.choice(("view", "addtocart")), None) for u in (1, 1, 1, 2) for _ in range(220)})
    windows = [
        WindowCount("h", 60 * MINUTE), WindowCount("d", DAY_MS, "view"), WindowCount("m", 30 * DAY_MS), WindowCount("y", 365 * DAY_MS, "addtocart"),
    ]
    events = events_of(spark, rows)
    probes = spark.createDataFrame([(u, t * DAY_MS) for u in (1, 2, 9) for t in (0, 31, 133, 134, 500)], "user_id long, ts_ms long")
    both = events.unionByName(probes, allowMissingColumns=True)

    def counts(chosen, hot):
        found = window_counts(both, "user_id", chosen, hot)
        return sorted(map(str, found.select(*sorted(found.columns)).collect()))

    plain = counts(windows, None)
    assert plain == counts(windows, 25) and len(plain) == len(rows) + 15
    assert counts(windows[2:], 25) == counts(windows[2:], None)
    plan = window_counts(both, "user_id", windows, 25)._jdf.queryExecution().analyzed().toString()
    assert "_bucket" in plan and str(365 * DAY_MS) in plan
