"""The log store trims before it exchanges: same tables with duplicates and hot users, rows dealt by user once."""

from __future__ import annotations

import random

from conftest import bursty_rows, events_of

from asofkit.schema import EVENT_COLUMNS
from asofkit.streaming.store import OnlineStore, distinct_by_user, retain_history, retain_items, retain_users


def _rows(df):
    return sorted(map(str, df.select(*EVENT_COLUMNS).collect()))


def _exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def _with_duplicates(spark, seed, n):
    events = events_of(spark, bursty_rows(seed, n=n))
    doubled = events.unionByName(events.where("ts_ms % 3 = 0")).unionByName(events.where("user_id < 2"))
    return events, spark.createDataFrame(doubled.collect(), doubled.schema)


def test_rows_are_dealt_by_user_once(spark):
    _, doubled = _with_duplicates(spark, 81, 200)
    assert len(_exchanges(distinct_by_user(doubled, lambda rows, _: retain_history(rows)))) == 1
    users = distinct_by_user(doubled, lambda rows, hot: retain_users(rows, hot_rows=hot))
    assert all("hashpartitioning(user_id" in line and line.split("hashpartitioning(")[1].split(")")[0].count("#") == 1 for line in _exchanges(users))
    # items: only what is kept is exchanged, to drop its duplicates
    assert len(_exchanges(retain_items(doubled).dropDuplicates(EVENT_COLUMNS))) == 1


def test_tables_with_duplicates_and_hot_users(spark, tmp_path):
    events, doubled = _with_duplicates(spark, 82, 400)
    want = [_rows(f(events)) for f in (retain_users, retain_items, retain_history)]
    parts = doubled.randomSplit([0.5, 0.3, 0.2], random.Random(1).randrange(99))
    for hot in (None, 30, 10**6):
        store = OnlineStore(spark, str(tmp_path / f"store{hot}"), hot_rows=hot)
        for n, part in enumerate(parts):
            store.append(part, n)
        found = [_rows(x) for x in (store.user_events(), store.item_events(), store.history_log())]
        assert found == want, hot
        store.compact()
        store.vacuum()
        store.append(events, 9)
        found = [_rows(x) for x in (store.user_events(), store.item_events(), store.history_log())]
        assert found == want, hot
