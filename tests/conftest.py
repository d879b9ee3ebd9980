"""Shared session, event builders and a slow, obvious implementation to compare with."""

from __future__ import annotations

import random

import pytest

from asofkit.definitions import STANDARD
from asofkit.schema import EVENT_SCHEMA, LAST_EVENT_CAP_MS, SESSION_GAP_MS
from asofkit.session import build_session
from asofkit.sources.events import clean

MINUTE = 60_000
HOURS_MS = 6 * 60 * MINUTE


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def events_of(spark, rows):
    """Canonical events from (ts_ms, user_id, item_id, event[, transaction_id]) tuples."""
    full = [tuple(r) + (None,) * (5 - len(r)) for r in rows]
    return clean(spark.createDataFrame(full, EVENT_SCHEMA))


# Every length that a feature is bounded by, and one millisecond to either side.
BOUNDS = sorted({w.window_ms for w in (*STANDARD.user_windows, *STANDARD.item_windows)} | {SESSION_GAP_MS})
GAPS = [0, 7, 45_000, *(b + d for b in BOUNDS[:-1] for d in (-1, 0, 1))]


def bursty_rows(seed, users=12, items=9, n=500):
    """Per user a share of the events, busy users first, at gaps around every boundary, equal times included."""
    rng = random.Random(seed)
    shares = [1 / (1 + u) for u in range(users)]
    rows = set()
    for user, share in enumerate(shares):
        at = rng.randrange(HOURS_MS)
        for _ in range(max(3, round(n * share / sum(shares)))):
            kind = rng.choices(("view", "addtocart", "transaction"), (6, 3, 1))[0]
            rows.add((at, user, rng.randrange(items), kind, len(rows) if kind == "transaction" else None))
            at += rng.choice(GAPS)
    return sorted(rows, key=lambda r: (r[:4], r[4] or -1))


def slow_user_features(rows, user, as_of, gap=SESSION_GAP_MS):
    past = sorted(r for r in ((t, i, e) for t, u, i, e, _ in rows if u == user and t < as_of))
    out = {
        "user_events_5m": sum(t >= as_of - 5 * MINUTE for t, _, _ in past),
        "user_events_1h": sum(t >= as_of - 60 * MINUTE for t, _, _ in past),
        "user_carts_1h": sum(t >= as_of - 60 * MINUTE and e == "addtocart" for t, _, e in past),
        "session_events": 0,
        "session_distinct_items": 0,
        "session_carts": 0,
        "session_duration_ms": 0,
        "last_event_age_ms": LAST_EVENT_CAP_MS,
    }
    if past:
        last = past[-1][0]
        out["last_event_age_ms"] = min(as_of - last, LAST_EVENT_CAP_MS)
        if as_of - last <= gap:
            session = [past[-1]]
            for event in reversed(past[:-1]):
                if session[-1][0] - event[0] > gap:
                    break
                session.append(event)
            out["session_events"] = len(session)
            out["session_distinct_items"] = len({i for _, i, _ in session})
            out["session_carts"] = sum(e == "addtocart" for _, _, e in session)
            out["session_duration_ms"] = last - session[-1][0]
    return out


def slow_item_features(rows, item, as_of):
    past = [(as_of - t, e) for t, _, i, e, _ in rows if i == item and t < as_of]

    def count(minutes, kind):
        return sum(age <= minutes * MINUTE and e == kind for age, e in past)

    return {
        "item_views_5m": count(5, "view"),
        "item_views_1h": count(60, "view"),
        "item_views_24h": count(1440, "view"),
        "item_carts_1h": count(60, "addtocart"),
        "item_carts_24h": count(1440, "addtocart"),
        "item_purchases_24h": count(1440, "transaction"),
    }


def slow_history(rows, user, as_of, length=50):
    past = sorted(
        (t, i, e, -1 if x is None else x) for t, u, i, e, x in rows if u == user and t < as_of
    )
    return [(t, i, e) for t, i, e, _ in past[-length:]]


def as_dicts(df):
    return [r.asDict() for r in df.collect()]
