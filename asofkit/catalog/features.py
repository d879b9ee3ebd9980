"""Point-in-time features, sessions, histories and the joins behind them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.catalog.common import (
    EV,
    IPTS,
    ORD,
    ORDERS,
    REQ,
    SPLIT,
    UPTS,
    WIDE,
    backfill_sql,
    clicks,
    item_features_sql,
    purchases,
    requests,
    user_features_sql,
    with_,
)
from asofkit.definitions import STANDARD
from asofkit.operators.order import top_per_group
from asofkit.operators.timeline import (
    as_history,
    preceding_events,
    ranked_positions,
    session_state,
    user_state,
    window_counts,
)
from asofkit.plans.features import (
    backfill,
    history_events,
    item_features,
    user_features,
    user_histories,
    with_event_index,
)
from asofkit.plans.requests import request_pairs
from asofkit.plans.retrieval import training_histories
from asofkit.schema import HISTORY_LEN, HOUR_MS

PROBE_SHIFT_MS = 17 * 60_000 + 1


def _dated(table: DataFrame) -> DataFrame:
    return table.withColumn("date", F.col("date").cast("string"))


def t1_backfill(spark, sf) -> DataFrame:
    return _dated(backfill(clicks(spark, sf)))


def t1_backfill_wide(spark, sf) -> DataFrame:
    return _dated(backfill(clicks(spark, sf), WIDE))


def t1_backfill_orders(spark, sf) -> DataFrame:
    return _dated(backfill(purchases(spark, sf), ORDERS))


def t1_backfill_hot_keys(spark, sf) -> DataFrame:
    """Every key above 30 rows takes the bucketed path."""
    return _dated(backfill(clicks(spark, sf), WIDE, hot_rows=30))


def e1_user_windows(spark, sf) -> DataFrame:
    return window_counts(clicks(spark, sf), "user_id", WIDE.user_windows)


def e1_item_windows(spark, sf) -> DataFrame:
    return window_counts(clicks(spark, sf), "item_id", WIDE.item_windows)


def e2_sessions(spark, sf) -> DataFrame:
    """Sessions of more than one event, with their extent."""
    state = session_state(clicks(spark, sf), WIDE.session_gap_ms)
    return (
        state.groupBy("user_id", F.col("session_start_ms"))
        .agg(F.count("*").alias("events"), F.max("ts_ms").alias("session_end_ms"))
        .where("events > 1")
    )


def e3_session_prefixes(spark, sf) -> DataFrame:
    state = session_state(purchases(spark, sf), ORDERS.session_gap_ms)
    return state.select(
        "user_id", "ts_ms", "item_id", "event", "transaction_id", "session_start_ms",
        "session_events", "session_carts", "session_distinct_items",
    )


def e4_session_features(spark, sf) -> DataFrame:
    return user_state(clicks(spark, sf), WIDE)


def e6_histories(spark, sf) -> DataFrame:
    return history_events(
        purchases(spark, sf), _last_moments(purchases(spark, sf))
    ).select("user_id", "as_of_ms", (F.col("end") - F.col("pos")).alias("back"), "ts_ms", "item_id", "event")


def _last_moments(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.max("ts_ms").alias("as_of_ms"))


def e7_event_index(spark, sf) -> DataFrame:
    return with_event_index(purchases(spark, sf))


def e11_preceding_rows(spark, sf) -> DataFrame:
    """Row-positional history of every event: the 50 rows before it."""
    placed = ranked_positions(clicks(spark, sf))
    ends = placed.select("user_id", (F.col("pos") - 1).alias("end"), F.col("pos").alias("target_pos"))
    return preceding_events(placed, ends, ["target_pos"], HISTORY_LEN).select(
        "user_id", "target_pos", "pos", "item_id"
    )


def e12_training_targets(spark, sf) -> DataFrame:
    events = clicks(spark, sf)
    frequent = events.groupBy("item_id").count().where("count >= 2").select("item_id")
    packed = training_histories(events, frequent, strict=False)
    return packed.select(
        "user_id",
        "target_pos",
        "target_item",
        F.size("hist").cast("long").alias("n"),
        F.aggregate("hist.item_id", F.lit(0).cast("long"), lambda a, x: a + x).alias("item_sum"),
    )


def _user_probes(spark, sf) -> DataFrame:
    """Moments shortly after each event, on event times, and for an unknown user."""
    events = clicks(spark, sf)
    shifted = events.select("user_id", (F.col("ts_ms") + PROBE_SHIFT_MS).alias("as_of_ms"))
    exact = events.select("user_id", F.col("ts_ms").alias("as_of_ms"))
    unknown = events.select((-F.col("user_id") - 1).alias("user_id"), F.col("ts_ms").alias("as_of_ms"))
    return shifted.unionByName(exact).unionByName(unknown).distinct()


def _item_probes(spark, sf) -> DataFrame:
    events = clicks(spark, sf)
    shifted = events.select("item_id", (F.col("ts_ms") + PROBE_SHIFT_MS).alias("as_of_ms"))
    return shifted.unionByName(events.select("item_id", F.col("ts_ms").alias("as_of_ms"))).distinct()


def t2_user_features(spark, sf) -> DataFrame:
    return user_features(clicks(spark, sf), _user_probes(spark, sf), WIDE)


def t2_user_features_hot_keys(spark, sf) -> DataFrame:
    return user_features(clicks(spark, sf), _user_probes(spark, sf), WIDE, hot_rows=50)


def t3_item_features(spark, sf) -> DataFrame:
    return item_features(clicks(spark, sf), _item_probes(spark, sf), WIDE)


def t4_user_histories(spark, sf) -> DataFrame:
    return _text_lists(user_histories(clicks(spark, sf), _user_probes(spark, sf)))


def t4_user_histories_hot_keys(spark, sf) -> DataFrame:
    return _text_lists(user_histories(clicks(spark, sf), _user_probes(spark, sf), hot_rows=50))


def _text_lists(lists: DataFrame) -> DataFrame:
    def text(c: str):
        return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)

    return lists.select("user_id", "as_of_ms", text("hist_ts"), text("hist_items"), text("hist_events"))


def c3_events_of_requests(spark, sf) -> DataFrame:
    frame = requests(spark, sf).frame
    return clicks(spark, sf).join(F.broadcast(frame.select("user_id")), "user_id", "left_semi")


def c5_first_seen(spark, sf) -> DataFrame:
    events = clicks(spark, sf)
    first = events.groupBy("user_id").agg(F.min("ts_ms").alias("first_ts"))
    return events.join(first, "user_id").select("user_id", "ts_ms", "item_id", "first_ts")


def c6_request_events(spark, sf) -> DataFrame:
    pairs = request_pairs(clicks(spark, sf), requests(spark, sf).frame, small=False)
    return pairs.select("request_id", "user_id", "as_of_ms", "ts_ms", "item_id")


def c9_column_concat(spark, sf) -> DataFrame:
    """User and item features of the same points side by side, joined on the point."""
    events = clicks(spark, sf)
    points = events.select("user_id", "item_id", F.col("ts_ms").alias("as_of_ms"))
    with_users = user_features(events, points, WIDE)
    return item_features(events, with_users, WIDE)


def c10_as_of_join(spark, sf) -> DataFrame:
    """The user's last event strictly before each probe, and whether it is recent."""
    latest = history_events(clicks(spark, sf), _user_probes(spark, sf), length=1)
    return latest.select(
        "user_id", "as_of_ms", "ts_ms", "item_id", "event",
        (F.col("as_of_ms") - F.col("ts_ms") <= 6 * HOUR_MS).cast("int").alias("active"),
    )


def c11_range_count(spark, sf) -> DataFrame:
    return item_features(purchases(spark, sf), _order_probes(spark, sf), ORDERS)


def _order_probes(spark, sf) -> DataFrame:
    return purchases(spark, sf).select("item_id", (F.col("ts_ms") + 1).alias("as_of_ms")).distinct()


def e13_first_after_shuffle(spark, sf) -> DataFrame:
    """One event per user in digest order."""
    order = [F.md5(F.concat_ws(":", F.col("user_id").cast("string"), F.col("ts_ms").cast("string"))),
             F.col("ts_ms"), F.col("item_id")]
    events = clicks(spark, sf).select("user_id", "ts_ms", "item_id")
    return top_per_group(events, ["user_id"], order, 1, "r").drop("r")


def e9_position_from_end(spark, sf) -> DataFrame:
    history = requests(spark, sf).history
    return history.select(
        "request_id", "item_id", "ts_ms", (F.col("end") - F.col("pos")).alias("pos_from_end")
    )


def h_history_lists(spark, sf) -> DataFrame:
    lists = as_history(requests(spark, sf).history, ["request_id"])
    return lists.select(
        "request_id", F.array_join(F.col("hist_items").cast("array<string>"), ",").alias("items")
    )


QUERIES = {
    f.__name__: f
    for f in (
        t1_backfill, t1_backfill_wide, t1_backfill_orders, t1_backfill_hot_keys, e1_user_windows,
        e1_item_windows, e2_sessions, e3_session_prefixes, e4_session_features, e6_histories,
        e7_event_index, e9_position_from_end, e11_preceding_rows, e12_training_targets,
        e13_first_after_shuffle, t2_user_features, t2_user_features_hot_keys, t3_item_features,
        t4_user_histories, t4_user_histories_hot_keys, c3_events_of_requests, c5_first_seen,
        c6_request_events, c9_column_concat, c10_as_of_join, c11_range_count, h_history_lists,
    )
}

_USER_JOIN = "FROM ev e JOIN uf ON uf.user_id = e.user_id AND uf.as_of_ms = e.ts_ms"
_WINDOWS = ", ".join(w.name for w in STANDARD.user_windows)
_STARTS = """prevs AS (SELECT *, lag(ts_ms) OVER (PARTITION BY user_id ORDER BY ts_ms) AS prev FROM ev),
runs AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts_ms - prev > {gap} THEN 1 ELSE 0 END)
  OVER (PARTITION BY user_id ORDER BY ts_ms ROWS UNBOUNDED PRECEDING) AS run FROM prevs)"""
_PROBES = f"""probes AS (SELECT user_id, ts_ms + {PROBE_SHIFT_MS} AS as_of_ms FROM ev
  UNION SELECT user_id, ts_ms FROM ev UNION SELECT -user_id - 1, ts_ms FROM ev)"""
_ITEM_PROBES = f"""iprobes AS (SELECT item_id, ts_ms + {PROBE_SHIFT_MS} AS as_of_ms FROM ev
  UNION SELECT item_id, ts_ms FROM ev)"""
_LISTS = """past50 AS (SELECT * FROM (SELECT p.user_id, p.as_of_ms, e.ts_ms, e.item_id, e.event, e.transaction_id,
  row_number() OVER (PARTITION BY p.user_id, p.as_of_ms ORDER BY e.ts_ms DESC, e.item_id DESC, e.event DESC,
    e.transaction_id DESC NULLS LAST) AS back
  FROM probes p JOIN ev e ON e.user_id = p.user_id AND e.ts_ms < p.as_of_ms) WHERE back <= 50)"""
_LISTS_SELECT = """SELECT p.user_id, p.as_of_ms,
  coalesce(string_agg(ts_ms, ',' ORDER BY back DESC), '') AS hist_ts,
  coalesce(string_agg(item_id, ',' ORDER BY back DESC), '') AS hist_items,
  coalesce(string_agg(event, ',' ORDER BY back DESC), '') AS hist_events
  FROM probes p LEFT JOIN past50 h USING (user_id, as_of_ms) GROUP BY 1, 2"""
_WIDE_USERS = with_(EV, _PROBES, user_features_sql("probes", WIDE)) + "SELECT * FROM uf"
_POS = """placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms, item_id, event,
  transaction_id NULLS FIRST) AS pos FROM ev)"""

ORACLES = {
    "t1_backfill": backfill_sql(),
    "t1_backfill_wide": backfill_sql(EV, WIDE),
    "t1_backfill_orders": backfill_sql(ORD, ORDERS),
    "t1_backfill_hot_keys": backfill_sql(EV, WIDE),
    "e1_user_windows": with_(EV, UPTS, user_features_sql("upts", WIDE))
    + f"SELECT e.*, {_WINDOWS} {_USER_JOIN}",
    "e1_item_windows": with_(EV, IPTS, item_features_sql("ipts", WIDE))
    + "SELECT e.*, itf.* EXCLUDE (item_id, as_of_ms) FROM ev e"
    " JOIN itf ON itf.item_id = e.item_id AND itf.as_of_ms = e.ts_ms",
    "e2_sessions": with_(EV, _STARTS.format(gap=WIDE.session_gap_ms))
    + "SELECT user_id, min(ts_ms) AS session_start_ms, count(*) AS events, max(ts_ms) AS session_end_ms"
    " FROM runs GROUP BY user_id, run HAVING count(*) > 1",
    "e3_session_prefixes": with_(
        ORD, _STARTS.format(gap=ORDERS.session_gap_ms),
        "s AS (SELECT *, min(ts_ms) OVER (PARTITION BY user_id, run) AS session_start_ms FROM runs)",
    )
    + """SELECT a.user_id, a.ts_ms, a.item_id, a.event, a.transaction_id, a.session_start_ms,
  count(b.ts_ms) AS session_events, count(b.ts_ms) FILTER (WHERE b.event = 'addtocart') AS session_carts,
  count(DISTINCT b.item_id) AS session_distinct_items
  FROM (SELECT *, row_number() OVER () AS rid FROM s) a
  LEFT JOIN s b ON b.user_id = a.user_id AND b.run = a.run AND b.ts_ms < a.ts_ms GROUP BY a.rid, 1, 2, 3, 4, 5, 6""",
    "e4_session_features": with_(EV, UPTS, user_features_sql("upts", WIDE))
    + f"SELECT e.*, uf.* EXCLUDE (user_id, as_of_ms) {_USER_JOIN}",
    "e6_histories": with_(ORD)
    + """SELECT * FROM (SELECT e.user_id, as_of_ms, row_number() OVER (PARTITION BY e.user_id ORDER BY e.ts_ms DESC,
  e.item_id DESC, e.event DESC, e.transaction_id DESC NULLS LAST) - 1 AS back, e.ts_ms, e.item_id, e.event
  FROM (SELECT user_id, max(ts_ms) AS as_of_ms FROM ev GROUP BY 1) p JOIN ev e ON e.user_id = p.user_id AND e.ts_ms < as_of_ms)
  WHERE back < 50""",
    "e7_event_index": with_(ORD)
    + "SELECT *, row_number() OVER (ORDER BY ts_ms, user_id, item_id, event, transaction_id NULLS FIRST) - 1 AS event_idx FROM ev",
    "e9_position_from_end": with_(EV, SPLIT, REQ)
    + "SELECT request_id, item_id, ts_ms, back AS pos_from_end FROM hist",
    "e11_preceding_rows": with_(EV, _POS)
    + "SELECT t.user_id, t.pos AS target_pos, h.pos, h.item_id FROM placed t"
    " JOIN placed h ON h.user_id = t.user_id AND h.pos < t.pos AND h.pos >= t.pos - 50",
    "e12_training_targets": with_(EV, _POS)
    + """SELECT t.user_id, t.pos AS target_pos, t.item_id AS target_item, count(*) AS n,
  CAST(sum(h.item_id) AS BIGINT) AS item_sum FROM placed t
  JOIN placed h ON h.user_id = t.user_id AND h.pos < t.pos AND h.pos >= t.pos - 50
  WHERE t.item_id IN (SELECT item_id FROM ev GROUP BY 1 HAVING count(*) >= 2) GROUP BY 1, 2, 3""",
    "e13_first_after_shuffle": with_(EV)
    + """SELECT user_id, ts_ms, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id
  ORDER BY md5(concat_ws(':', CAST(user_id AS VARCHAR), CAST(ts_ms AS VARCHAR))), ts_ms, item_id) AS r FROM ev) WHERE r = 1""",
    "t2_user_features": _WIDE_USERS,
    "t2_user_features_hot_keys": _WIDE_USERS,
    "t3_item_features": with_(EV, _ITEM_PROBES, item_features_sql("iprobes", WIDE)) + "SELECT * FROM itf",
    "t4_user_histories": with_(EV, _PROBES, _LISTS) + _LISTS_SELECT,
    "t4_user_histories_hot_keys": with_(EV, _PROBES, _LISTS) + _LISTS_SELECT,
    "c3_events_of_requests": with_(EV, SPLIT, REQ)
    + "SELECT * FROM ev WHERE user_id IN (SELECT user_id FROM req)",
    "c5_first_seen": with_(EV)
    + "SELECT user_id, ts_ms, item_id, min(ts_ms) OVER (PARTITION BY user_id) AS first_ts FROM ev",
    "c6_request_events": with_(EV, SPLIT, REQ)
    + "SELECT request_id, user_id, as_of_ms, ts_ms, item_id FROM req JOIN ev USING (user_id)",
    "c9_column_concat": with_(
        EV, UPTS, IPTS, user_features_sql("upts", WIDE), item_features_sql("ipts", WIDE)
    )
    + "SELECT e.user_id, e.item_id, e.ts_ms AS as_of_ms, uf.* EXCLUDE (user_id, as_of_ms),"
    " itf.* EXCLUDE (item_id, as_of_ms) FROM ev e JOIN uf ON uf.user_id = e.user_id AND uf.as_of_ms = e.ts_ms"
    " JOIN itf ON itf.item_id = e.item_id AND itf.as_of_ms = e.ts_ms",
    "c10_as_of_join": with_(EV, _PROBES, _LISTS)
    + f"SELECT user_id, as_of_ms, ts_ms, item_id, event, CASE WHEN as_of_ms - ts_ms <= {6 * HOUR_MS} THEN 1 ELSE 0 END AS active"
    " FROM past50 WHERE back = 1",
    "c11_range_count": with_(
        ORD, "iprobes AS (SELECT DISTINCT item_id, ts_ms + 1 AS as_of_ms FROM ev)",
        item_features_sql("iprobes", ORDERS),
    )
    + "SELECT * FROM itf",
    "h_history_lists": with_(EV, SPLIT, REQ)
    + "SELECT request_id, string_agg(item_id, ',' ORDER BY back DESC) AS items FROM hist GROUP BY 1",
}
