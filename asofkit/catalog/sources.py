"""Sources, sinks, filters and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.catalog.common import (
    BACKFILL_COLUMNS,
    BACKFILL_FROM,
    EV,
    IPTS,
    REQ,
    SEED,
    SPLIT,
    UPTS,
    clicks,
    item_features_sql,
    purchases,
    r6,
    requests,
    user_features_sql,
    utc,
    weekly_split,
    with_,
)
from asofkit.definitions import STANDARD
from asofkit.functions import columns as fn
from asofkit.operators.order import dense_index
from asofkit.operators.timeline import as_history
from asofkit.plans.baselines import trailing
from asofkit.plans.eda import active_users, daily_volume
from asofkit.plans.features import backfill, item_features, with_event_index
from asofkit.plans.split import labelled, time_bounds
from asofkit.schema import DAY_MS, EVENT_COLUMNS, EVENT_TYPES, RAW_CSV_SCHEMA
from asofkit.session import scratch_path
from asofkit.sources.events import (
    build_cache,
    clean,
    first_n,
    from_date,
    load_events,
    order_violations,
    read_raw_csv,
    to_schema,
)
from asofkit.sources.feature_log import FeatureLog, write_feature_log
from asofkit.sources.messages import decode, encode
from asofkit.sources.reports import write_report
from asofkit.sources.tables import vectors

_RAW = {"ts_ms": "timestamp", "user_id": "visitorid", "item_id": "itemid", "transaction_id": "transactionid"}


def _raw_csv(spark, sf) -> str:
    path = scratch_path(spark, "raw")
    raw = clicks(spark, sf).withColumnsRenamed(_RAW).select(*RAW_CSV_SCHEMA.names)
    raw.write.option("header", True).csv(path)
    return path


def a1_read_csv(spark, sf) -> DataFrame:
    return read_raw_csv(spark, _raw_csv(spark, sf))


def a2_clean(spark, sf) -> DataFrame:
    twice = clicks(spark, sf).unionByName(clicks(spark, sf))
    return clean(twice)


def a3_event_types(spark, sf) -> DataFrame:
    return to_schema(clicks(spark, sf)).groupBy("event").agg(F.count("*").alias("n"))


def a4_build_cache(spark, sf) -> DataFrame:
    cached = build_cache(spark, _raw_csv(spark, sf), scratch_path(spark, "cache"))
    return cached.groupBy("event").agg(F.count("*").alias("n"), F.max("ts_ms").alias("last_ts"))


def a5_load_events(spark, sf) -> DataFrame:
    return load_events(spark, scratch_path(spark, "cache"), _raw_csv(spark, sf))


def _feature_log(spark, sf) -> FeatureLog:
    root = scratch_path(spark, "features")
    write_feature_log(with_event_index(backfill(clicks(spark, sf))), root)
    return FeatureLog(spark, root)


def a6_write_partitioned(spark, sf) -> DataFrame:
    log = _feature_log(spark, sf)
    return log.query(
        "SELECT CAST(date AS STRING) AS date, count(*) AS n, sum(item_views_24h) AS views"
        " FROM event_features GROUP BY date"
    )


def a7_feature_view(spark, sf) -> DataFrame:
    log = _feature_log(spark, sf)
    return log.query("SELECT event, count(*) AS n, max(event_idx) AS last_idx FROM event_features GROUP BY event")


def a8_parametrised_sql(spark, sf) -> DataFrame:
    log = _feature_log(spark, sf)
    return log.query(
        "SELECT user_id, count(*) AS n, max(user_events_1h) AS busiest FROM event_features"
        " WHERE event = ? AND ts_ms >= ? GROUP BY user_id",
        ["view", 1705000000000],
    )


_RANGE = (1704800000000, 1705400000000)


def a9_time_range(spark, sf) -> DataFrame:
    return _feature_log(spark, sf).between(*_RANGE)


def a10_encode(spark, sf) -> DataFrame:
    return encode(clicks(spark, sf))


def a13_from_date(spark, sf) -> DataFrame:
    return from_date(clicks(spark, sf), "2024-01-15")


def a13_first_n(spark, sf) -> DataFrame:
    return first_n(clicks(spark, sf), 500)


_ARRIVAL = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "ts_ms"]


def a14_order_check(spark, sf) -> DataFrame:
    lines = utc(spark).read.parquet(f"{sf}/lineitem.parquet")
    lines = lines.withColumn("ts_ms", F.unix_millis(F.col("l_shipdate").cast("timestamp")))
    arrivals = dense_index(lines.select(*_ARRIVAL), _ARRIVAL, "seq")
    return order_violations(arrivals, "seq").agg(
        F.count_if("before_first").alias("before_first"),
        F.count_if("inversion").alias("inversions"),
    )


def a15_report(spark, sf) -> DataFrame:
    path = scratch_path(spark, "report")
    daily = daily_volume(clicks(spark, sf)).withColumn("day", F.col("day").cast("string"))
    write_report(daily, path)
    return spark.read.schema(daily.schema).json(path)


def b1_split_filter(spark, sf) -> DataFrame:
    return labelled(weekly_split(spark, sf)).groupBy("part").agg(
        F.count("*").alias("n"), F.min("ts_ms").alias("first_ts"), F.max("ts_ms").alias("last_ts")
    )


def b2_type_filter(spark, sf) -> DataFrame:
    return clicks(spark, sf).groupBy("item_id").agg(
        *[F.count_if(F.col("event") == t).alias(f"n_{t}") for t in EVENT_TYPES]
    )


def b3_trailing_window(spark, sf) -> DataFrame:
    return trailing(clicks(spark, sf), 7)


def b5_valid_ids(spark, sf) -> DataFrame:
    """Items without a vector get the sentinel -1 and are dropped."""
    known = vectors(spark, sf).select("item_id", F.lit(1).alias("known"))
    touched = clicks(spark, sf).join(known, "item_id", "left")
    marked = touched.select("user_id", F.when(F.col("known") == 1, F.col("item_id")).otherwise(-1).alias("item_id"))
    return marked.where(F.col("item_id") >= 0).groupBy("user_id").agg(F.count("*").alias("n"))


def b6_weights(spark, sf) -> DataFrame:
    return clicks(spark, sf).groupBy("user_id").agg(F.sum(fn.event_weight()).alias("weight"))


def b7_active_users(spark, sf) -> DataFrame:
    events = clicks(spark, sf)
    return active_users(events, time_bounds(events)[1])


def b8_feature_subset(spark, sf) -> DataFrame:
    events = clicks(spark, sf)
    points = events.select("item_id", F.col("ts_ms").alias("as_of_ms"))
    return item_features(events, points, STANDARD.only_items(["item_views_24h"]))


def g1_train_and_val(spark, sf) -> DataFrame:
    return weekly_split(spark, sf).train_val


def g2_distinct_pairs(spark, sf) -> DataFrame:
    return purchases(spark, sf).select("user_id", "item_id").distinct()


def h1_epoch_to_date(spark, sf) -> DataFrame:
    return clicks(spark, sf).select(
        "ts_ms",
        "user_id",
        F.date_format(fn.event_date(F.col("ts_ms")), "yyyy-MM-dd").alias("date"),
        F.date_format(F.timestamp_millis("ts_ms"), "yyyy-MM-dd HH:mm:ss").alias("at"),
    )


def h2_date_to_epoch(spark, sf) -> DataFrame:
    days = purchases(spark, sf).select(
        F.date_format(fn.event_date(F.col("ts_ms")), "yyyy-MM-dd").alias("day")
    )
    return days.distinct().withColumn("ms", fn.iso_date_ms(F.col("day")))


def h3_clip(spark, sf) -> DataFrame:
    start = 1705000000000
    age = F.col("ts_ms") - start
    return clicks(spark, sf).select(
        "ts_ms",
        "user_id",
        fn.clipped(age, DAY_MS).alias("at_most_a_day"),
        F.greatest(age, F.lit(0)).alias("not_negative"),
    )


def h4_fill_and_cast(spark, sf) -> DataFrame:
    return clicks(spark, sf).select(
        "ts_ms",
        "user_id",
        F.coalesce("transaction_id", F.lit(-1)).alias("transaction_id"),
        F.when(F.col("event") == "view", 1).otherwise(0).alias("is_view"),
        F.col("item_id").cast("double").alias("item_double"),
    )


def _request_lists(spark, sf) -> DataFrame:
    return as_history(requests(spark, sf).history, ["request_id"])


def h5_explode_lists(spark, sf) -> DataFrame:
    zipped = F.posexplode(F.arrays_zip("hist_ts", "hist_items", "hist_events"))
    return (
        _request_lists(spark, sf)
        .select("request_id", F.size("hist_items").cast("long").alias("n"), zipped)
        .select("request_id", "n", F.col("pos").cast("long").alias("idx"), "col.hist_ts", "col.hist_items", "col.hist_events")
    )


def h6_reverse_distinct(spark, sf) -> DataFrame:
    items = fn.reverse_distinct(F.col("hist_items"))
    return _request_lists(spark, sf).select(
        "request_id", F.array_join(items.cast("array<string>"), ",").alias("items")
    )


def h7_json_round_trip(spark, sf) -> DataFrame:
    return decode(encode(clicks(spark, sf))).where("accepted").select(*EVENT_COLUMNS)


def h8_dot_and_norm(spark, sf) -> DataFrame:
    vecs = vectors(utc(spark), sf).select("item_id", "vec")
    nxt = vecs.select((F.col("item_id") - 1).alias("item_id"), F.col("vec").alias("next_vec"))
    unit = fn.l2_normalised(F.col("vec"))
    return vecs.join(nxt, "item_id").select(
        "item_id",
        r6(fn.dot(F.col("vec"), F.col("next_vec"))).alias("dot"),
        r6(fn.dot(unit, unit)).alias("unit_norm"),
    )


def h9_logarithms(spark, sf) -> DataFrame:
    return clicks(spark, sf).select(
        "ts_ms",
        "user_id",
        r6(fn.rank_discount(F.col("item_id"))).alias("discount"),
        r6(F.log(F.col("item_id") + 1.0)).alias("ln_value"),
    )


def h10_round(spark, sf) -> DataFrame:
    return (
        spark.read.parquet(f"{sf}/lineitem.parquet")
        .groupBy("l_suppkey")
        .agg(F.round(F.avg(F.col("l_extendedprice") / 7), 3).alias("price"))
    )


def h11_sampling_hash(spark, sf) -> DataFrame:
    return clicks(spark, sf).select(
        "user_id", "ts_ms", fn.sampling_digest(SEED, ["user_id", "ts_ms"]).alias("digest")
    )


QUERIES = {
    f.__name__: f
    for f in (
        a1_read_csv, a2_clean, a3_event_types, a4_build_cache, a5_load_events, a6_write_partitioned,
        a7_feature_view, a8_parametrised_sql, a9_time_range, a10_encode, a13_from_date, a13_first_n,
        a14_order_check, a15_report, b1_split_filter, b2_type_filter, b3_trailing_window,
        b5_valid_ids, b6_weights, b7_active_users, b8_feature_subset, g1_train_and_val,
        g2_distinct_pairs, h1_epoch_to_date, h2_date_to_epoch, h3_clip, h4_fill_and_cast,
        h5_explode_lists, h6_reverse_distinct, h7_json_round_trip, h8_dot_and_norm, h9_logarithms,
        h10_round, h11_sampling_hash,
    )
}

_ALL = "SELECT DISTINCT ts_ms, user_id, item_id, event, transaction_id FROM ev"
_FEATURES = with_(
    EV, UPTS, IPTS, user_features_sql("upts"), item_features_sql("ipts"),
    f"f AS (SELECT {BACKFILL_COLUMNS}, row_number() OVER (ORDER BY e.ts_ms, e.user_id, e.item_id, e.event,"
    f" e.transaction_id NULLS FIRST) - 1 AS event_idx FROM {BACKFILL_FROM})",
)
_DAILY = """SELECT strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS day,
  count(*) FILTER (WHERE event = 'view') AS view, count(*) FILTER (WHERE event = 'addtocart') AS addtocart,
  count(*) FILTER (WHERE event = 'transaction') AS "transaction" FROM ev GROUP BY 1"""

ORACLES = {
    "a1_read_csv": with_(EV) + _ALL,
    "a2_clean": with_(EV) + _ALL,
    "a3_event_types": with_(EV) + "SELECT event, count(*) AS n FROM ev GROUP BY 1",
    "a4_build_cache": with_(EV, f"d AS ({_ALL})")
    + "SELECT event, count(*) AS n, max(ts_ms) AS last_ts FROM d GROUP BY 1",
    "a5_load_events": with_(EV) + _ALL,
    "a6_write_partitioned": _FEATURES
    + "SELECT date, count(*) AS n, CAST(sum(item_views_24h) AS BIGINT) AS views FROM f GROUP BY 1",
    "a7_feature_view": _FEATURES
    + "SELECT event, count(*) AS n, max(event_idx) AS last_idx FROM f GROUP BY 1",
    "a8_parametrised_sql": _FEATURES
    + "SELECT user_id, count(*) AS n, max(user_events_1h) AS busiest FROM f"
    " WHERE event = 'view' AND ts_ms >= 1705000000000 GROUP BY 1",
    "a9_time_range": _FEATURES
    + f"SELECT * EXCLUDE (date) FROM f WHERE ts_ms >= {_RANGE[0]} AND ts_ms < {_RANGE[1]}",
    "a10_encode": with_(EV)
    + """SELECT CAST(user_id AS VARCHAR) AS key, '{"ts_ms":' || ts_ms || ',"user_id":' || user_id ||
  ',"item_id":' || item_id || ',"event":"' || event || '","transaction_id":' ||
  coalesce(CAST(transaction_id AS VARCHAR), 'null') || '}' AS value FROM ev""",
    "a13_from_date": with_(EV) + "SELECT * FROM ev WHERE ts_ms >= epoch_ms(TIMESTAMP '2024-01-15')",
    "a13_first_n": with_(EV)
    + "SELECT * FROM ev ORDER BY ts_ms, user_id, item_id, event, transaction_id NULLS FIRST LIMIT 500",
    "a14_order_check": """WITH p AS (SELECT epoch_ms(l_shipdate) AS ts, lag(epoch_ms(l_shipdate)) OVER w AS prev,
  first_value(epoch_ms(l_shipdate)) OVER w AS f FROM lineitem
  WINDOW w AS (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate))
SELECT count(*) FILTER (WHERE ts < f) AS before_first, count(*) FILTER (WHERE ts < prev) AS inversions FROM p""",
    "a15_report": with_(EV) + _DAILY,
    "b1_split_filter": with_(EV, SPLIT)
    + """SELECT CASE WHEN ts_ms < val_start THEN 'train' WHEN ts_ms < test_start THEN 'val' ELSE 'test' END AS part,
  count(*) AS n, min(ts_ms) AS first_ts, max(ts_ms) AS last_ts FROM ev, b GROUP BY 1""",
    "b2_type_filter": with_(EV)
    + "SELECT item_id, count(*) FILTER (WHERE event = 'view') AS n_view, count(*) FILTER (WHERE event = 'addtocart')"
    " AS n_addtocart, count(*) FILTER (WHERE event = 'transaction') AS n_transaction FROM ev GROUP BY 1",
    "b3_trailing_window": with_(EV)
    + f"SELECT * FROM ev WHERE ts_ms >= (SELECT max(ts_ms) + 1 - 7 * {DAY_MS} FROM ev)",
    "b5_valid_ids": with_(EV)
    + "SELECT user_id, count(*) AS n FROM ev WHERE item_id IN (SELECT vec_id FROM embeddings) GROUP BY 1",
    "b6_weights": with_(EV)
    + "SELECT user_id, sum(CASE event WHEN 'view' THEN 1.0 WHEN 'addtocart' THEN 3.0 ELSE 5.0 END)::DOUBLE AS weight"
    " FROM ev GROUP BY 1",
    "b7_active_users": with_(EV)
    + f"SELECT DISTINCT user_id FROM ev WHERE ts_ms > (SELECT max(ts_ms) FROM ev) - {7 * DAY_MS}",
    "b8_feature_subset": with_(EV, IPTS, item_features_sql("ipts", STANDARD.only_items(["item_views_24h"])))
    + "SELECT ipts.item_id, ipts.as_of_ms, item_views_24h FROM ipts JOIN itf USING (item_id, as_of_ms)",
    "g1_train_and_val": with_(EV, SPLIT) + "SELECT * FROM train UNION ALL SELECT * FROM val",
    "g2_distinct_pairs": "SELECT DISTINCT o_custkey AS user_id, l_partkey AS item_id FROM lineitem"
    " JOIN orders ON l_orderkey = o_orderkey",
    "h1_epoch_to_date": with_(EV)
    + """SELECT ts_ms, user_id, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS date,
  strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d %H:%M:%S') AS at FROM ev""",
    "h2_date_to_epoch": """SELECT DISTINCT strftime(l_shipdate, '%Y-%m-%d') AS day,
  epoch_ms(date_trunc('day', l_shipdate)::TIMESTAMP) AS ms FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "h3_clip": with_(EV)
    + f"SELECT ts_ms, user_id, least(ts_ms - 1705000000000, {DAY_MS}) AS at_most_a_day,"
    " greatest(ts_ms - 1705000000000, 0) AS not_negative FROM ev",
    "h4_fill_and_cast": with_(EV)
    + "SELECT ts_ms, user_id, coalesce(transaction_id, -1) AS transaction_id,"
    " CASE WHEN event = 'view' THEN 1 ELSE 0 END AS is_view, item_id::DOUBLE AS item_double FROM ev",
    "h5_explode_lists": with_(EV, SPLIT, REQ)
    + """SELECT request_id, count(*) OVER (PARTITION BY request_id) AS n,
  count(*) OVER (PARTITION BY request_id) - 1 - back AS idx, ts_ms AS hist_ts, item_id AS hist_items,
  event AS hist_events FROM hist""",
    "h6_reverse_distinct": with_(
        EV, SPLIT, REQ, "d AS (SELECT request_id, item_id, min(back) AS m FROM hist GROUP BY 1, 2)"
    )
    + "SELECT request_id, string_agg(item_id, ',' ORDER BY m) AS items FROM d GROUP BY 1",
    "h7_json_round_trip": with_(EV) + "SELECT * FROM ev",
    "h8_dot_and_norm": """SELECT a.vec_id AS item_id,
  round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS dot, 1.0::DOUBLE AS unit_norm
  FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "h9_logarithms": with_(EV)
    + "SELECT ts_ms, user_id, round(1 / log2(item_id + 2), 6) AS discount, round(ln(item_id + 1), 6) AS ln_value FROM ev",
    "h10_round": "SELECT l_suppkey, round(avg(l_extendedprice / 7), 3) AS price FROM lineitem GROUP BY 1",
    "h11_sampling_hash": with_(EV)
    + f"SELECT user_id, ts_ms, md5(concat_ws(':', '{SEED}', CAST(user_id AS VARCHAR), CAST(ts_ms AS VARCHAR))) AS digest FROM ev",
}
