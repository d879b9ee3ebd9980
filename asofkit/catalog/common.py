"""Inputs of the registered queries and the SQL fragments their checks are built from."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from asofkit.definitions import STANDARD, FeatureSet, WindowCount
from asofkit.plans.requests import RequestSet, sample_requests
from asofkit.plans.retrieval import ItemVectors, VectorConfig
from asofkit.plans.split import TimeSplit, time_split
from asofkit.schema import DAY_MS, HOUR_MS
from asofkit.session import checkpointed
from asofkit.sources.tables import click_events, order_events, vectors

SEED = 7
N_REQUESTS = 1000
LABEL_HORIZON_MS = DAY_MS
LIST_LEN = 20
CELLS = 16


def spec(short: int, middle: int, long: int, gap: int, cap: int) -> FeatureSet:
    """The standard features over other window lengths, for sparser clickstreams."""
    users = (
        WindowCount("user_events_5m", short),
        WindowCount("user_events_1h", middle),
        WindowCount("user_carts_1h", middle, "addtocart"),
    )
    items = (
        WindowCount("item_views_5m", short, "view"),
        WindowCount("item_views_1h", middle, "view"),
        WindowCount("item_views_24h", long, "view"),
        WindowCount("item_carts_1h", middle, "addtocart"),
        WindowCount("item_carts_24h", long, "addtocart"),
        WindowCount("item_purchases_24h", long, "transaction"),
    )
    return FeatureSet(users, items, gap, cap)


WIDE = spec(6 * HOUR_MS, DAY_MS, 7 * DAY_MS, 12 * HOUR_MS, 7 * DAY_MS)
ORDERS = spec(30 * DAY_MS, 90 * DAY_MS, 365 * DAY_MS, 45 * DAY_MS, 365 * DAY_MS)


def utc(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def clicks(spark: SparkSession, sf: str) -> DataFrame:
    return click_events(utc(spark), sf)


def purchases(spark: SparkSession, sf: str) -> DataFrame:
    return order_events(utc(spark), sf)


def weekly_split(spark: SparkSession, sf: str) -> TimeSplit:
    return time_split(clicks(spark, sf), val_days=7, test_days=7)


@cache
def requests(spark: SparkSession, sf: str) -> RequestSet:
    split = weekly_split(spark, sf)
    found = sample_requests(
        split.events, split.test_start_ms, split.end_ms, None, SEED, LABEL_HORIZON_MS
    )
    return RequestSet(
        found.frame, checkpointed(found.history), found.relevant, found.seen
    )


def given_vectors(spark: SparkSession, sf: str) -> ItemVectors:
    """The vector model with the given embeddings in both roles."""
    given = vectors(utc(spark), sf)
    model = ItemVectors(VectorConfig(dim=64))
    model.targets = given.select("item_id", "vec")
    model.contexts = given.select("item_id", F.col("vec").alias("features"))
    return model


def r6(column: str | Column) -> Column:
    return F.round(column, 6)


# --- SQL fragments ---------------------------------------------------------------------------

EV = """ev AS (
  SELECT epoch_us(ts) // 1000 AS ts_ms, user_id, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS item_id,
         CASE WHEN event_type IN ('view', 'error') THEN 'view' WHEN event_type IN ('click', 'signup') THEN 'addtocart'
           ELSE 'transaction' END AS event,
         CASE WHEN event_type = 'purchase' THEN event_id END AS transaction_id
  FROM events)"""

ORD = """ev AS (
  SELECT epoch_ms(l_shipdate) AS ts_ms, o_custkey AS user_id, l_partkey AS item_id,
         CASE l_returnflag WHEN 'N' THEN 'view' WHEN 'A' THEN 'addtocart' ELSE 'transaction' END AS event,
         CASE WHEN l_returnflag = 'R' THEN l_orderkey END AS transaction_id
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

SPLIT = f"""b AS (
  SELECT max(ts_ms) + 1 AS end_ms, max(ts_ms) + 1 - 7 * {DAY_MS} AS test_start,
         max(ts_ms) + 1 - 14 * {DAY_MS} AS val_start FROM ev),
train AS (SELECT ev.* FROM ev, b WHERE ts_ms < val_start),
val AS (SELECT ev.* FROM ev, b WHERE ts_ms >= val_start AND ts_ms < test_start),
test AS (SELECT ev.* FROM ev, b WHERE ts_ms >= test_start),
past AS (SELECT ev.* FROM ev, b WHERE ts_ms < test_start)"""

EVAL = """rel AS (SELECT DISTINCT user_id, item_id FROM test WHERE user_id IN (SELECT user_id FROM past)),
seen AS (SELECT DISTINCT user_id, item_id FROM past WHERE user_id IN (SELECT user_id FROM rel))"""

REQ = f"""firsts AS (SELECT user_id, min(ts_ms) AS first_ts FROM ev GROUP BY 1),
elig AS (SELECT DISTINCT e.user_id, e.ts_ms AS as_of_ms FROM ev e JOIN firsts USING (user_id), b
         WHERE e.ts_ms >= b.test_start AND e.ts_ms < b.end_ms AND e.ts_ms > first_ts),
drawn AS (SELECT user_id, as_of_ms FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id
      ORDER BY md5(concat_ws(':', '{SEED}', CAST(user_id AS VARCHAR), CAST(as_of_ms AS VARCHAR))), as_of_ms) AS r
    FROM elig) WHERE r = 1),
req AS MATERIALIZED (SELECT row_number() OVER (ORDER BY as_of_ms, user_id) - 1 AS request_id, user_id, as_of_ms FROM drawn),
rrel AS (SELECT DISTINCT request_id, item_id FROM req JOIN ev USING (user_id), b
         WHERE ts_ms >= as_of_ms AND ts_ms < least(as_of_ms + {LABEL_HORIZON_MS}, end_ms)),
rseen AS (SELECT DISTINCT request_id, item_id FROM req JOIN ev USING (user_id) WHERE ts_ms < as_of_ms),
hist AS MATERIALIZED (SELECT * FROM (
    SELECT r.request_id, r.as_of_ms, e.ts_ms, e.item_id, e.event,
           row_number() OVER (PARTITION BY r.request_id ORDER BY e.ts_ms DESC, e.item_id DESC, e.event DESC,
                              e.transaction_id DESC NULLS LAST) - 1 AS back
    FROM req r JOIN ev e ON e.user_id = r.user_id AND e.ts_ms < r.as_of_ms) WHERE back < 50)"""

def sampled_requests(n: int) -> str:
    """CTE ``sampled``: ``n`` requests, the smallest user digests, numbered among themselves."""
    digest = f"md5(concat_ws(':', '{SEED}', CAST(user_id AS VARCHAR)))"
    return f"""sampled AS (SELECT row_number() OVER (ORDER BY as_of_ms, user_id) - 1 AS request_id, user_id, as_of_ms
  FROM (SELECT * FROM drawn ORDER BY {digest}, user_id LIMIT {n}))"""


WEIGHT = "CASE event WHEN 'view' THEN 1.0::DOUBLE WHEN 'addtocart' THEN 3.0::DOUBLE ELSE 5.0::DOUBLE END"

# user vector: recency- and type-weighted mean of history vectors, L2-normalised
CAND = f"""parts AS (SELECT request_id, unnest(range(1, 65)) AS d, unnest(embedding)::DOUBLE AS x,
           {WEIGHT} * pow(0.9, back) AS w FROM hist JOIN embeddings ON vec_id = item_id),
pooled AS MATERIALIZED (SELECT request_id, d, sum(w * x) AS x FROM parts GROUP BY 1, 2),
lens AS (SELECT request_id, sqrt(sum(x * x)) AS n FROM pooled GROUP BY 1),
uvec AS MATERIALIZED (SELECT request_id, list(x / n ORDER BY d) AS v FROM pooled JOIN lens USING (request_id) GROUP BY 1),
sims AS MATERIALIZED (SELECT request_id, vec_id AS item_id, list_dot_product(v, embedding::DOUBLE[]) AS s FROM uvec, embeddings),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY s DESC, item_id) - 1 AS ann_rank
         FROM sims) WHERE ann_rank < {LIST_LEN}),
recent AS (SELECT request_id, item_id, row_number() OVER (PARTITION BY request_id ORDER BY min(back)) - 1 AS recent_rank
         FROM hist GROUP BY 1, 2),
cand AS MATERIALIZED (SELECT coalesce(n.request_id, r.request_id) AS request_id, coalesce(n.item_id, r.item_id) AS item_id,
         ann_rank, recent_rank FROM near n FULL JOIN recent r ON n.request_id = r.request_id AND n.item_id = r.item_id),
scored AS (SELECT c.*, s.s AS ann_score FROM cand c LEFT JOIN sims s USING (request_id, item_id))"""


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


def user_features_sql(points: str, features: FeatureSet = STANDARD, log: str = "ev") -> str:
    """CTE ``uf``: user features of the (user_id, as_of_ms) rows of ``points``, by plain joins."""
    gap, cap = features.session_gap_ms, features.last_event_cap_ms
    counts = []
    for w in features.user_windows:
        kind = f" AND e.event = '{w.event}'" if w.event else ""
        counts.append(
            f"CAST(count(e.ts_ms) FILTER (WHERE e.ts_ms >= l.as_of_ms - {w.window_ms}{kind}) AS BIGINT) AS {w.name}"
        )
    live = f"l.as_of_ms - l.last_ts <= {gap} AND e.ts_ms >= l.start_ms"
    return f"""starts AS (SELECT user_id, ts_ms AS start_ms FROM (
    SELECT user_id, ts_ms, lag(ts_ms) OVER (PARTITION BY user_id ORDER BY ts_ms) AS prev FROM {log})
  WHERE prev IS NULL OR ts_ms - prev > {gap}),
lastev AS (SELECT p.user_id, p.as_of_ms, max(e.ts_ms) AS last_ts
  FROM (SELECT DISTINCT user_id, as_of_ms FROM {points}) p
  LEFT JOIN {log} e ON e.user_id = p.user_id AND e.ts_ms < p.as_of_ms GROUP BY 1, 2),
sess AS (SELECT l.user_id, l.as_of_ms, l.last_ts, max(s.start_ms) AS start_ms FROM lastev l
  LEFT JOIN starts s ON s.user_id = l.user_id AND s.start_ms <= l.last_ts GROUP BY 1, 2, 3),
uf AS (SELECT l.user_id, l.as_of_ms, {", ".join(counts)},
  CAST(count(e.ts_ms) FILTER (WHERE {live}) AS BIGINT) AS session_events,
  CAST(count(DISTINCT e.item_id) FILTER (WHERE {live}) AS BIGINT) AS session_distinct_items,
  CAST(count(e.ts_ms) FILTER (WHERE {live} AND e.event = 'addtocart') AS BIGINT) AS session_carts,
  CAST(CASE WHEN l.as_of_ms - l.last_ts <= {gap} THEN l.last_ts - l.start_ms ELSE 0 END AS BIGINT) AS session_duration_ms,
  CAST(CASE WHEN l.last_ts IS NULL THEN {cap} ELSE least(l.as_of_ms - l.last_ts, {cap}) END AS BIGINT) AS last_event_age_ms
  FROM sess l LEFT JOIN {log} e ON e.user_id = l.user_id AND e.ts_ms < l.as_of_ms
  GROUP BY l.user_id, l.as_of_ms, l.last_ts, l.start_ms)"""


def item_features_sql(points: str, features: FeatureSet = STANDARD, log: str = "ev") -> str:
    """CTE ``itf``: item window counts of the (item_id, as_of_ms) rows of ``points``."""
    counts = [
        f"CAST(count(e.ts_ms) FILTER (WHERE e.ts_ms >= p.as_of_ms - {w.window_ms} AND e.event = '{w.event}') AS BIGINT) AS {w.name}"
        for w in features.item_windows
    ]
    return f"""itf AS (SELECT p.item_id, p.as_of_ms, {", ".join(counts)}
  FROM (SELECT DISTINCT item_id, as_of_ms FROM {points}) p
  LEFT JOIN {log} e ON e.item_id = p.item_id AND e.ts_ms < p.as_of_ms GROUP BY 1, 2)"""


UPTS = "upts AS (SELECT user_id, ts_ms AS as_of_ms FROM ev)"
IPTS = "ipts AS (SELECT item_id, ts_ms AS as_of_ms FROM ev)"
BACKFILL_COLUMNS = """e.ts_ms, e.user_id, e.item_id, e.event, e.transaction_id,
  uf.* EXCLUDE (user_id, as_of_ms), itf.* EXCLUDE (item_id, as_of_ms),
  strftime(make_timestamp(e.ts_ms * 1000), '%Y-%m-%d') AS date"""
BACKFILL_FROM = """ev e JOIN uf ON uf.user_id = e.user_id AND uf.as_of_ms = e.ts_ms
  JOIN itf ON itf.item_id = e.item_id AND itf.as_of_ms = e.ts_ms"""


def backfill_sql(source: str = EV, features: FeatureSet = STANDARD) -> str:
    return (
        with_(source, UPTS, IPTS, user_features_sql("upts", features), item_features_sql("ipts", features))
        + f"SELECT {BACKFILL_COLUMNS} FROM {BACKFILL_FROM}"
    )


def metrics_sql(recs: str, rel: str, key: str, ks: tuple[int, ...] = (10, 50), prefix: str = "") -> str:
    """A SELECT of the mean metrics of ``recs`` (key, item_id, rank) against ``rel`` (key, item_id)."""
    kmax = max(ks)
    per_key, outer = [], []
    for k in ks:
        per_key.append(
            f"count(*) FILTER (WHERE rank < {k}) / max(n_rel)::DOUBLE AS r{k},"
            f" coalesce(sum(1 / log2(rank + 2)) FILTER (WHERE rank < {k}), 0) /"
            f" max((SELECT sum(1 / log2(i + 2)) FROM range(0, {k}) t(i) WHERE i < n_rel)) AS n{k}"
        )
        outer += [
            f"round(avg(r{k}), 6) AS {prefix}recall_at_{k}",
            f"round(avg(n{k}), 6) AS {prefix}ndcg_at_{k}",
        ]
    outer.append(f"round(avg(m), 6) AS {prefix}mrr_at_{kmax}")
    return f"""SELECT {", ".join(outer)} FROM (
  SELECT {key}, {", ".join(per_key)}, coalesce(1.0 / (min(rank) + 1), 0) AS m FROM (
    SELECT rel.{key}, rel.item_id, recs.rank, count(DISTINCT rel.item_id) OVER (PARTITION BY rel.{key}) AS n_rel
    FROM {rel} rel LEFT JOIN (SELECT * FROM {recs} WHERE rank < {kmax}) recs
      ON recs.{key} = rel.{key} AND recs.item_id = rel.item_id)
  GROUP BY {key})"""
