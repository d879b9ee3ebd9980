"""Summaries, baselines, offline evaluation and request sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.catalog.common import (
    EV,
    EVAL,
    N_REQUESTS,
    ORD,
    REQ,
    SEED,
    SPLIT,
    WEIGHT,
    clicks,
    metrics_sql,
    purchases,
    sampled_requests,
    r6,
    requests,
    weekly_split,
    with_,
)
from asofkit.operators.order import top_per_group
from asofkit.operators.timeline import as_history
from asofkit.plans import eda
from asofkit.plans.baselines import (
    Popularity,
    RecentThenPopular,
    export_popular,
    item_scores,
    popularity_by_window,
    popularity_ranking,
    recent_items,
    recent_then_popular_at,
)
from asofkit.plans.evaluation import (
    build_eval_set,
    eval_counts,
    evaluate,
    list_recall,
    mean_std,
    novel_view,
    per_user_metrics,
    score,
)
from asofkit.plans.experiments import popularity_window_scores, run_baselines
from asofkit.plans.requests import choose_requests, first_seen
from asofkit.plans.split import labelled
from asofkit.schema import DAY_MS, POPULARITY_WINDOWS
from asofkit.session import scratch_path
from asofkit.sources.reports import METHOD_COLUMNS, formatted


def d1_event_counts(spark, sf) -> DataFrame:
    return eda.event_counts(clicks(spark, sf))


def d2_distinct_counts(spark, sf) -> DataFrame:
    return eda.distinct_counts(purchases(spark, sf)).withColumn("sparsity", r6("sparsity"))


def d3_date_range(spark, sf) -> DataFrame:
    return eda.date_range(clicks(spark, sf))


def d4_user_activity(spark, sf) -> DataFrame:
    return eda.user_activity(purchases(spark, sf))


def d5_tail_activity(spark, sf) -> DataFrame:
    return eda.tail_activity(purchases(spark, sf))


def d6_conversion_rates(spark, sf) -> DataFrame:
    return eda.conversion_rates(clicks(spark, sf))


def d1_d6_summary(spark, sf) -> DataFrame:
    found = eda.summary(clicks(spark, sf))
    return found.withColumn("sparsity", r6("sparsity"))


def d7_daily_volume(spark, sf) -> DataFrame:
    return eda.daily_volume(clicks(spark, sf)).withColumn("day", F.col("day").cast("string"))


def d8_clipped_histogram(spark, sf) -> DataFrame:
    return eda.clipped_activity(purchases(spark, sf), 45)


def d9_share_curve(spark, sf) -> DataFrame:
    return eda.share_curve(purchases(spark, sf)).withColumn("share", r6("share"))


def d10_repeat_share(spark, sf) -> DataFrame:
    split = weekly_split(spark, sf)
    found = eda.repeat_share(split.train_val, split.test)
    return found.withColumn("repeat_share", r6("repeat_share"))


def c4_repeat_pairs(spark, sf) -> DataFrame:
    split = weekly_split(spark, sf)
    pairs = split.test.select("user_id", "item_id").distinct()
    return pairs.join(
        split.train_val.select("user_id", "item_id").distinct(), ["user_id", "item_id"], "left_semi"
    )


def d11_item_scores(spark, sf) -> DataFrame:
    return item_scores(clicks(spark, sf))


def c1_warm_target(spark, sf) -> DataFrame:
    split = weekly_split(spark, sf)
    return split.val.join(split.train.select("user_id").distinct(), "user_id", "left_semi")


def c2_history_of_evaluated(spark, sf) -> DataFrame:
    split = weekly_split(spark, sf)
    users = build_eval_set(split.train_val, split.test).users
    return split.train_val.join(users, "user_id", "left_semi")


def d12_relevant_sets(spark, sf) -> DataFrame:
    split = weekly_split(spark, sf)
    found = build_eval_set(split.train_val, split.test)
    return found.relevant.withColumn("kind", F.lit("relevant")).unionByName(
        found.seen.withColumn("kind", F.lit("seen"))
    )


def d13_eval_counts(spark, sf) -> DataFrame:
    split = weekly_split(spark, sf)
    return eval_counts(split.train_val, split.test)


def d14_first_seen(spark, sf) -> DataFrame:
    return first_seen(clicks(spark, sf))


def f1_popular_top(spark, sf) -> DataFrame:
    return popularity_ranking(purchases(spark, sf), window_days=365)


def f2_recent_items(spark, sf) -> DataFrame:
    return recent_items(purchases(spark, sf), 50)


def t5_time_split(spark, sf) -> DataFrame:
    return labelled(weekly_split(spark, sf))


def _popular_lists(spark, sf) -> DataFrame:
    split = weekly_split(spark, sf)
    model = Popularity(14)
    model.fit(split.train_val)
    return model.recommend(split.test.select("user_id").distinct(), 20)


def t6_popularity(spark, sf) -> DataFrame:
    return _popular_lists(spark, sf)


def _recent_lists(spark, sf) -> DataFrame:
    split = weekly_split(spark, sf)
    model = RecentThenPopular(14)
    model.fit(split.train_val)
    return model.recommend(split.test.select("user_id").distinct(), 60)


def t7_recent_then_popular(spark, sf) -> DataFrame:
    return _recent_lists(spark, sf)


def g5_ordered_union(spark, sf) -> DataFrame:
    """Where in its list each user's first popular-only item appears, and the list length."""
    lists = _recent_lists(spark, sf)
    own = recent_items(weekly_split(spark, sf).train_val).select("user_id", "item_id")
    backfill = lists.join(own, ["user_id", "item_id"], "left_anti")
    sizes = lists.groupBy("user_id").agg(F.count("*").alias("n"))
    return backfill.groupBy("user_id").agg(F.min("rank").alias("first_popular")).join(sizes, "user_id")


def t8_request_time_lists(spark, sf) -> DataFrame:
    split = weekly_split(spark, sf)
    model = Popularity(14)
    model.fit(split.train_val)
    lists = as_history(requests(spark, sf).history, ["request_id"])
    return recent_then_popular_at(lists, "request_id", model.items, 50)


def t9_sample_requests(spark, sf) -> DataFrame:
    split = weekly_split(spark, sf)
    return choose_requests(split.events, split.test_start_ms, split.end_ms, N_REQUESTS, SEED)


def t9_small_sample(spark, sf) -> DataFrame:
    split = weekly_split(spark, sf)
    return choose_requests(split.events, split.test_start_ms, split.end_ms, 40, SEED)


def b4_label_window(spark, sf) -> DataFrame:
    return requests(spark, sf).relevant


def t9_seen_items(spark, sf) -> DataFrame:
    return requests(spark, sf).seen


def f6_request_order(spark, sf) -> DataFrame:
    return t9_sample_requests(spark, sf)


def _eval_set(spark, sf):
    split = weekly_split(spark, sf)
    return build_eval_set(split.train_val, split.test)


def t10_eval_set(spark, sf) -> DataFrame:
    found = _eval_set(spark, sf)
    seen = found.seen.groupBy("user_id").agg(F.count("*").alias("n_seen"))
    return (
        found.relevant.groupBy("user_id")
        .agg(F.count("*").alias("n_relevant"), F.sum("item_id").alias("item_sum"))
        .join(seen, "user_id", "left")
    )


def t11_novel_view(spark, sf) -> DataFrame:
    return novel_view(_recent_lists(spark, sf), _eval_set(spark, sf))[0]


def g3_new_targets(spark, sf) -> DataFrame:
    return novel_view(_recent_lists(spark, sf), _eval_set(spark, sf))[1].relevant


def g4_hit_counts(spark, sf) -> DataFrame:
    lists = _recent_lists(spark, sf)
    return (
        _eval_set(spark, sf)
        .relevant.join(lists, ["user_id", "item_id"])
        .groupBy("user_id")
        .agg(F.count("*").alias("hits"))
    )


def _user_metric(spark, sf, names: list[str]) -> DataFrame:
    found = per_user_metrics(_recent_lists(spark, sf), _eval_set(spark, sf), (10, 50))
    return found.select("user_id", *[r6(n).alias(n) for n in names])


def t12_recall_at_k(spark, sf) -> DataFrame:
    return _user_metric(spark, sf, ["recall_at_10", "recall_at_50"])


def t13_ndcg_at_k(spark, sf) -> DataFrame:
    return _user_metric(spark, sf, ["ndcg_at_10", "ndcg_at_50"])


def t14_mrr_at_k(spark, sf) -> DataFrame:
    return _user_metric(spark, sf, ["mrr_at_50"])


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def t15_score(spark, sf) -> DataFrame:
    return _rounded(score(_recent_lists(spark, sf), _eval_set(spark, sf), (10, 50)))


def d19_mean_over_users(spark, sf) -> DataFrame:
    per_user = per_user_metrics(_popular_lists(spark, sf), _eval_set(spark, sf), (20,))
    return per_user.agg(r6(F.avg("recall_at_20")).alias("mean_recall"), F.count("*").alias("users"))


def t16_evaluate(spark, sf) -> DataFrame:
    split = weekly_split(spark, sf)
    return _rounded(evaluate(RecentThenPopular(14), split.train_val, split.test, (10, 50)))


def t17_popularity_windows(spark, sf) -> DataFrame:
    split = weekly_split(spark, sf)
    return _rounded(popularity_window_scores(split.train, split.val, POPULARITY_WINDOWS, 50))


def t17_window_rankings(spark, sf) -> DataFrame:
    return popularity_by_window(purchases(spark, sf), (30, 365, None), 100).select(
        "window_days", "item_id", "score", "last_ts", "rank"
    )


def t31_popular_export(spark, sf) -> DataFrame:
    path = scratch_path(spark, "popular")
    export_popular(weekly_split(spark, sf).train_val, path)
    saved = spark.read.schema("items array<bigint>").json(path)
    ranked = saved.select(F.posexplode("items").alias("rank", "item_id"))
    return ranked.withColumn("rank", F.col("rank").cast("long"))


def _runs(spark, sf) -> DataFrame:
    """Per-user recall grouped into three runs per model, standing in for seeds."""
    events = clicks(spark, sf)
    return events.groupBy("event", (F.col("user_id") % 3).alias("seed")).agg(
        F.avg("item_id").alias("metric")
    )


def d23_seed_summary(spark, sf) -> DataFrame:
    return _rounded(mean_std(_runs(spark, sf), "event", "metric"))


def d23_single_run(spark, sf) -> DataFrame:
    runs = clicks(spark, sf).groupBy("event").agg(F.avg("item_id").alias("metric"))
    return _rounded(mean_std(runs, "event", "metric"))


def d24_stage_percentiles(spark, sf) -> DataFrame:
    raw = spark.read.parquet(f"{sf}/events.parquet")
    return eda.stage_percentiles(raw.select(F.col("event_type").alias("stage"), F.col("value").alias("ms")))


def d21_list_recall(spark, sf) -> DataFrame:
    """How much of the 365-day popular list the 30-day list recovers, per event type."""
    events = purchases(spark, sf)

    def lists(df: DataFrame) -> DataFrame:
        counted = df.groupBy("event", "item_id").agg(F.count("*").alias("n"))
        return top_per_group(counted, ["event"], [F.desc("n"), F.asc("item_id")], 100, "rank")

    return _rounded(list_recall(lists(events.where(F.col("user_id") % 2 == 0)), lists(events), "event"))


def d22_relevant_per_request(spark, sf) -> DataFrame:
    found = requests(spark, sf)
    sizes = found.relevant.groupBy("request_id").agg(F.count("*").alias("n"))
    return sizes.agg(r6(F.avg("n")).alias("mean_relevant"), F.max("n").alias("max_relevant"))


def a15_method_table(spark, sf) -> DataFrame:
    split = weekly_split(spark, sf)
    rows = run_baselines(split, 14).where("part = 'test'")
    return formatted(rows, "model", METHOD_COLUMNS)


QUERIES = {
    f.__name__: f
    for f in (
        d1_event_counts, d2_distinct_counts, d3_date_range, d4_user_activity, d5_tail_activity,
        d6_conversion_rates, d1_d6_summary, d7_daily_volume, d8_clipped_histogram, d9_share_curve,
        d10_repeat_share, c4_repeat_pairs, d11_item_scores, c1_warm_target, c2_history_of_evaluated,
        d12_relevant_sets, d13_eval_counts, d14_first_seen, f1_popular_top, f2_recent_items,
        t5_time_split, t6_popularity, t7_recent_then_popular, g5_ordered_union,
        t8_request_time_lists, t9_sample_requests, t9_small_sample, b4_label_window, t9_seen_items,
        f6_request_order, t10_eval_set, t11_novel_view, g3_new_targets, g4_hit_counts,
        t12_recall_at_k, t13_ndcg_at_k, t14_mrr_at_k, t15_score, d19_mean_over_users, t16_evaluate,
        t17_popularity_windows, t17_window_rankings, t31_popular_export, d23_seed_summary,
        d23_single_run, d24_stage_percentiles, d21_list_recall, d22_relevant_per_request,
        a15_method_table,
    )
}

_SUMMARY = """SELECT count(*) AS events, count(*) FILTER (WHERE event = 'view') AS view_events,
  count(*) FILTER (WHERE event = 'addtocart') AS addtocart_events,
  count(*) FILTER (WHERE event = 'transaction') AS transaction_events FROM ev"""
_DISTINCT = """SELECT count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items,
  (SELECT count(*) FROM (SELECT DISTINCT user_id, item_id FROM ev)) AS user_item_pairs,
  round(1 - (SELECT count(*) FROM (SELECT DISTINCT user_id, item_id FROM ev)) /
    (count(DISTINCT user_id)::DOUBLE * count(DISTINCT item_id)), 6) AS sparsity FROM ev"""
_RANGE = f"""SELECT strftime(make_timestamp(min(ts_ms) * 1000), '%Y-%m-%d') AS start_date,
  strftime(make_timestamp(max(ts_ms) * 1000), '%Y-%m-%d') AS end_date,
  round((max(ts_ms) - min(ts_ms)) / {DAY_MS}.0, 1)::DOUBLE AS days FROM ev"""
_ACTIVITY = """SELECT median(n)::DOUBLE AS events_per_user_median,
  (SELECT n FROM (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS c
     FROM (SELECT count(*) AS n FROM ev GROUP BY user_id)) WHERE i = round((c - 1) * 0.99))::DOUBLE AS p99_nearest
  FROM (SELECT count(*) AS n FROM ev GROUP BY user_id)"""
_TAIL = """SELECT (SELECT round(100 * avg(CASE WHEN n = 1 THEN 1.0 ELSE 0.0 END), 1)
    FROM (SELECT count(*) AS n FROM ev GROUP BY user_id))::DOUBLE AS users_with_one_event_pct,
  (SELECT count(*) FROM (SELECT item_id FROM ev GROUP BY 1 HAVING count(*) >= 5)) AS items_with_5plus_events"""
_RATES = """SELECT round(count(*) FILTER (WHERE event = 'addtocart') / (count(*) FILTER (WHERE event = 'view'))::DOUBLE, 4)
    AS view_to_cart_rate,
  round(count(*) FILTER (WHERE event = 'transaction') / (count(*) FILTER (WHERE event = 'view'))::DOUBLE, 4)
    AS view_to_purchase_rate FROM ev"""


def _popular(source: str, name: str, days: int, limit: int) -> str:
    return f"""{name} AS (SELECT item_id, score, last_ts, row_number() OVER (ORDER BY score DESC, last_ts DESC, item_id) - 1 AS rank
  FROM (SELECT item_id, sum({WEIGHT}) AS score, max(ts_ms) AS last_ts FROM {source}
        WHERE ts_ms >= (SELECT max(ts_ms) + 1 - {days}::BIGINT * {DAY_MS} FROM {source}) GROUP BY 1)
  QUALIFY rank < {limit})"""


_POP = _popular("past", "pop", 14, 1000)
_TARGET_USERS = "tusers AS (SELECT DISTINCT user_id FROM test)"
_OWN = """own AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY last DESC, item_id) - 1 AS rank
  FROM (SELECT user_id, item_id, max(ts_ms) AS last FROM past GROUP BY 1, 2) QUALIFY rank < 50)"""


def _filled(key: str, keys: str, own: str, k: int, name: str) -> str:
    """Own items first, then popular ones not among them, cut to k."""
    return f"""{name} AS (SELECT {key}, item_id, row_number() OVER (PARTITION BY {key} ORDER BY src, r) - 1 AS rank FROM (
    SELECT {key}, item_id, 0 AS src, rank AS r FROM {own} WHERE {key} IN (SELECT {key} FROM {keys})
    UNION ALL
    SELECT {key}, p.item_id, 1, p.rank FROM {keys} k, pop p
      WHERE NOT EXISTS (SELECT 1 FROM {own} o WHERE o.{key} = k.{key} AND o.item_id = p.item_id))
  QUALIFY rank < {k})"""


_RECS = _filled("user_id", "tusers", "own", 60, "recs")
_RECS_BASE = (EV, SPLIT, EVAL, _POP, _TARGET_USERS, _OWN, _RECS)
_NEW = """newrel AS (SELECT * FROM rel WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = rel.user_id AND s.item_id = rel.item_id)),
newrecs AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY rank) - 1 AS rank FROM {recs} r
  WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = r.user_id AND s.item_id = r.item_id)
    AND user_id IN (SELECT user_id FROM newrel))"""
_COUNTS = """SELECT count(*) FILTER (WHERE warm) AS eval_users, count(*) FILTER (WHERE warm AND fresh) AS new_eval_users,
  count(*) FILTER (WHERE NOT warm) AS cold_users_skipped FROM (
  SELECT user_id, user_id IN (SELECT user_id FROM past) AS warm,
    bool_or((user_id, item_id) NOT IN (SELECT (user_id, item_id) FROM past)) AS fresh FROM test GROUP BY 1)"""


def _per_user(names: str) -> str:
    return f"""SELECT user_id, {names} FROM (
  SELECT user_id, round(count(*) FILTER (WHERE rank < 10) / max(n_rel)::DOUBLE, 6) AS recall_at_10,
    round(count(*) FILTER (WHERE rank < 50) / max(n_rel)::DOUBLE, 6) AS recall_at_50,
    round(coalesce(sum(1 / log2(rank + 2)) FILTER (WHERE rank < 10), 0) /
      max((SELECT sum(1 / log2(i + 2)) FROM range(0, 10) t(i) WHERE i < n_rel)), 6) AS ndcg_at_10,
    round(coalesce(sum(1 / log2(rank + 2)) FILTER (WHERE rank < 50), 0) /
      max((SELECT sum(1 / log2(i + 2)) FROM range(0, 50) t(i) WHERE i < n_rel)), 6) AS ndcg_at_50,
    round(coalesce(1.0 / (min(rank) FILTER (WHERE rank < 50) + 1), 0), 6)::DOUBLE AS mrr_at_50
  FROM (SELECT rel.user_id, rel.item_id, recs.rank, count(*) OVER (PARTITION BY rel.user_id) AS n_rel
        FROM rel LEFT JOIN recs USING (user_id, item_id)) GROUP BY 1)"""


_EVAL_RECS = _filled("user_id", "tusers", "own", 100, "recs")
_POP_EVAL = """precs AS (SELECT user_id, item_id, rank FROM tusers, pop WHERE rank < 100)"""
_FMT = """SELECT '{model}' AS model, printf('%.4f', recall_at_50) AS "Recall@50", printf('%.4f', ndcg_at_10) AS "NDCG@10",
  printf('%.4f', mrr_at_50) AS "MRR@50", printf('%.4f', new_recall_at_50) AS "New-item Recall@50",
  printf('%.4f', new_ndcg_at_10) AS "New-item NDCG@10" FROM ({m}), ({n})"""
_TOP20 = "top AS (SELECT user_id, item_id, rank FROM tusers, pop WHERE rank < 20)"
_TVAL_REL = "vrel AS (SELECT DISTINCT user_id, item_id FROM val WHERE user_id IN (SELECT user_id FROM train))"


def _window_recall(days: int) -> str:
    since = f"(SELECT max(ts_ms) + 1 - {days}::BIGINT * {DAY_MS} FROM train)" if days else "0"
    return f"""SELECT {days} AS window_days, round(avg(r), 6) AS recall FROM (
  SELECT user_id, count(l.item_id) / count(*)::DOUBLE AS r FROM vrel LEFT JOIN (
    SELECT item_id FROM (SELECT item_id, sum({WEIGHT}) AS score, max(ts_ms) AS last_ts FROM train WHERE ts_ms >= {since} GROUP BY 1)
    ORDER BY score DESC, last_ts DESC, item_id LIMIT 50) l USING (item_id) GROUP BY 1)"""


_TOP100 = """(SELECT event, item_id FROM (SELECT event, item_id, row_number() OVER (PARTITION BY event ORDER BY count(*) DESC, item_id) AS r
  FROM ev {where} GROUP BY 1, 2) WHERE r <= 100)"""

ORACLES = {
    "d1_event_counts": with_(EV) + _SUMMARY,
    "d2_distinct_counts": with_(ORD) + _DISTINCT,
    "d3_date_range": with_(EV) + _RANGE,
    "d4_user_activity": with_(ORD) + _ACTIVITY,
    "d5_tail_activity": with_(ORD) + _TAIL,
    "d6_conversion_rates": with_(EV) + _RATES,
    "d1_d6_summary": with_(EV)
    + f"SELECT * FROM ({_SUMMARY}), ({_DISTINCT}), ({_RANGE}), ({_ACTIVITY}), ({_TAIL}), ({_RATES})",
    "d7_daily_volume": with_(EV)
    + """SELECT strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%d') AS day, count(*) FILTER (WHERE event = 'view') AS view,
  count(*) FILTER (WHERE event = 'addtocart') AS addtocart,
  count(*) FILTER (WHERE event = 'transaction') AS "transaction" FROM ev GROUP BY 1""",
    "d8_clipped_histogram": with_(ORD)
    + "SELECT least(n, 45) AS events_clipped, count(*) AS users FROM (SELECT count(*) AS n FROM ev GROUP BY user_id) GROUP BY 1",
    "d9_share_curve": with_(ORD)
    + """SELECT row_number() OVER w AS top_n, item_id, n,
  round((sum(n) OVER (ORDER BY n DESC, item_id ROWS UNBOUNDED PRECEDING) / (SELECT count(*) FROM ev)::DOUBLE)::DOUBLE, 6) AS share
  FROM (SELECT item_id, count(*) AS n FROM ev GROUP BY 1) WINDOW w AS (ORDER BY n DESC, item_id)""",
    "d10_repeat_share": with_(EV, SPLIT, EVAL)
    + """SELECT count(DISTINCT user_id) AS warm_users, count(*) AS target_pairs,
  (SELECT count(*) FROM rel JOIN seen USING (user_id, item_id)) AS repeat_pairs,
  round((SELECT count(*) FROM rel JOIN seen USING (user_id, item_id)) / count(*)::DOUBLE, 6) AS repeat_share FROM rel""",
    "c4_repeat_pairs": with_(EV, SPLIT, EVAL) + "SELECT user_id, item_id FROM rel JOIN seen USING (user_id, item_id)",
    "d11_item_scores": with_(EV)
    + f"SELECT item_id, sum({WEIGHT}) AS score, max(ts_ms) AS last_ts FROM ev GROUP BY 1",
    "c1_warm_target": with_(EV, SPLIT) + "SELECT * FROM val WHERE user_id IN (SELECT user_id FROM train)",
    "c2_history_of_evaluated": with_(EV, SPLIT, EVAL) + "SELECT * FROM past WHERE user_id IN (SELECT user_id FROM rel)",
    "d12_relevant_sets": with_(EV, SPLIT, EVAL)
    + "SELECT user_id, item_id, 'relevant' AS kind FROM rel UNION ALL SELECT user_id, item_id, 'seen' FROM seen",
    "d13_eval_counts": with_(EV, SPLIT) + _COUNTS,
    "d14_first_seen": with_(EV) + "SELECT user_id, min(ts_ms) AS first_ts FROM ev GROUP BY 1",
    "f1_popular_top": with_(ORD, _popular("ev", "pop", 365, 1000)) + "SELECT * FROM pop",
    "f2_recent_items": with_(ORD)
    + """SELECT user_id, item_id, ts_ms, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms DESC, item_id) - 1 AS rank
  FROM (SELECT user_id, item_id, max(ts_ms) AS ts_ms FROM ev GROUP BY 1, 2) QUALIFY rank < 50""",
    "t5_time_split": with_(EV, SPLIT)
    + "SELECT ev.*, CASE WHEN ts_ms < val_start THEN 'train' WHEN ts_ms < test_start THEN 'val' ELSE 'test' END AS part FROM ev, b",
    "t6_popularity": with_(EV, SPLIT, _POP, _TARGET_USERS, _TOP20) + "SELECT * FROM top",
    "t7_recent_then_popular": with_(*_RECS_BASE) + "SELECT * FROM recs",
    "g5_ordered_union": with_(*_RECS_BASE)
    + """SELECT user_id, min(rank) AS first_popular, max(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM recs) r
  WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.user_id = r.user_id AND o.item_id = r.item_id) GROUP BY 1""",
    "t8_request_time_lists": with_(
        EV, SPLIT, REQ, _POP,
        "rown AS (SELECT request_id, item_id, row_number() OVER (PARTITION BY request_id ORDER BY min(back)) - 1 AS rank"
        " FROM hist GROUP BY 1, 2)",
        "rkeys AS (SELECT DISTINCT request_id FROM hist)",
        _filled("request_id", "rkeys", "rown", 50, "recs"),
    ) + "SELECT * FROM recs",
    "t9_sample_requests": with_(EV, SPLIT, REQ, sampled_requests(N_REQUESTS)) + "SELECT * FROM sampled",
    "t9_small_sample": with_(EV, SPLIT, REQ, sampled_requests(40)) + "SELECT * FROM sampled",
    "b4_label_window": with_(EV, SPLIT, REQ) + "SELECT * FROM rrel",
    "t9_seen_items": with_(EV, SPLIT, REQ) + "SELECT * FROM rseen",
    "f6_request_order": with_(EV, SPLIT, REQ, sampled_requests(N_REQUESTS)) + "SELECT * FROM sampled",
    "t10_eval_set": with_(EV, SPLIT, EVAL)
    + """SELECT user_id, count(*) AS n_relevant, CAST(sum(item_id) AS BIGINT) AS item_sum,
  max((SELECT count(*) FROM seen s WHERE s.user_id = rel.user_id)) AS n_seen FROM rel GROUP BY 1""",
    "t11_novel_view": with_(*_RECS_BASE, _NEW.format(recs="recs")) + "SELECT * FROM newrecs",
    "g3_new_targets": with_(*_RECS_BASE, _NEW.format(recs="recs")) + "SELECT * FROM newrel",
    "g4_hit_counts": with_(*_RECS_BASE)
    + "SELECT user_id, count(*) AS hits FROM rel JOIN recs USING (user_id, item_id) GROUP BY 1",
    "t12_recall_at_k": with_(*_RECS_BASE) + _per_user("recall_at_10, recall_at_50"),
    "t13_ndcg_at_k": with_(*_RECS_BASE) + _per_user("ndcg_at_10, ndcg_at_50"),
    "t14_mrr_at_k": with_(*_RECS_BASE) + _per_user("mrr_at_50"),
    "t15_score": with_(*_RECS_BASE) + metrics_sql("recs", "rel", "user_id"),
    "d19_mean_over_users": with_(EV, SPLIT, EVAL, _POP, _TARGET_USERS, _TOP20)
    + """SELECT round(avg(r), 6) AS mean_recall, count(*) AS users FROM (
  SELECT user_id, count(rank) / count(*)::DOUBLE AS r FROM rel LEFT JOIN top USING (user_id, item_id) GROUP BY 1)""",
    "t16_evaluate": with_(EV, SPLIT, EVAL, _POP, _TARGET_USERS, _OWN, _EVAL_RECS, _NEW.format(recs="recs"))
    + f"SELECT * FROM ({metrics_sql('recs', 'rel', 'user_id')}),"
    f" ({metrics_sql('newrecs', 'newrel', 'user_id', prefix='new_')}), ({_COUNTS})",
    "t17_popularity_windows": with_(EV, SPLIT, _TVAL_REL)
    + " UNION ALL ".join(_window_recall(d) for d in (3, 7, 14, 30, 0)),
    "t17_window_rankings": with_(ORD)
    + " UNION ALL ".join(
        f"""SELECT {d} AS window_days, item_id, score, last_ts, rank FROM (SELECT item_id, score, last_ts,
  row_number() OVER (ORDER BY score DESC, last_ts DESC, item_id) - 1 AS rank FROM (
    SELECT item_id, sum({WEIGHT}) AS score, max(ts_ms) AS last_ts FROM ev
    WHERE ts_ms >= {f'(SELECT max(ts_ms) + 1 - {d}::BIGINT * {DAY_MS} FROM ev)' if d else '0'} GROUP BY 1)) WHERE rank < 100"""
        for d in (30, 365, 0)
    ),
    "t31_popular_export": with_(EV, SPLIT, _POP) + "SELECT rank, item_id FROM pop",
    "d23_seed_summary": with_(EV)
    + "SELECT event, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS std FROM"
    " (SELECT event, user_id % 3 AS seed, avg(item_id) AS m FROM ev GROUP BY 1, 2) GROUP BY 1",
    "d23_single_run": with_(EV)
    + "SELECT event, round(avg(item_id), 6) AS mean, 0.0::DOUBLE AS std FROM ev GROUP BY 1",
    "d24_stage_percentiles": "SELECT event_type AS stage, round(quantile_cont(value, 0.5), 2) AS p50_ms,"
    " round(quantile_cont(value, 0.99), 2) AS p99_ms FROM events GROUP BY 1",
    "d21_list_recall": with_(ORD)
    + f"""SELECT round(avg(r), 6) AS recall FROM (SELECT e.event, count(a.item_id) / count(*)::DOUBLE AS r
  FROM {_TOP100.format(where='')} e LEFT JOIN {_TOP100.format(where='WHERE user_id % 2 = 0')} a USING (event, item_id) GROUP BY 1)""",
    "d22_relevant_per_request": with_(EV, SPLIT, REQ)
    + "SELECT round(avg(n), 6) AS mean_relevant, max(n) AS max_relevant FROM"
    " (SELECT count(*) AS n FROM rrel GROUP BY request_id)",
    "a15_method_table": with_(
        EV, SPLIT, EVAL, _POP, _TARGET_USERS, _OWN, _EVAL_RECS, _POP_EVAL, _NEW.format(recs="recs"),
        "pnewrecs AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY rank) - 1 AS rank FROM precs r"
        " WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.user_id = r.user_id AND s.item_id = r.item_id)"
        " AND user_id IN (SELECT user_id FROM newrel))",
    )
    + _FMT.format(model="recent_then_popular", m=metrics_sql("recs", "rel", "user_id"),
                  n=metrics_sql("newrecs", "newrel", "user_id", prefix="new_"))
    + " UNION ALL "
    + _FMT.format(model="popularity_14d", m=metrics_sql("precs", "rel", "user_id"),
                  n=metrics_sql("pnewrecs", "newrel", "user_id", prefix="new_")),
}
