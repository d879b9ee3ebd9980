from math import log2

import pytest
from conftest import MINUTE, as_dicts, bursty_rows, events_of
from pyspark.sql import functions as F

from asofkit.operators.order import exact_quantiles
from asofkit.plans import eda
from asofkit.plans.baselines import (
    Popularity,
    RecentThenPopular,
    popularity_ranking,
    recent_then_popular_at,
)
from asofkit.plans.evaluation import (
    EvalSet,
    build_eval_set,
    check_complete,
    evaluate,
    mean_std,
    novel_view,
    per_user_metrics,
    score,
)
from asofkit.plans.experiments import popularity_window_scores, select_popularity_window
from asofkit.plans.requests import choose_requests, sample_requests
from asofkit.plans.split import time_split
from asofkit.schema import DAY_MS


class Prepared:
    """A model whose lists are given."""

    name = "prepared"

    def __init__(self, spark, lists):
        rows = [(u, i, n) for u, items in lists.items() for n, i in enumerate(items)]
        self.lists = spark.createDataFrame(rows, "user_id long, item_id long, rank long")

    def fit(self, history): ...

    def recommend(self, users, k):
        return self.lists.where(F.col("rank") < k).join(users, "user_id", "left_semi")


def _sets(df, key="user_id"):
    out = {}
    for r in as_dicts(df):
        out.setdefault(r[key], set()).add(r["item_id"])
    return out


def _lists(df, key="user_id"):
    out = {}
    for r in sorted(as_dicts(df), key=lambda r: r["rank"]):
        out.setdefault(r[key], []).append(r["item_id"])
    return out


def _metrics(spark, recs, relevant, ks):
    lists = spark.createDataFrame([(1, r, i) for r, i in enumerate(recs)], "user_id long, rank long, item_id long")
    rel = spark.createDataFrame([(1, i) for i in relevant], "user_id long, item_id long")
    return per_user_metrics(lists, EvalSet(rel, rel.limit(0)), ks).first().asDict()


def test_metrics_by_hand(spark):
    recs = [8, 2, 6, 4]
    m = _metrics(spark, recs, {2, 4, 15, 16}, (3, 4))
    assert (m["recall_at_3"], m["recall_at_4"]) == (0.25, 0.5) and m["mrr_at_4"] == pytest.approx(0.5)
    ideal = sum(1 / log2(n) for n in (2, 3, 4, 5))
    assert m["ndcg_at_4"] == pytest.approx((1 / log2(3) + 1 / log2(5)) / ideal)
    assert _metrics(spark, recs, {4}, (4,))["mrr_at_4"] == pytest.approx(0.25)
    none = _metrics(spark, recs, {1}, (3, 4))
    assert none["recall_at_3"] == none["ndcg_at_4"] == none["mrr_at_4"] == 0
    with pytest.raises(ValueError):
        _metrics(spark, recs, {8}, (0,))


def _small_world(spark):
    """Three known users, of whom two come back; two unknown ones appear."""
    history = events_of(spark, [(2, 51, 5, "view"), (3, 52, 6, "addtocart"), (4, 53, 7, "view")])
    rows = [(20, 51, 8, "view"), (21, 52, 9, "addtocart"), (22, 52, 8, "view"), (23, 52, 6, "view"), (24, 52, 6, "view")]
    return history, events_of(spark, rows + [(24, 54, 9, "view"), (25, 55, 5, "view")])


def test_only_warm_users_are_scored(spark):
    history, target = _small_world(spark)
    assert _sets(build_eval_set(history, target).relevant) == {51: {8}, 52: {6, 8, 9}}
    perfect = evaluate(Prepared(spark, {51: [8], 52: [9, 8, 6], 54: [9]}), history, target).first()
    assert perfect.recall_at_50 == perfect.ndcg_at_10 == perfect.mrr_at_50 == pytest.approx(1.0)
    assert (perfect.eval_users, perfect.cold_users_skipped) == (2, 2)


def test_users_without_hits_count_as_zero(spark):
    history, target = _small_world(spark)
    eval_set = build_eval_set(history, target)
    m = score(Prepared(spark, {52: [1, 9]}).lists, eval_set, (10,)).first()
    assert m.recall_at_10 == pytest.approx(1 / 6) and m.mrr_at_10 == pytest.approx(1 / 4)
    for lists, problem in (({51: [1], 52: [1], 53: [7]}, "1 are of other keys"), ({52: [1, 9]}, "1 are missing")):
        with pytest.raises(ValueError, match=problem):
            check_complete(Prepared(spark, lists).lists, eval_set)
    with pytest.raises(ValueError, match="are missing"):
        score(Prepared(spark, {52: [1, 9]}).lists, eval_set, (10,), complete=True)
    check_complete(Prepared(spark, {51: [1], 52: [1]}).lists, eval_set)


def test_novel_metrics_leave_out_seen_items(spark):
    history = events_of(spark, [(0, 51, 5, "view"), (1, 52, 6, "view"), (2, 52, 8, "view")])
    target = events_of(spark, [(9, 51, 5, "view"), (9, 51, 8, "view"), (9, 52, 6, "view"), (9, 52, 9, "view")])
    model = Prepared(spark, {51: [5, 8], 52: [9, 6]})
    m = evaluate(model, history, target, (1,)).first()
    assert (m.recall_at_1, m.new_recall_at_1, m.new_eval_users) == (0.5, 1.0, 2)
    lists, left = novel_view(model.lists, build_eval_set(history, target))
    assert _lists(lists) == {51: [8], 52: [9]} and _sets(left.relevant) == {51: {8}, 52: {9}}


def test_an_empty_eval_set_gives_null(spark):
    history, target = _small_world(spark)
    m = score(Prepared(spark, {51: [1]}).lists, build_eval_set(history, target.where("false")), (5,))
    assert m.first().recall_at_5 is None


DAY = DAY_MS


def _popularity_events(spark):
    """Four old views of 31, a cart and a view of 32 on day 50, a purchase of 33 on day 45."""
    rows = [(u, u, 31, "view") for u in (1, 2, 3, 4)]
    rows += [(50 * DAY, 1, 32, "addtocart"), (50 * DAY + 9, 2, 32, "view"), (45 * DAY, 3, 33, "transaction")]
    return events_of(spark, rows)


@pytest.mark.parametrize("days, items", [(None, [33, 32, 31]), (14, [33, 32]), (3, [32])])
def test_popularity(spark, days, items):
    ranking = popularity_ranking(_popularity_events(spark), days)
    assert [r.item_id for r in ranking.orderBy("rank").collect()] == items


def test_recent_then_popular(spark):
    model = RecentThenPopular(None)
    model.fit(_popularity_events(spark))
    users = spark.createDataFrame([(u,) for u in (1, 2, 3, 4, 9)], "user_id long")
    assert _lists(model.recommend(users, 3)) == {
        1: [32, 31, 33], 2: [32, 31, 33], 3: [33, 31, 32], 4: [31, 33, 32], 9: [33, 32, 31],
    }


def test_request_time_lists(spark):
    rows = [(4, [9, 2, 9, 3, 3]), (6, [])]
    lists = spark.createDataFrame(rows, "request_id long, hist_items array<long>")
    found = _lists(recent_then_popular_at(lists, "request_id", [2, 8, 1, 9], 5), "request_id")
    assert found == {4: [3, 9, 2, 8, 1], 6: [2, 8, 1, 9]}


def test_popularity_window_selection_matches_single_evaluations(spark):
    rows = [(t * DAY // 7, t % 11, (t * t) % 13, "view") for t in range(400)]
    events = events_of(spark, rows)
    split = time_split(events, 7, 7)
    windows = (3, 7, None)
    found = {r.window_days: r.recall for r in popularity_window_scores(split.train, split.val, windows, 5).collect()}
    for w in windows:
        single = evaluate(Popularity(w), split.train, split.val, (5,)).first().recall_at_5
        assert found[w or 0] == pytest.approx(single)
    assert select_popularity_window(split.train, split.val, windows) in windows


def test_split_is_disjoint_and_ordered(spark):
    rows = [(week * 7 * DAY + u * 1000, u, 100 + week, "view") for week in range(4) for u in range(5)]
    events = events_of(spark, rows)
    split = time_split(events, 7, 7)
    sizes = [part.count() for part in (split.train, split.val, split.test)]
    assert sum(sizes) == len(rows) and all(sizes)
    assert split.train.agg(F.max("ts_ms")).first()[0] < split.val_start_ms <= split.val.agg(F.min("ts_ms")).first()[0]
    assert split.val.agg(F.max("ts_ms")).first()[0] < split.test_start_ms <= split.test.agg(F.min("ts_ms")).first()[0]
    assert split.train_val.count() == sizes[0] + sizes[1]
    for days in ((30, 30), (0, 7), (7, -1)):
        with pytest.raises(ValueError):
            time_split(events, *days)


def test_summary(spark):
    rows = [(0, 1, 1, "view"), (1, 1, 2, "view"), (DAY, 1, 1, "addtocart"), (2 * DAY, 2, 1, "view")]
    s = eda.summary(events_of(spark, rows)).first()
    assert (s.events, s.view_events, s.addtocart_events, s.transaction_events) == (4, 3, 1, 0)
    assert (s.users, s.items, s.user_item_pairs) == (2, 2, 3) and s.sparsity == pytest.approx(0.25)
    assert (s.start_date, s.end_date, s.days) == ("1970-01-01", "1970-01-03", 2.0)
    assert s.users_with_one_event_pct == 50.0 and s.events_per_user_median == 2.0
    assert s.view_to_cart_rate == pytest.approx(0.3333) and s.view_to_purchase_rate == 0.0
    no_views = eda.conversion_rates(events_of(spark, [(0, 1, 1, "addtocart")])).first()
    assert no_views.view_to_cart_rate == 0.0


def test_mean_and_deviation(spark):
    runs = spark.createDataFrame([("a", 0.2), ("a", 0.4), ("b", 0.5)], "model string, m double")
    found = {r.model: (r.mean, r.std) for r in mean_std(runs, "model", "m").collect()}
    assert found["a"] == pytest.approx((0.3, 0.1414), abs=1e-4) and found["b"] == (0.5, 0.0)


def _request_events(spark):
    """User 4 has two moments to choose from, user 5 only a first one, user 6 one with two labels."""
    minutes = [(5, 4, 40), (40, 4, 41), (52, 4, 42), (95, 4, 43), (31, 5, 50), (33, 6, 60), (80, 6, 61), (80, 6, 62)]
    return events_of(spark, [(m * MINUTE, u, i, "view") for m, u, i in minutes])


@pytest.mark.parametrize("n, small", [(10, 100), (10, 0), (None, 100)])
def test_requests_are_point_in_time(spark, n, small):
    found = sample_requests(_request_events(spark), 30 * MINUTE, 90 * MINUTE, n, small=small)
    at = {r["user_id"]: (r["request_id"], r["as_of_ms"] // MINUTE) for r in as_dicts(found.frame)}
    seen, relevant, history = (_sets(df, "request_id") for df in (found.seen, found.relevant, found.history))
    assert set(at) == {4, 6} and sorted(i for i, _ in at.values()) == [0, 1]
    one, two = at[4], at[6]
    assert (seen[one[0]], relevant[one[0]]) == {40: ({40}, {41, 42}), 52: ({40, 41}, {42})}[one[1]]
    assert two[1] == 80 and (seen[two[0]], relevant[two[0]]) == ({60}, {61, 62})
    assert history == seen


def test_labels_end_with_the_window(spark):
    found = sample_requests(_request_events(spark), 30 * MINUTE, 50 * MINUTE, 10)
    assert _sets(found.relevant, "request_id") == {0: {41}}


def test_large_samples_draw_the_same_users(spark):
    events = events_of(spark, bursty_rows(23))
    end = max(r[0] for r in bursty_rows(23)) + 1
    assert choose_requests(events, 0, end, 5, 3).collect() == choose_requests(events, 0, end, 5, 3, small=0).collect()


def test_requests_ignore_the_future_and_the_partitioning(spark):
    rows = bursty_rows(11)
    times = sorted(r[0] for r in rows)
    lo, hi = times[len(times) // 3], times[2 * len(times) // 3]
    full = events_of(spark, rows)

    def everything(events):
        s = sample_requests(events, lo, hi, 8, seed=1)
        return [sorted(map(str, df.collect())) for df in (s.frame, s.history, s.relevant, s.seen)]

    base = everything(full)
    assert everything(full.where(F.col("ts_ms") < hi)) == base
    assert everything(full.repartition(1)) == base
    frame = choose_requests(full, lo, hi, 8, 1).collect()
    assert len({r.user_id for r in frame}) == len(frame)
    assert all(lo <= r.as_of_ms < hi for r in frame)
    assert choose_requests(full, lo, hi, 8, 2).collect() != frame


def test_quantiles_of_groups_that_span_partitions(spark):
    """Exact, interpolated, with one group in all partitions, ties, single rows, nulls; no group's values in one place."""
    rows = [("hot", float((i * 7919) % 5003)) for i in range(6000)] + [("tied", 2.0)] * 500 + [("one", 9.5), ("none", None)]
    rows += [(None, float(i)) for i in range(4)] + [("pair", 1.0), ("pair", 4.0)]
    frame = spark.createDataFrame(rows, "stage string, ms double").repartition(6)
    found = {(r.stage, r.q): r.quantile for r in exact_quantiles(frame, "stage", "ms", (0.0, 0.3, 0.5, 0.99, 1.0)).collect()}
    for stage in ("hot", "tied", "one", "pair", None):
        values = sorted(v for s, v in rows if s == stage)
        for q in (0.0, 0.3, 0.5, 0.99, 1.0):
            at = q * (len(values) - 1)
            low, high = values[int(at)], values[min(int(at) + 1, len(values) - 1)]
            assert found[stage, q] == pytest.approx(low + (high - low) * (at - int(at)))
    assert len(found) == 25
    plan = eda.stage_percentiles(frame)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "collect_list" not in plan
