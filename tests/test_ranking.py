import random

import pytest
from conftest import as_dicts, bursty_rows, events_of, slow_history, slow_item_features, slow_user_features
from pyspark.sql import functions as F

from asofkit.definitions import ITEM_FEATURES, RANKER_FEATURES, USER_FEATURES
from asofkit.plans.baselines import Popularity
from asofkit.plans.experiments import run_ranking
from asofkit.plans.pairwise import PairwiseRanker
from asofkit.plans.ranking import (
    Ranker,
    RankerConfig,
    add_labels,
    build_features,
    candidate_recall,
    compare_methods,
    group_sizes,
    prefer_lean,
    pruned_features,
    split_requests,
    user_item_features,
    with_positives,
)
from asofkit.plans.recommend import BatchRecommender, as_requests
from asofkit.plans.requests import sample_requests
from asofkit.plans.retrieval import ItemVectors, Retriever, VectorConfig
from asofkit.plans.split import time_split
from asofkit.streaming.store import OnlineStore

TREES = RankerConfig(max_iter=5, max_depth=3)


def _frame(spark, requests=30, candidates=20, seed=0):
    rng = random.Random(seed)
    rows = []
    for q in range(requests):
        best = rng.randrange(candidates)
        for i in range(candidates):
            signal = rng.random() + (1.0 if i == best else 0.0)
            rows.append((q, i, signal, rng.random(), None if i % 5 else 1.0, int(i == best)))
    schema = "request_id long, item_id long, signal double, noise double, gappy double, label int"
    return spark.createDataFrame(rows, schema)


def test_ranker_learns_the_signal(spark, tmp_path):
    frame = _frame(spark)
    train, valid = split_requests(frame, 30)
    assert train.select("request_id").distinct().count() == 24
    ranker = Ranker(TREES, ["noise", "signal", "gappy"])
    stats = ranker.fit(train, valid).first()
    assert stats.valid_ndcg_at_10 > 0.8 and stats.train_requests == 24
    assert next(iter(ranker.importance())) == "signal"
    top = as_dicts(ranker.rerank(frame, 3))
    assert len(top) == 90 and {r["rank"] for r in top} == {0, 1, 2}
    ranker.save(str(tmp_path / "ranker"))
    again = Ranker.load(spark, str(tmp_path / "ranker"))
    assert again.features == ranker.features and again.config == TREES
    assert sorted(map(str, again.rerank(frame, 3).collect())) == sorted(
        map(str, ranker.rerank(frame, 3).collect())
    )


def test_requests_without_positives_are_left_out_of_training(spark):
    frame = _frame(spark, requests=4).withColumn(
        "label", F.when(F.col("request_id") == 2, 0).otherwise(F.col("label"))
    )
    assert {r.request_id for r in with_positives(frame).select("request_id").distinct().collect()} == {0, 1, 3}
    assert {r.candidates for r in group_sizes(frame).collect()} == {20}


def test_pruning_rule():
    gains = dict.fromkeys(RANKER_FEATURES, 0.1) | {"item_views_5m": 0.004, "user_events_5m": 0.0}
    kept = pruned_features(gains)
    assert "item_views_5m" not in kept and "user_events_5m" in kept and len(kept) == 21
    assert pruned_features({}) == [f for f in RANKER_FEATURES if f not in ITEM_FEATURES]
    assert prefer_lean(0.5, 0.499) and not prefer_lean(0.5, 0.49)


@pytest.fixture(scope="module")
def world(spark):
    rows = bursty_rows(41, users=14, items=12, n=700)
    events = events_of(spark, rows)
    model = ItemVectors(VectorConfig(dim=8, iterations=2, min_item_count=1))
    model.fit(events.where(F.col("ts_ms") < rows[400][0]))
    return rows, events, model


def test_ranker_table_is_point_in_time(spark, world):
    rows, events, model = world
    lo, hi = rows[400][0], rows[-1][0] + 1
    reqs = sample_requests(events, lo, hi, 10, 1)
    candidates = Retriever(model).candidates(reqs.history, 5)
    table = add_labels(build_features(candidates, reqs, events), reqs.relevant)
    found = as_dicts(table)
    frame = {r["request_id"]: r for r in as_dicts(reqs.frame)}
    relevant = {(r["request_id"], r["item_id"]) for r in as_dicts(reqs.relevant)}
    assert len(found) == candidates.count() and set(RANKER_FEATURES) <= set(found[0])
    for r in found:
        user, as_of = frame[r["request_id"]]["user_id"], frame[r["request_id"]]["as_of_ms"]
        assert {f: r[f] for f in USER_FEATURES} == slow_user_features(rows, user, as_of)
        assert {f: r[f] for f in ITEM_FEATURES} == slow_item_features(rows, r["item_id"], as_of)
        history = slow_history(rows, user, as_of)
        back = [n for n, h in enumerate(reversed(history)) if h[1] == r["item_id"]]
        assert r["ui_events"] == (len(back) or None)
        assert r["ui_last_pos"] == (back[0] if back else None)
        assert r["ui_is_last"] == int(back[:1] == [0])
        assert r["label"] == int((r["request_id"], r["item_id"]) in relevant)
    future = events.unionByName(
        events.where(F.col("ts_ms") >= hi - 1).withColumn("ts_ms", F.col("ts_ms") + 5)
    )
    again = add_labels(build_features(candidates, reqs, future), reqs.relevant)
    assert sorted(map(str, table.collect())) == sorted(map(str, again.select(table.columns).collect()))
    assert 0 < candidate_recall(candidates, reqs.relevant).first()[0] <= 1
    row = compare_methods({"recent": candidates.where("recent_rank is not null").withColumnRenamed("recent_rank", "rank")}, reqs.eval_set()).first()
    assert row.method == "recent" and 0 <= row.recall_at_10 <= 1


def test_user_item_features_by_hand(spark):
    rows = [(0, 100, 3, 1, 10, 5, "view"), (0, 100, 3, 2, 20, 6, "addtocart"), (0, 100, 3, 3, 20, 5, "addtocart")]
    history = spark.createDataFrame(
        rows, "request_id long, as_of_ms long, end long, pos long, ts_ms long, item_id long, event string"
    )
    five, six = sorted(as_dicts(user_item_features(history)), key=lambda r: r["item_id"])
    assert five == dict(request_id=0, item_id=5, ui_events=2, ui_carts=1, ui_age_ms=80, ui_last_pos=0, ui_is_last=1)
    assert six == dict(request_id=0, item_id=6, ui_events=1, ui_carts=1, ui_age_ms=80, ui_last_pos=1, ui_is_last=0)


class BySignal:
    features = ["ui_events", "item_views_24h", "user_events_1h"]

    def rerank(self, frame, k):
        from asofkit.plans.ranking import top_k_by_score

        assert "item_views_5m" not in frame.columns  # not computed for this ranker
        total = F.coalesce("ui_events", F.lit(0)) + F.col("item_views_24h") + F.col("user_events_1h")
        return top_k_by_score(frame.withColumn("score", total.cast("double")), k)


def test_recommendations_from_the_store_equal_those_from_the_log(spark, world, tmp_path):
    rows, events, model = world
    popular = Popularity(14)
    popular.fit(events)
    store = OnlineStore(spark, str(tmp_path / "store"))
    store.append(events, 0)
    store.compact()
    as_of = store.watermark() + 1
    users = spark.createDataFrame([(u, as_of) for u in [*range(14), 999]], "user_id long, as_of_ms long")
    reqs = as_requests(users)
    retriever = Retriever(model)
    from_log = BatchRecommender(retriever, BySignal(), popular.items, events)
    from_store = BatchRecommender(
        retriever, BySignal(), popular.items, store.user_events(), store.item_events(), store.history_log()
    )
    a, b = (sorted(map(str, r.recommend(reqs, 5).collect())) for r in (from_log, from_store))
    assert a == b
    found = as_dicts(from_log.recommend(reqs, 5))
    cold = sorted((r for r in found if r["user_id"] == 999), key=lambda r: r["rank"])
    assert [r["item_id"] for r in cold] == popular.items[:5]
    assert {(r["source"], r["n_candidates"]) for r in cold} == {("popular", 0)}
    assert {r["source"] for r in found if r["user_id"] != 999} == {"ranked"}


def test_ranking_experiment(spark):
    rows = bursty_rows(43, users=30, items=12, n=1500)
    span = 21 * 86_400_000 / rows[-1][0]
    events = events_of(spark, [(int(t * span), *rest) for t, *rest in rows])
    result = run_ranking(
        time_split(events, 7, 7), 40, 3, VectorConfig(dim=4, iterations=2), TREES, ann_k=5, cells=2
    )
    found = {r.method: r for r in result.methods.collect()}
    assert len(found) == 6 and all(0 <= r.recall_at_50 <= 1 for r in found.values())
    assert set(result.importance) == set(RANKER_FEATURES)


def test_pairwise_ranker_learns_the_planted_order(spark, tmp_path):
    """Relevance follows a signal within each request, whose level differs wildly between requests."""
    rng = random.Random(31)
    rows = []
    for request in range(120):
        level = 10 ** rng.uniform(0, 4)
        signals = [level * rng.uniform(1, 3) for _ in range(15)]
        best = sorted(signals)[-3]
        for item, signal in enumerate(signals):
            missing = rng.random() < 0.1
            rows.append((request, item, None if missing else float(signal), rng.random() * 100, None if item % 2 else 1.0, int(signal >= best and not missing)))
    frame = spark.createDataFrame(rows, "request_id long, item_id long, signal double, noise double, flag double, label int")
    train, valid = split_requests(frame, 120)
    ranker = PairwiseRanker(features=["signal", "noise", "flag"])
    losses = ranker.fit(train, valid)
    assert losses[0][1] == pytest.approx(0.6931, abs=1e-3) and min(v for _, v in losses) < 0.35
    assert next(iter(ranker.importance())) == "signal" and sum(ranker.importance().values()) == pytest.approx(1)
    top = ranker.rerank(valid, 3).join(frame, ["request_id", "item_id"]).agg(F.avg("label")).first()[0]
    # a missing signal makes an item irrelevant, so some requests have fewer than three to find
    reachable = valid.where("label = 1").count() / (3 * 24)
    assert top > 0.93 * reachable
    ranker.save(str(tmp_path / "pairwise"))
    again = PairwiseRanker.load(spark, str(tmp_path / "pairwise"))
    assert again.rerank(valid, 5).collect() == ranker.rerank(valid, 5).collect()
    plain = PairwiseRanker(features=["signal"])
    assert plain.fit(train.where("label = 0"), valid)[0][1] > 0  # nothing to learn from is no error
