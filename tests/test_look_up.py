"""Rows of a request stay together: no step of the ranker table is exchanged by (request, item)."""

from __future__ import annotations

import random

from conftest import bursty_rows, events_of

from asofkit.operators.order import look_up
from asofkit.plans.features import item_features
from asofkit.plans.ranking import build_features
from asofkit.plans.requests import sample_requests
from asofkit.plans.retrieval import ItemVectors, Retriever, VectorConfig


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_look_up_is_a_left_join_on_a_unique_pair(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([None, *range(6)]), n) for n, k in enumerate(rng.choices(range(8), k=90))]
    few = sorted({(k, i) for k, i, _ in rows if i is not None and rng.random() < 0.5} | {(50, 1)})
    left = spark.createDataFrame(rows, "k long, i long, n long")
    right = spark.createDataFrame([(k, i, 10 * k + i, None) for k, i in few] + [(1, None, 5, 5)], "k long, i long, a long, b long")
    found = look_up(left, right, "k", "i", ["a", "b"])
    assert found.columns == ["k", "i", "n", "a", "b"]
    want = [(k, i, n, 10 * k + i if (k, i) in few else None, None) for k, i, n in rows]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))


def test_ranker_rows_are_exchanged_by_request_only(spark):
    rows = bursty_rows(31, users=20, items=10, n=900)
    events = events_of(spark, rows)
    end = rows[-1][0] + 1
    reqs = sample_requests(events, end // 2, end, None, 1)
    model = ItemVectors(VectorConfig(dim=3))
    vectors = [(i, [1.0 + i, 2.0, -float(i)]) for i in range(8)]
    model.targets = spark.createDataFrame(vectors, "item_id long, vec array<double>")
    model.contexts = model.targets.withColumnRenamed("vec", "features")
    candidates = Retriever(model).candidates(reqs.history, 4, 3)
    pairs = candidates.select("request_id", "item_id").collect()
    assert len(pairs) == len(set(pairs)) > 0
    plan = _plan(build_features(candidates, reqs, events))
    by_pair = [line for line in plan.splitlines() if "Exchange hashpartitioning(request_id" in line and "item_id" in line.split("),")[0]]
    # the figures of a history are counted by pair; the candidates are not exchanged so
    assert all("ann_score" not in line for line in by_pair) and len(by_pair) <= 1, plan


def test_counts_of_few_points_are_broadcast(spark):
    events = events_of(spark, bursty_rows(32, users=5, items=4, n=100))
    queries = spark.range(200).selectExpr("id % 4 AS item_id", "90000000L AS as_of_ms", "id AS request_id")
    found = item_features(events, queries)
    assert "BroadcastHashJoin" in _plan(found) and found.count() == 200
