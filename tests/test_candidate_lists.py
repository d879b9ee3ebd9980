"""Candidates in a row per request: the same rows, features and counts, and no exchange of a row per candidate."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import events_of
from pyspark.sql import functions as F

from asofkit.definitions import ITEM_FEATURES, STANDARD
from asofkit.functions.columns import l2_normalised
from asofkit.operators import topk
from asofkit.plans.features import item_counts, item_features, with_item_counts
from asofkit.plans.ranking import build_features, build_list_features
from asofkit.plans.requests import RequestSet
from asofkit.plans.retrieval import ItemVectors, Retriever, VectorConfig, list_rows, list_sizes

HOUR = 3_600_000


def _retriever(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(40, 4))
    ids = [*range(38), -3, -9]
    items = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, m, strict=True)], "item_id long, vec array<double>")
    model = ItemVectors(VectorConfig(dim=4))
    model.targets, model.contexts = items, items.withColumnRenamed("vec", "features")
    return Retriever(model)


def _asked(spark):
    """Requests with known, unknown (77), negative and null items; request 3 has no vector, request 4 no history."""
    rows = [(q, 10 * HOUR, 6, p, p * HOUR, i, "view") for q, own in enumerate(
        ([1, 2, 1, 77, 5, 6], [-3, 8, -9, -3, 9, 2], [None, 4, 4, 30, 31, None], [77, 78, 77, 79, 77, 78])
    ) for p, i in enumerate(own, 1)]
    history = spark.createDataFrame(rows, "request_id long, as_of_ms long, end long, pos long, ts_ms long, item_id long, event string")
    frame = spark.createDataFrame([(q, 100 + q, 10 * HOUR) for q in range(5)], "request_id long, user_id long, as_of_ms long")
    events = events_of(spark, [(r[4], 100 + r[0], r[5], "view") for r in rows if r[5] is not None])
    return history, frame, events


def _rows(df, digits=9):
    return sorted((tuple(round(x, digits) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("sent", [0, 4])
def test_lists_hold_the_candidates(spark, monkeypatch, sent):
    monkeypatch.setattr(topk, "SENT_CHUNKS", sent)
    history, frame, events = _asked(spark)
    retriever = _retriever(spark)
    rows, lists = retriever.candidates(history, 12, 4), retriever.candidate_lists(history, 12, 4)
    known = rows.where(F.col("item_id").isNotNull())
    assert _rows(list_rows(lists).where(F.col("item_id").isNotNull()).select(known.columns)) == _rows(known)
    assert _rows(list_sizes(lists)) == _rows(rows.groupBy("request_id").agg(F.count("*").alias("n_candidates")))
    none = history.select("request_id", "item_id").limit(0)
    requests = RequestSet(frame, history, none, none)
    packed = build_list_features(lists, requests, events)
    assert _rows(packed) == _rows(build_features(rows, requests, events)) and packed.count() == known.count()
    # from the list on, a row per candidate meets a broadcast table only (before: exchanged by request twice, written twice)
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan[: plan.find("Generate")] and "Generate posexplode" in plan


def test_only_items_with_events_are_counted(spark):
    """Before: a point of every candidate item went through the counting job, and its zeros were joined."""
    events = events_of(spark, [(HOUR, 1, 5, "view"), (2 * HOUR, 2, 5, "addtocart"), (HOUR, 1, 6, "view")])
    points = [(i, at) for i in (5, 6, 7, 8, None) for at in (HOUR, 3 * HOUR, None)]
    queries = spark.createDataFrame(points, "item_id long, as_of_ms long")
    whole = queries.where(F.col("item_id").isNotNull() & F.col("as_of_ms").isNotNull())
    counts = item_counts(events, whole.distinct())
    assert sorted((r.item_id, r.as_of_ms) for r in counts.collect()) == [(i, at) for i in (5, 6) for at in (HOUR, 3 * HOUR)]
    found = {(r.item_id, r.as_of_ms): r for r in item_features(events, queries).collect()}
    assert sorted(found) == [(i, at) for i in (5, 6, 7, 8) for at in (HOUR, 3 * HOUR)]
    assert found[5, 3 * HOUR].item_views_24h == 1 and found[5, 3 * HOUR].item_carts_24h == 1
    assert all(found[i, at][f] == 0 for i, at in found if i > 6 or at == HOUR for f in ITEM_FEATURES)
    assert with_item_counts(queries, counts, STANDARD).count() == len(found)


def test_norms_are_summed_once(spark):
    rows = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0]), (2, None), (3, [])], "id long, vec array<float>")
    unit = rows.select("id", l2_normalised(F.col("vec")).alias("vec"))
    assert {r.id: r.vec for r in unit.collect()} == {0: [0.6, 0.8], 1: [0.0, 0.0], 2: None, 3: []}
    # before: once more inside the function over the components, so for each of them
    assert unit._jdf.queryExecution().optimizedPlan().toString().count("zip_with") == 1
