"""The best items of many queries, and the index that reads its blocks: results, and what is exchanged."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from asofkit.catalog import retrieval as catalog
from asofkit.operators import topk
from asofkit.operators.places import NONE, ExactBest, pair_scores, true_at
from asofkit.plans import vector_index
from asofkit.plans.evaluation import list_recall, packed_recall
from asofkit.plans.retrieval import FlatIndex, index_quality
from asofkit.plans.vector_index import QuantisedIndex, _found_by


def _unit(rng, n, dim):
    m = rng.normal(size=(n, dim))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _frame(spark, name, m):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], f"{name} long, vec array<double>")


@pytest.mark.parametrize("kind", ["unit", "ties", "equal", "odd"])
def test_best_items_are_brute_force(kind):
    """Narrow products only leave out what cannot be among the best: ties, equal items, undefined, tiny and huge vectors."""
    rng = np.random.default_rng(3)
    for _ in range(40):
        n, size, dim, k = (int(rng.integers(1, x)) for x in (20, 160, 6, 30))
        queries, items = _unit(rng, n, dim), _unit(rng, size, dim)
        if kind in ("ties", "equal"):
            queries, items = (rng.integers(-2, 3, x.shape).astype(float) for x in (queries, items))
            items = items[rng.integers(0, 2 if kind == "equal" else size, size) % size]
        if kind == "odd":
            queries *= 10.0 ** rng.uniform(-30, 30)
            items[rng.random(size) < 0.05] *= 1e20
            items[rng.random(size) < 0.05] = np.nan
        ids, best = rng.permutation(size), ExactBest(queries, k)
        for at in range(0, size, 17):
            best.add(np.arange(n), ids[at : at + 17], items[at : at + 17])
        found, scores = best.places.ranked()
        every = pair_scores(queries, items, np.repeat(np.arange(n), size), np.tile(np.arange(size), n)).reshape(n, size)
        for q in range(n):
            want = sorted((-s, i) for s, i in zip(every[q], ids, strict=True) if s == s)[:k]
            assert [(-s, i) for s, i in zip(scores[q], found[q], strict=True) if i != NONE] == want


def test_places_of_true_entries():
    rng = np.random.default_rng(1)
    for share in (0, 0.01, 0.5, 1):
        for shape in ((1, 1), (3, 8), (7, 13), (64, 129)):
            mask = rng.random(shape) < share
            assert (true_at(mask) == np.flatnonzero(mask)).all()


def test_codes_must_come_before_vectors():
    ids, vecs = np.arange(3), _unit(np.random.default_rng(2), 3, 4)
    part = {"ids": ids.tobytes(), "vecs": vecs.tobytes()}
    codes = {"cell": 0, "ids": ids.tobytes(), "body": bytes(range(3))}
    exact = {"cell": -1, "ids": ids.tobytes(), "body": vecs.tobytes()}
    run = _found_by(np.zeros((1, 4)), vecs[None], 1, 3, 2)
    ((_, found, _),) = run(iter([(part, codes), (part, exact)]))
    assert (np.frombuffer(found, np.int64).reshape(3, 2) == np.argsort(-(vecs @ vecs.T), axis=1)[:, :2]).all()
    with pytest.raises(RuntimeError, match="after the vectors"):
        list(run(iter([(part, exact), (part, codes)])))


def test_index_exchanges_queries_and_not_items(spark, monkeypatch):
    """Many parts of the queries read the same blocks (before: codes and vectors were exchanged for every chunk)."""
    monkeypatch.setattr(vector_index, "PART_CELLS", 1500, raising=False)
    monkeypatch.setattr(vector_index, "QUERY_ROWS", 16)
    monkeypatch.setattr(topk, "CHUNK_CELLS", 1500)  # as small where chunks are sent
    monkeypatch.setattr(vector_index, "CHUNK_CELLS", 1500, raising=False)
    rng = np.random.default_rng(5)
    m = _unit(rng, 3000, 16)
    items, queries = _frame(spark, "item_id", m).cache(), _frame(spark, "query_id", m[:600]).cache()
    assert items.count() + queries.count() == 3600
    index = QuantisedIndex(items, cells=12)
    index.shortlist = 10
    store, bus = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty(30_000)
    before = store.executorSummary("driver").totalShuffleWrite()
    found = index.search(queries, 3).collect()
    bus.waitUntilEmpty(30_000)
    assert store.executorSummary("driver").totalShuffleWrite() - before < 600 * 16 * 8 * 4  # items are 3000 * 16 * 8
    assert len(found) == 1800 and all(abs(r.score - m[r.query_id] @ m[r.item_id]) < 1e-9 for r in found)
    assert all(r.item_id == r.query_id for r in found if r["rank"] == 0)
    # every cell and every code: the exact lists
    index.shortlist = None
    want = np.argsort(-(m[:40] @ m.T), axis=1)[:, :3]
    got = {(r.query_id, r["rank"]): r.item_id for r in index.search(queries.where("query_id < 40"), 3).collect()}
    assert got == {(q, r): want[q, r] for q in range(40) for r in range(3)}


def test_recall_joins_a_row_per_query(spark, monkeypatch):
    monkeypatch.setattr(topk, "SENT_CHUNKS", 0)
    rng = np.random.default_rng(7)
    m, q = _unit(rng, 300, 8), _unit(rng, 40, 8)
    exact, queries = FlatIndex(_frame(spark, "item_id", m)), _frame(spark, "query_id", q)
    part = FlatIndex(_frame(spark, "item_id", m).where("item_id % 3 > 0"))
    quality = index_quality(part, exact, queries, (20, 5))
    plan = quality._jdf.queryExecution().optimizedPlan().toString()
    assert "item_id" not in plan and "Window" not in plan  # before: a row per query and rank was ranked and joined by item, twice
    found, truth = part.search(queries, 20), exact.search(queries, 20)
    for r in quality.collect():
        want = list_recall(found.where(F.col("rank") < r.k), truth.where(F.col("rank") < r.k), "query_id").first().recall
        assert r.recall == pytest.approx(want, abs=1e-12) and 0 < r.recall < 1


def test_recall_of_missing_and_repeated_items(spark):
    exact = spark.createDataFrame([(0, [1, 2, 2]), (1, [3, 4]), (2, [5]), (3, [])], "query_id long, items array<long>")
    approx = spark.createDataFrame([(0, [2, 9]), (1, [4, 3, 3]), (7, [1]), (3, [1])], "query_id long, items array<long>")
    assert {r.k: r.recall for r in packed_recall(approx, exact, "query_id", (3, 1)).collect()} == pytest.approx({3: 0.5, 1: 0.0})


def test_vectors_join_the_lists_after_they_are_ranked(spark, monkeypatch):
    """Before: both vectors of every row were exchanged by query once more for the comparison with its neighbour."""

    class Index:
        def search(self, queries, k):
            rows = [(q, i, 0.0, r) for q in range(2) for r, i in enumerate((3, 4))]
            return spark.createDataFrame(rows, "query_id long, item_id long, score double, rank long")

    monkeypatch.setattr(catalog, "quantised_index", lambda spark, sf: Index())
    found = catalog.t21_quantised_index(spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.find("Join") < plan.find("Window")  # the window is below the joins
    assert sorted((r.query_id, r.n_items, r.last_rank, r.exact_and_ordered) for r in found.collect()) == [(0, 2, 1, False), (1, 2, 1, False)]
