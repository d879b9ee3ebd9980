"""Exact search of many queries: tasks read the items where they were written, only the sort and the results are exchanged."""

from __future__ import annotations

import numpy as np
import pytest

from asofkit.operators import topk
from asofkit.operators.topk import KBest, exact_top_k, read_rows, super_block_candidates


def _frame(spark, name, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], f"{name} long, vec array<double>")


def _unit(n, dim, seed):
    m = np.random.default_rng(seed).normal(size=(n, dim))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _lists(found):
    return {(r.query_id, r["rank"]): r.item_id for r in found.collect()}


def _shuffled_mb(spark, run):
    """MB written to shuffles while ``run`` runs, from the accumulators that Spark keeps per stage."""
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = store.executorSummary("driver").totalShuffleWrite()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return (store.executorSummary("driver").totalShuffleWrite() - before) / 1e6


def test_items_are_not_exchanged_per_chunk_of_queries(spark):
    """Sixteen chunks meet all items; what is exchanged is less than three times queries and items (before: one copy a chunk)."""
    items_m, queries_m = _unit(9000, 16, 1), _unit(8400, 16, 2)
    items, queries = (_frame(spark, name, enumerate(m)).cache() for name, m in (("item_id", items_m), ("query_id", queries_m)))
    assert items.count() + queries.count() == 17_400
    got = {}
    moved = _shuffled_mb(spark, lambda: got.update(_lists(exact_top_k(queries, items, 3, 64, 4))))
    assert 0 < moved < 3 * 17_400 * 16 * 8 / 1e6
    want = np.argsort(-(queries_m @ items_m.T), axis=1)[:, :3]
    assert got == {(q, r): want[q, r] for q in range(8400) for r in range(3)}
    rows = super_block_candidates(queries, items, 3, 64, 4)
    assert rows.count() == 3 * 8400  # finished lists leave the search
    assert "chunk" not in rows._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("scale", [1.0, 0.99])
def test_read_search_is_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "SENT_CHUNKS", 0)
    own, queries_m = _unit(700, 8, 3) * (scale ** np.arange(700))[:, None], _unit(60, 8, 4)
    items, queries = _frame(spark, "item_id", enumerate(own)), _frame(spark, "query_id", enumerate(queries_m))
    want = np.argsort(-(queries_m @ own.T), axis=1)
    for k, block_rows in ((5, 8), (1, 64), (40, 4096)):
        got = _lists(exact_top_k(queries, items, k, block_rows, 2))
        assert got == {(q, r): want[q, r] for q in range(60) for r in range(k)}, k


def test_read_search_of_odd_vectors(spark, monkeypatch):
    """Ties, zero, null and undefined vectors; fewer items than asked for; empty tables."""
    monkeypatch.setattr(topk, "SENT_CHUNKS", 0)
    vecs = [[0.0, 0.0], [-1.0, 0.0], [-1.0, 0.0], [-2.0, 0.0], [0.5, 0.0]] * 4
    items = _frame(spark, "item_id", [*enumerate(vecs), (98, None), (99, [float("nan"), 1.0])])
    asked = {0: [1.0, 0.0], 1: [0.0, 0.0], 2: [-1.0, 1.0]}
    queries = _frame(spark, "query_id", [*asked.items(), (3, None)])
    for k in (7, 50):
        got = _lists(exact_top_k(queries, items, k, 2, 2))
        for q, v in asked.items():
            want = sorted(range(20), key=lambda i: (-(np.array(vecs[i]) @ np.array(v)), i))[:k]
            assert [got[q, r] for r in range(len(want))] == want
        assert len(got) == 3 * min(k, 20)
    assert exact_top_k(queries, items.where("false"), 7).count() == 0
    assert exact_top_k(queries.where("false"), items, 7).count() == 0


def test_small_items_beside_an_undefined_one_are_found(spark):
    """A null component sorts last and must not hide the items of its block."""
    items = spark.createDataFrame(
        [(i, [1.0 - i / 100, 0.0]) for i in range(10)] + [(98, [0.0, None]), (99, [0.1, 2.0])], "item_id long, vec array<double>"
    )
    queries = _frame(spark, "query_id", [(0, [1.0, 0.0]), (1, [1.0, 1.0])])
    got = _lists(exact_top_k(queries, items, 2, 4, 1))
    assert got == {(0, 0): 0, (0, 1): 1, (1, 0): 99, (1, 1): 0}


def _blocks(m, numbers, rows=10):
    """A super-block of two blocks per entry of ``numbers``, in falling order of the norms."""
    for n, number in enumerate(numbers):
        for at in (2 * n * rows, (2 * n + 1) * rows):
            part = m[at : at + rows]
            top = np.linalg.norm(part, axis=1).max(keepdims=True)
            yield {"super": number, "ids": np.arange(at, at + rows).tobytes(), "vecs": part.tobytes(), "limits": top.tobytes()}


def test_reading_stops_where_no_query_can_want_more():
    m = _unit(200, 4, 5) * (0.9 ** np.arange(200))[:, None]
    probes = _unit(6, 4, 6)
    part = {"ids": np.arange(6).tobytes(), "vecs": probes.tobytes()}
    blocks = list(_blocks(m, range(10)))
    supers = [(-np.frombuffer(b["limits"])[0], b["super"]) for b in blocks[::2]]
    want = np.argsort(-(probes @ m.T), axis=1)[:, :3]

    def run(order):
        met = []
        pairs = ((part, b) for b in order if met.append(b["super"]) is None)
        ((_, ids, scores),) = topk._best_of_all(3, supers)(pairs)
        ids, scores = np.frombuffer(ids, np.int64).reshape(6, 3), np.frombuffer(scores).reshape(6, 3)
        assert (np.take_along_axis(ids, np.argsort(-scores, axis=1), 1) == want).all()
        return len(met)

    assert run(blocks) < 14
    assert run(blocks[6:] + blocks[:6]) > 14  # partitions read in another order: the largest norms are waited for


def test_queries_of_a_task_are_bounded():
    assert read_rows(10**7, 64, 25, 24) == 65_536 and read_rows(10**7, 1024, 25, 24) == 4096
    assert read_rows(10**7, 64, 1000, 24) == 2000 and read_rows(9000, 64, 25, 24) == 512
    assert KBest(read_rows(10**7, 64, 25, 24), 25).ids.nbytes < 16 * 2**20
