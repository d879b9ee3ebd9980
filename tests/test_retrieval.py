import random

import numpy as np
import pytest
from conftest import as_dicts, bursty_rows, events_of
from pyspark.sql import functions as F

from asofkit.operators.topk import KBest, block_top_k, exact_top_k, super_block_candidates
from asofkit.plans.vector_index import QuantisedIndex
from asofkit.plans.evaluation import evaluate, list_recall
from asofkit.plans.retrieval import (
    CellIndex,
    FlatIndex,
    ItemVectors,
    Retriever,
    VectorConfig,
    encoded_histories,
    fit_best,
    index_quality,
    item_vocab,
    last_positions,
    log_q,
    recent_candidates,
    training_pairs,
)

VISITS = [
    (3, 21, 70, "view"), (4, 22, 70, "addtocart"), (5, 21, 71, "view"), (6, 23, 71, "view"),
    (7, 22, 72, "view"), (8, 21, 70, "view"), (9, 23, 72, "transaction"), (12, 22, 73, "view"),
]


def test_vocabulary(spark):
    vocab = item_vocab(events_of(spark, VISITS), 2)
    assert {r.item_id: r.item_index for r in vocab.collect()} == {70: 2, 71: 3, 72: 4}


def test_log_q_covers_padding_and_unknown_items(spark):
    events = events_of(spark, VISITS)
    found = {r.item_index: r.log_q for r in log_q(events, item_vocab(events, 2)).collect()}
    smoothed = {0: 1, 1: 2, 2: 4, 3: 3, 4: 3}  # item 73 alone is unknown
    assert found == pytest.approx({i: np.log(n / 13) for i, n in smoothed.items()})


def test_encoded_histories_are_right_aligned(spark):
    vocab = item_vocab(events_of(spark, VISITS), 2)
    rows = [(8, 1, 73, "view"), (8, 2, 71, "transaction"), (8, 3, 70, "view")]
    history = spark.createDataFrame(rows, "request_id long, pos long, item_id long, event string")
    r = encoded_histories(history, vocab, "request_id", 5).first()
    assert (r.hist_index, r.hist_type) == ([0, 0, 1, 3, 2], [0, 0, 1, 3, 1])


def test_training_pairs(spark):
    tied = [(12, 21, 71, "view"), (12, 21, 72, "addtocart")]
    events = events_of(spark, VISITS + tied)
    vocab = item_vocab(events, 2)
    strict = as_dicts(training_pairs(events, vocab, 3))
    loose = as_dicts(training_pairs(events, vocab, 3, strict=False))
    for r in strict + loose:
        assert r["target_item"] != 73 and 1 <= r["pos"] < r["target_pos"]

    def contexts(pairs, target_pos):
        return sorted(r["pos"] for r in pairs if r["user_id"] == 21 and r["target_pos"] == target_pos)

    # positions 4 and 5 share a millisecond: only the loose form sees one before the other
    assert contexts(strict, 4) == contexts(loose, 4) == contexts(strict, 5) == [1, 2, 3]
    assert contexts(loose, 5) == [2, 3, 4]
    assert {r.user_id: r.end for r in last_positions(events).collect()} == {21: 5, 22: 3, 23: 2}


def _unit(spark, n, dim, seed, name):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)]
    return m, spark.createDataFrame(rows, f"{name} long, vec array<double>")


@pytest.mark.parametrize("block_rows", [7, 64, 4096])
def test_exact_top_k_is_brute_force(spark, block_rows):
    items_m, items = _unit(spark, 150, 8, 0, "item_id")
    queries_m, queries = _unit(spark, 40, 8, 1, "query_id")
    found = as_dicts(exact_top_k(queries, items, 10, block_rows))
    want = np.argsort(-(queries_m @ items_m.T), axis=1)[:, :10]
    got = np.zeros((40, 10), dtype=int)
    for r in found:
        got[r["query_id"], r["rank"]] = r["item_id"]
    assert len(found) == 400 and (got == want).all()


def test_top_k_ties_and_short_lists(spark):
    items = spark.createDataFrame([(i, [1.0, 0.0]) for i in (9, 3, 7)], "item_id long, vec array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.0])], "query_id long, vec array<double>")
    found = sorted(as_dicts(exact_top_k(queries, items, 5, 2)), key=lambda r: r["rank"])
    assert [r["item_id"] for r in found] == [3, 7, 9]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_super_blocks_emit_at_most_k_rows_each_and_are_left_out(spark):
    """Rows that reach the final ranking: k per super-block at most, and few where the norms fall."""
    rng = np.random.default_rng(8)
    m = rng.normal(size=(640, 8))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    queries_m, queries = _unit(spark, 30, 8, 9, "query_id")
    for scale, most in ((np.ones(640), 44), (0.9 ** np.arange(640), 12)):
        own = m * scale[:, None]
        items = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(own)], "item_id long, vec array<double>")
        rows = super_block_candidates(queries, items, 5, block_rows=8, super_blocks=2)
        per_query = [r.n for r in rows.groupBy("query_id").agg(F.count("*").alias("n")).collect()]
        assert len(per_query) == 30 and max(per_query) <= 5 * most
        found = as_dicts(exact_top_k(queries, items, 5, 8, 2))
        got = {(r["query_id"], r["rank"]): r["item_id"] for r in found}
        want = np.argsort(-(queries_m @ own.T), axis=1)[:, :5]
        assert got == {(q, r): want[q, r] for q in range(30) for r in range(5)}


def test_exact_top_k_needs_no_nested_loop(spark):
    _, items = _unit(spark, 200, 4, 0, "item_id")
    _, queries = _unit(spark, 20, 4, 1, "query_id")
    plan = _plan(exact_top_k(queries, items, 3, 16, 2))
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_top_k_of_zero_negative_and_equal_vectors(spark):
    items_m = np.array([[0.0, 0.0], [-1.0, 0.0], [-1.0, 0.0], [-2.0, 0.0], [0.0, 0.0], [-0.5, 0.0]] * 4)
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items_m)] + [(99, None)], "item_id long, vec array<double>")
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [-1.0, 1.0]), (3, None)], "query_id long, vec array<double>")
    found = as_dicts(exact_top_k(queries, items, 7, 2, 2))
    for q, v in ((0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [-1.0, 1.0])):
        want = sorted(range(24), key=lambda i: (-(items_m[i] @ np.array(v)), i))[:7]
        assert [r["item_id"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == q] == want
    assert len(found) == 21
    assert exact_top_k(queries, items.where("false"), 7).count() == 0
    assert exact_top_k(queries.where("false"), items, 7).count() == 0


def test_rows_that_leave_the_search_do_not_grow_with_the_items(spark):
    """Super-blocks are dealt over lanes, so twice as many of them give no more rows to rank."""
    rng = np.random.default_rng(4)
    m = rng.normal(size=(4000, 4))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    items = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "item_id long, vec array<double>")
    queries_m, queries = _unit(spark, 12, 4, 5, "query_id")
    rows = super_block_candidates(queries, items, 5, block_rows=4, super_blocks=2)
    lanes = 2 * spark.sparkContext.defaultParallelism
    assert max(r["count"] for r in rows.groupBy("query_id").count().collect()) <= 5 * (1 + lanes) < 5 * 500
    got = {(r.query_id, r["rank"]): r.item_id for r in exact_top_k(queries, items, 5, 4, 2).collect()}
    want = np.argsort(-(queries_m @ m.T), axis=1)[:, :5]
    assert got == {(q, r): want[q, r] for q in range(12) for r in range(5)}


def test_best_of_many_ties_and_undefined_scores():
    rng = np.random.default_rng(6)
    for k in (1, 3, 9):
        best, all_ids, all_scores = KBest(20, k), [], []
        for at in range(0, 40, 8):
            ids, scores = 100 - np.arange(at, at + 8), rng.integers(0, 3, (20, 8)).astype(float)
            scores[::4, 0] = np.nan
            best.add(np.arange(20), ids, scores, np.full(20, -np.inf))
            all_ids.append(ids)
            all_scores.append(scores)
        ids, scores = np.concatenate(all_ids), np.hstack(all_scores)
        for q in range(20):
            want = sorted((-s, i) for s, i in zip(scores[q], ids, strict=True) if s == s)[:k]
            assert sorted(zip(-best.scores[q], best.ids[q], strict=True)) == want


def test_cell_index_recall(spark):
    _, items = _unit(spark, 1500, 8, 2, "item_id")
    _, queries = _unit(spark, 50, 8, 3, "query_id")
    exact = FlatIndex(items)
    quality = {r.k: r.recall for r in index_quality(CellIndex(items, 12, 6), exact, queries, (50, 10)).collect()}
    assert quality[10] > 0.8 and quality[50] > 0.75
    everything = list_recall(CellIndex(items, 12, 12).search(queries, 10), exact.search(queries, 10), "query_id")
    assert everything.first().recall == 1.0


def test_cell_search_ranks_few_rows_whatever_the_blocks(spark):
    """A query's rows are combined over all blocks of its cells before they leave a task."""
    items_m, items = _unit(spark, 3000, 4, 12, "item_id")
    queries_m, queries = _unit(spark, 9, 4, 13, "query_id")
    placed = items.withColumn("cell", F.col("item_id") % 3)
    asked = queries.withColumn("cells", F.array(F.lit(0).cast("long"), F.lit(2).cast("long")))
    found = block_top_k(asked, placed, 5, 4)
    assert "NestedLoop" not in _plan(found)
    got = {(r.query_id, r["rank"]): r.item_id for r in found.collect()}
    scores = np.where(np.arange(3000) % 3 == 1, -np.inf, queries_m @ items_m.T)
    want = np.argsort(-scores, axis=1)[:, :5]
    assert got == {(q, r): want[q, r] for q in range(9) for r in range(5)}


def test_crowded_cell_is_split_and_complete(spark):
    rows = [(i, [1.0, i * 1e-6]) for i in range(900)]
    items = spark.createDataFrame(rows, "item_id long, vec array<double>")
    queries = spark.createDataFrame([(0, [0.0, 1.0])], "query_id long, vec array<double>")
    found = exact_top_k(queries, items, 900, block_rows=50).orderBy("rank").collect()
    assert [r.item_id for r in found] == list(range(899, -1, -1))


FOLLOWS = {40: 41, 50: 51, 60: 61}


def _planted(spark):
    """Users go on from an item to the one that follows it; the probes have only begun."""
    rng = np.random.default_rng(17)
    rows = []
    for user in range(300, 390):
        first, at = int(rng.choice(list(FOLLOWS))), int(rng.integers(0, 4_000))
        rows += [(at, user, first, "view"), (at + int(rng.integers(1, 50)), user, FOLLOWS[first], "view")]
    probes = [(4_500 + u, u, list(FOLLOWS)[u % 3], "view") for u in range(700, 715)]
    target = [(9_000 + u, u, FOLLOWS[i], "view") for _, u, i, _ in probes]
    return events_of(spark, rows + probes), events_of(spark, target)


def test_vectors_learn_what_follows(spark, tmp_path):
    history, target = _planted(spark)
    model = ItemVectors(VectorConfig(dim=8, iterations=5, min_item_count=1))
    found = evaluate(model, history, target, (1,)).first()
    assert found.recall_at_1 == pytest.approx(1.0)
    model.save(str(tmp_path / "m"))
    again = ItemVectors.load(spark, str(tmp_path / "m"))
    users = spark.createDataFrame([(700,), (305,), (-1,)], "user_id long")

    def lists(m):
        return sorted((r.user_id, r.rank, r.item_id) for r in m.recommend(users, 3).collect())

    assert again.config == model.config and lists(again) == lists(model)
    assert [i for u, _, i in lists(again) if u == -1] == model.popular[:3]


def test_model_selection_keeps_the_best(spark):
    history, _ = _planted(spark)
    scores = iter([0.2, 0.5, 0.1, 0.1, 0.9])
    configs = [VectorConfig(dim=4, iterations=1, min_item_count=1, seed=s) for s in range(5)]
    best = fit_best(history, configs, lambda config, model: next(scores), patience=2)
    assert best.config.seed == 1  # stopped before the last one


def test_candidates_keep_both_sources(spark):
    _, items = _unit(spark, 30, 4, 5, "item_id")
    model = ItemVectors(VectorConfig(dim=4))
    model.targets, model.contexts = items, items.withColumnRenamed("vec", "features")
    rng = random.Random(1)
    rows = [(q, 1000, 8, p, p, rng.choice([*range(10), 77]), "view") for q in range(5) for p in range(1, 9)]
    history = spark.createDataFrame(
        rows, "request_id long, as_of_ms long, end long, pos long, ts_ms long, item_id long, event string"
    )
    found = as_dicts(Retriever(model).candidates(history, 6, 3))
    for q in range(5):
        mine = [r for r in found if r["request_id"] == q]
        assert len({r["item_id"] for r in mine}) == len(mine)
        assert sorted(r["ann_rank"] for r in mine if r["ann_rank"] is not None) == list(range(6))
        seen = list(dict.fromkeys(x[5] for x in reversed([r for r in rows if r[0] == q])))[:3]
        recent = sorted((r for r in mine if r["recent_rank"] is not None), key=lambda r: r["recent_rank"])
        assert [r["item_id"] for r in recent] == seen
        assert all((r["ann_score"] is None) == (r["item_id"] == 77) for r in mine)
    assert recent_candidates(history, 3).count() == sum(r["recent_rank"] is not None for r in found)


def test_vectors_ignore_the_future(spark):
    rows = bursty_rows(31)
    cut = rows[300][0]
    past = events_of(spark, [r for r in rows if r[0] < cut])
    model = ItemVectors(VectorConfig(dim=4, iterations=2, min_item_count=1))
    vocab = item_vocab(past, 1)
    pairs = model.transitions(past, vocab).collect()
    full = events_of(spark, rows).where(F.col("ts_ms") < cut)
    assert sorted(pairs) == sorted(model.transitions(full, vocab).collect())


def _clustered(n, dim, centres, spread, seed):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(centres, dim))
    m = middles[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_quantised_index_reaches_its_recall_with_part_of_the_work(spark):
    m = _clustered(3000, 16, 40, 0.35, 21)
    items = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "item_id long, vec array<double>")
    q = _clustered(3200, 16, 40, 0.35, 21)[3000:]
    queries = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(q)], "query_id long, vec array<double>")
    index = QuantisedIndex(items.repartition(3))
    assert len(index.centres) == 55 and index.books.shape == (4, 256, 4)
    index.calibrate(queries, (500, 50), 0.95)
    assert index.probes < 40 and index.shortlist is not None
    quality = {r.k: r.recall for r in index_quality(index, FlatIndex(items), queries, (500, 50)).collect()}
    assert min(quality.values()) >= 0.95
    # codes stand for the vectors, and scores are those of the vectors
    found = index.search(queries.where("query_id < 20"), 10).collect()
    assert all(abs(r.score - m[r.item_id] @ q[r.query_id]) < 1e-9 for r in found) and len(found) == 200
    # finished lists leave the tasks: no vector is copied per cell, no candidate is ranked afterwards
    assert index.ranked_cells(queries, 3).columns == ["query_id", "cell", "cell_rank"]
    assert "Window" not in _plan(index.search(queries, 10))
    one = QuantisedIndex(items.where("item_id = 5"))
    one.calibrate(queries, (2,))
    assert [r.item_id for r in one.search(queries.where("query_id = 0"), 2).collect()] == [5]
