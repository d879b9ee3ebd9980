"""Vocabulary, vectors, top-k, candidates, ranker inputs and recommendations."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asofkit.catalog.common import (
    CAND,
    CELLS,
    EV,
    LIST_LEN,
    ORD,
    REQ,
    SPLIT,
    STANDARD,
    WIDE,
    clicks,
    given_vectors,
    item_features_sql,
    metrics_sql,
    purchases,
    r6,
    requests,
    user_features_sql,
    utc,
    weekly_split,
    with_,
)
from asofkit.functions.columns import dot
from asofkit.definitions import ITEM_FEATURES, RANKER_FEATURES, USER_FEATURES
from asofkit.operators.topk import exact_top_k
from asofkit.plans.baselines import Popularity
from asofkit.plans.evaluation import build_eval_set, list_recall, score, score_with_novel
from asofkit.plans.experiments import run_ranking
from asofkit.plans.pairwise import PairwiseRanker
from asofkit.plans.ranking import (
    Ranker,
    RankerConfig,
    add_labels,
    build_features,
    candidate_recall,
    group_sizes,
    pruned_features,
    request_volume,
    split_requests,
    top_k_by_score,
    user_item_features,
    with_positives,
)
from asofkit.plans.recommend import BatchRecommender, as_requests
from asofkit.plans.retrieval import (
    CellIndex,
    FlatIndex,
    ItemVectors,
    Retriever,
    VectorConfig,
    encoded,
    encoded_histories,
    fit_best,
    index_quality,
    item_vocab,
    log_q,
    merge_candidates,
    recent_candidates,
    with_pair_scores,
)
from asofkit.plans.vector_index import QuantisedIndex
from asofkit.session import scratch_path
from asofkit.sources.tables import vectors

INDEX_KS, INDEX_RECALL = (500, 50), 0.95
_SMALL_MODEL = VectorConfig(dim=16, iterations=4)


class FixedWeights:
    """A linear ranker with given weights, so that ranked lists can be checked in SQL."""

    features = list(RANKER_FEATURES)

    def rerank(self, frame: DataFrame, k: int) -> DataFrame:
        score = (
            F.coalesce("ann_score", F.lit(0.0))
            + 0.5 * F.coalesce("ui_events", F.lit(0))
            + 0.01 * F.col("item_views_24h")
            - 0.001 * F.coalesce("recent_rank", F.lit(50))
        )
        return top_k_by_score(frame.withColumn("score", F.round(score, 6)), k)


def d15_vocabulary(spark, sf) -> DataFrame:
    return item_vocab(purchases(spark, sf), 25)


def d16_log_q(spark, sf) -> DataFrame:
    events = purchases(spark, sf)
    return log_q(events, item_vocab(events, 25)).withColumn("log_q", r6("log_q"))


def t19_encoded_histories(spark, sf) -> DataFrame:
    vocab = item_vocab(clicks(spark, sf), 55)
    lists = encoded_histories(requests(spark, sf).history, vocab, "request_id")

    def text(c: str):
        return F.array_join(F.col(c).cast("array<string>"), ",").alias(c)

    return lists.select("request_id", text("hist_index"), text("hist_type"))


def t19_empty_histories(spark, sf) -> DataFrame:
    """Keys with and without a history: every request and as many that saw nothing."""
    vocab = item_vocab(clicks(spark, sf), 55)
    known = requests(spark, sf)
    keys = known.frame.select("request_id").unionByName(known.frame.select((-F.col("request_id") - 1).alias("request_id")))
    lists = encoded_histories(known.history, vocab, "request_id", keys=keys)
    return lists.select(
        "request_id",
        F.size("hist_index").cast("long").alias("length"),
        F.size(F.filter("hist_type", lambda x: x != 0)).cast("long").alias("events"),
        F.aggregate("hist_index", F.lit(0).cast("long"), lambda a, x: a + x).alias("index_sum"),
    )


def t20_encoded_events(spark, sf) -> DataFrame:
    events = purchases(spark, sf)
    return encoded(events, item_vocab(events, 25)).select(
        "user_id", "ts_ms", "item_id", "item_index", "type_index"
    )


def _queries(spark, sf) -> DataFrame:
    return vectors(utc(spark), sf).select(F.col("item_id").alias("query_id"), "vec")


def f5_exact_top_k(spark, sf) -> DataFrame:
    items = vectors(utc(spark), sf).select("item_id", "vec")
    return exact_top_k(_queries(spark, sf), items, 10).withColumn("score", r6("score"))


def t22_flat_index(spark, sf) -> DataFrame:
    """Several item blocks per query, merged."""
    items = vectors(utc(spark), sf).select("item_id", "vec")
    found = FlatIndex(items, block_rows=64).search(_queries(spark, sf), 25)
    return found.select("query_id", "item_id", "rank")


def c13_best_match(spark, sf) -> DataFrame:
    """Every vector's best match among all vectors of another label's half."""
    rows = vectors(utc(spark), sf)
    even = rows.where(F.col("label") % 2 == 0).select("item_id", "vec")
    odd = rows.where(F.col("label") % 2 == 1).select(F.col("item_id").alias("query_id"), "vec")
    return exact_top_k(odd, even, 1).select("query_id", "item_id", r6("score").alias("score"))


def t21_cell_index(spark, sf) -> DataFrame:
    items = vectors(utc(spark), sf).select("item_id", "vec")
    return CellIndex(items, CELLS, 8).search(_queries(spark, sf), 10)


def t21_cell_index_all_probes(spark, sf) -> DataFrame:
    """Scanning every cell must give the exact lists."""
    items = vectors(utc(spark), sf).select("item_id", "vec")
    found = CellIndex(items, CELLS, CELLS).search(_queries(spark, sf), 10)
    return found.select("query_id", "item_id", "rank")


def t23_index_quality(spark, sf) -> DataFrame:
    items = vectors(utc(spark), sf).select("item_id", "vec")
    return index_quality(CellIndex(items, CELLS, 8), FlatIndex(items), _queries(spark, sf), (100, 10))


@cache
def quantised_index(spark, sf) -> QuantisedIndex:
    """Over all vectors, its effort set on sample queries for the declared lists of 500 and 50."""
    index = QuantisedIndex(vectors(utc(spark), sf).select("item_id", "vec"))
    index.calibrate(_queries(spark, sf), INDEX_KS, INDEX_RECALL)
    return index


def t21_quantised_index(spark, sf) -> DataFrame:
    """What holds for the list of every query: its length, distinct items, exact scores in falling order."""
    found = quantised_index(spark, sf).search(_queries(spark, sf), 50)
    own = _queries(spark, sf).select("query_id", F.col("vec").alias("q"))
    items = vectors(utc(spark), sf).select("item_id", F.col("vec").alias("v"))
    # neighbours in a list are compared before vectors join it, so one exchange has vectors in it, that by item
    before = F.lag("score").over(Window.partitionBy("query_id").orderBy("rank"))
    ordered = found.withColumn("ordered", F.coalesce(before, F.col("score")) >= F.col("score"))
    exact = F.abs(F.col("score") - dot(F.col("q"), F.col("v"))) < 1e-9
    both = ordered.join(own, "query_id").join(items, "item_id")
    checked = both.select("query_id", "item_id", "rank", (exact & F.col("ordered")).alias("fine"))
    return checked.groupBy("query_id").agg(
        F.count_distinct("item_id").alias("n_items"), F.max("rank").alias("last_rank"), F.bool_and("fine").alias("exact_and_ordered")
    )


def t23_quantised_recall(spark, sf) -> DataFrame:
    """Recall against exact lists over all queries, at the declared sizes, not only on the sample."""
    items = vectors(utc(spark), sf).select("item_id", "vec")
    found = index_quality(quantised_index(spark, sf), FlatIndex(items), _queries(spark, sf), INDEX_KS)
    return found.select(F.col("k").cast("long").alias("k"), (F.col("recall") >= INDEX_RECALL).alias("reached"))


def d21_full_probe_recall(spark, sf) -> DataFrame:
    items = vectors(utc(spark), sf).select("item_id", "vec")
    approx = CellIndex(items, CELLS, CELLS).search(_queries(spark, sf), 10)
    return list_recall(approx, exact_top_k(_queries(spark, sf), items, 10), "query_id")


def _user_vectors(spark, sf) -> DataFrame:
    return given_vectors(spark, sf).user_vectors(requests(spark, sf).history, "request_id")


def t18_user_vectors(spark, sf) -> DataFrame:
    numbers = _user_vectors(spark, sf).select("request_id", F.posexplode("vec").alias("d", "x"))
    return numbers.select("request_id", F.col("d").cast("long").alias("d"), r6("x").alias("x"))


def t18_learned_vectors(spark, sf) -> DataFrame:
    """Lists of the learned model for all users with a history."""
    split = weekly_split(spark, sf)
    model = ItemVectors(_SMALL_MODEL)
    model.fit(split.train_val)
    return model.recommend(split.train_val.select("user_id").distinct(), 10)


def t18_model_selection(spark, sf) -> DataFrame:
    """Two configurations scored on validation; the better one's target vectors."""
    split = weekly_split(spark, sf)

    def on_fit(config: VectorConfig, model: ItemVectors) -> float:
        judged = build_eval_set(split.train, split.val)
        found = score(model.recommend(judged.users, 50), judged, (50,))
        return found.first()["recall_at_50"]

    configs = [VectorConfig(dim=8, iterations=2), VectorConfig(dim=8, iterations=4)]
    return fit_best(split.train, configs, on_fit).targets


def e8_recent_rank(spark, sf) -> DataFrame:
    return recent_candidates(requests(spark, sf).history)


def e10_ann_rank(spark, sf) -> DataFrame:
    retriever = Retriever(given_vectors(spark, sf))
    return retriever.nearest(_user_vectors(spark, sf), LIST_LEN)


def c8_candidate_union(spark, sf) -> DataFrame:
    return merge_candidates(e10_ann_rank(spark, sf), e8_recent_rank(spark, sf))


def c12_vector_lookup(spark, sf) -> DataFrame:
    """Scores of (request, recent item) pairs; items 50 and up are left out of the vectors."""
    pairs = requests(spark, sf).history.select("request_id", "item_id").distinct()
    known = given_vectors(spark, sf).targets.where(F.col("item_id") < 50)
    found = with_pair_scores(pairs, _user_vectors(spark, sf), known)
    return found.withColumn("ann_score", r6("ann_score"))


def _candidates(spark, sf) -> DataFrame:
    return Retriever(given_vectors(spark, sf)).candidates(requests(spark, sf).history, LIST_LEN)


def t24_candidates(spark, sf) -> DataFrame:
    return _candidates(spark, sf).withColumn("ann_score", r6("ann_score"))


def t25_user_item_features(spark, sf) -> DataFrame:
    return user_item_features(requests(spark, sf).history)


def _ranker_table(spark, sf, features=STANDARD) -> DataFrame:
    return build_features(
        _candidates(spark, sf), requests(spark, sf), clicks(spark, sf), features
    )


def t26_ranker_table(spark, sf) -> DataFrame:
    return _ranker_table(spark, sf, WIDE).withColumn("ann_score", r6("ann_score"))


def _labelled(spark, sf) -> DataFrame:
    return add_labels(_ranker_table(spark, sf), requests(spark, sf).relevant)


def t27_labels(spark, sf) -> DataFrame:
    return add_labels(_candidates(spark, sf), requests(spark, sf).relevant).select(
        "request_id", "item_id", "label"
    )


def c7_joined_attributes(spark, sf) -> DataFrame:
    frame = requests(spark, sf).frame
    return _candidates(spark, sf).join(F.broadcast(frame), "request_id").select(
        "request_id", "item_id", "user_id", "as_of_ms"
    )


def d17_last_positions(spark, sf) -> DataFrame:
    found = user_item_features(requests(spark, sf).history)
    return found.select("request_id", "item_id", "ui_last_pos", "ui_is_last")


def d18_with_positives(spark, sf) -> DataFrame:
    return with_positives(t27_labels(spark, sf))


def d20_candidate_recall(spark, sf) -> DataFrame:
    found = candidate_recall(_candidates(spark, sf), requests(spark, sf).relevant)
    return found.select(r6("candidate_recall").alias("candidate_recall"))


def d22_request_volume(spark, sf) -> DataFrame:
    found = requests(spark, sf)
    n = found.frame.count()
    volume = request_volume(_candidates(spark, sf), found.relevant, n)
    return volume.select(*[r6(c).alias(c) for c in volume.columns])


def d26_group_sizes(spark, sf) -> DataFrame:
    return group_sizes(_candidates(spark, sf))


def t29_request_split(spark, sf) -> DataFrame:
    found = requests(spark, sf)
    first, second = split_requests(_candidates(spark, sf), found.frame.count())
    return (
        first.withColumn("part", F.lit("fit"))
        .unionByName(second.withColumn("part", F.lit("valid")))
        .groupBy("part")
        .agg(F.count("*").alias("n"), F.max("request_id").alias("last_request"))
    )


def f3_rerank(spark, sf) -> DataFrame:
    found = FixedWeights().rerank(_ranker_table(spark, sf), 10)
    return found.select("request_id", "rank", "item_id", r6("score").alias("score"))


def f4_rerank_one_each(spark, sf) -> DataFrame:
    found = FixedWeights().rerank(_ranker_table(spark, sf), 1)
    return found.select("request_id", "item_id", r6("score").alias("score"))


def t34_fixed_ranker_metrics(spark, sf) -> DataFrame:
    """The comparison row of one method over the sampled requests."""
    lists = FixedWeights().rerank(_ranker_table(spark, sf), 100)
    found = score_with_novel(lists, requests(spark, sf).eval_set())
    return found.select(*[r6(c).alias(c) for c in found.columns])


_TREES = RankerConfig(max_iter=5, max_depth=3)


def t28_ranker(spark, sf) -> DataFrame:
    """Fit on earlier requests, save, load, and rerank everything."""
    frame = _labelled(spark, sf)
    train, valid = split_requests(frame, requests(spark, sf).frame.count())
    ranker = Ranker(_TREES)
    ranker.fit(train, valid)
    path = scratch_path(spark, "ranker")
    ranker.save(path)
    return Ranker.load(spark, path).rerank(frame, 10)


def t28_pairwise_ranker(spark, sf) -> DataFrame:
    """Learned from pairs at the declared size, saved and loaded; what holds for every request's list."""
    frame = _labelled(spark, sf)
    train, valid = split_requests(frame, requests(spark, sf).frame.count())
    ranker = PairwiseRanker()
    losses = ranker.fit(train, valid)
    if min(v for _, v in losses) >= losses[0][1]:
        raise RuntimeError("no step made the validation pairs better ordered")
    path = scratch_path(spark, "pairwise")
    ranker.save(path)
    found = PairwiseRanker.load(spark, path).rerank(frame, 10)
    before = F.lag("score").over(Window.partitionBy("request_id").orderBy("rank"))
    ordered = found.withColumn("fine", F.coalesce(before, F.col("score")) >= F.col("score"))
    return ordered.groupBy("request_id").agg(
        F.count_distinct("item_id").alias("n_items"), F.max("rank").alias("last_rank"), F.bool_and("fine").alias("ordered")
    )


def t18_declared_vectors(spark, sf) -> DataFrame:
    """Vectors of the declared size with popularity correction; what holds for every user's list."""
    split = weekly_split(spark, sf)
    model = ItemVectors(VectorConfig())
    model.fit(split.train_val)
    found = model.recommend(split.train_val.select("user_id").distinct(), 10)
    before = F.lag("score").over(Window.partitionBy("user_id").orderBy("rank"))
    ordered = found.withColumn("fine", F.coalesce(before >= F.col("score"), F.lit(True)))
    sizes = model.targets.agg(F.min(F.size("vec")).alias("dim"), F.bool_and(F.abs(dot(F.col("vec"), F.col("vec")) - 1) < 1e-6).alias("unit"))
    per_user = ordered.groupBy("user_id").agg(F.count_distinct("item_id").alias("n_items"), F.bool_and("fine").alias("ordered"))
    return per_user.crossJoin(F.broadcast(sizes))  # one row


def t30_feature_pruning(spark, sf) -> DataFrame:
    """Gain share of every feature and whether the lean ranker keeps it."""
    frame = _labelled(spark, sf)
    train, valid = split_requests(frame, requests(spark, sf).frame.count())
    ranker = Ranker(_TREES)
    ranker.fit(train, valid)
    gains = ranker.importance()
    kept = set(pruned_features(gains))
    rows = [(name, share, name in kept) for name, share in gains.items()]
    return spark.createDataFrame(rows, "feature string, gain double, kept boolean")


def _recommender(spark, sf) -> BatchRecommender:
    split = weekly_split(spark, sf)
    popular = Popularity(14)
    popular.fit(split.train_val)
    return BatchRecommender(
        Retriever(given_vectors(spark, sf)), FixedWeights(), popular.items, split.train_val
    )


def t32_recommend(spark, sf) -> DataFrame:
    """Every user at the start of the test window, and one unknown user per known one."""
    split = weekly_split(spark, sf)
    known = split.events.select("user_id").distinct()
    everyone = known.unionByName(known.select((-F.col("user_id") - 1).alias("user_id")))
    points = everyone.withColumn("as_of_ms", F.lit(split.test_start_ms))
    return _recommender(spark, sf).recommend(as_requests(points), 10)


def t32_latest(spark, sf) -> DataFrame:
    """Known and unknown users without a moment: just after the latest event of the recommender's log."""
    known = weekly_split(spark, sf).events.select("user_id").distinct()
    everyone = known.unionByName(known.select((-F.col("user_id") - 1).alias("user_id")))
    return _recommender(spark, sf).recommend(everyone, 10)


def t34_methods(spark, sf) -> DataFrame:
    """Six methods on the same requests, with learned vectors and trees."""
    return run_ranking(
        weekly_split(spark, sf), 400, 7, _SMALL_MODEL, _TREES, ann_k=40, cells=8
    ).methods


QUERIES = {
    f.__name__: f
    for f in (
        d15_vocabulary, d16_log_q, t19_encoded_histories, t20_encoded_events, f5_exact_top_k,
        t22_flat_index, c13_best_match, t21_cell_index, t21_cell_index_all_probes,
        t21_quantised_index, t23_quantised_recall, t23_index_quality, d21_full_probe_recall, t18_user_vectors, t18_learned_vectors,
        t18_model_selection, e8_recent_rank, e10_ann_rank, c8_candidate_union, c12_vector_lookup,
        t24_candidates, t25_user_item_features, t26_ranker_table, t27_labels, c7_joined_attributes,
        d17_last_positions, d18_with_positives, d20_candidate_recall, d22_request_volume,
        d26_group_sizes, t29_request_split, f3_rerank, f4_rerank_one_each,
        t34_fixed_ranker_metrics, t28_ranker, t28_pairwise_ranker, t18_declared_vectors, t30_feature_pruning, t32_recommend, t32_latest, t19_empty_histories, t34_methods,
    )
}

_VOCAB = """vocab AS (SELECT item_id, row_number() OVER (ORDER BY item_id) + 1 AS item_index FROM
  (SELECT item_id FROM ev GROUP BY 1 HAVING count(*) >= {n}))"""
_TYPE = "CASE event WHEN 'view' THEN 1 WHEN 'addtocart' THEN 2 ELSE 3 END"
_TOP = """SELECT * FROM (SELECT q.vec_id AS query_id, i.vec_id AS item_id,
  list_dot_product(q.embedding::DOUBLE[], i.embedding::DOUBLE[]) AS s,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, i.vec_id) - 1 AS rank FROM embeddings q, embeddings i {where})
  WHERE rank < {k}"""
_BASE = (EV, SPLIT, REQ)
_C = (*_BASE, CAND)
_UI = """ui AS (SELECT request_id, item_id, count(*)::INTEGER AS ui_events,
  (count(*) FILTER (WHERE event = 'addtocart'))::INTEGER AS ui_carts, max(as_of_ms) - max(ts_ms) AS ui_age_ms,
  min(back)::INTEGER AS ui_last_pos, (CASE WHEN min(back) = 0 THEN 1 ELSE 0 END)::TINYINT AS ui_is_last FROM hist GROUP BY 1, 2)"""


def _table(features) -> tuple[str, ...]:
    return (
        *_C,
        _UI,
        "upoints AS (SELECT user_id, as_of_ms FROM req)",
        "ipoints AS (SELECT item_id, as_of_ms FROM scored JOIN req USING (request_id))",
        user_features_sql("upoints", features),
        item_features_sql("ipoints", features),
        """tab AS (SELECT s.request_id, s.item_id, r.user_id, r.as_of_ms, round(s.ann_score, 6) AS ann_score,
  s.ann_rank::INTEGER AS ann_rank, s.recent_rank::INTEGER AS recent_rank, ui_events, ui_carts, ui_age_ms, ui_last_pos,
  coalesce(ui_is_last, 0)::TINYINT AS ui_is_last, """
        + ", ".join((*ITEM_FEATURES, *USER_FEATURES))
        + """ FROM scored s JOIN req r USING (request_id) LEFT JOIN ui USING (request_id, item_id)
  JOIN uf ON uf.user_id = r.user_id AND uf.as_of_ms = r.as_of_ms
  JOIN itf ON itf.item_id = s.item_id AND itf.as_of_ms = r.as_of_ms)""",
    )


_FIXED = """fixed AS (SELECT request_id, item_id, score, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, item_id) - 1 AS rank
  FROM (SELECT *, round(coalesce(raw, 0) + 0.5 * coalesce(ui_events, 0) + 0.01 * item_views_24h
    - 0.001 * coalesce(recent_rank, 50), 6) AS score
    FROM (SELECT tab.*, scored.ann_score AS raw FROM tab JOIN scored USING (request_id, item_id))))"""
_RNEW = """rnewrel AS (SELECT * FROM rrel WHERE NOT EXISTS (SELECT 1 FROM rseen s WHERE s.request_id = rrel.request_id AND s.item_id = rrel.item_id)),
rnewrecs AS (SELECT request_id, item_id, row_number() OVER (PARTITION BY request_id ORDER BY rank) - 1 AS rank FROM lists r
  WHERE NOT EXISTS (SELECT 1 FROM rseen s WHERE s.request_id = r.request_id AND s.item_id = r.item_id)
    AND request_id IN (SELECT request_id FROM rnewrel))"""
_LABELS = """lab AS (SELECT c.request_id, c.item_id, (CASE WHEN r.item_id IS NULL THEN 0 ELSE 1 END)::TINYINT AS label
  FROM cand c LEFT JOIN rrel r USING (request_id, item_id))"""
# the serving moment: every user at the start of the test window
_SERVE_REQ = """allusers AS (SELECT DISTINCT user_id FROM ev UNION SELECT DISTINCT -user_id - 1 FROM ev),
req AS (SELECT row_number() OVER (ORDER BY user_id) - 1 AS request_id, user_id, test_start AS as_of_ms FROM allusers, b),
hist AS (SELECT * FROM (
    SELECT r.request_id, r.as_of_ms, e.ts_ms, e.item_id, e.event,
           row_number() OVER (PARTITION BY r.request_id ORDER BY e.ts_ms DESC, e.item_id DESC, e.event DESC,
                              e.transaction_id DESC NULLS LAST) - 1 AS back
    FROM req r JOIN ev e ON e.user_id = r.user_id AND e.ts_ms < r.as_of_ms) WHERE back < 50)"""
_SERVE_CAND = CAND.replace(f"ann_rank < {LIST_LEN}", "ann_rank < 500")
_SERVE_POP = """pop AS (SELECT item_id, row_number() OVER (ORDER BY score DESC, last_ts DESC, item_id) - 1 AS rank FROM (
  SELECT item_id, sum(CASE event WHEN 'view' THEN 1.0 WHEN 'addtocart' THEN 3.0 ELSE 5.0 END) AS score, max(ts_ms) AS last_ts
  FROM past WHERE ts_ms >= (SELECT max(ts_ms) + 1 - 14::BIGINT * 86400000 FROM past) GROUP BY 1))"""


def _serve(at: str = "test_start") -> str:
    table = [p for p in _table(STANDARD) if p not in _C]
    return with_(EV, SPLIT, _SERVE_REQ.replace("test_start AS as_of_ms", f"{at} AS as_of_ms"), _SERVE_CAND, *table, _FIXED, _SERVE_POP) + """
SELECT req.user_id, req.as_of_ms, rank::INTEGER AS rank, item_id, round(score, 6) AS score, 'ranked' AS source,
  (SELECT count(*) FROM cand c WHERE c.request_id = fixed.request_id) AS n_candidates
  FROM fixed JOIN req USING (request_id) WHERE rank < 10
UNION ALL
SELECT user_id, as_of_ms, rank::INTEGER, item_id, NULL, 'popular', 0 FROM req, pop
  WHERE rank < 10 AND request_id NOT IN (SELECT request_id FROM hist)"""


ORACLES = {
    "d15_vocabulary": with_(ORD, _VOCAB.format(n=25)) + "SELECT * FROM vocab",
    "d16_log_q": with_(ORD, _VOCAB.format(n=25))
    + """SELECT i.item_index, round(ln((count(e.item_index) + 1) / ((SELECT count(*) FROM ev) + (SELECT count(*) FROM vocab) + 2)::DOUBLE), 6) AS log_q
  FROM (SELECT item_index FROM vocab UNION ALL SELECT 0 UNION ALL SELECT 1) i
  LEFT JOIN (SELECT coalesce(item_index, 1) AS item_index FROM ev LEFT JOIN vocab USING (item_id)) e USING (item_index) GROUP BY 1""",
    "t19_encoded_histories": with_(*_BASE, _VOCAB.format(n=55))
    + f"""SELECT request_id, repeat('0,', (50 - count(*))::BIGINT) || string_agg(coalesce(item_index, 1), ',' ORDER BY back DESC) AS hist_index,
  repeat('0,', (50 - count(*))::BIGINT) || string_agg({_TYPE}, ',' ORDER BY back DESC) AS hist_type
  FROM hist LEFT JOIN vocab USING (item_id) GROUP BY 1""",
    "t20_encoded_events": with_(ORD, _VOCAB.format(n=25))
    + f"SELECT user_id, ts_ms, item_id, coalesce(item_index, 1) AS item_index, {_TYPE} AS type_index FROM ev LEFT JOIN vocab USING (item_id)",
    "f5_exact_top_k": f"SELECT query_id, item_id, rank, round(s, 6) AS score FROM ({_TOP.format(where='', k=10)})",
    "t22_flat_index": f"SELECT query_id, item_id, rank FROM ({_TOP.format(where='', k=25)})",
    "c13_best_match": "SELECT query_id, item_id, round(s, 6) AS score FROM ("
    + _TOP.format(where="WHERE q.label % 2 = 1 AND i.label % 2 = 0", k=1) + ")",
    "t21_quantised_index": "SELECT vec_id AS query_id, least(50, (SELECT count(*) FROM embeddings)) AS n_items,"
    " least(50, (SELECT count(*) FROM embeddings)) - 1 AS last_rank, true AS exact_and_ordered FROM embeddings",
    "t23_quantised_recall": "SELECT k::BIGINT AS k, true AS reached FROM (VALUES (500), (50)) t(k)",
    "t21_cell_index_all_probes": f"SELECT query_id, item_id, rank FROM ({_TOP.format(where='', k=10)})",
    "d21_full_probe_recall": "SELECT 1.0::DOUBLE AS recall FROM embeddings GROUP BY ALL HAVING count(*) > 0",
    "t18_user_vectors": with_(*_C)
    + "SELECT request_id, d - 1 AS d, round(x / n, 6) AS x FROM pooled JOIN lens USING (request_id)",
    "e8_recent_rank": with_(*_C) + "SELECT request_id, item_id, recent_rank::INTEGER AS recent_rank FROM recent",
    "e10_ann_rank": with_(*_C) + "SELECT request_id, item_id, ann_rank::INTEGER AS ann_rank FROM near",
    "c8_candidate_union": with_(*_C)
    + "SELECT request_id, item_id, ann_rank::INTEGER AS ann_rank, recent_rank::INTEGER AS recent_rank FROM cand",
    "c12_vector_lookup": with_(*_C)
    + "SELECT DISTINCT h.request_id, h.item_id, CASE WHEN h.item_id < 50 THEN round(s.s, 6) END AS ann_score"
    " FROM hist h LEFT JOIN sims s USING (request_id, item_id)",
    "t24_candidates": with_(*_C)
    + "SELECT request_id, item_id, ann_rank::INTEGER AS ann_rank, recent_rank::INTEGER AS recent_rank,"
    " round(ann_score, 6) AS ann_score FROM scored",
    "t25_user_item_features": with_(*_BASE, _UI) + "SELECT * FROM ui",
    "t26_ranker_table": with_(*_table(WIDE)) + "SELECT * FROM tab",
    "t27_labels": with_(*_C, _LABELS) + "SELECT * FROM lab",
    "c7_joined_attributes": with_(*_C)
    + "SELECT request_id, item_id, user_id, as_of_ms FROM cand JOIN req USING (request_id)",
    "d17_last_positions": with_(*_BASE, _UI) + "SELECT request_id, item_id, ui_last_pos, ui_is_last FROM ui",
    "d18_with_positives": with_(*_C, _LABELS)
    + "SELECT * FROM lab WHERE request_id IN (SELECT request_id FROM lab WHERE label = 1)",
    "d20_candidate_recall": with_(*_C)
    + "SELECT round(avg(r), 6) AS candidate_recall FROM (SELECT rrel.request_id, count(c.item_id) / count(*)::DOUBLE AS r"
    " FROM rrel LEFT JOIN cand c USING (request_id, item_id) GROUP BY 1)",
    "d22_request_volume": with_(*_C)
    + "SELECT round((SELECT count(*) FROM cand) / (SELECT count(*) FROM req)::DOUBLE, 6) AS candidates_per_request,"
    " round((SELECT count(*) FROM rrel) / (SELECT count(*) FROM req)::DOUBLE, 6) AS mean_relevant_per_request",
    "d26_group_sizes": with_(*_C) + "SELECT request_id, count(*) AS candidates FROM cand GROUP BY 1",
    "t29_request_split": with_(*_C)
    + "SELECT CASE WHEN request_id < floor(0.8 * (SELECT count(*) FROM req)) THEN 'fit' ELSE 'valid' END AS part,"
    " count(*) AS n, max(request_id) AS last_request FROM cand GROUP BY 1",
    "f3_rerank": with_(*_table(STANDARD), _FIXED)
    + "SELECT request_id, rank, item_id, round(score, 6) AS score FROM fixed WHERE rank < 10",
    "f4_rerank_one_each": with_(*_table(STANDARD), _FIXED)
    + "SELECT request_id, item_id, round(score, 6) AS score FROM fixed WHERE rank = 0",
    "t34_fixed_ranker_metrics": with_(
        *_table(STANDARD), _FIXED, "lists AS (SELECT * FROM fixed WHERE rank < 100)", _RNEW
    )
    + f"SELECT * FROM ({metrics_sql('lists', 'rrel', 'request_id')}),"
    f" ({metrics_sql('rnewrecs', 'rnewrel', 'request_id', prefix='new_')})",
    "t32_recommend": _serve(),
    "t28_pairwise_ranker": with_(*_C)
    + "SELECT request_id, least(10, count(*)) AS n_items, least(10, count(*)) - 1 AS last_rank, true AS ordered FROM cand GROUP BY 1",
    "t18_declared_vectors": with_(EV, SPLIT)
    + "SELECT DISTINCT user_id, 10::BIGINT AS n_items, true AS ordered, 64::INTEGER AS dim, true AS unit FROM ev, b WHERE ts_ms < test_start",
    "t32_latest": _serve("(SELECT max(ts_ms) + 1 FROM ev WHERE ts_ms < test_start)"),
    "t19_empty_histories": with_(*_BASE, _VOCAB.format(n=55))
    + f"""SELECT request_id, 50::BIGINT AS length, count(*) AS events, sum(coalesce(item_index, 1))::BIGINT AS index_sum
  FROM hist LEFT JOIN vocab USING (item_id) GROUP BY 1 UNION ALL SELECT -request_id - 1, 50, 0, 0 FROM req""",
}
