"""The evaluation runs: popularity window selection, baselines, and the ranking experiment."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.definitions import RANKER_FEATURES
from asofkit.plans.baselines import (
    Popularity,
    RecentThenPopular,
    popularity_by_window,
    recent_then_popular_at,
)
from asofkit.plans.evaluation import build_eval_set, evaluate
from asofkit.plans.ranking import (
    Ranker,
    RankerConfig,
    add_labels,
    build_features,
    compare_methods,
    prefer_lean,
    pruned_features,
    split_requests,
)
from asofkit.plans.requests import RequestSet, sample_requests
from asofkit.plans.retrieval import (
    CellIndex,
    FlatIndex,
    ItemVectors,
    Retriever,
    VectorConfig,
)
from asofkit.operators.timeline import as_history
from asofkit.plans.split import TimeSplit
from asofkit.schema import POPULARITY_WINDOWS
from asofkit.session import checkpointed


def popularity_window_scores(
    history: DataFrame,
    target: DataFrame,
    windows: Sequence[int | None] = POPULARITY_WINDOWS,
    k: int = 50,
) -> DataFrame:
    """(window_days, recall) of the popular list of each window; 0 stands for all history.

    One scan scores all windows, and the lists meet the relevant pairs in one join.
    """
    # at most k rows per window
    lists = popularity_by_window(history, windows, k).select("window_days", "item_id")
    relevant = build_eval_set(history, target).relevant
    size = relevant.groupBy("user_id").agg(F.count("*").alias("n_relevant"))
    hits = (
        relevant.join(F.broadcast(lists), "item_id")
        .groupBy("window_days", "user_id")
        .agg(F.count("*").alias("hits"))
    )
    found = (
        hits.join(size, "user_id")
        .groupBy("window_days")
        .agg(F.sum(F.col("hits") / F.col("n_relevant")).alias("total"))
    )
    users = size.count()
    spark = history.sparkSession
    tried = spark.createDataFrame([(w or 0,) for w in windows], "window_days int")
    return tried.join(F.broadcast(found), "window_days", "left").select(
        "window_days", (F.coalesce("total", F.lit(0.0)) / F.lit(users)).alias("recall")
    )


def select_popularity_window(
    history: DataFrame, target: DataFrame, windows: Sequence[int | None] = POPULARITY_WINDOWS
) -> int | None:
    """The window with the best recall; the first one wins ties."""
    recalls = {r.window_days: r.recall for r in popularity_window_scores(history, target, windows).collect()}
    best = max(windows, key=lambda w: recalls[w or 0])
    return best


def run_baselines(split: TimeSplit, window: int | None) -> DataFrame:
    """Validation and test metrics of both baselines."""
    rows = None
    for make in (Popularity, RecentThenPopular):
        for part, history, target in (
            ("val", split.train, split.val),
            ("test", split.train_val, split.test),
        ):
            model = make(window)
            row = evaluate(model, history, target).withColumns(
                {"model": F.lit(model.name), "part": F.lit(part)}
            )
            rows = row if rows is None else rows.unionByName(row)
    return rows


@dataclass(frozen=True)
class RankingResult:
    methods: DataFrame
    ranker: Ranker
    retriever: Retriever
    full_ndcg: float
    lean_ndcg: float
    importance: dict[str, float]


def featurize(retriever: Retriever, requests: RequestSet, events: DataFrame, k: int) -> DataFrame:
    candidates = checkpointed(retriever.candidates(requests.history, k))
    frame = build_features(candidates, requests, events)
    return checkpointed(add_labels(frame, requests.relevant))


def _materialised(requests: RequestSet) -> RequestSet:
    """Requests are read by many jobs; the sampled rows are written once."""
    return RequestSet(
        requests.frame,
        checkpointed(requests.history),
        checkpointed(requests.relevant),
        checkpointed(requests.seen),
    )


def run_ranking(
    split: TimeSplit,
    n_requests: int = 8000,
    seed: int = 42,
    vectors: VectorConfig | None = None,
    ranker_config: RankerConfig | None = None,
    ann_k: int = 500,
    cells: int = 64,
) -> RankingResult:
    """Train on requests of the validation window, compare all methods on the test window."""
    events = split.events
    model_a, model_b = ItemVectors(vectors), ItemVectors(vectors)
    model_a.fit(split.train)
    model_b.fit(split.train_val)
    fit_requests = _materialised(
        sample_requests(events, split.val_start_ms, split.test_start_ms, n_requests, seed)
    )
    test_requests = _materialised(
        sample_requests(events, split.test_start_ms, split.end_ms, n_requests, seed + 1)
    )
    retriever_a = Retriever(model_a, CellIndex(model_a.targets, cells))
    retriever_b = Retriever(model_b, CellIndex(model_b.targets, cells))
    fit_frame = featurize(retriever_a, fit_requests, events, ann_k)
    test_frame = featurize(retriever_b, test_requests, events, ann_k)

    train, valid = split_requests(fit_frame, fit_requests.frame.count())
    full = Ranker(ranker_config, RANKER_FEATURES)
    full_ndcg = full.fit(train, valid).first()["valid_ndcg_at_10"] or 0.0
    importance = full.importance()
    lean = Ranker(ranker_config, pruned_features(importance))
    lean_ndcg = lean.fit(train, valid).first()["valid_ndcg_at_10"] or 0.0
    chosen = lean if prefer_lean(full_ndcg, lean_ndcg) else full

    popular = Popularity(14)
    popular.fit(split.train_val)
    keys = test_requests.frame.select("request_id")
    histories = as_history(test_requests.history, ["request_id"])
    as_users = keys.withColumnRenamed("request_id", "user_id")
    vecs = checkpointed(retriever_b.request_vectors(test_requests.history))
    exact = Retriever(model_b, FlatIndex(model_b.targets))

    def nearest(retriever: Retriever) -> DataFrame:
        return retriever.nearest(vecs, 100).withColumnRenamed("ann_rank", "rank")

    methods = compare_methods(
        {
            "popularity_14d": popular.recommend(as_users, 100).withColumnRenamed(
                "user_id", "request_id"
            ),
            "recent_then_popular": recent_then_popular_at(
                histories, "request_id", popular.items, 100
            ),
            "vectors_exact": nearest(exact),
            "vectors_cells": nearest(retriever_b),
            f"reranked_{len(full.features)}": full.rerank(test_frame, 100),
            f"reranked_lean_{len(lean.features)}": lean.rerank(test_frame, 100),
        },
        test_requests.eval_set(),
    )
    return RankingResult(methods, chosen, retriever_b, full_ndcg, lean_ndcg, importance)
