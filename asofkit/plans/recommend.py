"""Batch recommendation for many users at one or several moments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.definitions import ITEM_FEATURES, STANDARD
from asofkit.operators.order import dense_index
from asofkit.plans.features import history_events
from asofkit.plans.ranking import Ranker, build_list_features
from asofkit.plans.requests import RequestSet
from asofkit.plans.retrieval import Retriever, list_sizes
from asofkit.schema import ANN_K
from asofkit.session import checkpointed


def as_requests(users: DataFrame) -> DataFrame:
    """(request_id, user_id, as_of_ms) from (user_id, as_of_ms)."""
    return dense_index(
        users.select("user_id", "as_of_ms").distinct(), ["as_of_ms", "user_id"], "request_id"
    ).select("request_id", "user_id", "as_of_ms")


def latest_requests(users: DataFrame, watermark_ms: int | None) -> DataFrame:
    """(request_id, user_id, as_of_ms) one millisecond after the latest event: everything seen so far counts."""
    if watermark_ms is None:
        raise ValueError("no events yet: nothing to recommend from")
    return as_requests(users.select("user_id").withColumn("as_of_ms", F.lit(watermark_ms + 1).cast("long")))


class BatchRecommender:
    """Ranked lists from history, candidates, features and the ranker; popular items otherwise.

    ``user_events`` and ``item_events`` are the log or the retained tables of the online store.
    """

    def __init__(
        self,
        retriever: Retriever,
        ranker: Ranker,
        popular: Sequence[int],
        user_events: DataFrame,
        item_events: DataFrame | None = None,
        history_log: DataFrame | None = None,
    ) -> None:
        self.retriever, self.ranker, self.popular = retriever, ranker, list(popular)
        self.user_events = user_events
        self.item_events = user_events if item_events is None else item_events
        self.history_log = user_events if history_log is None else history_log
        # item windows the ranker never reads are not computed
        self.features = STANDARD.only_items([f for f in ITEM_FEATURES if f in ranker.features])

    def inputs(self, requests: DataFrame, k: int = ANN_K) -> tuple[DataFrame, DataFrame]:
        """(ranker rows, long history) of the requests."""
        frame, history, _ = self._prepared(requests, k)
        return frame, history

    def _prepared(self, requests: DataFrame, k: int = ANN_K) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(ranker rows, long history, lists of candidates): each candidate is one ranker row."""
        found = history_events(self.history_log, requests.select("user_id", "as_of_ms"))
        history = checkpointed(
            requests.join(found, ["user_id", "as_of_ms"]).select(
                "request_id", "as_of_ms", "end", "pos", "ts_ms", "item_id", "event"
            )
        )
        none = history.select("request_id", "item_id").limit(0)
        lists = checkpointed(self.retriever.candidate_lists(history, k))
        frame = build_list_features(
            lists,
            RequestSet(requests, history, none, none),
            self.user_events,
            self.features,
            item_events=self.item_events,
        )
        return frame, history, lists

    def recommend(self, requests: DataFrame, k: int = 10) -> DataFrame:
        """(user_id, as_of_ms, rank, item_id, score, source, n_candidates).

        ``requests`` without moments, (user_id) alone, are asked just after the latest event.
        """
        if "as_of_ms" not in requests.columns:
            requests = latest_requests(requests, self.user_events.agg(F.max("ts_ms")).first()[0])
        frame, history, lists = self._prepared(requests)
        sizes = list_sizes(lists)
        ranked = (
            self.ranker.rerank(frame, k)
            .join(requests, "request_id")
            .join(sizes, "request_id")
            .select(
                "user_id",
                "as_of_ms",
                F.col("rank").cast("int"),
                "item_id",
                F.round("score", 6).alias("score"),
                F.lit("ranked").alias("source"),
                "n_candidates",
            )
        )
        top = F.array(*[F.lit(i) for i in self.popular[:k]]).cast("array<bigint>")
        cold = requests.join(history.select("request_id").distinct(), "request_id", "left_anti")
        fallback = cold.select(
            "user_id",
            "as_of_ms",
            F.posexplode(top).alias("rank", "item_id"),
            F.lit(None).cast("double").alias("score"),
            F.lit("popular").alias("source"),
            F.lit(0).cast("long").alias("n_candidates"),
        )
        return ranked.unionByName(fallback)
