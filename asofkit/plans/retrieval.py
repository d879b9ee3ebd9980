"""Item and user vectors, approximate and exact retrieval, candidate generation."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.functions.columns import dot, event_weight, l2_normalised
from asofkit.operators.order import dense_index, look_up, top_per_group
from asofkit.operators.skew import HOT_ROWS
from asofkit.operators.timeline import as_history, preceding_arrays, preceding_events, ranked_positions
from asofkit.operators.topk import BLOCK_ROWS, block_top_k, exact_lists, exact_top_k, folded
from asofkit.plans.baselines import Popularity, ranked_lists
from asofkit.plans.evaluation import packed_recall
from asofkit.plans.features import history_events
from asofkit.schema import (
    ANN_K,
    EVENT_TYPES,
    FIRST_ITEM_INDEX,
    HISTORY_LEN,
    N_RECENT,
    OOV_INDEX,
    PAD_INDEX,
)
from asofkit.session import checkpointed

TYPE_INDEX = {event: i + 1 for i, event in enumerate(EVENT_TYPES)}


# --- vocabulary and training sequences -------------------------------------------------------


def item_vocab(events: DataFrame, min_count: int = 2) -> DataFrame:
    """(item_id, item_index): items with enough events, ids ascending, indexed from 2."""
    frequent = (
        events.groupBy("item_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= min_count)
    )
    return dense_index(frequent.select("item_id"), ["item_id"], "item_index", FIRST_ITEM_INDEX)


def type_index(column: str = "event"):
    pairs = [F.lit(x) for pair in TYPE_INDEX.items() for x in pair]
    return F.create_map(*pairs)[F.col(column)]


def encoded(rows: DataFrame, vocab: DataFrame) -> DataFrame:
    """Add ``item_index`` (1 for items outside the vocabulary) and ``type_index``."""
    return rows.join(vocab, "item_id", "left").withColumns(
        {
            "item_index": F.coalesce("item_index", F.lit(OOV_INDEX).cast("long")),
            "type_index": type_index(),
        }
    )


def encoded_histories(
    history: DataFrame, vocab: DataFrame, key: str, length: int = HISTORY_LEN, keys: DataFrame | None = None
) -> DataFrame:
    """Right-aligned, zero-padded index arrays per ``key`` from long history rows.

    ``keys`` of which some have no history get rows of padding alone.
    """
    ordered = F.array_sort(F.collect_list(F.struct("pos", "item_index", "type_index")))
    packed = encoded(history, vocab).groupBy(key).agg(ordered.alias("h"))
    if keys is not None:
        packed = keys.select(key).distinct().join(packed, key, "left")

    def padded(field: str):
        values = F.col(f"h.{field}").cast("array<bigint>")
        known = F.coalesce(F.size("h"), F.lit(0))
        padding = F.array_repeat(F.lit(PAD_INDEX).cast("long"), F.lit(length) - F.when(known < 0, 0).otherwise(known))
        return F.concat(padding, F.coalesce(values, F.array().cast("array<bigint>")))

    return packed.select(
        key, padded("item_index").alias("hist_index"), padded("type_index").alias("hist_type")
    )


def log_q(events: DataFrame, vocab: DataFrame) -> DataFrame:
    """Smoothed log frequency per index, padding and out-of-vocabulary included."""
    counts = encoded(events.select("item_id", "event"), vocab).groupBy("item_index").agg(
        F.count("*").alias("n")
    )
    spark = events.sparkSession
    special = spark.range(PAD_INDEX, FIRST_ITEM_INDEX).withColumnRenamed("id", "item_index")
    index = vocab.select("item_index").unionByName(special)
    total = events.count() + vocab.count() + FIRST_ITEM_INDEX
    return index.join(counts, "item_index", "left").select(
        "item_index", F.log((F.coalesce("n", F.lit(0)) + 1) / F.lit(float(total))).alias("log_q")
    )


def training_pairs(
    events: DataFrame,
    vocab: DataFrame,
    length: int = HISTORY_LEN,
    strict: bool = True,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """``training_histories`` in long form: (user_id, target_pos, target_item, end, pos, ts_ms, item_id, event)."""
    found = training_histories(events, vocab, length, strict, hot_rows)
    return found.select(*[c for c in found.columns if c != "hist"], F.inline("hist"))


def training_histories(
    events: DataFrame,
    vocab: DataFrame,
    length: int = HISTORY_LEN,
    strict: bool = True,
    hot_rows: int | None = HOT_ROWS,
) -> DataFrame:
    """One row per target with its packed history: (user_id, target_pos, target_item, end, hist).

    A target is an in-vocabulary event with an earlier event. ``strict`` leaves events of the same
    millisecond out of the history; otherwise every earlier row counts. Events are folded into blocks once, and a history is cut from
    at most two of them, so nothing is copied per event but the array itself.
    """
    placed = checkpointed(ranked_positions(events, hot_rows))
    end = F.col("n_before") if strict else F.col("pos") - 1
    targets = placed.join(vocab.select("item_id"), "item_id", "left_semi").select(
        "user_id",
        end.alias("end"),
        F.col("pos").alias("target_pos"),
        F.col("item_id").alias("target_item"),
    )
    return preceding_arrays(placed, targets, ["target_pos", "target_item"], length)


def last_positions(events: DataFrame) -> DataFrame:
    """Number of events per user: the end of the history used at inference time."""
    return events.groupBy("user_id").agg(F.count("*").alias("end"))


# --- vector model ----------------------------------------------------------------------------


@dataclass(frozen=True)
class VectorConfig:
    dim: int = 64
    iterations: int = 10
    span: int = 5
    min_item_count: int = 2
    regularisation: float = 0.05
    alpha: float = 10.0
    recency: float = 0.9
    correction: float = 0.25
    seed: int = 42


FitCallback = Callable[[VectorConfig, "ItemVectors"], float]


class ItemVectors:
    """Two sets of item vectors learned from "touched i, then touched j" counts.

    A user is the weighted mean of the *context* vectors of the last events, so users that were not
    in the training data are served too; items are ranked by their *target* vectors.
    """

    name = "item_vectors"

    def __init__(self, config: VectorConfig | None = None) -> None:
        self.config = config or VectorConfig()
        self.targets: DataFrame | None = None
        self.contexts: DataFrame | None = None
        self.history: DataFrame | None = None
        self.popular: list[int] = []

    def fit(self, history: DataFrame) -> None:
        cfg = self.config
        self.history = history
        ranked = Popularity()
        ranked.fit(history)
        self.popular = ranked.items
        vocab = checkpointed(item_vocab(history, cfg.min_item_count))
        als = ALS(
            rank=cfg.dim,
            maxIter=cfg.iterations,
            regParam=cfg.regularisation,
            alpha=cfg.alpha,
            implicitPrefs=True,
            userCol="context",
            itemCol="target",
            ratingCol="weight",
            seed=cfg.seed,
            checkpointInterval=5,
        )
        model = als.fit(checkpointed(self.corrected(self.transitions(history, vocab), history, vocab)))

        def by_item(factors: DataFrame) -> DataFrame:
            ids = factors.select(F.col("id").cast("long").alias("item_index"), "features")
            return ids.join(vocab, "item_index").select("item_id", "features")

        self.targets = checkpointed(
            by_item(model.itemFactors).select(
                "item_id", l2_normalised(F.col("features")).alias("vec")
            )
        )
        self.contexts = checkpointed(by_item(model.userFactors))

    def corrected(self, pairs: DataFrame, history: DataFrame, vocab: DataFrame) -> DataFrame:
        """Weights divided by the target's frequency to the power ``correction``, 1 for the most frequent item.

        Popular items follow everything; without this their counts drown what follows a particular item.
        """
        frequency = log_q(history, vocab).join(vocab, "item_index")  # without the special indexes
        top = frequency.agg(F.max("log_q")).first()[0]
        if top is None or not self.config.correction:
            return pairs
        factor = F.exp(F.lit(self.config.correction) * (F.lit(top) - F.col("log_q")))
        return pairs.join(frequency.select(F.col("item_index").cast("int").alias("target"), factor.alias("_f")), "target").select(
            "context", "target", (F.col("weight") * F.col("_f")).alias("weight")
        )

    def transitions(self, history: DataFrame, vocab: DataFrame) -> DataFrame:
        """(context, target, weight): how often an item follows another within ``span`` events.

        Each event looks back ``span`` positions; the join key (user_id, pos) is unique.
        """
        placed = checkpointed(
            ranked_positions(history)
            .join(vocab, "item_id")
            .select("user_id", "pos", F.col("item_index").cast("int").alias("item_index"), "event")
        )
        back = F.sequence(F.greatest(F.col("pos") - self.config.span, F.lit(1)), F.col("pos") - 1)
        looking_back = placed.where(F.col("pos") > 1).select(
            "user_id",
            F.explode(back).alias("pos"),
            F.col("item_index").alias("target"),
            event_weight().alias("_w"),
        )
        context = placed.select("user_id", "pos", F.col("item_index").alias("context"))
        return (
            looking_back.join(context, ["user_id", "pos"])
            .where(F.col("context") != F.col("target"))
            .groupBy("context", "target")
            .agg(F.sum("_w").alias("weight"))
        )

    def user_vectors(self, history: DataFrame, key: str) -> DataFrame:
        """(key, vec) from long history rows (key, end, pos, item_id, event)."""
        weight = event_weight() * F.pow(F.lit(self.config.recency), F.col("end") - F.col("pos"))
        weighted = history.select(key, "item_id", weight.alias("_w")).join(self.contexts, "item_id")
        sums = [F.sum(F.col("_w") * F.col("features")[i]) for i in range(self.config.dim)]
        pooled = weighted.groupBy(key).agg(F.array(*sums).alias("vec"))
        return pooled.select(key, l2_normalised(F.col("vec")).alias("vec"))

    def recommend(self, users: DataFrame, k: int) -> DataFrame:
        """Lists by vector; users without a known item in their history get the popular one, without scores."""
        placed = ranked_positions(self.history.join(users, "user_id", "left_semi"))
        ends = last_positions(self.history).join(users, "user_id", "left_semi")
        recent = preceding_events(placed, ends, ["user_id"])
        queries = checkpointed(self.user_vectors(recent, "user_id").withColumnRenamed("user_id", "query_id"))
        own = exact_top_k(queries, self.targets, k).select(
            F.col("query_id").alias("user_id"), "rank", "item_id", "score"
        )
        known = queries.select(F.col("query_id").alias("user_id"))
        others = users.select("user_id").distinct().join(known, "user_id", "left_anti")
        listed = ranked_lists(others, "user_id", self.popular[:k])
        return own.unionByName(listed.withColumn("score", F.lit(None).cast("double")))

    def save(self, path: str) -> None:
        """All that ``load`` needs: both sets of vectors, each user's last events, popular items, settings."""
        latest = [F.desc("ts_ms"), F.desc("item_id"), F.desc("event"), F.desc("transaction_id")]
        ends = top_per_group(self.history, ["user_id"], latest, HISTORY_LEN, "_r").drop("_r")
        ends.write.mode("overwrite").parquet(f"{path}/history")
        self.targets.write.mode("overwrite").parquet(f"{path}/targets")
        self.contexts.write.mode("overwrite").parquet(f"{path}/contexts")
        settings = json.dumps(asdict(self.config))
        row = self.targets.sparkSession.createDataFrame([(settings, self.popular)], "settings string, popular array<long>")
        row.write.mode("overwrite").parquet(f"{path}/model")

    @classmethod
    def load(cls, spark, path: str) -> ItemVectors:
        row = spark.read.parquet(f"{path}/model").first()
        model = cls(VectorConfig(**json.loads(row.settings)))
        model.popular = list(row.popular)
        model.history, model.targets, model.contexts = (
            spark.read.parquet(f"{path}/{name}") for name in ("history", "targets", "contexts")
        )
        return model


def fit_best(
    history: DataFrame, configs: list[VectorConfig], on_fit: FitCallback, patience: int = 2
) -> ItemVectors:
    """Fit configurations in order, keep the best score, stop after ``patience`` worse ones."""
    best, best_score, worse = None, float("-inf"), 0
    for config in configs:
        model = ItemVectors(config)
        model.fit(history)
        score = on_fit(config, model)
        if score > best_score:
            best, best_score, worse = model, score, 0
        else:
            worse += 1
            if worse >= patience:
                break
    return best


# --- indexes ---------------------------------------------------------------------------------


class CellIndex:
    """Approximate top-k: items live in k-means cells and a query scans its nearest cells."""

    def __init__(
        self, items: DataFrame, cells: int = 64, probes: int = 16, seed: int = 42
    ) -> None:
        self.probes = min(probes, cells)
        assigned = items.select("item_id", "vec", array_to_vector("vec").alias("features"))
        model = KMeans(k=cells, seed=seed, featuresCol="features", predictionCol="cell").fit(assigned)
        # `cells` centres, a parameter; never grows with the data
        self.centres = np.stack(model.clusterCenters())
        self.items = checkpointed(model.transform(assigned).select("item_id", "cell", "vec"))

    def _nearest(self, queries: DataFrame) -> DataFrame:
        """(query_id, cells, vec): the nearest cells of every query."""
        centres, probes = self.centres, min(self.probes, len(self.centres))
        norms = (centres**2).sum(axis=1)

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if len(batch) == 0:
                    continue
                vecs = np.stack(batch["vec"].to_numpy()).astype(np.float64)
                distance = norms[None, :] - 2.0 * vecs @ centres.T
                near = np.argsort(distance, axis=1, kind="stable")[:, :probes]
                yield pd.DataFrame({"query_id": batch["query_id"], "cells": list(near), "vec": batch["vec"]})

        kind = queries.schema["vec"].dataType.simpleString()
        return queries.select("query_id", "vec").mapInPandas(run, f"query_id long, cells array<long>, vec {kind}")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return block_top_k(self._nearest(queries), self.items, k)

    def lists(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, items, scores): a row per query, best first."""
        return folded(self.search(queries, k))


class FlatIndex:
    """Exact top-k with the same interface."""

    def __init__(self, items: DataFrame, block_rows: int = BLOCK_ROWS) -> None:
        self.items, self.block_rows = items, block_rows

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        return exact_top_k(queries, self.items, k, self.block_rows)

    def lists(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, items, scores): a row per query, best first."""
        return exact_lists(queries, self.items, k, self.block_rows)


def index_quality(
    approx: CellIndex, exact: FlatIndex, queries: DataFrame, ks: tuple[int, ...] = (500, 50)
) -> DataFrame:
    """Recall of the approximate index against the exact one: (k, recall). Lists are searched once and joined as a row per query."""
    found, truth = approx.lists(queries, max(ks)), exact.lists(queries, max(ks))
    return packed_recall(found, truth, "query_id", ks)


# --- candidates ------------------------------------------------------------------------------


def recent_candidates(history: DataFrame, n_recent: int = N_RECENT) -> DataFrame:
    """(request_id, item_id, recent_rank): distinct history items, latest first."""
    last = history.groupBy("request_id", "item_id").agg(F.max("pos").alias("_last"))
    ranked = top_per_group(last, ["request_id"], [F.desc("_last")], n_recent, "recent_rank")
    return ranked.select("request_id", "item_id", F.col("recent_rank").cast("int"))


def merge_candidates(nearest: DataFrame, recent: DataFrame) -> DataFrame:
    """Full outer union of both sources; a rank is null where its source lacks the item."""
    return nearest.join(recent, ["request_id", "item_id"], "full")


def with_pair_scores(pairs: DataFrame, user_vecs: DataFrame, item_vecs: DataFrame) -> DataFrame:
    """Add ``ann_score`` of each (request_id, item_id); null for items without a vector."""
    return (
        pairs.join(item_vecs.select("item_id", F.col("vec").alias("_iv")), "item_id", "left")
        .join(user_vecs.select("request_id", F.col("vec").alias("_uv")), "request_id", "left")
        .withColumn("ann_score", dot(F.col("_uv"), F.col("_iv")))
        .drop("_iv", "_uv")
    )


class Retriever:
    def __init__(self, model: ItemVectors, index: CellIndex | FlatIndex | None = None) -> None:
        self.model = model
        self.index = index or FlatIndex(model.targets)

    def request_vectors(self, history: DataFrame) -> DataFrame:
        return self.model.user_vectors(history, "request_id")

    def nearest(self, user_vecs: DataFrame, k: int = ANN_K, scores: bool = False) -> DataFrame:
        """(request_id, item_id, ann_rank), and ``ann_score`` if asked for."""
        queries = user_vecs.withColumnRenamed("request_id", "query_id")
        return (
            self.index.search(queries, k)
            .where(F.col("item_id") >= 0)
            .select(
                F.col("query_id").alias("request_id"),
                "item_id",
                F.col("rank").cast("int").alias("ann_rank"),
                *([F.col("score").alias("ann_score")] if scores else []),
            )
        )

    def candidates(
        self, history: DataFrame, k: int = ANN_K, n_recent: int = N_RECENT
    ) -> DataFrame:
        """(request_id, item_id, ann_rank, recent_rank, ann_score) from long history rows."""
        user_vecs, recent = checkpointed(self.request_vectors(history)), recent_candidates(history, n_recent)
        near = look_up(self.nearest(user_vecs, k, scores=True), recent, "request_id", "item_id", ["recent_rank"])
        near = checkpointed(near.select("request_id", "item_id", "ann_rank", "recent_rank", "ann_score"))
        # the search has scored what it found; only recent items beyond it, few per request, need their vectors
        both = near.where(F.col("recent_rank").isNotNull()).select("request_id", "item_id")
        others = recent.join(both, ["request_id", "item_id"], "left_anti").withColumn("ann_rank", F.lit(None).cast("int"))
        return near.unionByName(with_pair_scores(others, user_vecs, self.model.targets).select(near.columns))

    def candidate_lists(self, history: DataFrame, k: int = ANN_K, n_recent: int = N_RECENT) -> DataFrame:
        """``candidates`` in a row per request: (request_id, items, scores, n_near, recent).

        The first ``n_near`` items were found by the search, in its order; ``recent`` maps items to their recent ranks.
        """
        user_vecs, recent = checkpointed(self.request_vectors(history)), recent_candidates(history, n_recent)
        ranks = F.collect_list(F.struct("item_id", "recent_rank"))
        near = self.index.lists(user_vecs.withColumnRenamed("request_id", "query_id"), k).withColumnRenamed("query_id", "request_id")
        both = checkpointed(
            recent.groupBy("request_id").agg(ranks.alias("_recent")).join(near, "request_id", "full").withColumns(
                {
                    "_recent": F.coalesce("_recent", F.array().cast("array<struct<item_id:bigint,recent_rank:int>>")),
                    "items": F.coalesce("items", F.array().cast("array<bigint>")),
                    "scores": F.coalesce("scores", F.array().cast("array<double>")),
                }
            )
        )
        # the search has scored what it found; only recent items beyond it, few per request, need their vectors
        own = F.col("_recent.item_id")
        beyond = F.array_union(F.array_except(own, "items"), F.filter(own, lambda x: x < 0))
        others = with_pair_scores(both.select("request_id", F.explode(beyond).alias("item_id")), user_vecs, self.model.targets)
        folded_others = others.groupBy("request_id").agg(F.collect_list(F.struct("item_id", "ann_score")).alias("_others"))

        def joined(found: str, other: str, kind: str):
            return F.concat(found, F.coalesce(F.col(f"_others.{other}"), F.array().cast(kind)))

        known = F.filter("_recent", lambda r: r["item_id"].isNotNull())
        return both.join(folded_others, "request_id", "left").select(
            "request_id",
            joined("items", "item_id", "array<bigint>").alias("items"),
            joined("scores", "ann_score", "array<double>").alias("scores"),
            F.size("items").alias("n_near"),
            F.map_from_entries(known).alias("recent"),
        )


def list_sizes(lists: DataFrame) -> DataFrame:
    """(request_id, n_candidates) of ``candidate_lists``."""
    unknown = F.size(F.filter(F.slice("items", 1, F.col("n_near")), lambda x: x < 0))
    return lists.select("request_id", (F.size("items") - unknown).cast("long").alias("n_candidates"))


def list_rows(lists: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(*keep, request_id, item_id, ann_rank, recent_rank, ann_score): the rows of ``candidate_lists``."""
    each = lists.select(*keep, "request_id", "n_near", "recent", F.posexplode(F.arrays_zip("items", "scores")).alias("_at", "_of"))
    found = F.col("_at") < F.col("n_near")
    return each.where(~found | (F.col("_of.items") >= 0)).select(
        *keep,
        "request_id",
        F.col("_of.items").alias("item_id"),
        F.when(found, F.col("_at")).alias("ann_rank"),
        F.col("recent")[F.col("_of.items")].alias("recent_rank"),
        F.col("_of.scores").alias("ann_score"),
    )


def histories_at(events: DataFrame, queries: DataFrame) -> DataFrame:
    """Array form of the histories for display; the jobs use the long form."""
    keys = ["user_id", "as_of_ms"]
    return as_history(history_events(events, queries), keys)
