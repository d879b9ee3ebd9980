"""Offline evaluation in long form: (user_id, rank, item_id) against (user_id, item_id).

``key`` may be a user or a request column; lists are never gathered per user.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import log2
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.functions.columns import rank_discount
from asofkit.schema import EVAL_KS, SEEN_HEADROOM
from asofkit.session import checkpointed


class Recommender(Protocol):
    """Anything that can be fitted on a history and asked for ranked lists."""

    name: str

    def fit(self, history: DataFrame) -> None: ...

    def recommend(self, users: DataFrame, k: int) -> DataFrame:
        """(user_id, rank, item_id) with rank from 0."""


@dataclass(frozen=True)
class EvalSet:
    """Distinct relevant and already-seen (key, item_id) pairs of the scored keys."""

    relevant: DataFrame
    seen: DataFrame
    key: str = "user_id"

    @property
    def users(self) -> DataFrame:
        return self.relevant.select(self.key).distinct()


def build_eval_set(history: DataFrame, target: DataFrame) -> EvalSet:
    """Warm users only: those with an event in ``history``."""
    warm = history.select("user_id").distinct()
    relevant = target.select("user_id", "item_id").distinct().join(warm, "user_id", "left_semi")
    seen = (
        history.select("user_id", "item_id")
        .distinct()
        .join(relevant.select("user_id").distinct(), "user_id", "left_semi")
    )
    return EvalSet(relevant, seen)


def eval_counts(history: DataFrame, target: DataFrame) -> DataFrame:
    """Scored users, users with something new to find, and skipped cold users, in one row."""
    target_pairs = target.select("user_id", "item_id").distinct()
    past_pairs = history.select("user_id", "item_id").distinct().withColumn("_seen", F.lit(1))
    past_users = history.select("user_id").distinct().withColumn("_warm", F.lit(1))
    per_user = (
        target_pairs.join(past_pairs, ["user_id", "item_id"], "left")
        .groupBy("user_id")
        .agg(F.count_if(F.col("_seen").isNull()).alias("_new"))
        .join(past_users, "user_id", "left")
    )
    warm = F.col("_warm").isNotNull()
    return per_user.agg(
        F.count_if(warm).alias("eval_users"),
        F.count_if(warm & (F.col("_new") > 0)).alias("new_eval_users"),
        F.count_if(~warm).alias("cold_users_skipped"),
    )


def novel_view(recs: DataFrame, eval_set: EvalSet) -> tuple[DataFrame, EvalSet]:
    """Without already-seen items on either side; ranks close up, order is kept."""
    key = eval_set.key
    relevant = eval_set.relevant.join(eval_set.seen, [key, "item_id"], "left_anti")
    unseen = recs.join(eval_set.seen, [key, "item_id"], "left_anti").join(
        relevant.select(key).distinct(), key, "left_semi"
    )
    rank = F.row_number().over(Window.partitionBy(key).orderBy("rank")) - 1
    packed = unseen.withColumn("rank", rank.cast("long"))
    return packed, EvalSet(relevant, eval_set.seen, key)


def _ideal_dcg(n_relevant: Column, k: int) -> Column:
    prefix, total = [], 0.0
    for rank in range(k):
        total += 1.0 / log2(rank + 2)
        prefix.append(total)
    return F.element_at(
        F.array(*[F.lit(x) for x in prefix]), F.least(n_relevant, F.lit(k)).cast("int")
    )


def per_user_metrics(
    recs: DataFrame, eval_set: EvalSet, ks: Sequence[int] = EVAL_KS
) -> DataFrame:
    """One row per key: recall and NDCG at each k, MRR at the largest. No hit scores 0."""
    if min(ks) <= 0:
        raise ValueError("k must be positive")
    key, kmax = eval_set.key, max(ks)
    shown = recs.where(F.col("rank") < kmax).select(key, "item_id", "rank")
    # an item listed twice counts at each place, as in a list scan
    hits = eval_set.relevant.join(shown, [key, "item_id"], "left")
    rank = F.col("rank")
    cols = []
    for k in ks:
        inside = rank < k
        cols += [
            F.count_if(inside).alias(f"_hits_{k}"),
            F.sum(F.when(inside, rank_discount(rank))).alias(f"_dcg_{k}"),
        ]
    per_key = hits.groupBy(key).agg(
        F.count_distinct("item_id").alias("n_relevant"),
        *cols,
        F.min("rank").alias("_first"),
    )
    metrics = []
    for k in ks:
        metrics += [
            (F.col(f"_hits_{k}") / F.col("n_relevant")).alias(f"recall_at_{k}"),
            (
                F.coalesce(F.col(f"_dcg_{k}"), F.lit(0.0)) / _ideal_dcg(F.col("n_relevant"), k)
            ).alias(f"ndcg_at_{k}"),
        ]
    mrr = F.coalesce(F.lit(1.0) / (F.col("_first") + 1), F.lit(0.0)).alias(f"mrr_at_{kmax}")
    return per_key.select(key, *metrics, mrr)


def score(
    recs: DataFrame, eval_set: EvalSet, ks: Sequence[int] = EVAL_KS, prefix: str = "", complete: bool = False
) -> DataFrame:
    """Mean metrics over all keys of the eval set, in one row (null for an empty set).

    A key without rows has an empty list and scores 0, unless ``complete`` asks for one list per key.
    """
    if complete:
        check_complete(recs, eval_set)
    per_key = per_user_metrics(recs, eval_set, ks)
    names = [c for c in per_key.columns if c != eval_set.key]
    return per_key.agg(*[F.avg(c).alias(prefix + c) for c in names])


def check_complete(recs: DataFrame, eval_set: EvalSet) -> None:
    """Every key of the eval set has a list, and no other key has one."""
    listed = recs.select(eval_set.key).distinct().withColumn("_listed", F.lit(1))
    both = eval_set.users.select(eval_set.key).withColumn("_asked", F.lit(1)).join(listed, eval_set.key, "full")
    missing, surplus = both.agg(F.count_if(F.col("_listed").isNull()), F.count_if(F.col("_asked").isNull())).first()
    if missing or surplus:
        raise ValueError(f"need one list per key of the eval set: {missing} are missing, {surplus} are of other keys")


def score_with_novel(
    recs: DataFrame, eval_set: EvalSet, ks: Sequence[int] = EVAL_KS
) -> DataFrame:
    """All metrics plus their ``new_`` versions on unseen items, in one row."""
    new_recs, new_set = novel_view(recs, eval_set)
    both = score(recs, eval_set, ks).unionByName(
        score(new_recs, new_set, ks, "new_"), allowMissingColumns=True
    )
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def evaluate(
    model: Recommender,
    history: DataFrame,
    target: DataFrame,
    ks: Sequence[int] = EVAL_KS,
    fit: bool = True,
    headroom: int = SEEN_HEADROOM,
) -> DataFrame:
    """Fit, recommend ``max(ks) + headroom`` items per warm user, and score."""
    if fit:
        model.fit(history)
    eval_set = build_eval_set(history, target)
    recs = checkpointed(model.recommend(eval_set.users, max(ks) + headroom))
    check_complete(recs, eval_set)
    parts = score_with_novel(recs, eval_set, ks).unionByName(
        eval_counts(history, target), allowMissingColumns=True
    )
    return parts.agg(*[F.max(c).alias(c) for c in parts.columns])


def list_recall(approx: DataFrame, exact: DataFrame, key: str) -> DataFrame:
    """Mean share of each exact list found in the approximate one."""
    found = approx.select(key, "item_id").distinct().withColumn("_found", F.lit(1))
    return (
        exact.select(key, "item_id")
        .distinct()
        .join(found, [key, "item_id"], "left")
        .groupBy(key)
        .agg((F.count("_found") / F.count("*")).alias("_recall"))
        .agg(F.avg("_recall").alias("recall"))
    )


def packed_recall(approx: DataFrame, exact: DataFrame, key: str, ks: Sequence[int]) -> DataFrame:
    """(k, recall): ``list_recall`` of the first ``k`` of ``items``, best first, in rows that are unique per ``key``."""
    both = exact.where(F.size("items") > 0).select(key, F.col("items").alias("_e")).join(
        approx.select(key, F.col("items").alias("_a")), key, "left"
    )

    def share(k: int):
        best = F.array_distinct(F.slice("_e", 1, k))
        return F.coalesce(F.size(F.array_intersect(best, F.slice("_a", 1, k))) / F.size(best), F.lit(0.0))

    # a row per query, then one per k; a missing list has size NULL under ANSI rules and -1 otherwise
    shares = both.select(*[F.when(F.col("_a").isNull(), 0.0).otherwise(share(k)).alias(f"_{n}") for n, k in enumerate(ks)])
    means = shares.agg(*[F.avg(f"_{n}").alias(f"_{n}") for n in range(len(ks))])
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_{n}").alias("recall")) for n, k in enumerate(ks)])
    return means.select(F.inline(each))


def mean_std(runs: DataFrame, by: str, metric: str) -> DataFrame:
    """Mean and sample deviation over runs; a single run has deviation 0."""
    return runs.groupBy(by).agg(
        F.avg(metric).alias("mean"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("std")
    )
