"""Comparison of online and offline values for every entity at several moments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.plans.features import item_features, user_features, user_histories
from asofkit.schema import CHECK_OFFSETS_MS
from asofkit.streaming.store import OnlineStore


def _long(df: DataFrame, key: str, names: Sequence[str], value: str) -> DataFrame:
    text = df.select(
        F.col(key).alias("entity_id"),
        "as_of_ms",
        *[F.to_json(n).alias(n) if n.startswith("hist") else F.col(n).cast("string") for n in names],
    )
    return text.unpivot(["entity_id", "as_of_ms"], list(names), "feature", value)


def differences(
    online: DataFrame, offline: DataFrame, key: str, names: Sequence[str]
) -> DataFrame:
    """One row per compared value: (entity_id, as_of_ms, feature, online, offline, same)."""
    on, off = _long(online, key, names, "online"), _long(offline, key, names, "offline")
    ids = ["entity_id", "as_of_ms", "feature"]
    return on.join(off, ids, "full").withColumn("same", F.col("online").eqNullSafe(F.col("offline")))


def report(diffs: DataFrame) -> DataFrame:
    return diffs.agg(
        F.count("*").alias("values_compared"), F.count_if(~F.col("same")).alias("mismatches")
    )


def examples(diffs: DataFrame, n: int = 10) -> DataFrame:
    return diffs.where(~F.col("same")).orderBy("as_of_ms", "feature", "entity_id").limit(n)


def moments(ids: DataFrame, times: Sequence[int]) -> DataFrame:
    """Every id at each of a few moments."""
    listed = F.array(*[F.lit(t).cast("long") for t in times])
    return ids.select("*", F.explode(listed).alias("as_of_ms"))


def compare_store(
    store: OnlineStore, events: DataFrame, offsets: Sequence[int] = CHECK_OFFSETS_MS
) -> DataFrame:
    """All values of all entities at ``watermark + offset``; the stream must be complete."""
    end = store.watermark()
    expected = events.agg(F.max("ts_ms")).first()[0]
    if end != expected:
        raise RuntimeError(f"stream incomplete: watermark {end} != {expected}")
    times = [end + offset for offset in offsets]
    users = moments(events.select("user_id").distinct(), times)
    items = moments(events.select("item_id").distinct(), times)
    spec, hot = store.features, store.hot_rows
    history = ("hist_ts", "hist_items", "hist_events")
    return (
        differences(
            store.user_features(users),
            user_features(events, users, spec, hot),
            "user_id",
            spec.user_features,
        )
        .unionByName(
            differences(
                store.item_features(items),
                item_features(events, items, spec, hot),
                "item_id",
                spec.item_features,
            )
        )
        .unionByName(
            differences(
                store.user_histories(users),
                user_histories(events, users, hot_rows=hot),
                "user_id",
                history,
            )
        )
    )
