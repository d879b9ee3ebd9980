"""Dataset summaries. Each is a small aggregated frame; nothing row-level reaches the driver."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.functions.columns import clipped, event_date
from asofkit.operators.order import dense_index, exact_quantiles
from asofkit.schema import DAY_MS, EVENT_TYPES


def _one_row(parts: list[DataFrame]) -> DataFrame:
    """Put single-row frames side by side without joining them."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def _pairs(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", "item_id").agg(F.count("*").alias("n"))


def events_per(events: DataFrame, key: str) -> DataFrame:
    return events.groupBy(key).agg(F.count("*").alias("n"))


def _type_count(event: str) -> Column:
    return F.count_if(F.col("event") == event)


def event_counts(events: DataFrame) -> DataFrame:
    """Row count and rows by type; a type without rows counts 0."""
    return events.agg(
        F.count("*").alias("events"), *[_type_count(t).alias(f"{t}_events") for t in EVENT_TYPES]
    )


def distinct_counts(events: DataFrame) -> DataFrame:
    """Exact distinct users, items and pairs. The pairs are shuffled once and feed all three."""
    pairs = _pairs(events)
    parts = [
        pairs.select("user_id").distinct().agg(F.count("*").alias("users")),
        pairs.select("item_id").distinct().agg(F.count("*").alias("items")),
        pairs.agg(F.count("*").alias("user_item_pairs")),
    ]
    return _one_row(parts).withColumn(
        "sparsity",
        1.0 - F.col("user_item_pairs") / (F.col("users").cast("double") * F.col("items")),
    )


def date_range(events: DataFrame) -> DataFrame:
    lo, hi = F.min("ts_ms"), F.max("ts_ms")
    return events.agg(
        F.date_format(event_date(lo), "yyyy-MM-dd").alias("start_date"),
        F.date_format(event_date(hi), "yyyy-MM-dd").alias("end_date"),
        F.round((hi - lo) / DAY_MS, 1).alias("days"),
    )


def activity_histogram(events: DataFrame, key: str) -> DataFrame:
    """(n, entities): how many entities have exactly ``n`` events.

    With N events there are fewer than sqrt(2N) different values of ``n``.
    """
    return events_per(events, key).groupBy("n").agg(F.count("*").alias("entities"))


def user_activity(events: DataFrame) -> DataFrame:
    """Median and nearest-rank p99 of events per user, from the histogram of counts."""
    ordered = Window.orderBy("n")
    hist = activity_histogram(events, "user_id").select(
        "n",
        "entities",
        F.sum("entities").over(ordered).alias("_upto"),
        F.sum("entities").over(Window.partitionBy()).alias("_all"),
    )
    p99_at = F.round((F.col("_all") - 1) * 0.99)
    return hist.agg(
        F.percentile("n", F.lit(0.5), F.col("entities")).alias("events_per_user_median"),
        F.min(F.when(F.col("_upto") > p99_at, F.col("n"))).cast("double").alias("p99_nearest"),
    )


def tail_activity(events: DataFrame) -> DataFrame:
    """Share of users with a single event and number of items with at least five."""
    users = events_per(events, "user_id").agg(
        F.round(100 * F.avg((F.col("n") == 1).cast("double")), 1).alias("users_with_one_event_pct")
    )
    items = events_per(events, "item_id").agg(
        F.count_if(F.col("n") >= 5).alias("items_with_5plus_events")
    )
    return _one_row([users, items])


def conversion_rates(events: DataFrame) -> DataFrame:
    views = _type_count("view")

    def rate(event: str) -> Column:
        return F.when(views > 0, F.round(_type_count(event) / views, 4)).otherwise(0.0)

    return events.agg(
        rate("addtocart").alias("view_to_cart_rate"),
        rate("transaction").alias("view_to_purchase_rate"),
    )


def summary(events: DataFrame) -> DataFrame:
    """All summary figures in one row."""
    return _one_row(
        [
            event_counts(events),
            distinct_counts(events),
            date_range(events),
            user_activity(events),
            tail_activity(events),
            conversion_rates(events),
        ]
    )


def daily_volume(events: DataFrame) -> DataFrame:
    """Events per UTC day, one column per type."""
    return (
        events.groupBy(event_date(F.col("ts_ms")).alias("day"))
        .pivot("event", list(EVENT_TYPES))
        .agg(F.count(F.lit(1)))
        .fillna(0, list(EVENT_TYPES))
    )


def clipped_activity(events: DataFrame, upper: int = 50) -> DataFrame:
    """Users by number of events, with everything above ``upper`` in the last bin."""
    return (
        activity_histogram(events, "user_id")
        .groupBy(clipped(F.col("n"), upper).alias("events_clipped"))
        .agg(F.sum("entities").alias("users"))
    )


def share_curve(events: DataFrame) -> DataFrame:
    """(top_n, item_id, n, share): share of all events held by the ``top_n`` busiest items.

    Cumulative sums run over the few distinct counts; an item adds its offset among equal counts.
    """
    per_item = events_per(events, "item_id")
    lower_first = Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)
    classes = (
        per_item.groupBy("n")
        .agg(F.count("*").alias("_items"))
        .select(
            "n",
            F.coalesce(F.sum("_items").over(lower_first), F.lit(0)).alias("_items_before"),
            F.coalesce(F.sum(F.col("_items") * F.col("n")).over(lower_first), F.lit(0)).alias(
                "_events_before"
            ),
            F.sum(F.col("_items") * F.col("n")).over(Window.partitionBy()).alias("_events"),
        )
    )
    ranked = dense_index(per_item, [F.desc("n"), "item_id"], "top_n", start=1)
    events_upto = F.col("_events_before") + (F.col("top_n") - F.col("_items_before")) * F.col("n")
    return ranked.join(classes, "n").select(
        "top_n", "item_id", "n", (events_upto / F.col("_events")).alias("share")
    )


def repeat_share(history: DataFrame, target: DataFrame) -> DataFrame:
    """How many distinct target pairs of warm users the user had already touched."""
    warm = target.join(history.select("user_id").distinct(), "user_id", "left_semi")
    pairs = warm.select("user_id", "item_id").distinct()
    past = history.select("user_id", "item_id").distinct().withColumn("_seen", F.lit(1))
    return (
        pairs.join(past, ["user_id", "item_id"], "left")
        .agg(
            F.count_distinct("user_id").alias("warm_users"),
            F.count("*").alias("target_pairs"),
            F.count("_seen").alias("repeat_pairs"),
        )
        .withColumn("repeat_share", F.col("repeat_pairs") / F.col("target_pairs"))
    )


def stage_percentiles(timings: DataFrame) -> DataFrame:
    """(stage, ms) rows to exact interpolated p50 and p99 per stage."""
    found = exact_quantiles(timings, "stage", "ms", (0.5, 0.99))
    at = lambda q: F.round(F.max(F.when(F.col("q") == q, F.col("quantile"))), 2)
    return found.groupBy("stage").agg(at(0.5).alias("p50_ms"), at(0.99).alias("p99_ms"))


def active_users(events: DataFrame, watermark_ms: int, days: int = 7) -> DataFrame:
    recent = events.where(F.col("ts_ms") > watermark_ms - days * DAY_MS)
    return recent.select("user_id").distinct()
