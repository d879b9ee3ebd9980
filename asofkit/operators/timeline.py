"""Point-in-time operators over an entity's timeline.

Input rows are events and, optionally, probe rows: a probe has ``event IS NULL`` and asks for the
state strictly before its own ``ts_ms``. Every result column describes events with smaller
``ts_ms`` only, so events can be their own probes.

Sliding frames are re-evaluated per row by Spark, hence every count over ``[t - w, t)`` is written
as the difference of two frames that only grow: events before ``t`` minus events before ``t - w``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from asofkit.definitions import FeatureSet, WindowCount
from asofkit.operators.skew import HOT_ROWS, Hot, scan_before, split_hot, to_points, with_overlap
from asofkit.schema import DAY_MS, HISTORY_LEN, HOUR_MS
from asofkit.session import checkpointed

SCAN_BUCKET_MS = DAY_MS
PLACE_BUCKET_MS = HOUR_MS


def _is_event() -> Column:
    return F.col("event").isNotNull()


def _measure(event: str | None) -> str:
    return "_n_any" if event is None else f"_n_{event}"


def _measures(windows: Sequence[WindowCount]) -> dict[str, Column]:
    """0/1 columns, one per event type the windows need; summed when rows are pre-aggregated."""
    out = {"_n_any": _is_event().cast("long")}
    for w in windows:
        if w.event is not None:
            out[_measure(w.event)] = F.coalesce(F.col("event") == w.event, F.lit(False)).cast("long")
    return out


def _count_columns(windows: Sequence[WindowCount], timeline: WindowSpec) -> list[Column]:
    def before(measure: str, offset_ms: int) -> Column:
        frame = timeline.rangeBetween(Window.unboundedPreceding, -(offset_ms + 1))
        return F.coalesce(F.sum(measure).over(frame), F.lit(0))

    return [
        (before(_measure(w.event), 0) - before(_measure(w.event), w.window_ms)).alias(w.name)
        for w in windows
    ]


def window_counts(
    rows: DataFrame,
    key: str,
    windows: Sequence[WindowCount],
    hot: Hot = HOT_ROWS,
) -> DataFrame:
    """``rows`` plus one count column per window, as of each row's own ``ts_ms``."""
    if not windows:
        return rows
    cold, busy = split_hot(rows, key, hot)
    result = _counts_by_key(cold, key, windows)
    if busy is not None:
        result = result.unionByName(_counts_by_bucket(busy, key, windows))
    return result


def _counts_by_key(rows: DataFrame, key: str, windows: Sequence[WindowCount]) -> DataFrame:
    timeline = Window.partitionBy(key).orderBy("ts_ms")
    tagged = rows.withColumns(_measures(windows))
    return tagged.select(*rows.columns, *_count_columns(windows, timeline))


def _counts_by_bucket(rows: DataFrame, key: str, windows: Sequence[WindowCount]) -> DataFrame:
    """Counts of hot keys; whatever the windows, a task holds the milliseconds of ``SCAN_BUCKET_MS`` at most.

    Windows up to that length are counted in buckets that carry a copy of the bucket before. Longer ones are
    differences of two prefix sums, which are looked up where they lie.
    """
    measures = _measures(windows)
    points = to_points(rows.withColumns(measures), [key], list(measures))
    short = [w for w in windows if w.window_ms <= SCAN_BUCKET_MS]
    counted = points.select(key, "ts_ms")
    if short:
        timeline = Window.partitionBy(key, "_bucket").orderBy("ts_ms")
        counted = (
            with_overlap(points, max(w.window_ms for w in short), "_n_any")
            .select(key, "ts_ms", "_own", *_count_columns(short, timeline))
            .where("_own")
            .drop("_own")
        )
    if len(short) < len(windows):
        longer = _counts_by_prefix(points, key, [w for w in windows if w not in short])
        counted = counted.join(longer, [key, "ts_ms"])
    return rows.join(counted.select(key, "ts_ms", *(w.name for w in windows)), [key, "ts_ms"])


def _counts_by_prefix(points: DataFrame, key: str, windows: Sequence[WindowCount]) -> DataFrame:
    """(key, ts_ms) with one count per window, from two-level prefix sums.

    Each point asks for the sums before its own time and before the start of every window. Questions are answered in
    the time bucket they fall into: the sum of the bucket's earlier points plus that of all earlier buckets, of which one row per
    (key, bucket) is added up.
    """
    lengths = sorted({w.window_ms for w in windows})
    names = sorted({_measure(w.event) for w in windows})
    asked = points.select(
        key, F.col("ts_ms").alias("_of"), *names, F.explode(F.array(*(F.lit(x).cast("long") for x in (0, *lengths)))).alias("_back")
    ).withColumn("_at", F.col("_of") - F.col("_back"))
    own = F.col("_back") == 0
    asked = asked.withColumns({n: F.when(own, F.col(n)).otherwise(0) for n in names})
    asked = asked.withColumn("_bucket", F.floor(F.col("_at") / F.lit(SCAN_BUCKET_MS)).cast("long"))
    inside = Window.partitionBy(key, "_bucket").orderBy("_at").rangeBetween(Window.unboundedPreceding, -1)
    local = asked.select(key, "_bucket", "_of", "_back", *(F.coalesce(F.sum(n).over(inside), F.lit(0)).alias(n) for n in names))
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = asked.groupBy(key, "_bucket").agg(*(F.sum(n).alias(n) for n in names))
    carried = totals.select(key, "_bucket", *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_before{n}") for n in names))
    sums = local.join(carried, [key, "_bucket"]).select(key, "_of", "_back", *((F.col(n) + F.col(f"_before{n}")).alias(n) for n in names))

    def before(measure: str, back: int) -> Column:
        return F.max(F.when(F.col("_back") == back, F.col(measure)))

    return sums.groupBy(key, F.col("_of").alias("ts_ms")).agg(
        *((before(_measure(w.event), 0) - before(_measure(w.event), w.window_ms)).alias(w.name) for w in windows)
    )


def session_state(rows: DataFrame, gap_ms: int, hot: Hot = HOT_ROWS) -> DataFrame:
    """``rows`` plus ``session_start_ms`` and the session's content strictly before each row.

    A row whose previous event is more than ``gap_ms`` away starts a session of its own, so its
    session columns are zero without further conditions. ``_prev_ts`` is the previous event's time.
    """
    cold, busy = split_hot(rows, "user_id", hot)
    result = _sessions_by_user(cold, gap_ms)
    if busy is not None:
        result = result.unionByName(_sessions_by_bucket(busy, gap_ms))
    return result


def _starts_session(gap_ms: int) -> Column:
    return F.col("_prev_ts").isNull() | (F.col("ts_ms") - F.col("_prev_ts") > gap_ms)


def _is_cart() -> Column:
    return F.coalesce(F.col("event") == "addtocart", F.lit(False))


def _sessions_by_user(
    rows: DataFrame, gap_ms: int, windows: Sequence[WindowCount] = ()
) -> DataFrame:
    """Sessions, and optionally window counts, of ordinary users: one exchange for everything."""
    timeline = Window.partitionBy("user_id").orderBy("ts_ms")
    earlier = timeline.rangeBetween(Window.unboundedPreceding, -1)
    up_to_now = timeline.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same_item = Window.partitionBy("user_id", "session_start_ms", "item_id").orderBy("ts_ms", "event")
    in_session = (
        Window.partitionBy("user_id", "session_start_ms")
        .orderBy("ts_ms")
        .rangeBetween(Window.unboundedPreceding, -1)
    )
    event_ts = F.when(_is_event(), F.col("ts_ms"))
    start = F.max(F.when(_starts_session(gap_ms), F.col("ts_ms"))).over(up_to_now)
    # probes carry no item, so they never take an item's first row
    first_of_item = _is_event() & (F.row_number().over(same_item) == 1)
    zero = F.lit(0).cast("long")

    def so_far(measure: Column) -> Column:
        return F.coalesce(F.sum(measure.cast("long")).over(in_session), zero)

    return (
        rows.withColumns(_measures(windows))
        .select(
            *rows.columns,
            *_count_columns(windows, timeline),
            F.max(event_ts).over(earlier).alias("_prev_ts"),
        )
        .withColumn("session_start_ms", start)
        .withColumn("_first_of_item", first_of_item)
        .select(
            *rows.columns,
            *[w.name for w in windows],
            "session_start_ms",
            "_prev_ts",
            so_far(_is_event()).alias("session_events"),
            so_far(_is_cart()).alias("session_carts"),
            so_far(F.col("_first_of_item")).alias("session_distinct_items"),
            F.coalesce(F.max(event_ts).over(in_session) - F.col("session_start_ms"), zero).alias(
                "session_duration_ms"
            ),
        )
    )


def _sessions_by_bucket(rows: DataFrame, gap_ms: int) -> DataFrame:
    """The same columns for hot users, from bucketed scans over one point per millisecond."""
    measured = rows.withColumns(
        {"_n": _is_event().cast("long"), "_carts": _is_cart().cast("long")}
    )
    points = to_points(measured, ["user_id"], ["_n", "_carts"]).withColumn(
        "_event_ts", F.when(F.col("_n") > 0, F.col("ts_ms"))
    )
    starts = (
        scan_before(points, ["user_id"], SCAN_BUCKET_MS, maxes=["_event_ts"])
        .withColumnRenamed("before__event_ts", "_prev_ts")
        .withColumn("_start", F.when(_starts_session(gap_ms), F.col("ts_ms")))
    )
    sessions = checkpointed(
        scan_before(starts, ["user_id"], SCAN_BUCKET_MS, maxes=["_start"])
        .withColumn("session_start_ms", F.greatest("before__start", "_start"))
        .drop("before__start", "_start")
    )
    first_seen = (
        rows.where(_is_event())
        .select("user_id", "ts_ms", "item_id")
        .distinct()
        .join(sessions.select("user_id", "ts_ms", "session_start_ms"), ["user_id", "ts_ms"])
        .groupBy("user_id", "session_start_ms", "item_id")
        .agg(F.min("ts_ms").alias("ts_ms"))
        .groupBy("user_id", "ts_ms")
        .agg(F.count("*").alias("_new_items"))
    )
    enriched = sessions.join(first_seen, ["user_id", "ts_ms"], "left").fillna(0, ["_new_items"])
    content = scan_before(
        enriched,
        ["user_id", "session_start_ms"],
        SCAN_BUCKET_MS,
        sums=["_n", "_carts", "_new_items"],
        maxes=["_event_ts"],
    ).select(
        "user_id",
        "ts_ms",
        "session_start_ms",
        "_prev_ts",
        F.col("before__n").alias("session_events"),
        F.col("before__carts").alias("session_carts"),
        F.col("before__new_items").alias("session_distinct_items"),
        F.coalesce(F.col("before__event_ts") - F.col("session_start_ms"), F.lit(0)).alias(
            "session_duration_ms"
        ),
    )
    return rows.join(content, ["user_id", "ts_ms"])


def user_state(rows: DataFrame, features: FeatureSet, hot: Hot = HOT_ROWS) -> DataFrame:
    """``rows`` plus all user features. One hot-key check serves windows and sessions."""
    cold, busy = split_hot(rows, "user_id", hot)
    result = _sessions_by_user(cold, features.session_gap_ms, features.user_windows)
    if busy is not None:
        counted = _counts_by_bucket(busy, "user_id", features.user_windows)
        result = result.unionByName(_sessions_by_bucket(counted, features.session_gap_ms))
    cap = F.lit(features.last_event_cap_ms).cast("long")
    age = F.least(F.coalesce(F.col("ts_ms") - F.col("_prev_ts"), cap), cap)
    return result.withColumn("last_event_age_ms", age).select(
        *rows.columns, *features.user_features
    )


def ranked_positions(rows: DataFrame, hot: Hot = HOT_ROWS) -> DataFrame:
    """``rows`` plus ``n_before`` (events strictly earlier) and, for events, 1-based ``pos``.

    Equal timestamps are ordered by (item_id, event, transaction_id).
    """
    cold, busy = split_hot(rows, "user_id", hot)
    tie_order = ["item_id", "event", F.col("transaction_id").asc_nulls_first()]
    one = _is_event().cast("long")
    by_time = Window.partitionBy("user_id").orderBy("ts_ms")
    by_position = Window.partitionBy("user_id").orderBy("ts_ms", *tie_order)
    result = cold.select(
        "*",
        F.coalesce(
            F.sum(one).over(by_time.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ).alias("n_before"),
        F.sum(one)
        .over(by_position.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        .alias("pos"),
    )
    if busy is not None:
        # one exchange of the rows: positions inside an hour of a user plus the events of earlier hours, a row per hour
        bucketed = busy.withColumn("_bucket", F.floor(F.col("ts_ms") / F.lit(PLACE_BUCKET_MS)).cast("long"))
        in_hour = Window.partitionBy("user_id", "_bucket").orderBy("ts_ms")
        placed = in_hour.orderBy("ts_ms", *tie_order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        local = bucketed.select(
            "*",
            F.coalesce(F.sum(one).over(in_hour.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("n_before"),
            F.sum(one).over(placed).alias("pos"),
        )
        hours = bucketed.groupBy("user_id", "_bucket").agg(F.sum(one).alias("_n"))
        earlier = Window.partitionBy("user_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        carried = hours.select("user_id", "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_carry"))
        ranked = local.join(carried, ["user_id", "_bucket"]).select(
            *rows.columns, (F.col("n_before") + F.col("_carry")).alias("n_before"), (F.col("pos") + F.col("_carry")).alias("pos")
        )
        result = result.unionByName(ranked)
    return result.withColumn("pos", F.when(_is_event(), F.col("pos")))


def preceding_arrays(
    positioned: DataFrame, ends: DataFrame, keys: Sequence[str], length: int = HISTORY_LEN, all_ends: bool = False
) -> DataFrame:
    """(user_id, *keys, end, hist): the events at positions ``(end - length, end]``, in order.

    With ``all_ends`` rows without earlier events stay, with a null ``hist``.

    ``ends`` holds (user_id, end, *keys). Positions are folded into blocks of ``length``, so an
    array never holds more than that; a range touches one block and possibly the one before it,
    which turns the range lookup into one equi-join on (user_id, block).
    """

    def block(position: Column) -> Column:
        return F.floor((position - 1) / length).cast("long").alias("_block")

    folded = (
        positioned.select(
            "user_id", block(F.col("pos")), F.struct("pos", "ts_ms", "item_id", "event").alias("_e")
        )
        .groupBy("user_id", "_block")
        .agg(F.array_sort(F.collect_list("_e")).alias("_here"))
    )
    shifted = folded.select(
        "user_id", (F.col("_block") + 1).alias("_block"), F.col("_here").alias("_before")
    )
    chained = folded.join(shifted, ["user_id", "_block"], "left")
    extra = [k for k in keys if k != "user_id"]
    wanted = ends if all_ends else ends.where(F.col("end") > 0)
    wanted = wanted.select("user_id", *extra, "end", block(F.col("end")))
    candidates = F.when(F.col("_before").isNull(), F.col("_here")).otherwise(
        F.concat("_before", "_here")
    )
    inside = F.filter(
        candidates, lambda e: (e["pos"] <= F.col("end")) & (e["pos"] > F.col("end") - length)
    )
    return wanted.join(chained, ["user_id", "_block"], "left" if all_ends else "inner").select(
        "user_id", *extra, "end", inside.alias("hist")
    )


def preceding_events(
    positioned: DataFrame, ends: DataFrame, keys: Sequence[str], length: int = HISTORY_LEN
) -> DataFrame:
    """The same in long form: one row (user_id, *keys, end, pos, ts_ms, item_id, event) per event."""
    found = preceding_arrays(positioned, ends, keys, length)
    return found.select(*[c for c in found.columns if c != "hist"], F.inline("hist"))


def as_history(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fold ``preceding_events`` rows into hist_ts / hist_items / hist_events, oldest first."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "ts_ms", "item_id", "event")))
    return parallel_lists(rows.groupBy(*keys).agg(ordered.alias("hist")), keys)


def parallel_lists(found: DataFrame, keys: Sequence[str]) -> DataFrame:
    return found.select(
        *keys,
        F.col("hist.ts_ms").alias("hist_ts"),
        F.col("hist.item_id").alias("hist_items"),
        F.col("hist.event").alias("hist_events"),
    )
