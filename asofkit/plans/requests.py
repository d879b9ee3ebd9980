"""Request sampling: real moments at which a returning user shows up."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asofkit.functions.columns import sampling_digest
from asofkit.operators.order import dense_index
from asofkit.operators.skew import HOT_ROWS
from asofkit.plans.evaluation import EvalSet
from asofkit.plans.features import history_events
from asofkit.schema import HORIZON_MS
from asofkit.session import checkpointed

SMALL_SAMPLE = 100_000


@dataclass(frozen=True)
class RequestSet:
    """``frame``: request_id, user_id, as_of_ms. The others are long and keyed by request_id.

    ``history`` rows are (request_id, as_of_ms, end, pos, ts_ms, item_id, event): position ``pos``
    of ``end`` events before the request.
    """

    frame: DataFrame
    history: DataFrame
    relevant: DataFrame
    seen: DataFrame

    def eval_set(self) -> EvalSet:
        return EvalSet(self.relevant, self.seen, "request_id")


def first_seen(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.min("ts_ms").alias("first_ts"))


def eligible_points(events: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Distinct (user_id, as_of_ms) in the window, except each user's very first moment.

    The anti-join is on the unique pair, so one busy user cannot fill a join partition.
    """
    ts = F.col("ts_ms")
    moments = (
        events.where((ts >= start_ms) & (ts < end_ms))
        .select("user_id", ts.alias("as_of_ms"))
        .distinct()
    )
    firsts = first_seen(events).withColumnRenamed("first_ts", "as_of_ms")
    return moments.join(firsts, ["user_id", "as_of_ms"], "left_anti")


def one_per_user(points: DataFrame, seed: int) -> DataFrame:
    """A pseudo-random moment per user: the smallest digest, combined before the shuffle."""
    draw = F.struct(
        sampling_digest(seed, ["user_id", "as_of_ms"]).alias("digest"), F.col("as_of_ms")
    )
    return points.groupBy("user_id").agg(F.min(draw).alias("d")).select("user_id", "d.as_of_ms")


def choose_requests(
    events: DataFrame, start_ms: int, end_ms: int, n: int | None, seed: int = 0, small: int = SMALL_SAMPLE
) -> DataFrame:
    """At most ``n`` users, or all, with one moment each, numbered by (as_of_ms, user_id).

    Up to ``small`` requests are drawn and numbered in one task; more are numbered by a range sort.
    """
    drawn = one_per_user(eligible_points(events, start_ms, end_ms), seed)
    chosen = drawn
    if n is not None and n > small:
        order = dense_index(drawn, [sampling_digest(seed, ["user_id"]), "user_id"], "_place")
        chosen = order.where(F.col("_place") < n).drop("_place")
    elif n is not None:
        chosen = drawn.orderBy(sampling_digest(seed, ["user_id"]), "user_id").limit(n)
    if n is None or n > small:
        numbered = dense_index(chosen, ["as_of_ms", "user_id"], "request_id")
    else:
        place = F.row_number().over(Window.orderBy("as_of_ms", "user_id")) - 1
        numbered = chosen.withColumn("request_id", place.cast("long"))
    return numbered.select("request_id", "user_id", "as_of_ms")


def request_pairs(events: DataFrame, requests: DataFrame, small: bool) -> DataFrame:
    """All events of the requesting users next to their request."""
    side = F.broadcast(requests) if small else requests
    return events.select("user_id", "ts_ms", "item_id", "event", "transaction_id").join(
        side, "user_id"
    )


def request_history(events: DataFrame, requests: DataFrame, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Long histories keyed by request."""
    found = history_events(events, requests.select("user_id", "as_of_ms"), hot_rows=hot_rows)
    return requests.join(found, ["user_id", "as_of_ms"]).select(
        "request_id", "as_of_ms", "end", "pos", "ts_ms", "item_id", "event"
    )


def sample_requests(
    events: DataFrame,
    start_ms: int,
    end_ms: int,
    n: int | None,
    seed: int = 0,
    horizon_ms: int = HORIZON_MS,
    hot_rows: int | None = HOT_ROWS,
    small: int = SMALL_SAMPLE,
) -> RequestSet:
    """Requests in ``[start_ms, end_ms)`` with history, labels and seen items.

    Labels are the items touched in ``[as_of, min(as_of + horizon, end))``.
    """
    requests = checkpointed(choose_requests(events, start_ms, end_ms, n, seed, small))
    pairs = request_pairs(events, requests, small=n is not None and n <= small)
    ts, as_of = F.col("ts_ms"), F.col("as_of_ms")
    until = F.least(as_of + horizon_ms, F.lit(end_ms))
    relevant = pairs.where((ts >= as_of) & (ts < until)).select("request_id", "item_id").distinct()
    seen = pairs.where(ts < as_of).select("request_id", "item_id").distinct()
    past = pairs.where(ts < as_of).select(
        "ts_ms", "user_id", "item_id", "event", "transaction_id"
    )
    return RequestSet(requests, request_history(past, requests, hot_rows), relevant, seen)
