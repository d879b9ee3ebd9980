"""Column expressions shared by the jobs. All of them run inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from asofkit.schema import EVENT_TYPES, EVENT_WEIGHTS


def event_date(ts_ms: Column) -> Column:
    """UTC date of an epoch-millisecond column (the session time zone must be UTC)."""
    return F.to_date(F.timestamp_millis(ts_ms))


def iso_date_ms(value: Column) -> Column:
    """Midnight UTC of an ISO date, as epoch milliseconds."""
    return F.unix_millis(F.to_timestamp(value, "yyyy-MM-dd"))


def mapped_or_fail(column: Column, mapping: Mapping[str, float]) -> Column:
    """Translate through ``mapping``; a value outside it fails the job."""
    cases = reduce(
        lambda acc, pair: acc.when(column == pair[0], F.lit(pair[1])), mapping.items(), F
    )
    message = F.concat(F.lit("unmapped value: "), F.coalesce(column, F.lit("null")))
    return cases.otherwise(F.raise_error(message).cast("double"))


def event_weight(weights: Mapping[str, float] = EVENT_WEIGHTS) -> Column:
    return mapped_or_fail(F.col("event"), weights)


def checked_event(column: Column) -> Column:
    """The event type itself, failing the job on anything outside the declared types."""
    message = F.concat(F.lit("unknown event type: "), F.coalesce(column, F.lit("null")))
    return F.when(column.isin(*EVENT_TYPES), column).otherwise(F.raise_error(message).cast("string"))


def clipped(column: Column, upper: int) -> Column:
    return F.least(column, F.lit(upper))


def reverse_distinct(items: Column) -> Column:
    """Distinct elements of a list, last occurrence first."""
    return F.array_distinct(F.reverse(items))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def l2_normalised(vec: Column) -> Column:
    # bound as a variable: written into the inner function, the norm would be summed up again for every component
    norm = F.array(F.sqrt(dot(vec, vec)))
    return F.transform(norm, lambda n: F.when(n > 0, F.transform(vec, lambda x: x.cast("double") / n)).otherwise(vec))[0]


def sampling_digest(seed: int, parts: Sequence[str]) -> Column:
    """Order for seeded sampling: the same on any partitioning and any SQL engine."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(p).cast("string") for p in parts]))


def rank_discount(rank: Column) -> Column:
    """DCG discount of a 0-based rank."""
    return F.lit(1.0) / F.log2(rank + F.lit(2.0))
