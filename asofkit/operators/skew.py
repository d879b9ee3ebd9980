"""Handling of keys that hold a large share of all rows.

A window over ``PARTITION BY key`` puts a key's rows into one task. That is the cheapest plan as
long as no key is huge, so the feature jobs use it for ordinary keys. Keys above ``HOT_ROWS`` rows
are split off by a counted, map-side-combined aggregation and go through the functions below, which
cut a key's timeline into time buckets:

* ``to_points`` pre-aggregates to one row per (key, millisecond), so a bucket of B milliseconds
  never holds more than B rows, whatever the data volume;
* ``with_overlap`` makes each bucket self-contained for look-backs no longer than a bucket;
* ``scan_before`` computes running sums and maxima over a whole timeline from per-bucket totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from asofkit.session import checkpointed

HOT_ROWS = 1_000_000
MAX_BROADCAST_KEYS = 1_000_000


Hot = int | DataFrame | None


def hot_keys(df: DataFrame, key: str, hot_rows: int) -> DataFrame | None:
    """Values of ``key`` that hold more than ``hot_rows`` rows, or None.

    One column is read and pre-aggregated before its shuffle. At most ``rows / hot_rows`` values
    can be hot, so the result is small by construction.
    """
    return hot_keys_of(df, (key,), hot_rows)[key]


def hot_keys_of(df: DataFrame, keys: Sequence[str], hot_rows: int) -> dict[str, DataFrame | None]:
    """``hot_keys`` of several columns in one pass and one job; the columns are of one type."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("_of"), F.col(k).alias("_key")) for n, k in enumerate(keys))))
    counted = df.select(each.alias("_x")).groupBy("_x._of", "_x._key").count() if len(keys) > 1 else (
        df.groupBy(F.col(keys[0]).alias("_key")).count().withColumn("_of", F.lit(0))
    )
    heavy = counted.where(F.col("count") > hot_rows).select("_of", "_key")
    found = heavy.limit(MAX_BROADCAST_KEYS + 1).collect()  # at most rows / hot_rows values
    if len(found) > MAX_BROADCAST_KEYS:
        heavy = checkpointed(heavy)
        parts = [heavy.where(F.col("_of") == n).select(F.col("_key").alias(k)) for n, k in enumerate(keys)]
        return dict(zip(keys, parts, strict=True))
    out: dict[str, DataFrame | None] = {}
    for n, key in enumerate(keys):
        own = [(r["_key"],) for r in found if r["_of"] == n]
        schema = f"{key} {df.schema[key].dataType.simpleString()}"
        out[key] = df.sparkSession.createDataFrame(own, schema) if own else None
    return out


def split_hot(df: DataFrame, key: str, hot: Hot = HOT_ROWS) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of hot keys or None).

    ``hot`` is the row limit to check for, a frame of hot keys found earlier, or None for no hot
    keys. The hot keys are broadcast only while they are few.
    """
    if isinstance(hot, int):
        hot = hot_keys(df, key, hot)
    if hot is None:
        return df, None
    keys = F.broadcast(hot) if hot.count() <= MAX_BROADCAST_KEYS else hot
    return df.join(keys, key, "left_anti"), df.join(keys, key, "left_semi")


def to_points(df: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """One row per (keys, ts_ms) with summed measures."""
    return df.groupBy(*keys, "ts_ms").agg(*[F.sum(c).alias(c) for c in sums])


def with_overlap(points: DataFrame, bucket_ms: int, carried: str) -> DataFrame:
    """Add ``_bucket`` and ``_own``; rows with ``carried > 0`` are also copied to the next bucket."""
    bucket = F.floor(F.col("ts_ms") / F.lit(bucket_ms)).cast("long")
    targets = F.when(F.col(carried) > 0, F.array(bucket, bucket + 1)).otherwise(F.array(bucket))
    return points.select("*", F.posexplode(targets).alias("_copy", "_bucket")).select(
        *points.columns, "_bucket", (F.col("_copy") == 0).alias("_own")
    )


def scan_before(
    points: DataFrame,
    keys: Sequence[str],
    bucket_ms: int,
    sums: Sequence[str] = (),
    maxes: Sequence[str] = (),
) -> DataFrame:
    """Add ``before_<c>``: the sum / maximum of ``c`` over the key's points at smaller ``ts_ms``.

    ``points`` must be unique per (keys, ts_ms). Work per task is one (keys, bucket) group; only
    the per-bucket totals of a key, one row per bucket of the covered time span, meet in one task.
    """
    keys = list(keys)
    bucketed = points.withColumn("_bucket", F.floor(F.col("ts_ms") / F.lit(bucket_ms)).cast("long"))
    inside = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy("ts_ms")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = bucketed.select(
        "*",
        *[F.sum(c).over(inside).alias(f"_in_{c}") for c in sums],
        *[F.max(c).over(inside).alias(f"_in_{c}") for c in maxes],
    )
    totals = bucketed.groupBy(*keys, "_bucket").agg(
        *[F.sum(c).alias(f"_all_{c}") for c in sums],
        *[F.max(c).alias(f"_all_{c}") for c in maxes],
    )
    earlier = (
        Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    )
    carry = totals.select(
        *keys,
        "_bucket",
        *[F.sum(f"_all_{c}").over(earlier).alias(f"_carry_{c}") for c in sums],
        *[F.max(f"_all_{c}").over(earlier).alias(f"_carry_{c}") for c in maxes],
    )
    zero = F.lit(0).cast("long")
    return local.join(carry, [*keys, "_bucket"]).select(
        *points.columns,
        *[
            (F.coalesce(f"_in_{c}", zero) + F.coalesce(f"_carry_{c}", zero)).alias(f"before_{c}")
            for c in sums
        ],
        *[F.greatest(f"_in_{c}", f"_carry_{c}").alias(f"before_{c}") for c in maxes],
    )
