"""Splits at global time cutoffs; all intervals are half-open."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.schema import DAY_MS


def time_bounds(events: DataFrame) -> tuple[int, int]:
    """First and last event time, from one aggregated row."""
    lo, hi = events.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    return lo, hi


@dataclass(frozen=True)
class TimeSplit:
    events: DataFrame
    val_start_ms: int
    test_start_ms: int
    end_ms: int

    @property
    def train(self) -> DataFrame:
        return self.events.where(F.col("ts_ms") < self.val_start_ms)

    @property
    def val(self) -> DataFrame:
        ts = F.col("ts_ms")
        return self.events.where((ts >= self.val_start_ms) & (ts < self.test_start_ms))

    @property
    def test(self) -> DataFrame:
        return self.events.where(F.col("ts_ms") >= self.test_start_ms)

    @property
    def train_val(self) -> DataFrame:
        """Everything before the test window: one filter instead of a union of two scans."""
        return self.events.where(F.col("ts_ms") < self.test_start_ms)


def time_split(events: DataFrame, val_days: int = 14, test_days: int = 14) -> TimeSplit:
    if val_days <= 0 or test_days <= 0:
        raise ValueError("val_days and test_days must be positive")
    first, last = time_bounds(events)
    test_start = last + 1 - test_days * DAY_MS
    val_start = test_start - val_days * DAY_MS
    if val_start <= first:
        raise ValueError("not enough history for the requested val/test windows")
    return TimeSplit(events, val_start, test_start, last + 1)


def labelled(split: TimeSplit) -> DataFrame:
    """All events with the part they fall into."""
    part = (
        F.when(F.col("ts_ms") < split.val_start_ms, "train")
        .when(F.col("ts_ms") < split.test_start_ms, "val")
        .otherwise("test")
    )
    return split.events.withColumn("part", part)
