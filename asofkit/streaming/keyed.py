"""The online store as keyed state: one processor per user and one per (item, event type), state in RocksDB.

It keeps what the log form keeps after compacting every batch, and is read as tables through the state reader, so the
same batch functions compute features from either form. The log form has no hot keys; here a user's events meet in one
task, whose state lies on disk, and an item's are dealt over ``SALTS`` keys, which is looser while streaming and
trimmed exactly when read. Late events are accepted at any lateness, and delivering an event again changes nothing.

Every access to state is a call from Python to the JVM, so events are stored in blocks, one list per column: a map holds a
block per stretch of event time, and a batch reads and writes only the blocks that it touches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from asofkit.definitions import STANDARD, FeatureSet
from asofkit.operators.skew import HOT_ROWS
from asofkit.plans.features import item_features, user_features, user_histories
from asofkit.schema import EVENT_COLUMNS, HISTORY_LEN
from asofkit.sources.messages import decode
from asofkit.streaming.store import retain_history, retain_items, retain_users

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SALTS = 16
COUNTS = "kept long, repeated long, dropped long, expired long"
USER_BLOCKS, ITEM_BLOCKS = 2, 32  # blocks per retention
_BLOCK = "block long"
_USER_EVENTS = "ts_ms array<long>, item_id array<long>, event array<string>, transaction_id array<long>"
_ITEM_EVENTS = "ts_ms array<long>, user_id array<long>, transaction_id array<long>"


def _identity(row: Row, names: tuple[str, ...]) -> tuple:
    return tuple(row[n] for n in names)


def _order(entry: tuple) -> tuple:
    """Event order with nulls first, as in the histories of the batch jobs."""
    return tuple((x is not None, x) for x in entry)


def _folded(entries: Iterable[tuple]) -> tuple:
    """One list per column."""
    return tuple(map(list, zip(*entries, strict=True)))


def _unfolded(columns: tuple | None) -> set[tuple]:
    return set() if columns is None else set(zip(*columns, strict=True))


def _by_block(entries: Iterable[tuple], block_ms: int) -> dict[int, set[tuple]]:
    found: dict[int, set[tuple]] = {}
    for entry in entries:
        found.setdefault(entry[0] // block_ms, set()).add(entry)
    return found


class _Expiring(StatefulProcessor):
    """Forgets a key that got no event for ``ttl_ms`` of wall-clock time; never by default."""

    def __init__(self, ttl_ms: int | None) -> None:
        self.ttl_ms = ttl_ms

    def renew(self, timerValues: Any) -> None:
        if self.ttl_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        for state in self.states:
            state.clear()
        yield Row(kept=0, repeated=0, dropped=0, expired=1)

    def write(self, block: int, old: set[tuple], new: set[tuple]) -> None:
        if new and new != old:
            self.retained.updateValue((block,), _folded(new))
        elif old and not new:
            self.retained.removeKey((block,))

    def close(self) -> None: ...


class UserState(_Expiring):
    """Map: blocks of retained events. Value: last event and session start. List: a block of the last events of any age, in order."""

    names = ("ts_ms", "item_id", "event", "transaction_id")

    def __init__(self, features: FeatureSet = STANDARD, length: int = HISTORY_LEN, ttl_ms: int | None = None) -> None:
        super().__init__(ttl_ms)
        self.retention_ms, self.gap_ms, self.length = features.user_retention_ms, features.session_gap_ms, length
        self.block_ms = max(1, self.retention_ms // USER_BLOCKS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.retained = handle.getMapState("retained", _BLOCK, _USER_EVENTS)
        self.span = handle.getValueState("span", "last_ms long, start_ms long")
        self.tail = handle.getListState("tail", _USER_EVENTS)
        self.states = (self.retained, self.span, self.tail)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        tail = {e for block in self.tail.get() for e in _unfolded(block)}
        blocks = {k[0]: _unfolded(v) for k, v in self.retained.iterator()}
        held = {e for block in blocks.values() for e in block}
        arrived = {_identity(r, self.names) for r in rows}
        new = arrived - held
        kept = self.trimmed(held | new)
        if kept != held:
            now = _by_block(kept, self.block_ms)
            for block in blocks.keys() | now.keys():
                self.write(block, blocks.get(block, set()), now.get(block, set()))
            times = sorted(e[0] for e in kept)
            self.span.update((times[-1], self.session_start(times)))
        if not arrived <= tail:
            last = sorted(tail | arrived, key=_order)[-self.length :]
            if set(last) != tail:
                self.tail.put([_folded(last)])
        self.renew(timerValues)
        yield Row(kept=len(new & kept), repeated=len(arrived) - len(new), dropped=len(new - kept) + len(held - kept), expired=0)

    def session_start(self, times: list[int]) -> int:
        start = times[-1]
        for t in reversed(times):
            if start - t > self.gap_ms:
                break
            start = t
        return start

    def trimmed(self, entries: set[tuple]) -> set[tuple]:
        """Events of the current session and of the longest window before the last one."""
        times = sorted(e[0] for e in entries)
        oldest = min(times[-1] - self.retention_ms, self.session_start(times))
        return {e for e in entries if e[0] >= oldest}


class ItemState(_Expiring):
    """Map: blocks of the events of an item, type and salt in the longest item window before its last event. Value: that event."""

    names = ("ts_ms", "user_id", "transaction_id")

    def __init__(self, features: FeatureSet = STANDARD, ttl_ms: int | None = None) -> None:
        super().__init__(ttl_ms)
        self.retention_ms = features.item_retention_ms
        self.block_ms = max(1, self.retention_ms // ITEM_BLOCKS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.retained = handle.getMapState("retained", _BLOCK, _ITEM_EVENTS)
        self.last = handle.getValueState("last", "last_ms long")
        self.states = (self.retained, self.last)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        arrived = {_identity(r, self.names) for r in rows}
        before = self.last.get()[0] if self.last.exists() else None
        last = max([e[0] for e in arrived] + ([] if before is None else [before]))
        oldest = last - self.retention_ms
        # what lies before the window of the last event so far is not held
        since = oldest if before is None else before - self.retention_ms
        blocks = _by_block((e for e in arrived if e[0] >= since), self.block_ms)
        stale: set[int] = set()
        if before is not None and last > before:
            stale = {k[0] for k in self.retained.keys() if k[0] <= oldest // self.block_ms}
        kept = repeated = dropped = 0
        for block in stale | blocks.keys():
            held = set() if before is None else _unfolded(self.retained.getValue((block,)))
            own = blocks.get(block, set())
            new = {e for e in own - held if e[0] >= oldest}
            left = {e for e in held if e[0] >= oldest}
            self.write(block, held, left | new)
            kept, repeated, dropped = kept + len(new), repeated + len(own & held), dropped + len(held) - len(left)
        dropped += len(arrived) - repeated - kept
        if last != before:
            self.last.update((last,))
        self.renew(timerValues)
        yield Row(kept=kept, repeated=repeated, dropped=dropped, expired=0)


class KeyedStore:
    """Two streaming queries over the same messages and the tables that their state holds."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        features: FeatureSet = STANDARD,
        hot_rows: int | None = HOT_ROWS,
        ttl_ms: int | None = None,
    ) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.features, self.hot_rows, self.ttl_ms = features, hot_rows, ttl_ms
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def start(self, messages: DataFrame, bounded: bool = True, interval: str = "10 seconds") -> list[StreamingQuery]:
        """Start both queries; started again on the same folder they go on where they stopped.

        Each batch's counts of kept, repeated and dropped events are observed as ``keyed``.
        """
        events = decode(messages).where("accepted").select(*EVENT_COLUMNS)
        salted = events.withColumn("salt", F.pmod(F.xxhash64("user_id"), F.lit(SALTS)))
        clock = "None" if self.ttl_ms is None else "ProcessingTime"
        by_user = events.groupBy("user_id").transformWithState(
            UserState(self.features, HISTORY_LEN, self.ttl_ms), COUNTS, "Update", clock
        )
        by_item = salted.groupBy("item_id", "event", "salt").transformWithState(
            ItemState(self.features, self.ttl_ms), COUNTS, "Update", clock
        )
        # queries with timers go on for ever, as they cannot know that none will run out
        bounded = bounded and self.ttl_ms is None
        trigger = {"availableNow": True} if bounded else {"processingTime": interval}
        totals = [F.sum(c.split()[0]).alias(c.split()[0]) for c in COUNTS.split(", ")]
        return [
            counts.observe("keyed", *totals)
            .writeStream.outputMode("update")
            .format("noop")
            .option("checkpointLocation", f"{self.root}/{name}")
            .trigger(**trigger)
            .start()
            for name, counts in (("users", by_user), ("items", by_item))
        ]

    def ingest(self, messages: DataFrame) -> None:
        """All that is available now."""
        for query in self.start(messages, interval="0 seconds"):
            if self.ttl_ms is None:
                query.awaitTermination()
            else:
                query.processAllAvailable()
                query.stop()

    def _state(self, name: str, variable: str) -> DataFrame:
        reader = self.spark.read.format("statestore").option("stateVarName", variable)
        return reader.load(f"{self.root}/{name}")

    def _unfold(self, state: DataFrame, value: str, names: tuple[str, ...]) -> DataFrame:
        """One row per event of the blocks in ``value``."""
        keys = [f"key.{c}" for c in EVENT_COLUMNS if c in state.schema["key"].dataType.names]
        blocks = state.select(*keys, f"{value}.*")
        left = [c for c in blocks.columns if c not in names]
        return blocks.select(*left, F.inline(F.arrays_zip(*names))).select(*EVENT_COLUMNS)

    def user_events(self) -> DataFrame:
        return self._unfold(self._state("users", "retained"), "user_map_value", UserState.names)

    def item_events(self) -> DataFrame:
        return retain_items(self._unfold(self._state("items", "retained"), "user_map_value", ItemState.names), self.features)

    def history_log(self) -> DataFrame:
        return self._unfold(self._state("users", "tail"), "list_element", UserState.names)

    def sessions(self) -> DataFrame:
        """(user_id, last_ms, start_ms) of every user's current session."""
        return self._state("users", "span").select("key.user_id", "value.*")

    def watermark(self) -> int | None:
        return self.sessions().agg(F.max("last_ms")).first()[0]

    def user_features(self, queries: DataFrame) -> DataFrame:
        events = self.user_events().join(queries.select("user_id").distinct(), "user_id", "left_semi")
        return user_features(retain_users(events, self.features, self.hot_rows), queries, self.features, self.hot_rows)

    def user_histories(self, queries: DataFrame) -> DataFrame:
        events = self.history_log().join(queries.select("user_id").distinct(), "user_id", "left_semi")
        return user_histories(retain_history(events), queries, hot_rows=self.hot_rows)

    def item_features(self, queries: DataFrame) -> DataFrame:
        events = self.item_events().join(queries.select("item_id").distinct(), "item_id", "left_semi")
        return item_features(events, queries, self.features, self.hot_rows)
