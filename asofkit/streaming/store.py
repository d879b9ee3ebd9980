"""Online feature store: retained events on shared storage, written by micro-batches.

Layout under ``root``:

* ``log/source=S/batch_id=N``  one micro-batch of one writer, overwritten when it is retried:
  ``accepted=true`` holds its events, ``accepted=false`` the raw values of rejected messages
* ``snapshot/id=K-...``        compacted ``users``, ``items`` and ``history``, and a ``manifest`` of the
  (source, batch) pairs that they cover
* ``commit/K``                 names the snapshot that became number K and its parent, number K - 1

Any number of workers may compact and clean up. A compaction starts from the newest commit and becomes the next one only
by creating its file, which one of them can; the others throw their work away. So every commit covers all that its parent
covered, and cleaning up removes only what a committed snapshot holds.

Writers need not know of each other: a source is one stream's id, so batch numbers that several
workers use, or that a stream with a new checkpoint starts again, never meet.

Nothing is keyed in executor state, so one very busy user or item never sits in a single state
partition. An event is identified by all its columns: delivering it again, in the same batch or a
later one, changes nothing. Late events are accepted at any lateness. Reads evaluate the batch
feature jobs over the retained events, so batch and stream agree by construction; they are exact
for any ``as_of`` at or after the entity's latest event.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from asofkit.definitions import STANDARD, FeatureSet
from asofkit.operators.order import top_per_group
from asofkit.operators.skew import HOT_ROWS, Hot, hot_keys, split_hot
from asofkit.operators.timeline import session_state
from asofkit.plans.features import item_features, user_features, user_histories
from asofkit.schema import EVENT_COLUMNS, EVENT_SCHEMA, HISTORY_LEN
from asofkit.session import checkpointed
from asofkit.sources.paths import child_names, create_new, delete_tree, path_exists, read_text, touch

_MARKER = "_SUCCESS"
_ONLY_REJECTED = "_ONLY_REJECTED"
DIRECT = "direct"
FEW_LASTS = 300_000  # (item, type) pairs up to which their last event times are broadcast
Batch = tuple[str, int]
MANIFEST = "source string, batch_id long"
LOG_SCHEMA = T.StructType(
    [*EVENT_SCHEMA, T.StructField("value", T.StringType()), T.StructField("accepted", T.BooleanType())]
)


def retain_users(events: DataFrame, features: FeatureSet = STANDARD, hot_rows: Hot = HOT_ROWS) -> DataFrame:
    """Per user: the current session and the longest user window before the last event.

    The session start is recomputed from the events at hand, so a late event that bridges two
    sessions moves it.
    """
    placed = session_state(events, features.session_gap_ms, hot_rows)
    ends = placed.groupBy("user_id").agg(
        F.max("ts_ms").alias("_last"), F.max("session_start_ms").alias("_start")
    )
    keep_from = F.least(F.col("_last") - features.user_retention_ms, F.col("_start"))
    bounds = ends.select("user_id", keep_from.alias("_from"))
    kept = events.join(bounds, "user_id").where(F.col("ts_ms") >= F.col("_from"))
    return kept.select(*EVENT_COLUMNS)


def retain_items(events: DataFrame, features: FeatureSet = STANDARD) -> DataFrame:
    """Per item and event type: the longest item window before the last event."""
    last = checkpointed(events.groupBy("item_id", "event").agg(F.max("ts_ms").alias("_last")))
    few = last.count() <= FEW_LASTS
    kept = events.join(F.broadcast(last) if few else last, ["item_id", "event"]).where(
        F.col("ts_ms") >= F.col("_last") - features.item_retention_ms
    )
    return kept.select(*EVENT_COLUMNS)


def retain_history(events: DataFrame, length: int = HISTORY_LEN) -> DataFrame:
    """Per user: the last ``length`` events by (ts_ms, item_id, event), of any age."""
    latest_first = [F.desc("ts_ms"), F.desc("item_id"), F.desc("event"), F.desc("transaction_id")]
    kept = top_per_group(events, ["user_id"], latest_first, length, "_r")
    return kept.select(*EVENT_COLUMNS)


def distinct_by_user(
    events: DataFrame, step: Callable[[DataFrame, Hot], DataFrame], hot_rows: int | None = HOT_ROWS
) -> DataFrame:
    """``step``, which works per user, over the events without duplicates.

    Rows of ordinary users are dealt by user once, for dropping duplicates and for all that follows; those of users with more
    than ``hot_rows`` rows, duplicates included, are dealt by all columns.
    """
    busy = None if hot_rows is None else hot_keys(events, "user_id", hot_rows)
    ordinary, heavy = split_hot(events, "user_id", busy)
    found = step(ordinary.repartition("user_id").dropDuplicates(EVENT_COLUMNS), None)
    return found if heavy is None else found.unionByName(step(heavy.dropDuplicates(EVENT_COLUMNS), busy))


@dataclass(frozen=True)
class Prepared:
    """A snapshot that is written and waits for its number."""

    number: int
    snapshot: str


class OnlineStore:
    def __init__(
        self,
        spark: SparkSession,
        root: str,
        features: FeatureSet = STANDARD,
        hot_rows: int | None = HOT_ROWS,
    ) -> None:
        if len(root.rstrip("/").split("/")) < 3:
            raise ValueError("the store needs a folder of its own")
        self.spark, self.root = spark, root.rstrip("/")
        self.features, self.hot_rows = features, hot_rows

    # batches ------------------------------------------------------------------

    def write_batch(self, decoded: DataFrame, batch_id: int, source: str = DIRECT) -> None:
        """``foreachBatch`` sink of the stream ``source``: retrying a batch rewrites the same folder."""
        raw = F.when(~F.col("accepted"), F.col("value")).cast("string")
        # one pass without a shuffle; duplicates are dropped by readers and by compaction
        decoded.select(*EVENT_COLUMNS, raw.alias("value"), "accepted").write.mode(
            "overwrite"
        ).partitionBy("accepted").parquet(self._folder((source, batch_id)))

    def append(self, events: DataFrame, batch_id: int, source: str = DIRECT) -> None:
        self.write_batch(events.withColumns({"accepted": F.lit(True), "value": F.lit(None)}), batch_id, source)

    def _folder(self, batch: Batch) -> str:
        return f"{self.root}/log/source={batch[0]}/batch_id={batch[1]}"

    def batches(self) -> list[Batch]:
        """Completed (source, batch) pairs that still hold events."""
        found = []
        for source in child_names(self.spark, f"{self.root}/log"):
            for name in child_names(self.spark, f"{self.root}/log/{source}"):
                batch = source.split("=")[1], int(name.split("=")[1])
                inside = child_names(self.spark, self._folder(batch))
                if _MARKER in inside and _ONLY_REJECTED not in inside:
                    found.append(batch)
        return sorted(found)

    def commits(self) -> list[int]:
        """Numbers of the committed snapshots, oldest first."""
        return sorted(int(n) for n in child_names(self.spark, f"{self.root}/commit") if n.isdigit())

    def _commit(self, number: int) -> str:
        """The snapshot that the commit names."""
        return json.loads(read_text(self.spark, f"{self.root}/commit/{number:012d}"))["snapshot"]

    def _head(self) -> tuple[int, str | None]:
        numbers = self.commits()
        return (numbers[-1], self._commit(numbers[-1])) if numbers else (0, None)

    def _covered(self, snapshot: str | None) -> set[Batch]:
        if snapshot is None:
            return set()
        rows = self.spark.read.schema(MANIFEST).parquet(f"{self.root}/snapshot/{snapshot}/manifest")
        return {(r.source, r.batch_id) for r in rows.collect()}

    def _state(self) -> tuple[int, str | None, set[Batch], list[Batch]]:
        """(commit, snapshot, covered batches, batches it lacks).

        The batches are listed before the commit is read: one that is cleaned up in between is covered by then.
        """
        listed = self.batches()
        number, snapshot = self._head()
        covered = self._covered(snapshot)
        return number, snapshot, covered, [b for b in listed if b not in covered]

    def pending(self) -> list[Batch]:
        """Batches that the newest commit does not cover."""
        return self._state()[3]

    def prepare(self) -> Prepared | None:
        """Write the next snapshot without making it visible; none if nothing is pending."""
        number, snapshot, covered, pending = self._state()
        if not pending:
            return None
        name = f"id={number + 1:012d}-{uuid.uuid4().hex[:8]}"
        target = f"{self.root}/snapshot/{name}"
        users, items, history = (self._events(t, snapshot, pending) for t in ("users", "items", "history"))
        self._retained_users(users).write.parquet(f"{target}/users")
        self._retained_items(items).write.parquet(f"{target}/items")
        self._retained_history(history).write.parquet(f"{target}/history")
        manifest = self.spark.createDataFrame(sorted(covered | set(pending)), MANIFEST)
        manifest.coalesce(1).write.parquet(f"{target}/manifest")
        return Prepared(number + 1, name)

    def commit(self, prepared: Prepared) -> bool:
        """Make a prepared snapshot the newest one; false, and it is deleted, if another has taken its number."""
        text = json.dumps({"snapshot": prepared.snapshot, "parent": prepared.number - 1})
        if create_new(self.spark, f"{self.root}/commit/{prepared.number:012d}", text):
            return True
        delete_tree(self.spark, f"{self.root}/snapshot/{prepared.snapshot}")
        return False

    def compact(self) -> bool:
        """Fold all completed batches into a new snapshot. False if nothing is pending or another worker was first."""
        before = self._head()[0]
        try:
            prepared = self.prepare()
        except Exception:
            # the other worker may have cleaned up what was being read
            if self._head()[0] == before:
                raise
            return False
        return prepared is not None and self.commit(prepared)

    def vacuum(self, keep: int = 0) -> int:
        """Delete what a commit has replaced: events of its batches, older snapshots, snapshots that came too late.

        With ``keep`` the last so many replaced commits stay readable for jobs that started from them. Rejected messages
        stay for inspection, unfinished snapshots of the next number for their writers, commits for ever.
        """
        numbers = self.commits()
        if len(numbers) <= keep:
            return 0
        number = numbers[-1 - keep]
        snapshots = {n: self._commit(n) for n in numbers if n >= number}
        old = []
        for batch in sorted(self._covered(snapshots[number]) & set(self.batches())):
            folder = self._folder(batch)
            if "accepted=false" in child_names(self.spark, folder):
                touch(self.spark, f"{folder}/{_ONLY_REJECTED}")
                old.append(f"{folder}/accepted=true")
            else:
                old.append(folder)
        for name in child_names(self.spark, f"{self.root}/snapshot"):
            own = int(name.split("=")[1].split("-")[0])
            if own <= numbers[-1] and name not in snapshots.values():
                old.append(f"{self.root}/snapshot/{name}")
        return sum(bool(delete_tree(self.spark, path)) for path in old)

    def clear(self) -> bool:
        """Remove this store's folders and nothing else."""
        parts = ("log", "snapshot", "commit")
        return any([delete_tree(self.spark, f"{self.root}/{part}") for part in parts])

    # events at hand -----------------------------------------------------------

    def _events(self, table: str, snapshot: str | None, batches: list[Batch]) -> DataFrame:
        """Snapshot ``table`` plus the batches that it lacks."""
        events = self._log(batches, True)
        if snapshot is not None:
            path = f"{self.root}/snapshot/{snapshot}/{table}"
            events = events.unionByName(self.spark.read.schema(EVENT_SCHEMA).parquet(path))
        return events

    def _distinct(self, table: str, snapshot: str | None, batches: list[Batch]) -> DataFrame:
        return self._events(table, snapshot, batches).dropDuplicates(EVENT_COLUMNS)

    def merged(self, table: str) -> DataFrame:
        """Snapshot and newer batches without duplicates and before trimming."""
        _, snapshot, _, pending = self._state()
        return self._distinct(table, snapshot, pending)

    def _at_hand(self, table: str) -> DataFrame:
        """The same with duplicates."""
        _, snapshot, _, pending = self._state()
        return self._events(table, snapshot, pending)

    def _retained_users(self, events: DataFrame) -> DataFrame:
        return distinct_by_user(events, lambda rows, hot: retain_users(rows, self.features, hot), self.hot_rows)

    def _retained_items(self, events: DataFrame) -> DataFrame:
        """What is kept depends on each type's last event alone, so duplicates are dropped from what is kept."""
        return retain_items(events, self.features).dropDuplicates(EVENT_COLUMNS)

    def _retained_history(self, events: DataFrame) -> DataFrame:
        return distinct_by_user(events, lambda rows, _: retain_history(rows), self.hot_rows)

    def _log(self, batches: list[Batch], accepted: bool) -> DataFrame:
        columns = EVENT_COLUMNS if accepted else ["value"]
        if not batches:
            return self.spark.createDataFrame([], LOG_SCHEMA).select(*columns)
        reader = self.spark.read.schema(LOG_SCHEMA).option("basePath", f"{self.root}/log")
        rows = reader.parquet(*[self._folder(b) for b in batches]).where(F.col("accepted") == accepted)
        return rows.select(*columns)

    def user_events(self) -> DataFrame:
        return self._retained_users(self._at_hand("users"))

    def item_events(self) -> DataFrame:
        return self._retained_items(self._at_hand("items"))

    def history_log(self) -> DataFrame:
        return self._retained_history(self._at_hand("history"))

    def rejected(self) -> DataFrame:
        """Raw values of all rejected messages."""
        folder = f"{self.root}/log"
        if not path_exists(self.spark, folder):
            return self._log([], False)
        rows = self.spark.read.schema(LOG_SCHEMA).parquet(folder).where(~F.col("accepted"))
        return rows.select("value")

    def watermark(self) -> int | None:
        """Latest event time seen; duplicates do not matter to it."""
        _, snapshot, _, pending = self._state()
        return self._events("users", snapshot, pending).agg(F.max("ts_ms")).first()[0]

    # reads -------------------------------------------------------------------

    def _wanted(self, events: DataFrame, queries: DataFrame, key: str) -> DataFrame:
        return events.join(queries.select(key).distinct(), key, "left_semi")

    def user_features(self, queries: DataFrame) -> DataFrame:
        """``queries``: (user_id, as_of_ms)."""
        events = self._wanted(self.merged("users"), queries, "user_id")
        return user_features(events, queries, self.features, self.hot_rows)

    def user_histories(self, queries: DataFrame) -> DataFrame:
        events = self._wanted(self.merged("history"), queries, "user_id")
        return user_histories(retain_history(events), queries, hot_rows=self.hot_rows)

    def item_features(self, queries: DataFrame, names: list[str] | None = None) -> DataFrame:
        """``queries``: (item_id, as_of_ms); ``names`` limits the windows that are computed."""
        features = self.features if names is None else self.features.only_items(names)
        events = self._wanted(self.merged("items"), queries, "item_id")
        return item_features(events, queries, features, self.hot_rows)
