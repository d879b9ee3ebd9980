"""A topic of key/value messages in a shared folder, as a Spark data source with offsets.

Registered as ``file_topic``, it reads and writes in batch and as a stream, so that jobs written for a broker run, restart
and replay without one. Options: ``path``; for writing also ``partitions`` (4) and, as a stream, ``stream``, a name that
stays the same when the query is restarted. Messages of one key keep their partition.

A partition is a folder of segments named ``first-count.jsonl``. Tasks stage their segments; the driver gives them offsets when
all tasks are done, so a failed or retried task leaves nothing. A stream's batch is numbered in the topic and
published once, however often it is retried. One query at a time may write to a topic; any number may read.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceStreamWriter,
    DataSourceWriter,
    InputPartition,
    WriterCommitMessage,
)

from asofkit.sources.messages import encode

SCHEMA = "key string, value string, partition int, offset long"
SEGMENT = re.compile(r"(\d+)-(\d+)\.jsonl$")
SEGMENT_ROWS = 100_000


class Topic:
    """The folder of a topic, on any file system that Arrow knows by its URI."""

    def __init__(self, options: dict[str, str]) -> None:
        path = options["path"]
        self.fs, self.root = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
        self.wanted = int(options.get("partitions", 4))

    def _children(self, folder: str) -> list[pafs.FileInfo]:
        return self.fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))

    def partitions(self) -> int:
        """Partitions of the topic, or those it will be made with."""
        return sum(f.base_name.startswith("p=") for f in self._children(self.root)) or self.wanted

    def segments(self, partition: int) -> list[tuple[int, int, str]]:
        """(first offset, messages, path) in order."""
        found = [(SEGMENT.match(f.base_name), f.path) for f in self._children(f"{self.root}/p={partition}")]
        return sorted((int(m[1]), int(m[2]), path) for m, path in found if m)

    def ends(self) -> list[int]:
        """The next offset of every partition."""
        last = [self.segments(p)[-1:] for p in range(self.partitions())]
        return [s[0][0] + s[0][1] if s else 0 for s in last]

    def read(self, path: str, first: int, start: int, end: int) -> Iterator[tuple[str | None, str | None, int]]:
        with self.fs.open_input_stream(path) as stream:
            offset, rest = first, b""
            while block := stream.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    if start <= offset < end:
                        yield (*json.loads(line), offset)
                    offset += 1

    def stage(self, rows: Iterator[Row], batch: str) -> list[tuple[int, str, int]]:
        """Write a task's messages; (partition, path, messages) of what waits to be published."""
        partitions, open_files, done = self.partitions(), {}, []

        def close(partition: int) -> None:
            stream, path, count = open_files.pop(partition)
            stream.close()
            done.append((partition, path, count))

        for row in rows:
            partition = crc32((row["key"] or "").encode()) % partitions
            if partition not in open_files:
                folder = f"{self.root}/_staged/{batch}"
                self.fs.create_dir(folder)
                path = f"{folder}/{partition}-{uuid.uuid4().hex}"
                open_files[partition] = [self.fs.open_output_stream(path), path, 0]
            entry = open_files[partition]
            entry[0].write(json.dumps([row["key"], row["value"]]).encode() + b"\n")
            entry[2] += 1
            if entry[2] == SEGMENT_ROWS:
                close(partition)
        for partition in list(open_files):
            close(partition)
        return done

    def publish(self, staged: list[tuple[int, str, int]]) -> None:
        ends = self.ends()
        for partition in range(self.partitions()):
            self.fs.create_dir(f"{self.root}/p={partition}")
        for partition, path, count in sorted(staged):
            self.fs.move(path, f"{self.root}/p={partition}/{ends[partition]:015d}-{count}.jsonl")
            ends[partition] += count

    def drop(self, batch: str) -> None:
        if self.fs.get_file_info(f"{self.root}/_staged/{batch}").type != pafs.FileType.NotFound:
            self.fs.delete_dir(f"{self.root}/_staged/{batch}")

    # what a stream has published -------------------------------------------------

    def plan(self, stream: str, batch_id: int, staged: list[tuple[int, str, int]]) -> list[tuple[int, str, str]]:
        """(partition, staged path, final path) of a batch, written down before the first move so that a retry ends it."""
        note = f"{self.root}/_streams/{stream}/{batch_id}"
        if self.fs.get_file_info(note).type == pafs.FileType.File:
            with self.fs.open_input_stream(note) as f:
                return json.loads(f.read())
        ends, moves = self.ends(), []
        for partition, path, count in sorted(staged):
            moves.append((partition, path, f"{self.root}/p={partition}/{ends[partition]:015d}-{count}.jsonl"))
            ends[partition] += count
        self.fs.create_dir(f"{self.root}/_streams/{stream}")
        with self.fs.open_output_stream(f"{note}.new") as f:
            f.write(json.dumps(moves).encode())
        self.fs.move(f"{note}.new", note)
        return moves

    def publish_once(self, stream: str, batch_id: int, staged: list[tuple[int, str, int]]) -> None:
        for partition in range(self.partitions()):
            self.fs.create_dir(f"{self.root}/p={partition}")
        for _, path, target in self.plan(stream, batch_id, staged):
            if self.fs.get_file_info(path).type == pafs.FileType.File:
                self.fs.move(path, target)


@dataclass
class Span(InputPartition):
    """Offsets of one partition, from ``start`` to before ``end``, out of one segment."""

    partition: int
    path: str
    first: int
    start: int
    end: int


def spans(topic: Topic, starts: list[int], ends: list[int]) -> list[Span]:
    found = []
    for partition, (start, end) in enumerate(zip(starts, ends, strict=True)):
        for first, count, path in topic.segments(partition):
            if max(first, start) < min(first + count, end):
                found.append(Span(partition, path, first, max(first, start), min(first + count, end)))
    return found


def rows(topic: Topic, span: Span) -> Iterator[tuple]:
    for key, value, offset in topic.read(span.path, span.first, span.start, span.end):
        yield key, value, span.partition, offset


class TopicReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[Span]:
        topic = Topic(self.options)
        ends = topic.ends()
        # a source without rows still needs a partition
        return spans(topic, [0] * len(ends), ends) or [Span(0, "", 0, 0, 0)]

    def read(self, span: Span) -> Iterator[tuple]:
        if span.path:
            yield from rows(Topic(self.options), span)


class TopicStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def initialOffset(self) -> dict:
        return {"ends": []}

    def latestOffset(self) -> dict:
        return {"ends": Topic(self.options).ends()}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        starts = start["ends"] + [0] * (len(end["ends"]) - len(start["ends"]))
        return spans(Topic(self.options), starts, end["ends"])

    def read(self, span: Span) -> Iterator[tuple]:
        yield from rows(Topic(self.options), span)

    def commit(self, end: dict) -> None: ...


@dataclass
class Staged(WriterCommitMessage):
    parts: list[tuple[int, str, int]]


class TopicWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.batch = options, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> Staged:
        return Staged(Topic(self.options).stage(iterator, self.batch))

    def commit(self, messages: list[Staged | None]) -> None:
        topic = Topic(self.options)
        topic.publish([part for m in messages if m for part in m.parts])
        topic.drop(self.batch)

    def abort(self, messages: list[Staged | None]) -> None:
        Topic(self.options).drop(self.batch)


class TopicStreamWriter(DataSourceStreamWriter):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.stream = options, options["stream"]
        self.attempt = f"{self.stream}-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Staged:
        return Staged(Topic(self.options).stage(iterator, self.attempt))

    def commit(self, messages: list[Staged | None], batchId: int) -> None:
        Topic(self.options).publish_once(self.stream, batchId, [part for m in messages if m for part in m.parts])

    def abort(self, messages: list[Staged | None], batchId: int) -> None: ...


class FileTopic(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_topic"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TopicReader:
        return TopicReader(dict(self.options))

    def streamReader(self, schema) -> TopicStreamReader:
        return TopicStreamReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> TopicWriter:
        if overwrite:
            raise ValueError("a topic can only be appended to")
        return TopicWriter(dict(self.options))

    def streamWriter(self, schema, overwrite: bool) -> TopicStreamWriter:
        return TopicStreamWriter(dict(self.options))


def read_file_topic(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(FileTopic)
    return spark.read.format("file_topic").load(path)


def stream_file_topic(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(FileTopic)
    return spark.readStream.format("file_topic").load(path)


def publish_to_file_topic(events: DataFrame, path: str, partitions: int = 4) -> None:
    events.sparkSession.dataSource.register(FileTopic)
    encode(events).write.format("file_topic").option("partitions", partitions).mode("append").save(path)
