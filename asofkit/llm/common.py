"""What the corpus operators share: columns, row keys, words and the folder results are cut to."""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from asofkit.session import shared_dir

TASK_BYTES = 4 << 20
BATCH_BYTES, ARROW_DEFAULT = 8 << 20, "67108864b"
SLICE_ROWS = 128


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialised(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back, so that lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bounded_batches(spark: SparkSession) -> None:
    """Hand whole texts to Python in batches of ``BATCH_BYTES`` instead of Spark's 64 MB, unless the session says otherwise.

    A task holds a batch several times over: as it is filled, sent, received and taken apart.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key) == ARROW_DEFAULT:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def ascii_lower(text: Column) -> Column:
    """A-Z become a-z; all other characters stay, unlike with ``lower``, which does for pure ASCII only."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def row_key(text: str = "text") -> Column:
    """Tells rows of one id with different texts apart; equal rows share it and get equal results."""
    return F.xxhash64(F.col(text), F.length(text))


def byte_words(texts: pa.ChunkedArray | pa.Array) -> Iterator[list[bytes]]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text with A-Z lower-cased; a null text has none.

    ``bytes.lower`` and ``bytes.split`` know exactly these letters and these six separators.
    """
    for at in range(0, len(texts), SLICE_ROWS):  # few texts at a time as Python objects
        for raw in texts.slice(at, SLICE_ROWS).cast(pa.binary()).to_pylist():
            yield raw.lower().split() if raw else []


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if it has at most that many rows, counted; otherwise as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
