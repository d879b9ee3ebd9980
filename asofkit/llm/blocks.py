"""Blocks of documents that stay where they are while what they ask for travels: compressed numbers and bucketed tables."""

from __future__ import annotations

import uuid

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from asofkit.session import shared_dir


def squeezed(numbers: np.ndarray) -> bytes:
    """32-bit numbers compressed, their lowest bytes first, then the second ones and so on."""
    return zstandard.ZstdCompressor().compress(np.ascontiguousarray(numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unsqueezed(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def squeezed_keys(keys: np.ndarray) -> bytes:
    """Rising unsigned 64-bit numbers compressed by their differences."""
    steps = np.diff(keys, prepend=np.zeros(1, np.uint64)).astype("<u8")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unsqueezed_keys(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel().cumsum(dtype=np.uint64)


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """``df`` written to the shared folder in buckets of ``key``, so that a join on it leaves these rows where they are."""
    spark = df.sparkSession
    name = f"chunk_blocks_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    written = spark.table(name)
    written.schema  # noqa: B018  the files are known from here on, and the name is free again
    spark.sql(f"DROP TABLE {name}")  # the folder stays
    return written
