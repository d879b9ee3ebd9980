"""What the vector operators share: valid rows, exact integer components, slot totals and digests."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Integer components have to stay below this, so that squared distances and sums are exact in 64 bits.
LARGEST = 1 << 26


def finite(vector: str, dim: int) -> Column:
    """True for vectors of ``dim`` components, none of them null, NaN or infinite; false for null vectors."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & good, F.lit(False))


def smallest_first(ids: str, vector: str) -> list[Column]:
    """Ids ascending, a null id last, rows of one id by their vectors."""
    return [F.col(ids).asc_nulls_last(), F.col(vector).asc()]


def scaled(column: pa.Array, dim: int, factor: int) -> np.ndarray:
    """``floor(factor * x)`` of every component, one row per vector."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.floor(flat * factor)
    if len(whole) and np.abs(whole).max() >= LARGEST:
        raise ValueError(f"a component times {factor} is {LARGEST} or more")
    return whole.astype(np.int64).reshape(-1, dim)


def fresh() -> int:
    """A number for a block; blocks are written once, so a number is never drawn again for the same rows."""
    return uuid.uuid4().int >> 65


def slot_totals(blocks: DataFrame, totals: Callable[[pa.RecordBatch], np.ndarray], slots: int) -> np.ndarray:
    """Integer totals in a fixed number of slots over all blocks: one array per task, then one sum per slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(slots, np.int64)
        for batch in batches:
            found += totals(batch)
        used = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(found[used])], ["slot", "total"])

    out = np.zeros(slots, np.int64)
    for row in blocks.mapInArrow(run, "slot long, total long").groupBy("slot").agg(F.sum("total").alias("total")).collect():
        out[row.slot] = row.total
    return out


def digest(values: np.ndarray) -> str:
    """Lowercase hex sha256 of the decimal integers joined by commas."""
    return hashlib.sha256(",".join(map(str, values.ravel().tolist())).encode()).hexdigest()
