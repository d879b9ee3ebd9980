"""Centroid clustering over Hilbert-ordered blocks with min/max boxes (zone maps).

Vectors are sorted once along a Hilbert curve through all their dimensions and cut into blocks of neighbours, each
with the box that holds it. In a round, a block compares its box with the centroids: beside the centroid ``b``
nearest to the box's middle, another centroid ``c`` stays a candidate only if somewhere in the box it is as near
as ``b``. ``|x-b|^2 - |x-c|^2`` is linear in ``x``, so its largest value over a box is exact and costs one sum per
dimension. Only candidates are compared with the block's vectors, as one matrix product in exact arithmetic.
On vectors without any cluster structure the boxes of 64 dimensions overlap and nearly all centroids stay
candidates; results are the same, only the saving differs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.common import materialised
from asofkit.llm.vectors import digest, finite, fresh, scaled, slot_totals

CURVE_BITS = 4
BLOCK_ROWS = 256
KEYED = "vec_id long, vector binary, curve binary"
BLOCK = "block long, vec_id array<bigint>, vectors binary, low binary, high binary"
RESULT = "vec_id long, cluster int, distance long"


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of every cell (rows of non-negative integers below ``2**bits``) on the Hilbert curve, as bytes in order."""
    x = cells.astype(np.uint8).T.copy()
    dims = len(x)
    top = 1 << (bits - 1)
    level = top
    while level > 1:
        below = np.uint8(level - 1)
        for i in range(dims):
            inverted = (x[i] & level) != 0
            swapped = np.where(inverted, 0, (x[0] ^ x[i]) & below).astype(np.uint8)
            x[0] ^= np.where(inverted, below, swapped).astype(np.uint8)
            if i:
                x[i] ^= swapped
        level >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flips = np.zeros(x.shape[1], np.uint8)
    level = top
    while level > 1:
        flips ^= np.where(x[-1] & level, level - 1, 0).astype(np.uint8)
        level >>= 1
    x ^= flips
    planes = np.stack([(x >> k) & 1 for k in range(bits - 1, -1, -1)])
    return np.packbits(planes.reshape(bits * dims, -1).T, axis=1)


def hilbert_blocks(vectors: DataFrame, dim: int, factor: int, rows: int, bits: int = CURVE_BITS) -> DataFrame:
    """Blocks of at most ``rows`` neighbours on the curve; equal places are spread by id, so no place fills a task."""
    ends = vectors.agg(F.min(F.array_min("embedding")).alias("low"), F.max(F.array_max("embedding")).alias("high")).first()
    low, width = float(ends.low or 0), float((ends.high or 0) - (ends.low or 0)) or 1.0
    cells = 1 << bits

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole = scaled(batch.column("embedding"), dim, factor)
            place = np.clip((whole / factor - low) / width * cells, 0, cells - 1).astype(np.int64)
            curve = hilbert_keys(place, bits)
            packed = whole.astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"),
                    pa.array([row.tobytes() for row in packed], pa.binary()),
                    pa.array([row.tobytes() for row in curve], pa.binary()),
                ],
                ["vec_id", "vector", "curve"],
            )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                own = np.frombuffer(b"".join(part.column("vector").to_pylist()), np.int32).reshape(-1, dim)
                ids = pa.ListArray.from_arrays([0, part.num_rows], part.column("vec_id"))
                boxes = [[own.tobytes()], [own.min(0).tobytes()], [own.max(0).tobytes()]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([fresh()]), ids, *(pa.array(b, pa.binary()) for b in boxes)],
                    [c.split()[0] for c in BLOCK.split(", ")],
                )

    spread = F.xxhash64("vec_id", "vector")
    ordered = vectors.select("vec_id", "embedding").mapInArrow(keyed, KEYED).withColumn("spread", spread)
    ordered = ordered.repartitionByRange("curve", "spread").sortWithinPartitions("curve", "spread")
    return materialised(ordered.drop("spread", "curve").mapInArrow(cut, BLOCK), "hilbert-blocks")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that may be nearest, ties to the smaller number, somewhere in the box; ascending."""
    middle = (low + high) // 2
    best = int(((centroids - middle) ** 2).sum(1).argmin())
    slope = centroids - centroids[best]
    square = (centroids**2).sum(1)
    lead = square[best] - square + 2 * np.maximum(slope * low, slope * high).sum(1)
    number = np.arange(len(centroids))
    return number[(lead > 0) | ((lead == 0) & (number <= best))]


def nearest(vectors: np.ndarray, centroids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest of the centroids ``among`` and its squared distance for every vector; exact in either arithmetic."""
    own = centroids[among]
    reach = max(np.abs(vectors).max(initial=0), np.abs(own).max(initial=0))
    # sums of products below 2^51 are exact in doubles, which multiply much faster
    kind = np.float64 if vectors.shape[1] * int(reach) ** 2 < 1 << 51 else np.int64
    partial = (own**2).sum(1) - 2 * (vectors.astype(kind) @ own.T.astype(kind)).astype(np.int64)
    first = partial.argmin(1)
    distance = partial[np.arange(len(vectors)), first] + (vectors**2).sum(1)
    return among[first], distance


def unpacked(batch: pa.RecordBatch, at: int, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    read = lambda name: np.frombuffer(batch.column(name)[at].as_buffer(), np.int32).astype(np.int64)
    return read("vectors").reshape(-1, dim), read("low"), read("high")


def clustered(
    embeddings: DataFrame,
    clusters: int = 40,
    rounds: int = 5,
    dim: int = 64,
    factor: int = 256,
    seed: str = "2",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``dim`` components, none null or non-finite; their integers ``floor(factor * x)``
    must stay below 2^26, beyond which the job stops. The start is the ``clusters`` kept vectors with the smallest
    sha256 of ``seed:vec_id``; a null id comes last, equal ids are ordered by their vectors, and fewer vectors make
    fewer centroids. Repeated rows count as often as they occur, distances that tie go to the smaller number, other
    columns are not looked at, and an empty table gives no rows.
    """
    kept = embeddings.select("vec_id", "embedding").filter(finite("embedding", dim))
    order = [F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), F.col("embedding").asc()]
    start = kept.orderBy(*order).limit(clusters).collect()  # a fixed number of rows
    if not start:
        return kept.select(
            "vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")),
            F.lit("").alias("centroid_sha256"),
        )
    centroids = np.floor(np.array([r.embedding for r in start], np.float64) * factor).astype(np.int64)
    blocks = hilbert_blocks(kept, dim, factor, block_rows)
    for _ in range(rounds):
        centroids = moved(blocks, centroids, dim)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                own, low, high = unpacked(batch, at, dim)
                cluster, distance = nearest(own, centroids, candidates(low, high, centroids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id")[at].values, pa.array(cluster.astype(np.int32)), pa.array(distance)],
                    ["vec_id", "cluster", "distance"],
                )

    assigned = blocks.mapInArrow(assign, RESULT)
    own = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).collect()  # one row per centroid
    facts = [(r.cluster, r.cluster_inertia, sum(x.cluster_inertia for x in own), digest(centroids[r.cluster])) for r in own]
    known = embeddings.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def moved(blocks: DataFrame, centroids: np.ndarray, dim: int) -> np.ndarray:
    """One round: every non-empty centroid becomes the componentwise floor of its vectors' mean."""
    slots = len(centroids) * (dim + 1)

    def totals(batch: pa.RecordBatch) -> np.ndarray:
        found = np.zeros((len(centroids), dim + 1), np.int64)
        for at in range(batch.num_rows):
            own, low, high = unpacked(batch, at, dim)
            cluster, _ = nearest(own, centroids, candidates(low, high, centroids))
            by = np.argsort(cluster, kind="stable")
            used, first = np.unique(cluster[by], return_index=True)
            found[used, :dim] += np.add.reduceat(own[by], first)
            found[used, dim] += np.diff(np.append(first, len(own)))
        return found.ravel()

    found = slot_totals(blocks.select("vectors", "low", "high"), totals, slots).reshape(-1, dim + 1)
    count = found[:, dim:]
    return np.where(count > 0, found[:, :dim] // np.maximum(count, 1), centroids)
