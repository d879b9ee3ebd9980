"""Exact and cell-restricted top-k by inner product.

The exact form orders items by their norm and cuts them into super-blocks of a fixed number of blocks. A task holds one
chunk of queries and streams the blocks of some super-blocks past it, keeping the best ``k`` items per query. All chunks
meet the super-block of the largest norms first; by Cauchy-Schwarz, a query then needs another one only where
``|query| * largest norm`` reaches its k-th best score, and a task leaves out blocks, and queries, that cannot.
Blocks are exchanged for a few chunks only. With more queries, the task of a chunk reads all blocks where they were written, in
falling order of their norms, until no query can want the next one; vectors are then exchanged for the sort alone, and finished lists,
ranked, leave the task.

The cell-restricted form sends a chunk the blocks of the cells that its queries visit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.operators.order import top_per_group
from asofkit.operators.places import NONE, ExactBest
from asofkit.session import checkpointed

BLOCK_ROWS = 2048
SUPER_BLOCKS = 64  # blocks per super-block
CHUNK_ROWS = 16_384  # queries of a task at most: 8 MB of numbers at 64 dimensions; all items are sent once per chunk
SENT_CHUNKS = 4  # chunks of BLOCK_ROWS queries that the blocks are sent to; tasks of more queries read them
READ_NUMBERS = 1 << 22  # numbers in the queries of a task that reads all blocks, at most: 32 MB, 65,536 queries at 64 dimensions
SLICE_ROWS = 512  # queries that are scored at a time
CHUNK_CELLS = 2_000_000  # (query, rank) places of a task: 32 MB of ids and scores
PAIR_ROWS = 100_000  # (chunk, super-block) pairs, two numbers each, up to which they are broadcast
ROWS_OUT = 100_000  # rows of a batch that leaves a task
SAFE = 1 + 1e-9  # roundings never leave a block out
_SCORED = "query_id long, item_id long, score double"
_PART = "chunk long, super long, seq long, ids binary, vecs binary, limits binary"
_VISIT = ["chunk", "lane", "super", "seq", "ids", "vecs", "limits"]
_FOUND = "chunk long, queries binary, reach double, floors binary, ids binary, scores binary"
_LISTS = "query_id long, items array<long>, scores array<double>"


# --- exact ---------------------------------------------------------------------------------------


class KBest:
    """The best ``k`` (item, score) of every query so far, in no order; ties go to the smaller item id."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.scores = np.full((n, k), -np.inf)
        self.ids = np.full((n, k), NONE)
        self.floors = np.full(n, -np.inf)  # the k-th best scores

    def add(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, floors: np.ndarray) -> None:
        """``scores`` of the queries ``rows`` with the items ``ids``; those below ``floors`` cannot be wanted, undefined ones are not."""
        scores = np.where(np.isnan(scores), -np.inf, scores)
        hit = scores.max(1) >= np.maximum(self.floors[rows], floors)
        own = rows[hit]
        if not len(own):
            return
        both = np.hstack([self.scores[own], scores[hit]])
        at = both.shape[1] - self.k
        best = np.argpartition(both, at, axis=1)[:, at:]
        kept = np.take_along_axis(both, best, 1)
        low = kept.min(1)
        open_ties = (both == low[:, None]).sum(1) > (kept == low[:, None]).sum(1)
        for r in np.flatnonzero(open_ties & (low > -np.inf)):
            names = np.concatenate([self.ids[own[r]], ids])
            best[r] = np.lexsort((names, -both[r]))[: self.k]
        old = np.take_along_axis(self.ids[own], np.minimum(best, self.k - 1), 1)
        self.scores[own] = kept = np.take_along_axis(both, best, 1)
        names = np.where(best < self.k, old, ids[np.maximum(best - self.k, 0)])
        self.ids[own] = np.where(np.isneginf(kept), NONE, names)
        self.floors[own] = low


def _matrix(raw: pa.Array, n: int) -> np.ndarray:
    return raw.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def numbers(raw: bytes, n: int, dim: int) -> np.ndarray:
    """``n`` vectors sent as 4- or 8-byte numbers."""
    return np.frombuffer(raw, np.float32 if len(raw) == 4 * n * dim else np.float64).reshape(n, dim).astype(np.float64)


def _place(seq: int) -> int:
    """A number that no other partition gives."""
    return (TaskContext.get().partitionId() << 32) + seq


def norm_blocks(items: DataFrame, block_rows: int = BLOCK_ROWS, super_blocks: int = SUPER_BLOCKS) -> DataFrame:
    """(super, seq, ids, vecs, limits): items in falling order of their norms, a block per row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        seq = 0

        def blocks(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal waiting, seq
            table = pa.Table.from_batches(waiting).combine_chunks()
            whole = table.num_rows if last else table.num_rows // block_rows * block_rows
            for at in range(0, whole, block_rows):
                part = table.slice(at, min(block_rows, whole - at)).combine_chunks().to_batches()[0]
                ids = part.column("item_id").to_numpy().astype(np.int64)
                vecs = part.column("vec").flatten().to_numpy(zero_copy_only=False)  # as narrow as they are given
                top = np.fmax.reduce(np.sqrt((_matrix(part.column("vec"), len(ids)) ** 2).sum(1)), initial=0.0)  # undefined ones aside
                yield _row([0], [_place(seq // super_blocks)], [seq], ids, vecs, np.array([top]))
                seq += 1
            waiting = table.slice(whole).to_batches()

        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= block_rows:
                yield from blocks(False)
        if sum(b.num_rows for b in waiting):
            yield from blocks(True)

    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    rows = items.select("item_id", "vec", norm.alias("_norm")).where(F.col("vec").isNotNull())
    ordered = rows.repartitionByRange(F.desc("_norm"), "item_id").sortWithinPartitions(F.desc("_norm"), "item_id")
    return checkpointed(ordered.drop("_norm").mapInArrow(cut, _PART)).drop("chunk")


def _row(chunk: list, super_id: list, seq: list, ids: np.ndarray, vecs: np.ndarray, limits: np.ndarray) -> pa.RecordBatch:
    binary = [pa.array([x.tobytes()], pa.binary()) for x in (ids, vecs, limits)]
    return pa.RecordBatch.from_arrays(
        [*(pa.array(x, pa.int64()) for x in (chunk, super_id, seq)), *binary], ["chunk", "super", "seq", "ids", "vecs", "limits"]
    )


def query_chunks(queries: DataFrame, rows: int, cells: str | None = None) -> DataFrame:
    """(chunk, ids, vecs, limits): at most ``rows`` queries per row with their norms and, at first, no floors, or with their cells."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids = part.column("query_id").to_numpy().astype(np.int64)
                vecs = _matrix(part.column("vec"), len(ids))
                if cells is None:
                    limits = np.concatenate([np.sqrt((vecs**2).sum(1)), np.full(len(ids), -np.inf)])
                else:
                    limits = part.column(cells).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                yield _row([_place(seq)], [0], [-1], ids, vecs, limits)
                seq += 1

    known = queries.select("query_id", "vec", *([cells] if cells else [])).where(F.col("vec").isNotNull())
    dealt = known.repartition(max(1, -(-known.count() // rows)))
    return checkpointed(dealt.mapInArrow(cut, _PART)).drop("super", "seq")


def query_parts(queries: DataFrame, parts: int) -> DataFrame:
    """(ids, vecs): queries dealt evenly over partitions, each of which is one row."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]
        if own:
            ids = np.concatenate([b.column("query_id").to_numpy().astype(np.int64) for b in own])
            vecs = np.concatenate([_matrix(b.column("vec"), b.num_rows) for b in own])
            binary = [pa.array([x.tobytes()], pa.binary()) for x in (ids, vecs)]
            yield pa.RecordBatch.from_arrays(binary, ["ids", "vecs"])

    known = queries.select("query_id", "vec").where(F.col("vec").isNotNull())
    return checkpointed(known.repartition(parts).mapInArrow(whole, "ids binary, vecs binary"))


def _best_of_all(k: int, supers: list[tuple[float, int]]):
    """Streams (queries, block) pairs, the queries always the same; ``supers`` are (-largest norm, number), in order."""

    def run(pairs: Iterator) -> Iterator[tuple]:
        ids = norms = best = places = now = None
        seen: set[int] = set()
        ahead = 0  # all super-blocks before this one have been met

        def asking(top: float) -> np.ndarray:
            return np.flatnonzero((norms * top * SAFE >= places.floors) | (places.floors <= 0))

        for part, block in pairs:
            if best is None:
                ids = np.frombuffer(part["ids"], np.int64)
                best = ExactBest(np.frombuffer(part["vecs"], np.float64).reshape(len(ids), -1), k)
                norms, places = best.norms, best.places
            if block["super"] != now:
                seen.add(now)
                now = block["super"]
                while supers[ahead][1] in seen:
                    ahead += 1
                places.settle_waiting()
                if not len(asking(-supers[ahead][0])):
                    break
            own = np.frombuffer(block["ids"], np.int64)
            rows = asking(np.frombuffer(block["limits"], np.float64)[0])
            vecs = numbers(block["vecs"], len(own), best.vecs.shape[1])
            for some in (rows[i : i + SLICE_ROWS] for i in range(0, len(rows), SLICE_ROWS)):
                best.add(some, own, vecs)
        if best is not None:
            found, scores = places.ranked()
            yield ids.tobytes(), found.tobytes(), scores.tobytes()

    return run


def _read_by_all(queries: DataFrame, blocks: DataFrame, k: int, parts: int, supers: list[tuple[float, int]]) -> DataFrame:
    """Best items of every query: each part of the queries is a task that reads the written blocks, none are exchanged."""
    pairs = query_parts(queries, parts).rdd.cartesian(blocks.rdd.coalesce(1))
    found = pairs.mapPartitions(_best_of_all(k, supers))
    return queries.sparkSession.createDataFrame(found, "queries binary, ids binary, scores binary", verifySchema=False)


def _best_of_visits(k: int, by_cell: bool = False):
    """Streams each (chunk, lane) group of sorted rows: the chunk of queries first, then blocks of falling norms."""

    def done(key, ids: np.ndarray, norms: np.ndarray, best: KBest) -> pa.RecordBatch:
        floors = best.floors
        open_ended = (norms == 0) | np.isinf(floors)
        reach = np.where(open_ended, -np.inf, floors / np.where(norms == 0, 1, norms)).min(initial=np.inf)
        binary = [pa.array([x.tobytes()], pa.binary()) for x in (floors, best.ids, best.scores)]
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]]), pa.array([ids.tobytes()], pa.binary()), pa.array([float(reach)]), *binary],
            [c.split()[0] for c in _FOUND.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = ids = probes = norms = floors = cells = best = None
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                own = np.frombuffer(row["ids"], np.int64)
                limits = np.frombuffer(row["limits"], np.int64 if by_cell else np.float64)
                if row["seq"] < 0:
                    if best is not None:
                        yield done(key, ids, norms, best)
                    probes = np.frombuffer(row["vecs"], np.float64).reshape(len(own), -1)
                    key, ids, best = (row["chunk"], row["lane"]), own, KBest(len(own), k)
                    norms, floors = (np.zeros(len(own)), np.full(len(own), -np.inf)) if by_cell else (limits[: len(own)], limits[len(own) :])
                    cells = limits.reshape(len(own), -1) if by_cell else None
                    continue
                if best is None or key != (row["chunk"], row["lane"]):
                    continue  # no query asks for it after all
                if by_cell:
                    rows = np.flatnonzero((cells == row["super"]).any(1))
                else:
                    need = np.maximum(floors, best.floors)
                    rows = np.flatnonzero((norms * limits[0] * SAFE >= need) | (need <= 0))
                vecs = numbers(row["vecs"], len(own), probes.shape[1])
                for some in (rows[i : i + SLICE_ROWS] for i in range(0, len(rows), SLICE_ROWS)):
                    best.add(some, own, probes[some] @ vecs.T, floors[some])
        if best is not None:
            yield done(key, ids, norms, best)

    return run


def _visited(query_rows: DataFrame, pairs: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Best items of every (chunk, lane) visit; ``query_rows`` has a row per visit, ``pairs`` its super-blocks."""
    few = pairs.limit(PAIR_ROWS + 1).count() <= PAIR_ROWS
    wanted = blocks.join(F.broadcast(pairs) if few else pairs, "super").select(_VISIT)
    first = F.lit(-1).cast("long")
    together = query_rows.withColumns({"super": first, "seq": first}).select(_VISIT).unionByName(wanted)
    ordered = together.repartition("chunk", "lane").sortWithinPartitions("chunk", "lane", "super", "seq")
    return ordered.mapInArrow(_best_of_visits(k), _FOUND)


def chunk_rows(queries: DataFrame, k: int) -> int:
    """Queries per chunk: as many as a task may hold, fewer where that would leave tasks without any."""
    tasks = 2 * queries.sparkSession.sparkContext.defaultParallelism
    return max(1, min(CHUNK_ROWS, CHUNK_CELLS // k, max(BLOCK_ROWS, -(-queries.count() // tasks))))


def read_rows(n: int, dim: int, k: int, tasks: int) -> int:
    """Queries of a task that reads all blocks: no more than it may hold, no fewer than are scored at a time."""
    return max(1, min(READ_NUMBERS // max(1, dim), CHUNK_CELLS // k, max(SLICE_ROWS, -(-n // tasks))))


def super_block_candidates(
    queries: DataFrame, items: DataFrame, k: int, block_rows: int = BLOCK_ROWS, super_blocks: int = SUPER_BLOCKS
) -> DataFrame:
    """(query_id, item_id, score): ``k`` rows per query, and where queries are few, as many per lane of super-blocks.

    For few queries, super-blocks are dealt over no more lanes than it takes to keep all tasks busy: ``k`` rows come from the
    largest norms and at most ``k`` from every lane of the others.
    """
    packed, rows = _searched(queries, items, k, block_rows, super_blocks)
    return rows if packed is None else _rows_of(packed, k)


def _searched(
    queries: DataFrame, items: DataFrame, k: int, block_rows: int, super_blocks: int
) -> tuple[DataFrame | None, DataFrame | None]:
    """Finished lists (queries, ids, scores), a row per task, where tasks read all blocks; candidates (query_id, item_id, score) otherwise."""
    blocks = norm_blocks(items, block_rows, super_blocks)
    # one row per super-block, SUPER_BLOCKS * BLOCK_ROWS items each
    tops = F.max(F.col("top")).alias("top")
    norms = blocks.select("super", "limits").mapInPandas(_tops, "super long, top double").groupBy("super").agg(tops)
    supers = sorted((-r.top, r.super) for r in norms.collect())
    tasks = 2 * queries.sparkSession.sparkContext.defaultParallelism
    n, dim = queries.agg(F.count("vec"), F.max(F.size("vec"))).first()
    if supers and n > SENT_CHUNKS * BLOCK_ROWS:
        parts = -(-n // read_rows(n, dim, k, tasks))
        return _read_by_all(queries, blocks, k, parts, supers), None
    return None, _sent_candidates(queries, blocks, k, supers, tasks)


def _sent_candidates(queries: DataFrame, blocks: DataFrame, k: int, supers: list[tuple[float, int]], tasks: int) -> DataFrame:
    """Candidates of few queries: blocks are sent to their chunks."""
    chunks = query_chunks(queries, chunk_rows(queries, k))
    if not supers:
        return chunks.select("chunk").where("false").selectExpr(
            "chunk AS query_id", "chunk AS item_id", "cast(chunk AS double) AS score"
        )
    first = chunks.withColumn("lane", F.lit(0).cast("long"))
    found = checkpointed(_visited(first, first.select("chunk", "lane", F.lit(supers[0][1]).alias("super")), blocks, k))
    scored = _rows_of(found, k)
    if len(supers) == 1:
        return scored
    lanes = max(1, min(len(supers) - 1, -(-tasks // max(1, chunks.count()))))
    rest = [(top, number, n % lanes) for n, (top, number) in enumerate(supers[1:])]

    def due(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for chunk, reach in zip(batch["chunk"], batch["reach"], strict=True):
                near = [(s, lane) for top, s, lane in rest if reach <= 0 or -top * SAFE >= reach]
                numbers = np.array(near, np.int64).reshape(-1, 2)
                yield pd.DataFrame({"chunk": np.full(len(near), chunk), "super": numbers[:, 0], "lane": numbers[:, 1]})

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = {c: batch.column(c)[at].as_py() for c in batch.schema.names}
                ids = np.frombuffer(row["ids"], np.int64)
                vecs = np.frombuffer(row["vecs"], np.float64).reshape(len(ids), -1)
                norms, floors = np.frombuffer(row["limits"], np.float64)[: len(ids)], np.frombuffer(row["floors"], np.float64)
                for top, _, lane in rest[:lanes]:  # the largest norms of every lane
                    asked = np.flatnonzero((norms * -top * SAFE >= floors) | (floors <= 0))
                    if len(asked):
                        limits = np.concatenate([norms[asked], floors[asked]])
                        yield _row([row["chunk"]], [lane], [-1], ids[asked], vecs[asked], limits)

    pairs = found.select("chunk", "reach").mapInPandas(due, "chunk long, super long, lane long")
    again = chunks.join(found.select("chunk", "floors"), "chunk").mapInArrow(sent, _PART).withColumnRenamed("super", "lane")
    return scored.unionByName(_rows_of(_visited(again, pairs, blocks, k), k))


def _tops(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"super": batch["super"], "top": [np.frombuffer(x, np.float64)[0] for x in batch["limits"]]})


def _rows_of(found: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                queries, ids, scores = (
                    np.frombuffer(batch.column(c)[at].as_py(), t)
                    for c, t in (("queries", np.int64), ("ids", np.int64), ("scores", np.float64))
                )
                full = ids != NONE
                columns = [np.repeat(queries, k)[full], ids[full], scores[full]]
                whole = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "item_id", "score"])
                yield from (whole.slice(i, ROWS_OUT) for i in range(0, whole.num_rows, ROWS_OUT))

    return found.select("queries", "ids", "scores").mapInArrow(run, _SCORED)


def exact_top_k(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    block_rows: int = BLOCK_ROWS,
    super_blocks: int = SUPER_BLOCKS,
) -> DataFrame:
    """Top ``k`` over all items (fewer when there are fewer items): (query_id, item_id, score, rank).

    Ties are broken by item id; null vectors neither ask nor are found; ids of queries and of items are unique.
    """
    packed, rows = _searched(queries, items, k, block_rows, super_blocks)
    if packed is not None:
        return exploded(lists_of(packed, k))
    return top_per_group(rows, ["query_id"], [F.desc("score"), F.asc("item_id")], k, "rank")


def exact_lists(
    queries: DataFrame, items: DataFrame, k: int, block_rows: int = BLOCK_ROWS, super_blocks: int = SUPER_BLOCKS
) -> DataFrame:
    """``exact_top_k`` with a row per query, best first: (query_id, items, scores)."""
    packed, rows = _searched(queries, items, k, block_rows, super_blocks)
    if packed is not None:
        return lists_of(packed, k)
    return folded(top_per_group(rows, ["query_id"], [F.desc("score"), F.asc("item_id")], k, "rank"))


def lists_of(packed: DataFrame, k: int) -> DataFrame:
    """(query_id, items, scores) from rows of many ranked lists of ``k`` places; queries without an item have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                queries, ids, scores = (
                    np.frombuffer(batch.column(c)[at].as_py(), t)
                    for c, t in (("queries", np.int64), ("ids", np.int64), ("scores", np.float64))
                )
                step = max(1, ROWS_OUT // k)
                for i in range(0, len(queries), step):
                    own, found = ids[i * k : (i + step) * k], queries[i : i + step]
                    full = own != NONE
                    sizes = full.reshape(-1, k).sum(1)
                    ends = pa.array(np.concatenate([[0], sizes[sizes > 0].cumsum()]).astype(np.int32))
                    columns = [own[full], scores[i * k : (i + step) * k][full]]
                    lists = [pa.ListArray.from_arrays(ends, pa.array(c)) for c in columns]
                    yield pa.RecordBatch.from_arrays([pa.array(found[sizes > 0]), *lists], ["query_id", "items", "scores"])

    return packed.select("queries", "ids", "scores").mapInArrow(run, _LISTS)


def exploded(lists: DataFrame) -> DataFrame:
    """(query_id, item_id, score, rank) from a row per query."""
    places = F.posexplode(F.arrays_zip("items", "scores")).alias("rank", "_of")
    return lists.select("query_id", places).select("query_id", "_of.items", "_of.scores", "rank").toDF(
        "query_id", "item_id", "score", "rank"
    ).withColumn("rank", F.col("rank").cast("long"))


def folded(rows: DataFrame) -> DataFrame:
    """(query_id, items, scores) from (query_id, item_id, score, rank)."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "item_id", "score"))).alias("_l")
    return rows.groupBy("query_id").agg(ordered).select("query_id", F.col("_l.item_id").alias("items"), F.col("_l.score").alias("scores"))


# --- by cells ------------------------------------------------------------------------------------


def _cell_blocks(items: DataFrame, block_rows: int) -> DataFrame:
    """(super, seq, ids, vecs, limits): at most ``block_rows`` items of one cell, which is ``super``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seq = 0
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            starts = np.flatnonzero(np.diff(cells, prepend=-1))
            for start, end in zip(starts, [*starts[1:], len(cells)], strict=True):
                for at in range(start, end, block_rows):
                    part = batch.slice(at, min(block_rows, end - at))
                    vecs = part.column("vec").flatten().to_numpy(zero_copy_only=False)
                    yield _row([0], [int(cells[at])], [_place(seq)], part.column("item_id").to_numpy().astype(np.int64), vecs, np.zeros(0))
                    seq += 1

    rows = items.select("item_id", F.col("cell").cast("long").alias("cell"), "vec")
    ordered = rows.repartitionByRange("cell", "item_id").sortWithinPartitions("cell", "item_id")
    return checkpointed(ordered.mapInArrow(cut, _PART)).drop("chunk")


def _cells_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for chunk, raw in zip(batch["chunk"], batch["limits"], strict=True):
            cells = np.unique(np.frombuffer(raw, np.int64))
            yield pd.DataFrame({"chunk": np.full(len(cells), chunk), "super": cells})


def block_top_k(queries: DataFrame, items: DataFrame, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Top ``k`` items per query among items of its ``cells``.

    ``queries``: (query_id, cells, vec), equally many cells each; ``items``: (item_id, cell, vec). A chunk of queries meets the blocks
    of all its cells in as few tasks as keep everything busy. Ties are broken by item id. Result: (query_id, item_id, score, rank).
    """
    blocks = _cell_blocks(items, block_rows)
    chunks = query_chunks(queries, chunk_rows(queries, k), "cells")
    tasks = 2 * queries.sparkSession.sparkContext.defaultParallelism
    lanes = max(1, min(blocks.count(), -(-tasks // max(1, chunks.count()))))
    pairs = chunks.select("chunk", "limits").mapInPandas(_cells_of, "chunk long, super long")  # a row per chunk and cell
    dealt = blocks.withColumn("lane", F.pmod(F.xxhash64("seq"), F.lit(lanes)))
    wanted = dealt.join(F.broadcast(pairs), "super").select(_VISIT)
    each = chunks.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    first = F.lit(-1).cast("long")
    together = each.withColumns({"super": first, "seq": first}).select(_VISIT).unionByName(wanted)
    ordered = together.repartition("chunk", "lane").sortWithinPartitions("chunk", "lane", "super", "seq")
    found = _rows_of(ordered.mapInArrow(_best_of_visits(k, by_cell=True), _FOUND), k)
    return top_per_group(found, ["query_id"], [F.desc("score"), F.asc("item_id")], k, "rank")
