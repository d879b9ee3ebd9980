"""An approximate index whose effort is set by measured recall.

Items lie in about ``sqrt(n)`` k-means cells and are stored as codes: the residual to the cell's centre is cut into parts,
each replaced by the number of its nearest codebook entry. A query ranks the cells by the inner product with their
centres, scores the codes of its nearest cells, and the best of these are scored exactly. A task holds a part of the queries, reads the
blocks of codes and then of vectors where they were written, and only finished lists leave it: nothing is exchanged per part. How many
cells a query visits and how many codes it keeps are not parameters: ``calibrate`` takes the fewest that reach the target recall on
sample queries.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.operators.places import NONE, Places, fits, norms_of, pair_scores, true_at
from asofkit.operators.topk import READ_NUMBERS, exact_top_k, exploded, lists_of, numbers, query_parts
from asofkit.plans.evaluation import list_recall
from asofkit.session import checkpointed

CELL_SAMPLE = 64  # items per cell, about, that the centres are fitted on
CODE_SAMPLE = 20_000  # items, at most about, that the codebooks are fitted on
CODE_ROUNDS = 8
ENTRIES = 256
PART_WIDTH = 4
BLOCK_ROWS = 2048  # codes, or vectors, of a block at most
QUERY_ROWS = 256  # queries that are ranked or scored at a time
PART_CELLS = 4_000_000  # (query, kept code) pairs of a task: 64 MB while the codes are met, about 150 MB for the vectors
PROBE_QUERIES = 200  # sample queries, at most about, that recall is measured on
SHORTLISTS = (2, 4, 8, 16)  # candidates scored exactly, in lists asked for
_BLOCK = "cell int, ids binary, body binary"


def hashed_sample(rows: DataFrame, id_col: str, total: int, wanted: int) -> DataFrame:
    """About ``wanted`` of ``total`` rows, the same ones every time."""
    return rows.where(F.pmod(F.xxhash64(id_col, F.lit("sample")), F.lit(max(1, total // wanted))) == 0)


def part_codebooks(residuals: np.ndarray, parts: int, entries: int, rounds: int = CODE_ROUNDS) -> np.ndarray:
    """(parts, entries, width) codebooks by k-means in every part."""
    rng = np.random.default_rng(0)
    cut = residuals.reshape(len(residuals), parts, -1)
    books = cut[rng.choice(len(cut), entries, replace=len(cut) < entries)].swapaxes(0, 1).copy()
    for _ in range(rounds):
        for p in range(parts):
            own = nearest_entries(cut[:, p], books[p])
            count = np.bincount(own, minlength=entries)[:, None]
            total = np.zeros_like(books[p])
            np.add.at(total, own, cut[:, p])
            books[p] = np.where(count > 0, total / np.maximum(count, 1), books[p])
    return books


def nearest_entries(points: np.ndarray, entries: np.ndarray) -> np.ndarray:
    return ((entries**2).sum(1) - 2 * points @ entries.T).argmin(1)


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _nearest_cells(scores: np.ndarray, probes: int) -> np.ndarray:
    return np.argsort(-scores, axis=1, kind="stable")[:, :probes]


def _block(cell: int, ids: np.ndarray, body: bytes) -> pa.RecordBatch:
    """One row of ``_BLOCK``: codes of items of a cell, or with a negative cell vectors."""
    columns = [pa.array([cell], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([body], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["cell", "ids", "body"])


class _Shortlist:
    """The best ``keep`` items of every query by their codes."""

    def __init__(self, vecs: np.ndarray, centres: np.ndarray, books: np.ndarray, probes: int, keep: int) -> None:
        # codes stand for their vectors by far less than 4-byte numbers are off, unless these overflow
        narrow = all(fits(norms_of(x)).all() for x in (vecs, centres, books.reshape(-1, books.shape[2])))
        kind = np.float32 if narrow else np.float64
        self.vecs, self.centres, self.books = (x.astype(kind) for x in (vecs, centres, books))
        self.visits = np.zeros((len(vecs), len(centres)), bool)
        for at in range(0, len(vecs), QUERY_ROWS):
            part = slice(at, at + QUERY_ROWS)
            np.put_along_axis(self.visits[part], _nearest_cells(vecs[part] @ centres.T, probes), True, 1)
        self.places = Places(len(vecs), keep, kind)

    def add(self, cell: int, ids: np.ndarray, raw: bytes) -> None:
        asked = np.flatnonzero(self.visits[:, cell])
        if not len(asked):
            return
        codes = np.frombuffer(raw, np.uint8).reshape(len(ids), -1)
        vecs = self.centres[cell] + self.books[np.arange(len(self.books)), codes].reshape(len(ids), -1)
        for rows in (asked[i : i + QUERY_ROWS] for i in range(0, len(asked), QUERY_ROWS)):
            scores = self.vecs[rows] @ vecs.T
            at = true_at(scores >= self.places.floors[rows, None])
            scores = scores.ravel()[at]
            known = scores > -np.inf
            self.places.put(rows[at // len(ids)][known], ids[at % len(ids)][known], scores[known])

    def kept(self) -> np.ndarray:
        self.places.settle_waiting()
        return self.places.ids[:, : self.places.k]


class _Rescored:
    """The exact scores of the wanted (query, item) pairs."""

    def __init__(self, vecs: np.ndarray, wanted: np.ndarray, k: int) -> None:
        self.vecs, self.keep, self.k = vecs, wanted.shape[1], k
        self.wanted = np.sort(wanted, axis=1).ravel()
        self.order = np.argsort(self.wanted).astype(np.int32)
        self.items = self.wanted[self.order]
        self.scores = np.full(len(self.wanted), -np.inf)

    def add(self, ids: np.ndarray, vecs: np.ndarray) -> None:
        """``ids`` ascend."""
        first, end = np.searchsorted(self.items, ids), np.searchsorted(self.items, ids, "right")
        counts = end - first
        place = np.repeat(np.arange(len(ids)), counts)
        pairs = self.order[np.arange(len(place)) + np.repeat(first - counts.cumsum() + counts, counts)]
        self.scores[pairs] = pair_scores(self.vecs, vecs, pairs // self.keep, place)

    def ranked(self) -> tuple[np.ndarray, np.ndarray]:
        scores, wanted = self.scores.reshape(-1, self.keep), self.wanted.reshape(-1, self.keep)
        found = []
        for part in (slice(at, at + QUERY_ROWS) for at in range(0, len(scores), QUERY_ROWS)):
            best = np.argsort(-scores[part], axis=1, kind="stable")[:, : self.k]  # items ascend, so ties go to the smaller id
            found.append((np.take_along_axis(wanted[part], best, 1), np.take_along_axis(scores[part], best, 1)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _found_by(centres: np.ndarray, books: np.ndarray, probes: int, keep: int, k: int):
    """Streams (queries, block) pairs, the queries always the same, blocks of codes before blocks of vectors."""

    def run(pairs: Iterator) -> Iterator[tuple]:
        queries = vecs = codes = exact = None
        for part, block in pairs:
            if vecs is None:
                queries = np.frombuffer(part["ids"], np.int64)
                vecs = np.frombuffer(part["vecs"], np.float64).reshape(len(queries), -1)
                codes = _Shortlist(vecs, centres, books, probes, keep)
            ids = np.frombuffer(block["ids"], np.int64)
            if block["cell"] < 0:
                if exact is None:
                    exact, codes = _Rescored(vecs, codes.kept(), k), None
                exact.add(ids, numbers(block["body"], len(ids), vecs.shape[1]))
            elif codes is None:
                raise RuntimeError("a block of codes came after the vectors")
            else:
                codes.add(block["cell"], ids, block["body"])
        if exact is not None:
            ids, scores = exact.ranked()
            yield queries.tobytes(), ids.tobytes(), scores.tobytes()

    return run


class QuantisedIndex:
    """``items``: (item_id, vec). ``calibrate`` has to be called before ``search``."""

    def __init__(self, items: DataFrame, cells: int | None = None, seed: int = 42) -> None:
        self.items = checkpointed(items.select("item_id", "vec").where(F.col("vec").isNotNull()))
        self.n = self.items.count()
        if not self.n:
            raise ValueError("an index needs items")
        wanted = cells or max(1, round(self.n**0.5))
        sample = hashed_sample(self.items, "item_id", self.n, CELL_SAMPLE * wanted)
        # about sqrt(n) centres, which every task holds
        self.centres = self._fitted(sample, wanted, seed)
        few = hashed_sample(self.items, "item_id", self.n, CODE_SAMPLE).limit(2 * CODE_SAMPLE).toPandas()
        vecs = _matrix(few["vec"])
        width = next(w for w in range(PART_WIDTH, 0, -1) if vecs.shape[1] % w == 0)
        own = nearest_entries(vecs, self.centres)
        self.books = part_codebooks(vecs - self.centres[own], vecs.shape[1] // width, min(ENTRIES, max(1, len(few))))
        self.placed = checkpointed(self._coded())
        # one table, so that whoever reads its partitions in order meets all codes before the first vector
        self.blocks = checkpointed(self._code_blocks().unionByName(self._vector_blocks()))
        self.probes, self.shortlist, self.recall = len(self.centres), None, {}

    def _fitted(self, sample: DataFrame, cells: int, seed: int) -> np.ndarray:
        if cells < 2:
            return _matrix(self.items.limit(CODE_SAMPLE).toPandas()["vec"]).mean(0, keepdims=True)
        features = sample.select(array_to_vector("vec").alias("features"))
        return np.stack(KMeans(k=cells, seed=seed, maxIter=10).fit(features).clusterCenters())

    def _coded(self) -> DataFrame:
        centres, books = self.centres, self.books

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                if not len(batch):
                    continue
                vecs = _matrix(batch["vec"])
                cell = nearest_entries(vecs, centres)
                cut = (vecs - centres[cell]).reshape(len(vecs), len(books), -1)
                codes = np.stack([nearest_entries(cut[:, p], book) for p, book in enumerate(books)], 1).astype(np.uint8)
                yield pd.DataFrame({"item_id": batch["item_id"], "cell": cell.astype(np.int32), "code": [c.tobytes() for c in codes]})

        return self.items.mapInPandas(run, "item_id long, cell int, code binary")

    def _code_blocks(self) -> DataFrame:
        """(cell, ids, body): the codes of at most ``BLOCK_ROWS`` items of a cell."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cells, ids = batch.column("cell").to_numpy(), batch.column("item_id").to_numpy().astype(np.int64)
                starts = np.flatnonzero(np.diff(cells, prepend=-1))
                for start, end in zip(starts, [*starts[1:], len(cells)], strict=True):
                    for at in range(start, end, BLOCK_ROWS):
                        part = slice(at, min(end, at + BLOCK_ROWS))
                        codes = batch.column("code").slice(at, part.stop - at).to_pylist()
                        yield _block(int(cells[at]), ids[part], b"".join(codes))

        ordered = self.placed.repartitionByRange("cell", "item_id").sortWithinPartitions("cell", "item_id")
        return ordered.mapInArrow(run, _BLOCK)

    def _vector_blocks(self) -> DataFrame:
        """(cell, ids, body): the vectors themselves, blocks of neighbouring ids; the cell is -1."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK_ROWS):
                    part = batch.slice(at, BLOCK_ROWS)
                    vecs = part.column("vec").flatten().to_numpy(zero_copy_only=False)
                    yield _block(-1, part.column("item_id").to_numpy().astype(np.int64), vecs.tobytes())

        rows = self.items.withColumn("item_id", F.col("item_id").cast("long"))
        ordered = rows.repartitionByRange("item_id").sortWithinPartitions("item_id")
        return ordered.mapInArrow(run, _BLOCK)

    def ranked_cells(self, queries: DataFrame, probes: int) -> DataFrame:
        """(query_id, cell, cell_rank): the cells with the largest inner products."""
        centres = self.centres

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), QUERY_ROWS):  # a row per query and cell
                    part = batch.iloc[at : at + QUERY_ROWS]
                    near = _nearest_cells(_matrix(part["vec"]) @ centres.T, probes)
                    yield pd.DataFrame(
                        {
                            "query_id": np.repeat(part["query_id"].to_numpy(), near.shape[1]),
                            "cell": near.ravel().astype(np.int32),
                            "cell_rank": np.tile(np.arange(near.shape[1], dtype=np.int32), len(near)),
                        }
                    )

        asked = queries.select("query_id", "vec").where(F.col("vec").isNotNull())
        return asked.mapInPandas(run, "query_id long, cell int, cell_rank int")

    def _search(self, queries: DataFrame, k: int, probes: int, keep: int) -> DataFrame:
        """The ``keep`` best codes of every query over the cells that it visits, then the ``k`` best vectors of these."""
        known = queries.select(F.col("query_id").cast("long").alias("query_id"), "vec").where(F.col("vec").isNotNull())
        tasks = 2 * known.sparkSession.sparkContext.defaultParallelism
        n = known.count()
        rows = max(1, min(READ_NUMBERS // self.centres.shape[1], PART_CELLS // keep, max(QUERY_ROWS, -(-n // tasks))))
        # coalescing keeps the order of partitions; where codes came too late, the task says so
        pairs = query_parts(known, max(1, -(-n // rows))).rdd.cartesian(self.blocks.rdd.coalesce(1))
        found = pairs.mapPartitions(_found_by(self.centres, self.books, probes, keep, k))
        packed = known.sparkSession.createDataFrame(found, "queries binary, ids binary, scores binary", verifySchema=False)
        return lists_of(packed, min(k, keep))

    def calibrate(self, queries: DataFrame, ks: Sequence[int] = (500, 50), target: float = 0.95) -> dict[int, float]:
        """Set the cells to visit and the codes to keep; returns the recall measured on sample queries per k.

        Which cell each true neighbour lies in gives the recall of every number of cells at once.
        """
        total = queries.count()
        sample = checkpointed(hashed_sample(queries, "query_id", total, PROBE_QUERIES).select("query_id", "vec"))
        truth = checkpointed(exact_top_k(sample, self.items, max(ks)))
        cells = self.ranked_cells(sample, len(self.centres))
        at = truth.join(self.placed.select("item_id", "cell"), "item_id").join(cells, ["query_id", "cell"])
        spare = (1 - target) / 2  # the other half of what may be missed is left to the codes
        self.probes = 1
        for k in ks:
            counts = np.zeros(len(self.centres))
            for r in at.where(F.col("rank") < k).groupBy("cell_rank").count().collect():  # one row per cell at most
                counts[r.cell_rank] = r["count"]
            reached = counts.cumsum() / max(1, counts.sum())
            self.probes = max(self.probes, 1 + int(np.argmax(reached >= target + spare)))
        for lists in (*SHORTLISTS, None):
            self.shortlist = lists
            found = checkpointed(self.search(sample, max(ks)))
            self.recall = {
                k: list_recall(found.where(F.col("rank") < k), truth.where(F.col("rank") < k), "query_id").first().recall for k in ks
            }
            if min(self.recall.values()) >= target + spare / 2:
                break
        return self.recall

    def lists(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, items, scores), best first; scores are exact, ties go to the smaller item id."""
        keep = self.n if self.shortlist is None else min(self.n, self.shortlist * k)
        return self._search(queries, k, self.probes, keep)

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """(query_id, item_id, score, rank) of the same lists."""
        return exploded(self.lists(queries, k))
