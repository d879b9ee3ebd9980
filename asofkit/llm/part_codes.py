"""Vector code compression: codebooks per part, trained exactly over anchors-hierarchy metric trees.

Vectors are cut into equal parts. For every block of vectors and every part position one metric tree is built once
and written: anchors are placed one after the other at the point farthest from its own anchor and take over the
points that are nearer to them (a point within half the distance between two anchors needs no look); then the
anchors are joined pairwise to the ball with the smallest reach, and crowded anchors are divided the same way, so the
tree grows from the middle both ways. A ball caches its middle, radius, count and sum.

In a round the balls pass a list of candidate entries down. Entry ``e`` leaves the list of a ball when ``b`` is nearer
for every point in it: ``|m-e|^2 - |m-b|^2 > 2 r |b-e|`` for middle ``m`` and radius ``r``. A ball with one candidate left
is wholly owned and adds its cached sum and count; only leaves with several compare their points with these.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asofkit.llm.common import broadcast_if_small, materialised
from asofkit.llm.vectors import digest, finite, fresh, scaled, slot_totals, smallest_first

BLOCK_ROWS = 4096
LEAF_ROWS = 64
SAFE = 1 + 1e-9  # roundings of a radius or a distance never remove a candidate
BLOCK = "block long, vec_id array<bigint>, label array<int>, trees array<binary>"
CODED = "vec_id long, label int, code string, error long"


@dataclass
class Tree:
    """Points in leaf order and balls in level order; ``first`` and ``last`` bound a ball's points."""

    points: np.ndarray  # rows, width
    order: np.ndarray  # rows: place of each point in the block
    middle: np.ndarray  # balls, width
    radius: np.ndarray
    total: np.ndarray  # balls, width
    first: np.ndarray
    last: np.ndarray
    left: np.ndarray  # -1 for a leaf
    right: np.ndarray

    def packed(self) -> bytes:
        rows, width = self.points.shape
        whole = [np.array([rows, width, len(self.radius)]), self.middle, self.total, self.first, self.last, self.left, self.right]
        numbers = np.concatenate([x.ravel().astype(np.int64) for x in whole]).tobytes()
        return numbers + self.radius.tobytes() + self.points.astype(np.int32).tobytes() + self.order.astype(np.int32).tobytes()

    @staticmethod
    def unpacked(raw: pa.Buffer) -> Tree:
        rows, width, balls = np.frombuffer(raw, np.int64, 3).tolist()
        numbers = np.frombuffer(raw, np.int64, balls * (2 * width + 4), 24)
        cuts = np.cumsum([balls * width, balls * width, balls, balls, balls])
        middle, total, first, last, left, right = np.split(numbers, cuts)
        at = 24 + numbers.nbytes
        radius = np.frombuffer(raw, np.float64, balls, at)
        at += radius.nbytes
        points = np.frombuffer(raw, np.int32, rows * width, at).reshape(rows, width).astype(np.int64)
        order = np.frombuffer(raw, np.int32, rows, at + rows * width * 4)
        return Tree(points, order, middle.reshape(-1, width), radius, total.reshape(-1, width), first, last, left, right)


def anchored(points: np.ndarray) -> np.ndarray:
    """The anchor number of every point, with about the square root of their number as anchors."""
    wanted = max(2, int(len(points) ** 0.5))
    anchors = [points[0]]
    owner = np.zeros(len(points), np.int64)
    reach = np.sqrt(((points - points[0]) ** 2).sum(1))
    while len(anchors) < wanted:
        far = int(reach.argmax())
        if reach[far] == 0:  # equal points only
            break
        new = points[far]
        apart = np.sqrt(((np.array(anchors) - new) ** 2).sum(1))
        near = np.flatnonzero(reach >= apart[owner] / (2 * SAFE))
        to_new = np.sqrt(((points[near] - new) ** 2).sum(1))
        taken = to_new < reach[near]
        owner[near[taken]] = len(anchors)
        reach[near[taken]] = to_new[taken]
        anchors.append(new)
    return owner


def joined(middles: np.ndarray, radii: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of balls to join one after the other, always those whose common ball is smallest; balls made are numbered on."""
    count = len(middles)
    middles = np.concatenate([middles, np.zeros((count - 1, middles.shape[1]))])
    radii = np.concatenate([radii, np.zeros(count - 1)])
    cost = np.full((2 * count - 1, 2 * count - 1), np.inf)
    for i in range(1, count):
        apart = np.sqrt(((middles[:i] - middles[i]) ** 2).sum(1))
        cost[i, :i] = np.maximum((apart + radii[:i] + radii[i]) / 2, np.maximum(radii[:i], radii[i]))
    alive = np.zeros(2 * count - 1, bool)
    alive[:count] = True
    pairs = []
    for new in range(count, 2 * count - 1):
        a, b = divmod(int(cost.argmin()), 2 * count - 1)
        pairs.append((a, b))
        radii[new] = cost[a, b]
        middles[new] = (middles[a] + middles[b]) / 2
        cost[[a, b]] = np.inf
        cost[:, [a, b]] = np.inf
        alive[[a, b]] = False
        others = np.flatnonzero(alive)
        apart = np.sqrt(((middles[others] - middles[new]) ** 2).sum(1))
        cost[new, others] = np.maximum((apart + radii[others] + radii[new]) / 2, np.maximum(radii[others], radii[new]))
        alive[new] = True
    return pairs


def built(points: np.ndarray, leaf_rows: int = LEAF_ROWS) -> Tree:
    """The metric tree of a block's points (at least one)."""
    children: list[tuple[int, int]] = [(-1, -1)]
    members: list[np.ndarray | None] = [np.arange(len(points))]
    crowded = [0]
    while crowded:
        ball = crowded.pop()
        rows = members[ball]
        if len(rows) <= leaf_rows:
            continue
        owner = anchored(points[rows])
        groups = [rows[owner == k] for k in range(owner.max() + 1)]
        groups = [g for g in groups if len(g)]
        if len(groups) == 1:
            continue
        middles = np.array([points[g].mean(0) for g in groups])
        radii = np.array([np.sqrt(((points[g] - m) ** 2).sum(1).max()) for g, m in zip(groups, middles, strict=True)])
        pairs = joined(middles, radii)
        own = []
        for k in range(2 * len(groups) - 2):  # all but the last, which is the ball itself
            own.append(len(members))
            members.append(groups[k] if k < len(groups) else None)
            children.append((-1, -1))
            if k < len(groups):
                crowded.append(own[-1])
        own.append(ball)
        members[ball] = None
        for k, (a, b) in enumerate(pairs):
            children[own[len(groups) + k]] = (own[a], own[b])
    first, last, order, level = {}, {}, [], []
    size = 0
    stack = [(0, False)]
    while stack:  # leaves from left to right
        ball, done = stack.pop()
        if done:
            last[ball] = size
            continue
        first[ball] = size
        stack.append((ball, True))
        a, b = children[ball]
        if a < 0:
            order.append(members[ball])
            size += len(members[ball])
        else:
            stack += [(b, False), (a, False)]
    level = [0]
    for ball in level:
        if children[ball][0] >= 0:
            level += children[ball]
    place = {ball: k for k, ball in enumerate(level)}
    order = np.concatenate(order)
    points = points[order]
    starts, ends = np.array([first[b] for b in level]), np.array([last[b] for b in level])
    running = np.concatenate([np.zeros((1, points.shape[1]), np.int64), points.cumsum(0)])
    total = running[ends] - running[starts]
    middle = total // (ends - starts)[:, None]
    radius = np.array([np.sqrt(((points[s:e] - m) ** 2).sum(1).max()) for s, e, m in zip(starts, ends, middle, strict=True)])
    links = np.array([[place.get(c, -1) for c in children[b]] for b in level])
    return Tree(points, order, middle, radius * SAFE, total, starts, ends, links[:, 0], links[:, 1])


def owned(tree: Tree, entries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Passes candidate lists down, a level of balls at a time.

    Yields (wholly owned balls, their entries, leaves with several candidates, their candidate lists).
    """
    between = np.sqrt(((entries[:, None] - entries[None]) ** 2).sum(2))
    balls = np.array([0])
    # of equal entries only the first can win
    lists = np.array([[not (entries[:e] == entries[e]).all(1).any() for e in range(len(entries))]])
    while len(balls):
        away = ((tree.middle[balls][:, None] - entries[None]) ** 2).sum(2)
        best = np.where(lists, away, np.iinfo(np.int64).max).argmin(1)
        lead = away - away[np.arange(len(balls)), best][:, None]
        lists = lists & ~(lead > 2 * tree.radius[balls][:, None] * between[best] * SAFE)
        single = lists.sum(1) == 1
        leaf = tree.left[balls] < 0
        mixed = leaf & ~single
        yield balls[single], best[single], balls[mixed], lists[mixed]
        deeper = ~single & ~leaf
        lists = np.repeat(lists[deeper], 2, axis=0)
        balls = np.stack([tree.left[balls[deeper]], tree.right[balls[deeper]]], 1).ravel()


def spans(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All places of the half-open spans, one after the other."""
    sizes = last - first
    return np.repeat(last - sizes.cumsum(), sizes) + np.arange(sizes.sum())


def compared(tree: Tree, leaves: np.ndarray, lists: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the leaves and the nearest of their leaf's candidates; ties go to the lower entry."""
    rows = spans(tree.first[leaves], tree.last[leaves])
    mine = np.repeat(lists, tree.last[leaves] - tree.first[leaves], axis=0)
    best, choice = np.full(len(rows), np.iinfo(np.int64).max), np.zeros(len(rows), np.int64)
    for e in np.flatnonzero(lists.any(0)):
        asked = np.flatnonzero(mine[:, e])
        away = ((tree.points[rows[asked]] - entries[e]) ** 2).sum(1)
        nearer = away < best[asked]
        best[asked[nearer]] = away[nearer]
        choice[asked[nearer]] = e
    return rows, choice


def part_totals(tree: Tree, entries: np.ndarray) -> np.ndarray:
    """Per entry the componentwise sum of the points nearest to it, and their number."""
    width = entries.shape[1]
    found = np.zeros((len(entries), width + 1), np.int64)
    for balls, owner, leaves, lists in owned(tree, entries):
        np.add.at(found[:, :width], owner, tree.total[balls])
        np.add.at(found[:, width], owner, tree.last[balls] - tree.first[balls])
        rows, choice = compared(tree, leaves, lists, entries)
        by = np.argsort(choice, kind="stable")
        used, first = np.unique(choice[by], return_index=True)
        if len(used):
            found[used, :width] += np.add.reduceat(tree.points[rows[by]], first)
            found[used, width] += np.diff(np.append(first, len(rows)))
    return found


def part_assigned(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of every point, in the block's order."""
    choice = np.zeros(len(tree.points), np.int64)
    for balls, owner, leaves, lists in owned(tree, entries):
        choice[spans(tree.first[balls], tree.last[balls])] = np.repeat(owner, tree.last[balls] - tree.first[balls])
        rows, best = compared(tree, leaves, lists, entries)
        choice[rows] = best
    code, error = np.zeros_like(choice), np.zeros_like(choice)
    code[tree.order] = choice
    error[tree.order] = ((tree.points - entries[choice]) ** 2).sum(1)
    return code, error


def tree_blocks(vectors: DataFrame, dim: int, parts: int, factor: int, rows: int) -> DataFrame:
    """Blocks of at most ``rows`` vectors as they lie in the partitions, with one tree per part position."""
    width = dim // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= rows:
                table = pa.Table.from_batches(waiting).combine_chunks()
                full = table.num_rows // rows * rows
                for at in range(0, full, rows):
                    yield block(table.slice(at, rows))
                waiting = table.slice(full).to_batches()
        rest = pa.Table.from_batches(waiting) if waiting else None
        if rest and rest.num_rows:
            yield block(rest)

    def block(rows: pa.Table) -> pa.RecordBatch:
        batch = rows.combine_chunks().to_batches()[0]
        whole = scaled(batch.column("embedding"), dim, factor)
        trees = [built(whole[:, p * width : (p + 1) * width]).packed() for p in range(parts)]
        lists = [pa.ListArray.from_arrays([0, batch.num_rows], batch.column(c)) for c in ("vec_id", "label")]
        return pa.RecordBatch.from_arrays(
            [pa.array([fresh()]), *lists, pa.array([trees], pa.list_(pa.binary()))], ["block", "vec_id", "label", "trees"]
        )

    return materialised(vectors.select("vec_id", "label", "embedding").mapInArrow(run, BLOCK), "part-trees")


def trees_of(batch: pa.RecordBatch, at: int) -> list[Tree]:
    return [Tree.unpacked(raw.as_buffer()) for raw in batch.column("trees")[at].values]


def trained(blocks: DataFrame, codebooks: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks (part, entry, component) after the rounds; an entry without points stays."""
    parts, entries, width = codebooks.shape

    for _ in range(rounds):

        def totals(batch: pa.RecordBatch, books: np.ndarray = codebooks) -> np.ndarray:
            found = np.zeros((parts, entries, width + 1), np.int64)
            for at in range(batch.num_rows):
                for p, tree in enumerate(trees_of(batch, at)):
                    found[p] += part_totals(tree, books[p])
            return found.ravel()

        found = slot_totals(blocks.select("trees"), totals, parts * entries * (width + 1)).reshape(parts, entries, width + 1)
        count = found[:, :, width:]
        codebooks = np.where(count > 0, found[:, :, :width] // np.maximum(count, 1), codebooks)
    return codebooks


def coded(blocks: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """Per vector: vec_id, label, code (two hex digits a part) and the squared distance to what it decodes to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                found = [part_assigned(t, c) for t, c in zip(trees_of(batch, at), codebooks, strict=True)]
                code = np.stack([f[0] for f in found], 1).astype(np.uint8)
                error = sum(f[1] for f in found)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id")[at].values,
                        batch.column("label")[at].values,
                        pa.array([row.tobytes().hex() for row in code], pa.string()),
                        pa.array(error),
                    ],
                    ["vec_id", "label", "code", "error"],
                )

    return blocks.mapInArrow(run, CODED)


def compressed(
    embeddings: DataFrame,
    parts: int = 8,
    entries: int = 16,
    rounds: int = 6,
    dim: int = 64,
    factor: int = 4096,
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, label, code, error) of every kept vector, and the codebooks (part, entry, component).

    Kept are vectors of ``dim`` components, none null or non-finite; their integers ``floor(factor * x)`` must stay below
    2^26, beyond which the job stops. Codebooks start as the parts of the vectors with the smallest ids (a null id
    last, equal ids by their vectors; fewer vectors make fewer entries). Repeated rows count as often as they occur, distances that tie
    go to the lower entry, columns other than vec_id, label and embedding are not looked at, an empty table gives no rows.
    """
    if dim % parts or not 0 < entries <= 256:
        raise ValueError("parts have to divide the dimension, and an entry number has to fit two hex digits")
    kept = embeddings.select("vec_id", F.col("label").cast("int").alias("label"), "embedding").filter(finite("embedding", dim))
    first = kept.orderBy(*smallest_first("vec_id", "embedding")).limit(entries).collect()  # a fixed number of rows
    start = np.floor(np.array([r.embedding for r in first], np.float64).reshape(len(first), dim) * factor).astype(np.int64)
    books = start.reshape(len(first), parts, dim // parts).swapaxes(0, 1)
    if not first:
        return kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), books
    blocks = tree_blocks(kept, dim, parts, factor, block_rows)
    books = trained(blocks, books, rounds)
    return materialised(coded(blocks, books), "part-codes"), books


def with_label_error(codes: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """Per vector: vec_id, code, error, label_error (summed over its label, nulls together), codebooks_sha256."""
    by_label = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    by_label = broadcast_if_small(by_label.select(F.col("label").alias("of"), "label_error"))
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256")
    )
