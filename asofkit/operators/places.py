"""The best scored items of many queries, kept by a task while blocks of items pass.

Scores are first taken from a matrix product of 4-byte numbers. What it may be off by is bounded from the norms, so only pairs that cannot
be among the best are left out there; the others, few after the first blocks, are scored with 8-byte numbers one by one. Where norms do not
fit that bound (undefined, very large or very small ones), the product has 8-byte numbers too.
"""

from __future__ import annotations

import numpy as np

NONE = np.iinfo(np.int64).max
PAIR_SLICE = 512  # (query, item) pairs that are scored at a time: they stay in a cache
SETTLED = 256  # queries whose hits are ranked at a time
LEAST_ROOM = 16  # hits, at least, that wait to be ranked
SMALLEST, LARGEST = 1e-15, 1e15  # norms between which products of 4-byte numbers neither vanish nor overflow


def true_at(mask: np.ndarray) -> np.ndarray:
    """Places of the true entries in row order; made for masks with few of them, which are looked for in words of eight."""
    flat = mask.ravel()
    whole = len(flat) // 8 * 8
    words = np.flatnonzero(flat[:whole].view(np.uint64))
    if len(words) * 32 > len(flat):
        return np.flatnonzero(flat)
    at = (words[:, None] * 8 + np.arange(8)).ravel()
    return np.concatenate([at[flat[at]], whole + np.flatnonzero(flat[whole:])])


def norms_of(vecs: np.ndarray) -> np.ndarray:
    return np.sqrt((vecs**2).sum(1))


def fits(norms: np.ndarray) -> np.ndarray:
    """Whether products of 4-byte numbers are as close to the exact ones as ``off_by`` says; false for undefined norms."""
    return (norms == 0) | ((norms >= SMALLEST) & (norms <= LARGEST))


def off_by(dim: int, norms: np.ndarray, largest: float, kind: type) -> np.ndarray:
    """How far a product of numbers of ``kind`` may be from the exact one, and half as much from any other order of summation."""
    return 2.0 * (dim + 4) * np.finfo(kind).eps * norms * largest


def pair_scores(left: np.ndarray, right: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows; equal pairs have equal scores."""
    out = np.empty(len(rows))
    for at in range(0, len(rows), PAIR_SLICE):
        part = slice(at, at + PAIR_SLICE)
        np.einsum("ij,ij->i", left.take(rows[part], 0), right.take(columns[part], 0), out=out[part])
    return out


class Places:
    """The best ``k`` (item, score) of every query, and a third as many hits that wait to be ranked. Ties go to the smaller item id."""

    def __init__(self, n: int, k: int, kind: type = np.float64) -> None:
        self.k, self.room = k, k + max(k // 3, LEAST_ROOM)
        self.scores, self.ids = np.full((n, self.room), -np.inf, kind), np.full((n, self.room), NONE)
        self.used = np.zeros(n, np.int64)
        self.floors = np.full(n, -np.inf, kind)  # the k-th best scores when they were ranked last

    def put(self, rows: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        """Hits of the queries ``rows``, which ascend; none is undefined."""
        flat_scores, flat_ids = self.scores.ravel(), self.ids.ravel()
        while len(rows):
            want = scores >= self.floors[rows]
            if not want.all():
                rows, ids, scores = rows[want], ids[want], scores[want]
                if not len(rows):
                    return
            starts = np.concatenate([[0], np.flatnonzero(rows[1:] != rows[:-1]) + 1])
            own, counts = rows[starts], np.diff(starts, append=len(rows))
            used = self.used[own]
            more = used + counts
            crowded = (more > self.room) & (used > self.k)
            if crowded.any():
                self.settle(own[crowded])
                continue
            at = np.arange(len(rows)) + np.repeat(own * self.room + used - starts, counts)
            if more.max() <= self.room:
                flat_scores[at], flat_ids[at] = scores, ids
                self.used[own] = more
                return
            now = at < np.repeat((own + 1) * self.room, counts)
            flat_scores[at[now]], flat_ids[at[now]] = scores[now], ids[now]
            self.used[own] = np.minimum(more, self.room)
            rows, ids, scores = rows[~now], ids[~now], scores[~now]

    def settle(self, own: np.ndarray) -> None:
        """Rank what waits for the queries ``own``, which have ``k`` items at least."""
        for some in (own[i : i + SETTLED] for i in range(0, len(own), SETTLED)):
            scores, ids = self.scores[some], self.ids[some]
            low = np.partition(scores, self.room - self.k, axis=1)[:, self.room - self.k, None]
            kept = scores >= low
            crowd = np.flatnonzero(kept.sum(1) > self.k)
            if len(crowd):  # ties with the last one
                kept[crowd] = False
                kept[crowd[:, None], np.lexsort((ids[crowd], -scores[crowd]), axis=1)[:, : self.k]] = True
            at = np.flatnonzero(kept)
            self.scores[some, : self.k], self.scores[some, self.k :] = scores.ravel()[at].reshape(-1, self.k), -np.inf
            self.ids[some, : self.k] = ids.ravel()[at].reshape(-1, self.k)
            self.used[some], self.floors[some] = self.k, low[:, 0]

    def settle_waiting(self) -> None:
        self.settle(np.flatnonzero((self.used > self.k) | ((self.used == self.k) & np.isneginf(self.floors))))

    def ranked(self) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of every query, best first; what is missing has the id ``NONE``."""
        self.settle_waiting()
        ids, scores = self.ids[:, : self.k], self.scores[:, : self.k]
        for at in range(0, len(ids), SETTLED):
            part = slice(at, at + SETTLED)
            order = np.lexsort((ids[part], -scores[part]), axis=1)
            ids[part], scores[part] = np.take_along_axis(ids[part], order, 1), np.take_along_axis(scores[part], order, 1)
        return ids, scores


class ExactBest:
    """Queries of a task and their best items by exact inner products."""

    def __init__(self, vecs: np.ndarray, k: int) -> None:
        self.vecs, self.norms, self.places = vecs, norms_of(vecs), Places(len(vecs), k)
        self.fit = fits(self.norms)
        with np.errstate(over="ignore", invalid="ignore"):
            self.narrow = vecs.astype(np.float32)

    def add(self, rows: np.ndarray, ids: np.ndarray, vecs: np.ndarray) -> None:
        """Items that the queries ``rows``, a slice of them, meet. Undefined scores are left out."""
        norms = norms_of(vecs)
        with np.errstate(over="ignore", invalid="ignore"):
            if fits(norms).all():
                wide = ~self.fit[rows]
                largest = norms.max(initial=0.0)
                self._meet(rows[~wide], self.narrow, vecs.astype(np.float32), ids, vecs, largest)
                rows = rows[wide]
            if len(rows):
                self._meet(rows, self.vecs, vecs, ids, vecs, norms.max(initial=0.0))

    def _meet(self, rows: np.ndarray, queries: np.ndarray, items: np.ndarray, ids: np.ndarray, vecs: np.ndarray, largest: float) -> None:
        if not len(rows) or not len(ids):
            return
        k, kind = self.places.k, queries.dtype.type
        products = queries[rows] @ items.T
        off = off_by(items.shape[1], self.norms[rows], largest, kind)
        bound = self.places.floors[rows] - off
        new = np.flatnonzero(np.isneginf(self.places.floors[rows]))
        if len(new) and len(ids) > k and kind is np.float32:  # a query's first block: only its k best can matter
            bound[new] = np.partition(products[new], len(ids) - k, axis=1)[:, len(ids) - k] - 2 * off[new]
        bound[np.isnan(bound)] = -np.inf
        at = true_at(products >= np.nextafter(bound.astype(kind), kind(-np.inf))[:, None])
        own, column = rows[at // len(ids)], at % len(ids)
        scores = pair_scores(self.vecs, vecs, own, column)
        known = scores > -np.inf  # neither undefined
        self.places.put(own[known], ids[column[known]], scores[known])
