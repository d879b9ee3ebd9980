"""Part codes and centroid clustering against plain comparisons of everything with everything."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from asofkit.llm import centroids, part_codes

SCHEMA = "vec_id long, embedding array<float>, label int, block string, cluster int, code string"


def made(seed: int, n: int, spread: float) -> list[tuple]:
    """Vectors around five middles, with ties, copies and one vector that is a third of all rows."""
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 0.3, (5, 64))
    vectors = (middles[rng.integers(0, 5, n)] + rng.normal(0, spread, (n, 64))).astype(np.float32)
    vectors[: n // 3] = vectors[0]
    vectors[n // 2 : n // 2 + 20] = np.float32(0.25)
    return [(i * 7 % 1009, v.tolist(), None if i % 9 == 0 else i % 4, "b", 1, "c") for i, v in enumerate(vectors)]


AWKWARD = [
    (5001, None, 1, "b", 1, "c"),
    (5002, [0.1] * 63 + [None], 1, "b", 1, "c"),
    (5003, [0.1] * 63 + [float("nan")], 1, "b", 1, "c"),
    (5004, [0.1] * 63 + [float("-inf")], 1, "b", 1, "c"),
    (5005, [0.1] * 63, 1, "b", 1, "c"),
    (5006, [], 1, "b", 1, "c"),
    (None, [-0.2] * 64, None, None, None, None),
]


def kept_rows(rows):
    good = [r for r in rows if r[1] is not None and len(r[1]) == 64 and all(x is not None and np.isfinite(x) for x in r[1])]
    return good, np.floor(np.array([r[1] for r in good], np.float32).astype(np.float64).reshape(-1, 64))


def plain_rounds(points, start, rounds):
    middles = start.copy()
    for left in range(rounds, -1, -1):
        away = ((points[:, None] - middles[None]) ** 2).sum(2)
        own = away.argmin(1)
        if left:
            for c in range(len(middles)):
                if (own == c).any():
                    middles[c] = points[own == c].sum(0) // (own == c).sum()
    return middles, own, away.min(1)


def integers(rows, factor):
    return np.floor(np.array([r[1] for r in rows], np.float32).astype(np.float64) * factor).astype(np.int64)


def sha(values):
    return hashlib.sha256(",".join(map(str, values)).encode()).hexdigest()


@pytest.mark.parametrize(("seed", "n", "spread"), [(1, 400, 0.02), (2, 300, 0.4), (3, 7, 0.1)])
def test_part_codes_equal_plain_rounds(spark, seed, n, spread):
    rows = made(seed, n, spread) + AWKWARD
    good, _ = kept_rows(rows)
    whole = integers(good, 4096)
    first = sorted(range(len(good)), key=lambda i: (good[i][0] is None, good[i][0] or 0, good[i][1]))[:16]
    codes, error, books = [], 0, []
    for p in range(8):
        part = whole[:, p * 8 : p * 8 + 8]
        middles, own, away = plain_rounds(part, part[first], 6)
        codes.append(own)
        error = error + away
        books += middles.ravel().tolist()
    want = []
    for i, r in enumerate(good):
        same = sum(int(error[j]) for j, o in enumerate(good) if o[2] == r[2])
        want.append((r[0], "".join(f"{c[i]:02x}" for c in codes), int(error[i]), same, sha(books)))
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = part_codes.with_label_error(*part_codes.compressed(frame, block_rows=128))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize(("seed", "n", "spread"), [(1, 400, 0.02), (2, 300, 0.4), (3, 7, 0.1)])
def test_clusters_equal_plain_rounds(spark, seed, n, spread):
    rows = made(seed, n, spread) + AWKWARD
    good, _ = kept_rows(rows)
    whole = integers(good, 256)
    rank = lambda i: (good[i][0] is None, hashlib.sha256(f"2:{good[i][0]}".encode()).hexdigest(), good[i][1])
    middles, own, away = plain_rounds(whole, whole[sorted(range(len(good)), key=rank)[:40]], 5)
    want = [
        (r[0], int(own[i]), int(away[i]), int(away[own == own[i]].sum()), int(away.sum()), sha(middles[own[i]].tolist()))
        for i, r in enumerate(good)
    ]
    got = centroids.clustered(spark.createDataFrame(rows, SCHEMA).repartition(3), block_rows=32)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_empty_tables_and_tables_without_a_good_vector(spark):
    for rows in ([], AWKWARD[:-1]):
        frame = spark.createDataFrame(rows, SCHEMA)
        assert part_codes.with_label_error(*part_codes.compressed(frame)).collect() == []
        assert centroids.clustered(frame).collect() == []


def test_components_out_of_range_stop_the_job(spark):
    frame = spark.createDataFrame([(1, [1e30] * 64, 1, "", 1, "")], SCHEMA)
    with pytest.raises(Exception, match="or more"):
        part_codes.compressed(frame)[0].collect()


def test_balls_hold_their_points_and_are_owned_without_a_look_at_them():
    rng = np.random.default_rng(4)
    middles = rng.integers(-5000, 5000, (12, 8))
    points = middles[rng.integers(0, 12, 3000)] + rng.integers(-30, 30, (3000, 8))
    tree = part_codes.Tree.unpacked(part_codes.built(points).packed())
    assert sorted(map(tuple, tree.points)) == sorted(map(tuple, points))
    for first, last, middle, radius, total in zip(tree.first, tree.last, tree.middle, tree.radius, tree.total, strict=True):
        own = tree.points[first:last]
        assert (own.sum(0) == total).all() and (np.sqrt(((own - middle) ** 2).sum(1)) <= radius).all()
    looked = sum((tree.last[leaves] - tree.first[leaves]).sum() for _, _, leaves, _ in part_codes.owned(tree, middles))
    assert looked < 300  # nearly all points are counted by the sums of their balls


def test_entries_that_are_equal_and_points_between_entries():
    points = np.array([[x] * 8 for x in range(-50, 51)] * 3)
    entries = np.array([[-10] * 8, [10] * 8, [-10] * 8, [0] * 8, [10] * 8])
    code, error = part_codes.part_assigned(part_codes.built(points, 4), entries)
    away = ((points[:, None] - entries[None]) ** 2).sum(2)
    assert (code == away.argmin(1)).all() and (error == away.min(1)).all()


def test_curve_visits_neighbours_and_boxes_drop_centroids():
    cells = np.array([[i, j, k] for i in range(8) for j in range(8) for k in range(8)])
    keys = centroids.hilbert_keys(cells, 3)
    walk = cells[np.lexsort(keys.T[::-1])]
    assert (np.abs(np.diff(walk, axis=0)).sum(1) == 1).all()
    rng = np.random.default_rng(6)
    own = rng.integers(-20, 20, (50, 64))
    middles = np.concatenate([rng.integers(-20, 20, (3, 64)), rng.integers(500, 600, (30, 64)), np.zeros((2, 64), int)])
    left = centroids.candidates(own.min(0), own.max(0), middles)
    away = ((own[:, None] - middles[None]) ** 2).sum(2)
    assert set(away.argmin(1)) <= set(left) and len(left) <= 5


def test_a_common_vector_is_dealt_over_partitions(spark):
    frame = spark.range(4000).select(
        F.col("id").alias("vec_id"), F.array_repeat(F.when(F.col("id") % 3 > 0, 0.5).otherwise(F.rand(3)).cast("float"), 64).alias("embedding")
    )
    blocks = centroids.hilbert_blocks(frame, 64, 256, 64)
    sizes = [r.n for r in blocks.groupBy(F.input_file_name()).agg(F.sum(F.size("vec_id")).alias("n")).collect()]
    assert sum(sizes) == 4000 and max(sizes) < 3 * 4000 / len(sizes)
