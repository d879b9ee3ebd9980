"""Quality selection by importance resampling.

Words and word pairs are hashed into ``BUCKETS`` features. A document's log weight is the sum over its
features of log p_target - log p_raw, the target being labelled good text, raw being all text. Adding Gumbel
noise, fixed per document by a hash, and taking the k largest draws k documents without replacement in
proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asofkit.llm.common import byte_words, materialised

BUCKETS = 1 << 17
TARGET_DOCS = 20_000
SMOOTHING = 0.5
CACHED_WORDS = 500_000
RANGES = 4_096  # per pass of the search for the edge of the sample
PASSES = 8
EDGE_ROWS = 100_000


class Features:
    """Buckets of the words and word pairs of a text."""

    def __init__(self) -> None:
        self.words: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.words
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter((known[w] for w in words), np.uint64, len(words))
        pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]) * np.uint64(0xFF51AFD7ED558CCD)
        return (np.concatenate([h, pairs]) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def feature_counts(texts: DataFrame) -> np.ndarray:
    """How often each bucket occurs in the ``text`` column; tasks add up arrays of fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, features = np.zeros(BUCKETS, np.int64), Features()
        for batch in batches:
            for words in byte_words(batch.column(0)):
                np.add.at(total, features(words), 1)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    found = rows.toPandas()  # at most BUCKETS rows
    counts = np.zeros(BUCKETS)
    counts[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy()
    return counts


def target_ids(labels: DataFrame, docs: int) -> DataFrame:
    """At most ``docs`` ids labelled good and not toxic, the first in hash order."""
    good = labels.filter((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0) & F.col("doc_id").isNotNull())
    order = F.xxhash64("doc_id")
    share = min(1.0, 2 * docs / max(good.count(), 1))
    near = good.filter(F.pmod(order, F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("doc_id").distinct()
    return near.orderBy(order, "doc_id").limit(docs)


def log_ratio(documents: DataFrame, labels: DataFrame, docs: int = TARGET_DOCS) -> np.ndarray:
    chosen = documents.join(F.broadcast(target_ids(labels, docs)), "doc_id", "left_semi")
    target, raw = feature_counts(chosen), feature_counts(documents)
    target, raw = (np.log((c + SMOOTHING) / (c + SMOOTHING).sum()) for c in (target, raw))
    return (target - raw).astype(np.float32)


def weighted(documents: DataFrame, ratio: np.ndarray) -> DataFrame:
    """(doc_id, n_features, log_weight, noisy); equal rows get equal noise."""
    shared = documents.sparkSession.sparkContext.broadcast(ratio)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            sizes, weights = [], []
            for words in byte_words(batch.column(1)):
                own = features(words)
                sizes.append(len(own))
                weights.append(float(shared.value[own].sum(dtype=np.float64)))
            arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(weights, pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_features", "log_weight"])

    rows = documents.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        weigh, "doc_id long, n_features long, log_weight double"
    )
    uniform = (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return rows.withColumn("noisy", F.col("log_weight") - F.log(-F.log(uniform)))


def sampled(documents: DataFrame, labels: DataFrame, share: float | None = None, docs: int = TARGET_DOCS) -> DataFrame:
    """Per document: doc_id, n_features, log_weight, noisy, kept.

    Kept are the ``share`` of all rows with the largest noisy weights; by default as many as the labels call good and
    not toxic. Ties go by doc_id. A null or empty text has weight 0. Without labels the weights are those of a
    uniform target and all rows are kept. One row per input row; columns other than doc_id, text, quality and toxic are
    not looked at. The target is fitted on at most ``docs`` labelled documents, raw text on all.
    """
    rows = materialised(weighted(documents, log_ratio(documents, labels, docs)), "weights")
    if share is None:
        good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
        share = labels.agg(F.avg(good.cast("double"))).first()[0]
        share = 1.0 if share is None else share
    n = rows.count()
    wanted = min(n, round(share * n))
    if wanted in (0, n):
        return rows.withColumn("kept", F.lit(wanted > 0))
    kept, edge, left = narrowed(rows, wanted)
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("noisy"), "doc_id")  # the few rows at the edge
    inside = rows.filter(edge).withColumn("kept", F.row_number().over(order) <= left)
    return rows.filter(~edge).withColumn("kept", kept).unionByName(inside)


def narrowed(rows: DataFrame, wanted: int, edge_rows: int = EDGE_ROWS) -> tuple[Column, Column, int]:
    """(surely among the first ``wanted``, at the edge, how many of the edge's rows are wanted).

    Rows go by falling ``noisy``, then by doc_id. A pass counts the rows at the edge in ``RANGES`` equal ranges of the key and
    goes on inside the range that holds the edge, until that has at most ``edge_rows`` rows or one value; then the next key is taken. So
    no value, however far out, and no number of ties puts the rows into one range.
    """
    kept, edge, left = F.lit(False), F.lit(True), wanted
    for key in (-F.col("noisy"), F.coalesce(F.col("doc_id").cast("double"), F.lit(-1e300))):
        for _ in range(PASSES):
            ends = rows.filter(edge).agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count(F.lit(1)).alias("n")).first()
            if left == ends.n:  # all of them
                return kept | edge, F.lit(False), 0
            if ends.n <= edge_rows:
                return kept, edge, left
            if ends.low == ends.high:
                break
            # halves are taken before the difference, which could overflow
            place = F.least(F.floor((key / 2 - ends.low / 2) / (ends.high / 2 - ends.low / 2) * RANGES), F.lit(RANGES - 1))
            sizes = sorted((r.at, r.n) for r in rows.filter(edge).groupBy(place.alias("at")).agg(F.count(F.lit(1)).alias("n")).collect())
            for at, size in sizes:  # at most RANGES rows
                if left <= size:
                    break
                left -= size
            kept, edge = kept | (edge & (place < at)), edge & (place == at)
    return kept, edge, left  # equal rows
