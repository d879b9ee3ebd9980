"""A ranker learned from pairs: within a request, relevant candidates should score above the others.

The model is linear in the logarithms of the features and in flags for missing values, so it scores in plain columns. Its
logistic loss over all (relevant, other) pairs of a request, each request counting alike, needs the candidates of one request
together and nothing else: requests are packed once, every step sums the gradients of all requests by tasks and slots, and
only the sum, as long as the model, comes to the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from asofkit.definitions import RANKER_FEATURES
from asofkit.plans.ranking import top_k_by_score, with_positives
from asofkit.session import checkpointed


@dataclass(frozen=True)
class PairwiseConfig:
    iterations: int = 60
    step: float = 0.15
    patience: int = 8
    l2: float = 1e-4


def log_features(features: Sequence[str]) -> list[Column]:
    """Per feature: sign(x) * log(1 + |x|), 0 if missing, and whether it is missing."""
    out = []
    for f in features:
        x = F.col(f).cast("double")
        out.append(F.coalesce(F.signum(x) * F.log1p(F.abs(x)), F.lit(0.0)))
        out.append(x.isNull().cast("double"))
    return out


class PairwiseRanker:
    def __init__(self, config: PairwiseConfig | None = None, features: Sequence[str] = RANKER_FEATURES) -> None:
        self.config = config or PairwiseConfig()
        self.features = list(features)
        self.weights: np.ndarray | None = None
        self.losses: list[tuple[float, float]] = []

    def _packed(self, frame: DataFrame, valid: bool) -> DataFrame:
        """One row per request with a relevant and another candidate; candidates of a request are few hundred."""
        rows = with_positives(frame).select("request_id", F.struct(F.array(*log_features(self.features)).alias("x"), F.col("label").cast("int").alias("y")).alias("c"))
        packed = rows.groupBy("request_id").agg(F.collect_list("c").alias("c"))
        return packed.select(F.flatten("c.x").alias("x"), F.col("c.y").alias("y"), F.lit(valid).alias("valid"))

    def fit(self, train: DataFrame, valid: DataFrame) -> list[tuple[float, float]]:
        """Losses on both parts after every step; the weights of the best step on ``valid`` are kept."""
        cfg, size = self.config, 2 * len(self.features)
        rows = checkpointed(self._packed(train, False).unionByName(self._packed(valid, True)))
        n, mean, spread = moments(rows, size)
        scale = np.where(spread > 1e-12, spread, 1.0)
        w, first, second = np.zeros(size), np.zeros(size), np.zeros(size)
        best, best_loss, since = w, np.inf, 0
        self.losses = []
        for t in range(1, cfg.iterations + 1):
            found = gradient(rows, w, mean, scale)
            requests = np.maximum(found[-2:], 1)
            losses = tuple((found[-4:-2] / requests).tolist())
            self.losses.append(losses)
            if losses[1] < best_loss - 1e-6:
                best, best_loss, since = w.copy(), losses[1], 0
            else:
                since += 1
                if since >= cfg.patience:
                    break
            g = found[:size] / requests[0] + cfg.l2 * w
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
            w = w - cfg.step * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        self.weights = best / scale
        self.gain = np.abs(best)
        return self.losses

    def predict(self, frame: DataFrame) -> DataFrame:
        terms = [F.lit(float(w)) * x for w, x in zip(self.weights, log_features(self.features), strict=True)]
        return frame.withColumn("score", sum(terms[1:], terms[0]))

    def rerank(self, frame: DataFrame, k: int) -> DataFrame:
        """Top ``k`` per request; a request without candidates has no rows."""
        return top_k_by_score(self.predict(frame), k)

    def importance(self) -> dict[str, float]:
        """Share of the weights over standardised inputs per feature, largest first."""
        share = self.gain.reshape(-1, 2).sum(1)
        share = share / (share.sum() or 1.0)
        return dict(sorted(zip(self.features, share.tolist(), strict=True), key=lambda item: -item[1]))

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        row = [(json.dumps(asdict(self.config)), self.features, self.weights.tolist(), self.gain.tolist())]
        spark.createDataFrame(row, "config string, features array<string>, weights array<double>, gain array<double>").write.mode(
            "overwrite"
        ).parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PairwiseRanker:
        row = spark.read.parquet(path).first()
        ranker = cls(PairwiseConfig(**json.loads(row.config)), row.features)
        ranker.weights, ranker.gain = np.array(row.weights), np.array(row.gain)
        return ranker


def _summed(rows: DataFrame, totals, slots: int) -> np.ndarray:
    """Sums over all requests: one array per task, then one value per slot."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(slots)
        for batch in batches:
            for x, y, valid in zip(batch["x"], batch["y"], batch["valid"], strict=True):
                totals(out, np.asarray(x).reshape(len(y), -1), np.asarray(y) > 0, valid)
        yield pd.DataFrame({"slot": np.arange(slots), "value": out})

    found = rows.mapInPandas(run, "slot long, value double").groupBy("slot").agg(F.sum("value").alias("value")).collect()
    out = np.zeros(slots)
    for r in found:
        out[r.slot] = r.value
    return out


def moments(rows: DataFrame, size: int) -> tuple[float, np.ndarray, np.ndarray]:
    """Number, mean and deviation of the training candidates' inputs."""

    def totals(out: np.ndarray, x: np.ndarray, y: np.ndarray, valid: bool) -> None:
        if not valid:
            out[:size] += x.sum(0)
            out[size : 2 * size] += (x**2).sum(0)
            out[-1] += len(x)

    found = _summed(rows, totals, 2 * size + 1)
    n = max(found[-1], 1.0)
    mean = found[:size] / n
    return n, mean, np.sqrt(np.maximum(found[size : 2 * size] / n - mean**2, 0))


def gradient(rows: DataFrame, w: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The training gradient, then losses and numbers of requests of the training and validation part."""
    size = len(w)

    def totals(out: np.ndarray, x: np.ndarray, y: np.ndarray, valid: bool) -> None:
        if y.all() or not y.any():
            return
        x = (x - mean) / scale
        s = x @ w
        apart = s[y][:, None] - s[~y][None, :]
        out[-4 + valid] += np.logaddexp(0, -apart).mean()
        out[-2 + valid] += 1
        if not valid:
            pull = 1 / (1 + np.exp(np.minimum(apart, 500))) / apart.size
            out[:size] += pull.sum(0) @ x[~y] - pull.sum(1) @ x[y]

    return _summed(rows, totals, size + 4)
