"""Autoencoder in -> 64 -> 32 -> 8 -> 32 -> 64 -> in, trained by rounds of local steps and averaging.

Each epoch sends the weights to the tasks, every task takes mini-batch steps over its partition, and the mean of
the tasks' weights, weighted by rows, goes on. Inputs are scaled by mean and deviation of the whole matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.quantiles import quantiles
from ..sources.store import kept as stored

HIDDEN = (64, 32, 8, 32, 64)


@dataclass
class Autoencoder:
    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray] = field(default_factory=list)
    threshold: float | None = None
    moments: list | None = None

    @classmethod
    def fresh(cls, mean: np.ndarray, scale: np.ndarray, seed: int) -> Autoencoder:
        rng, sizes = np.random.default_rng(seed), (len(mean), *HIDDEN, len(mean))
        weights = []
        for a, b in zip(sizes, sizes[1:], strict=False):
            weights += [rng.normal(0, np.sqrt(2 / a), (a, b)), np.zeros(b)]
        return cls(mean, np.where(scale > 0, scale, 1.0), weights)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale

    def forward(self, z: np.ndarray) -> list[np.ndarray]:
        layers = [z]
        for k in range(0, len(self.weights), 2):
            z = z @ self.weights[k] + self.weights[k + 1]
            if k < len(self.weights) - 2:
                z = np.maximum(z, 0)
            layers.append(z)
        return layers

    def errors(self, x: np.ndarray) -> np.ndarray:
        """Squared error of each scaled feature."""
        z = self.scaled(x)
        return (self.forward(z)[-1] - z) ** 2

    def fit(self, x: np.ndarray, batch: int, rate: float, seed: int) -> None:
        """One pass of Adam over x, whose moments go on from the pass before."""
        z, rng = self.scaled(x), np.random.default_rng(seed)
        m, v, t = self.moments or ([np.zeros_like(w) for w in self.weights], [np.zeros_like(w) for w in self.weights], 0)
        for rows in np.array_split(rng.permutation(len(z)), max(1, len(z) // batch)):
            layers = self.forward(z[rows])
            back = 2 * (layers[-1] - z[rows]) / layers[-1].size
            t += 1
            for k in range(len(self.weights) - 2, -1, -2):
                grads = layers[k // 2].T @ back, back.sum(0)
                if k:
                    back = (back @ self.weights[k].T) * (layers[k // 2] > 0)
                for j, g in enumerate(grads):
                    i = k + j
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    self.weights[i] = self.weights[i] - rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
        self.moments = [m, v, t]


def _array(s: pd.Series) -> np.ndarray:
    return np.array(s.tolist(), float).reshape(len(s), -1)


def train(matrix: DataFrame, epochs: int = 10, patience: int = 3, batch: int = 16, rate: float = 1e-3, seed: int = 42, share: float = 0.9) -> Autoencoder | None:
    """A fitted model, its threshold the given quantile of training errors; None for an empty matrix. A fifth of the rows
    (by hash) validates each epoch's weights; training ends after `patience` epochs without gain."""
    width = matrix.limit(1).select(F.size("vector")).first()
    if width is None:
        return None
    stats = matrix.agg(*[f(F.col("vector")[k]).alias(f"{n}{k}") for k in range(width[0]) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    model = Autoencoder.fresh(np.array([stats[f"m{k}"] for k in range(width[0])]), np.array([stats[f"s{k}"] for k in range(width[0])]), seed)
    spark = matrix.sparkSession
    split = matrix.select("vector", (F.pmod(F.xxhash64("vector"), F.lit(5)) == 0).alias("validation")).persist()
    best, left, kept = np.inf, patience, model.weights
    for epoch in range(epochs + 1):  # the last round only validates
        frozen = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pd.DataFrame], epoch=epoch, frozen=frozen) -> Iterator[pd.DataFrame]:
            m = frozen.value
            own = Autoencoder(m.mean, m.scale, list(m.weights))
            rows, error, checked = 0, 0.0, 0
            for pdf in batches:
                x, hold = _array(pdf["vector"]), pdf["validation"].to_numpy()
                error += float(m.errors(x[hold]).mean(1).sum())
                checked += int(hold.sum())
                if epoch < epochs and (~hold).any():
                    own.fit(x[~hold], batch, rate, seed + epoch)
                    rows += int((~hold).sum())
            yield pd.DataFrame({"rows": [rows], "error": [error], "checked": [checked], "weights": [np.concatenate([w.ravel() for w in own.weights]).tobytes()]})

        parts = split.mapInPandas(run, "rows long, error double, checked long, weights binary").filter("rows + checked > 0")
        # weights of fixed size per task; summed on the executors before they come back
        summed = parts.groupBy((F.spark_partition_id() % 8).alias("g")).applyInPandas(_summed, "rows long, error double, checked long, weights binary").toPandas()
        total = _summed(summed) if len(summed) else None
        if total is None:
            break
        error = total["error"].iloc[0] / max(1, total["checked"].iloc[0])
        if error < best - 1e-9:
            best, left, kept = error, patience, model.weights
        else:
            left -= 1
        if not left or not total["rows"].iloc[0]:
            break
        flat, at, new = np.frombuffer(total["weights"].iloc[0]), 0, []
        for w in model.weights:
            new.append(flat[at : at + w.size].reshape(w.shape))
            at += w.size
        model = Autoencoder(model.mean, model.scale, new)
    model = Autoencoder(model.mean, model.scale, kept)
    model.threshold = quantiles(stored(score(matrix, model).select("ae_error")), ["ae_error"], [share])["ae_error"][0]
    split.unpersist()
    return model


def _summed(pdf: pd.DataFrame) -> pd.DataFrame:
    """Mean of the weights by rows, and the sums of the rest."""
    rows = int(pdf["rows"].sum())
    mean = np.sum([np.frombuffer(w) * r for w, r in zip(pdf["weights"], pdf["rows"], strict=True)], axis=0) / max(rows, 1)
    return pd.DataFrame({"rows": [rows], "error": [pdf["error"].sum()], "checked": [int(pdf["checked"].sum())], "weights": [mean.tobytes()]})


def score(matrix: DataFrame, model: Autoencoder, vector: str = "vector") -> DataFrame:
    """Adds ae_error (mean squared error of the scaled row) and ae_parts (absolute error per feature)."""
    frozen = matrix.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<ae_error: double, ae_parts: array<double>>")
    def run(s: pd.Series) -> pd.DataFrame:
        e = np.concatenate([frozen.value.errors(_array(s.iloc[k : k + 2_000])) for k in range(0, max(len(s), 1), 2_000)])
        return pd.DataFrame({"ae_error": e.mean(1), "ae_parts": list(np.sqrt(e))})

    return matrix.withColumn("_ae", run(vector)).select("*", "_ae.ae_error", "_ae.ae_parts").drop("_ae")
