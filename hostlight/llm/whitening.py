"""Embedding whitening: principal components of integer vectors, with weighted multiplicity covariance.

1. Identical vectors are grouped: each distinct vector is kept once, with the number of its rows.
2. Fit weights are these numbers, or one for each distinct vector (`weights`). Sums per dimension are exact integers.
3. The covariance is one weighted, centred GEMM per task. Vectors are centred by the integers nearest to the means, so
   that products are exact sums of small integers; what the means differ from those integers is taken off exactly.
   The driver gets sums only: as many numbers as the dimensions squared.
4. Each distinct vector is whitened once and joined back to its rows. Vectors of more than a thousandth of all rows
   (at most a thousand of them) are broadcast, so that no task of the join's shuffle holds more than that share.

Defined results: rows whose vector is null, empty, or holds null, non-finite or huge entries (2^56 and more, whose
integers don't fit) are dropped, and so are vectors of another length than the most usual one (of equally usual
lengths, the longest stays). A null key stays. Repeated rows count as often as they occur, and so do rows with one key and
different vectors. Components without variance have `whitened` 0 and don't count in `identity_error`; `deviation` is
null where it doesn't fit into a long. The sign of a component makes its largest entry positive; ties take the first.
An empty table, or one in which nothing remains, gives an empty table. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
LARGEST = 2.0**56
#: A vector of more rows than this share of all, and than this number, is sent to all executors.
HOT_SHARE, HOT_ROWS = 1000, 1000
#: Eigenvalues below this share of the largest, for each dimension, are no variance.
FLAT = 1e-14


def integers(vector: Column) -> Column:
    """Each entry as floor(64 * entry) + 1000000."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(OFFSET))


def usable(vector: Column) -> Column:
    entry = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < LARGEST)
    return vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, entry)


def _matrix(column: pa.Array, kind=np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted sums per dimension of a task's vectors, as decimal text."""
    total = None
    for batch in batches:
        if not batch.num_rows:
            continue
        x, w = _matrix(batch.column(0)), batch.column(1).to_numpy()
        if float(np.abs(x).max()) * float(w.sum()) >= 2.0**62:
            x, w = x.astype(object), w.astype(object)
        part = (x * w[:, None]).sum(axis=0).astype(object)
        total = part if total is None else total + part
    if total is not None:
        yield pa.RecordBatch.from_pydict({"i": pa.array(np.arange(len(total), dtype=np.int32)), "s": pa.array([str(v) for v in total])})


def _scatter(batches: Iterator[pa.RecordBatch], centre: np.ndarray, kind=np.int64) -> Iterator[pa.RecordBatch]:
    """Weighted products of a task's centred vectors, and in column -1 their weighted sums."""
    total = None
    for batch in batches:
        if batch.num_rows:
            x, w = (_matrix(batch.column(0), kind) - centre).astype(np.float64), batch.column(1).to_numpy().astype(np.float64)
            part = np.column_stack([(x * w[:, None]).T @ x, w @ x])
            total = part if total is None else total + part
    if total is not None:
        d = len(total)
        i, j = np.divmod(np.arange(d * (d + 1), dtype=np.int32), d + 1)
        yield pa.RecordBatch.from_pydict({"i": i, "j": np.where(j == d, -1, j).astype(np.int32), "v": total.ravel()})


@dataclass
class Whitening:
    """A fitted whitening: number of fit rows, exact sums, components (columns) and their variances."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray

    @property
    def centre(self) -> np.ndarray:
        """The integers nearest to the means."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], dtype=np.int64)

    @property
    def flat(self) -> np.ndarray:
        return self.variances <= FLAT * len(self.sums) * max(self.variances[0], 0.0)

    def transform(self, x: np.ndarray) -> np.ndarray:
        rest = np.array([(s - self.n * int(m)) / self.n for s, m in zip(self.sums, self.centre, strict=True)])
        scale = np.where(self.flat, 0.0, 1 / np.sqrt(np.where(self.flat, 1.0, self.variances)))
        return (((x - self.centre) - rest) @ self.components) * scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums over dimensions of (n * x - sum)^2."""
        rest = np.array([s - self.n * int(m) for s, m in zip(self.sums, self.centre, strict=True)])
        d = x - self.centre
        if (float(np.abs(d).max(initial=0)) * self.n + self.n) ** 2 * d.shape[1] >= 2.0**62:
            d, rest = d.astype(object), rest.astype(object)
        out = ((self.n * d - rest) ** 2).sum(axis=1).tolist()
        return [v if v < 1 << 63 else None for v in out]


def distinct_vectors(df: DataFrame, vector: str) -> DataFrame:
    """Distinct integer vectors `x` of the most usual length with the number `n` of their rows."""
    v = F.col(f"`{vector}`")
    groups = stored(df.filter(usable(v)).select(integers(v).alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")))
    usual = groups.groupBy(F.size("x").alias("d")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return groups.filter(F.size("x") == (usual["d"] if usual else 0))


def fit(groups: DataFrame, weights: str = "counts", components: int = COMPONENTS) -> Whitening | None:
    """Fits on distinct vectors (`x`, `n`), weighted by their `counts` or with `one` each; None if there are none."""
    rows = groups.select("x", F.col("n") if weights == "counts" else F.lit(1).cast("long").alias("n"))
    n = rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    if not n:
        return None
    found = rows.mapInArrow(_sums, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sums = [int(r["s"]) for r in sorted(found)]
    model, d = Whitening(n, sums, np.empty(0), np.empty(0), np.empty(0)), len(sums)
    centre = model.centre
    products = rows.mapInArrow(lambda it: _scatter(it, centre), "i int, j int, v double").filter("j >= 0").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    p = np.zeros((d, d))
    p[products["i"], products["j"]] = products["v"]
    rest = [s - n * int(m) for s, m in zip(sums, centre, strict=True)]
    cov = np.array([[(int(p[i, j]) * n - rest[i] * rest[j]) / (n * n) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh((cov + cov.T) / 2)
    e, u = np.maximum(e[::-1], 0.0)[:components], u[:, ::-1][:, :components]
    u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
    trace = float(np.trace(cov))
    return Whitening(n, sums, u, e, e / trace if trace > 0 else e)


def _identity_error(white: DataFrame, model: Whitening, weights: str) -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity, over components with variance."""
    rows = white.select("white", F.col("n") if weights == "counts" else F.lit(1).cast("long").alias("n"))
    k = len(model.variances)
    found = rows.mapInArrow(lambda it: _scatter(it, np.zeros(k), np.float64), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    c = np.zeros((k, k + 1))
    c[found["i"], found["j"]] = found["v"] / model.n
    mean = c[:, -1]
    off = np.abs(c[:, :-1] - np.outer(mean, mean) - np.eye(k))[~model.flat][:, ~model.flat]
    return float(off.max(initial=0.0))


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", weights: str = "counts", components: int = COMPONENTS) -> DataFrame:
    """One row per row that remains: key, n, deviation, `white` (array of the components), explained (array), identity_error."""
    kind = df.schema[key].dataType.simpleString()
    groups = distinct_vectors(df, vector)
    model = fit(groups, weights, components)
    if model is None:
        return df.sparkSession.createDataFrame([], f"`{key}` {kind}, n long, deviation long, white array<double>, explained array<double>, identity_error double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0)) if batch.num_rows else np.empty((0, len(model.sums)), np.int64)
            y = pa.array(list(model.transform(x)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_pydict({"x": batch.column(0), "n": batch.column(1), "deviation": pa.array(model.deviations(x), pa.int64()), "white": y})

    white = stored(groups.mapInArrow(run, "x array<long>, n long, deviation long, white array<double>"))
    error = _identity_error(white, model, weights)
    v = F.col(f"`{vector}`")
    rows = df.filter(usable(v)).select(F.col(f"`{key}`").alias("key"), integers(v).alias("x"))
    total = groups.agg(F.sum("n").alias("n")).first()["n"]
    often = F.col("n") > max(HOT_ROWS, total // HOT_SHARE)
    hot = white.filter(often)
    if hot.isEmpty():
        joined = rows.join(white, "x")
    else:  # at most HOT_SHARE vectors
        joined = rows.join(F.broadcast(hot), "x").unionByName(rows.join(F.broadcast(hot.select("x")), "x", "left_anti").join(white.filter(~often), "x"))
    return joined.select(
        F.col("key").alias(key), F.lit(model.n).cast("long").alias("n"), "deviation", "white", F.array([F.lit(float(e)) for e in model.explained]).alias("explained"), F.lit(error).alias("identity_error"),
    )


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whiten(table(spark, sf_dir, "embeddings"))
    each = rows.select("vec_id", "n", "deviation", "explained", "identity_error", F.posexplode("white").alias("place", "whitened"))
    return each.select("vec_id", (F.col("place") + 1).cast("int").alias("component"), "n", "deviation", "whitened", F.element_at("explained", F.col("place") + 1).alias("explained"), "identity_error")
