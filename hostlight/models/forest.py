"""Isolation forest: Spark draws the rows of each tree, tasks build trees, a broadcast forest scores rows.

Training moves at most trees x sample rows. A vector is an array of doubles of one length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.quantiles import quantiles
from ..sources.store import kept


def expected_depth(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> np.ndarray:
    """A tree as rows (feature or -1, threshold, left, right, value): value is a leaf's depth."""
    nodes: list[list[float]] = []

    def split(rows: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0, 0, 0, depth + float(expected_depth(len(rows)))])
        low, high = rows.min(0), rows.max(0)
        able = np.flatnonzero(high > low)
        if depth < limit and len(rows) > 1 and len(able):
            f = int(rng.choice(able))
            cut = rng.uniform(low[f], high[f])
            left = rows[:, f] < cut
            if left.any() and not left.all():
                nodes[me][:4] = [f, cut, split(rows[left], depth + 1), split(rows[~left], depth + 1)]
        return me

    split(x, 0)
    return np.array(nodes)


def depths(tree: np.ndarray, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    feature = tree[:, 0].astype(np.int64)
    while (open_ := np.flatnonzero(feature[at] >= 0)).size:
        node = at[open_]
        goes_left = x[open_, feature[node]] < tree[node, 1]
        at[open_] = np.where(goes_left, tree[node, 2], tree[node, 3]).astype(np.int64)
    return tree[at, 4]


def train(matrix: DataFrame, trees: int = 200, sample: int = 256, seed: int = 42) -> list[np.ndarray]:
    """Trees of samples with replacement, drawn by Spark: a row joins each tree with one chance, whatever the table's size.

    One hash gives the first tree that a row joins, so that rows of none are done with it; the later trees have a hash each.
    """
    n = matrix.count()
    if n == 0:
        return []
    chance = min(1 - 1e-12, 2.0 * sample / n)
    rows = matrix.select("vector", F.monotonically_increasing_id().alias("_row"))
    even = lambda *salt: F.pmod(F.xxhash64(F.lit(seed), *salt, "vector", F.col("_row")), F.lit(1 << 30)) / float(1 << 30)
    joined = rows.withColumn("first", F.floor(F.log1p(-even(F.lit(-1))) / float(np.log1p(-chance))).cast("int")).filter(F.col("first") < trees)
    later = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: (t == F.col("first")) | ((t > F.col("first")) & (even(t) < chance)))
    drawn = joined.withColumn("tree", F.explode(later)).select("vector", "tree", even(F.lit(-2), F.col("tree")).alias("u"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        pdf = pdf.sort_values("u", kind="stable")
        rows = np.array(pdf["vector"].tolist(), float)
        rng = np.random.default_rng(seed * 1_000_003 + tree)
        size = min(sample, n)
        picked = rows[rng.integers(0, len(rows), size)] if len(rows) < size else rows[:size]
        return pd.DataFrame({"tree": [tree], "nodes": [grow(picked, rng, int(np.ceil(np.log2(max(size, 2))))).tobytes()]})

    found = drawn.groupBy("tree").applyInPandas(build, "tree int, nodes binary").orderBy("tree").collect()
    return [np.frombuffer(r["nodes"]).reshape(-1, 5) for r in found]


def score(matrix: DataFrame, forest: list[np.ndarray], sample: int = 256, vector: str = "vector", name: str = "iso_score") -> DataFrame:
    """Adds the negative anomaly score, -2^(-mean depth / expected depth): lower is odder; null without a forest."""
    frozen = matrix.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")  # not by iterator, so that one worker evaluates it with other models' functions
    def run(s: pd.Series) -> pd.Series:
        out = np.empty(len(s))
        for begin in range(0, len(s), 2_000):
            x = np.array(s.iloc[begin : begin + 2_000].tolist(), float).reshape(-1, len(s.iloc[0]))
            mean = sum(depths(t, x) for t in frozen.value) / len(frozen.value)
            out[begin : begin + 2_000] = -np.exp2(-mean / max(float(expected_depth(sample)), 1e-9))
        return pd.Series(out)

    return matrix.withColumn(name, run(vector) if forest else F.lit(None).cast("double"))


def threshold(scores: DataFrame, share: float = 0.1, name: str = "iso_score") -> float | None:
    """The score below which a share of the training rows lies."""
    return quantiles(kept(scores.select(name)), [name], [share])[name][0]
