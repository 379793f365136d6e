"""Folds with carried state, scans in two passes, quantiles by counting: against plain loops, over many partitions and batches."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hostlight.operators import baselines, carry, dedup, evaluate, features, federated, quantiles, scan

NULL = None


@pytest.fixture
def small_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    yield spark
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def skewed(n=400, seed=0):
    """Rows of which a third belong to one key, with a null key and keys of one row."""
    rng = np.random.default_rng(seed)
    keys = [("hot" if k % 3 == 0 else None if k % 29 == 0 else f"k{int(rng.integers(0, 60))}") for k in range(n)]
    return [(keys[k], int(rng.integers(0, 900)) * 1_000_000, k, ["critical", "low", "medium", "odd"][k % 4], float(rng.normal())) for k in range(n)]


SCHEMA = "client_id string, us long, id long, severity string, value double"


def by_key(data):
    groups = {}
    for r in sorted(data, key=lambda r: (r[1], r[2])):
        groups.setdefault(r[0], []).append(r)
    return groups


def test_fold_carries_state_across_batches(small_batches):
    data = skewed()
    df = small_batches.createDataFrame(data, SCHEMA).repartition(5)
    got = {r["id"]: r["kept"] for r in dedup.ttl_dedup(df, "client_id").collect()}
    want = {}
    for rows in by_key(data).values():
        for r, k in zip(rows, dedup.ttl_kept([r[1] for r in rows], [1_000_000 * dedup.SERVER_TTL.get(r[3], dedup.OTHER_TTL) for r in rows]), strict=True):
            want[r[2]] = k
    assert got == want and 0 < sum(want.values()) < len(want)
    limited = {r["id"]: r["kept"] for r in dedup.rate_limit(df, 3, 50_000_000).collect()}
    for rows in by_key(data).values():
        times = []
        for r in rows:
            times = [t for t in times if t > r[1] - 50_000_000]
            assert limited[r[2]] == (len(times) < 3)
            times += [r[1]] if len(times) < 3 else []
    recent = {r["id"]: r["kept"] for r in dedup.recent_dedup(df, "severity", last=2).collect()}
    for rows in by_key(data).values():
        last = []
        for r in rows:
            assert recent[r[2]] == (r[3] not in last)
            last = [*last, r[3]][-2:] if r[3] not in last else last


def test_fold_of_nothing(spark):
    assert dedup.ttl_dedup(spark.createDataFrame([], SCHEMA), "client_id").collect() == []


def test_reputation_is_folded_per_client(small_batches):
    rng = np.random.default_rng(1)
    data = [(f"c{k % 4}", k, float(rng.uniform(0, 20)), bool(k % 3 == 0)) for k in range(120)]
    df = small_batches.createDataFrame(data, "client_id string, us long, post_norm double, was_clipped boolean").repartition(6)
    got = federated.reputation(df).toPandas().sort_values("us")
    for c, g in got.groupby("client_id"):
        rows = [r for r in data if r[0] == c]
        assert np.allclose(g.reputation, federated.reputation_steps([r[2] for r in rows], [r[3] for r in rows], [r[2] > 15 for r in rows]))
        assert np.allclose(g.mean_norm, pd.Series([r[2] for r in rows]).expanding().mean()) and g.clips.tolist() == np.cumsum([r[3] for r in rows]).tolist()


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_scans_do_not_depend_on_partitions(small_batches, parts):
    small_batches.conf.set("spark.sql.shuffle.partitions", parts)
    small_batches.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        data = skewed(300, 3)
        df = small_batches.createDataFrame(data, SCHEMA).repartition(5)
        order = [F.col("us"), F.col("id")]
        ema = {r["id"]: r["ema"] for r in scan.scan(df, ["client_id"], order, scan.Forgetting(0.9)).collect()}
        sums = {r["id"]: (r["total"], r["rank"]) for r in scan.numbered(scan.scan(df, ["client_id"], order, scan.Sums(total="value")), ["client_id"], order).collect()}
        factors = df.withColumn("factor", F.exp(F.col("value") / 4))
        bounded = {r["id"]: r["sensitivity"] for r in scan.scan(factors, ["client_id"], order, scan.Bounded(1.0, 0.5, 2.0)).collect()}
    finally:
        small_batches.conf.set("spark.sql.shuffle.partitions", 4)
        small_batches.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for rows in by_key(data).values():
        e, total, s = None, 0.0, 1.0
        for n, r in enumerate(rows, 1):
            e = r[4] if e is None else 0.9 * e + 0.1 * r[4]
            total, s = total + r[4], min(2.0, max(0.5, s * np.exp(r[4] / 4)))
            assert np.isclose(ema[r[2]], e) and np.isclose(sums[r[2]][0], total) and sums[r[2]][1] == n and np.isclose(bounded[r[2]], s)


def test_long_runs_of_an_average_that_forgets(spark):
    op, x = scan.Forgetting(0.95), np.random.default_rng(5).normal(size=500)
    whole, end = op.rows(None, [x])
    step = op.then(op.step([x[:123]]), op.step([x[123:]]))
    assert np.isclose(op.after(None, step), whole[0][-1]) and np.isclose(op.after(op.rows(None, [x[:77]])[1], op.step([x[77:]])), end)


def test_robust_scores_stream(small_batches):
    rng = np.random.default_rng(2)
    data = [("hot" if k % 2 else f"c{k % 6}", k, float(rng.normal()), float(k % 5)) for k in range(500)]
    df = small_batches.createDataFrame(data, "client_id string, window_us long, a double, b double").repartition(5)
    for chunk in (None, 60):
        got = features.robust_normalize(df, ("a", "b"), last=30, chunk=chunk).toPandas().sort_values("window_us")
        assert len(got) == 500
        for c, g in got.groupby("client_id"):
            x = np.array([r[2:] for r in data if r[0] == c])
            want = []
            for k in range(len(x)):
                h = x[max(0, k - 29) : k + 1]
                mad = np.median(np.abs(h - np.median(h, 0)), 0)
                spread = h.max(0) - h.min(0)
                scores = np.where(mad > 1e-6, (x[k] - np.median(h, 0)) / (1.4826 * np.maximum(mad, 1e-12)), np.where(spread > 1e-6, (x[k] - h.min(0)) / np.maximum(spread, 1e-12), 0.0))
                want.append(np.clip(x[k], -3, 3) if len(h) < 20 else scores)
            assert np.allclose(g[["a", "b"]].to_numpy(), want)


def test_quantiles_by_counting(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW", 5)
    monkeypatch.setattr(quantiles, "BINS", 4)
    rng = np.random.default_rng(6)
    n = 700
    x = {"a": rng.normal(size=n), "ties": rng.integers(0, 3, n).astype(float), "wide": np.exp(rng.normal(0, 60, n)), "same": np.full(n, 2.5), "few": np.where(np.arange(n) < 3, np.arange(n) * 1.5, np.nan)}
    df = spark.createDataFrame(pd.DataFrame(x)).withColumn("none", F.lit(None).cast("double"))
    shares = [0.0, 0.1, 0.25, 0.5, 0.995, 1.0]
    got = quantiles.quantiles(df, [*x, "none"], shares)
    for c, v in x.items():
        assert np.allclose(got[c], np.quantile(v[~np.isnan(v)], shares), rtol=1e-12), c
    assert got["none"] == [None] * 6 and quantiles.quantiles(df.limit(0), ["a"], [0.5]) == {"a": [None]}
    assert quantiles.quantiles(spark.createDataFrame([(float("-inf"),), (1.0,), (2.0,), (3.0,), (float("inf"),)] * 3, "v double"), ["v"], [0.5])["v"] == [2.0]


def test_sensitivity_is_bounded_after_each_factor(spark):
    values = [0.0] * 30 + [100.0 * (k % 2) for k in range(60)]
    df = spark.createDataFrame([("c", "network", k, k, v) for k, v in enumerate(values)], "client_id string, metric string, us long, id long, value double")
    got = baselines.running_sensitivity(df).orderBy("id").toPandas()
    s = 1.0
    for f, v in zip(got.factor, got.sensitivity, strict=True):
        s = min(2.0, max(0.5, s * f))
        assert np.isclose(v, s)
    assert got.sensitivity.min() < 0.7 and got.sensitivity.max() == 2.0


def test_weighted_trimmed_mean_with_ties(spark):
    rng = np.random.default_rng(8)
    data = [(1 + k % 2, f"c{k:03d}", "key", float(rng.integers(0, 4)), float(rng.uniform(1, 9))) for k in range(80)]
    df = spark.createDataFrame(data, "round int, client_id string, key string, value double, w double").repartition(7)
    got = {r["round"]: (r["value"], r["kept"]) for r in federated.trimmed_mean(df, weight="w").collect()}
    for rnd in (1, 2):
        rows = sorted((r for r in data if r[0] == rnd), key=lambda r: (r[3], r[1]))[4:-4]
        assert np.isclose(got[rnd][0], sum(r[3] * r[4] for r in rows) / sum(r[4] for r in rows)) and got[rnd][1] == 32


def test_curve_of_one_large_model(spark):
    rng = np.random.default_rng(9)
    data = [("m", float(rng.integers(0, 50)), bool(rng.random() < 0.3)) for _ in range(600)]
    df = spark.createDataFrame(data, "model string, score double, label boolean").repartition(6)
    up = [s for _, s, label in data if label]
    down = [s for _, s, label in data if not label]
    want = np.mean([(a > b) + (a == b) / 2 for a in up for b in down])
    assert np.isclose(evaluate.auc(df).first()["auc"], want)
    assert carry.key_rows(pd.DataFrame({"a": [1.0, None], "b": ["x", None]}), ["a", "b"]) == [(1.0, "x"), (None, None)]
