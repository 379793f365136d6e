"""Keyed state of the agent and the server as Structured Streaming: histories, baselines, averages, known files, reputation.

Each key has several state variables with a time to live, so that keys that fall silent leave the store (the sessions need
the RocksDB state store: `use_rocksdb`). Rows of a key are taken in the order of (us, id) within a micro-batch, and
micro-batches as they come: as long as the source is in the order of time, results are those of the batch operators,
also across restarts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.federated import reputation_step

DAY_MS = 86_400_000
#: Buckets of known hashes: a key of the store holds a map of the hashes in it.
HASH_BUCKETS = 256


def use_rocksdb(spark: SparkSession, to_the_end: bool = False) -> None:
    """Settings of stateful streams. `to_the_end`: for runs with availableNow, which otherwise never end, as state with a
    time to live asks for one micro-batch without data after the other."""
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", not to_the_end)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Keyed(StatefulProcessor):
    """Gathers a key's rows of a micro-batch in order; subclasses add output columns from their state."""

    ttl_ms: int = 30 * DAY_MS
    order: tuple[str, ...] = ("us", "id")

    def added(self, rows: pd.DataFrame) -> dict[str, Sequence]:
        raise NotImplementedError

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows), ignore_index=True).sort_values(list(self.order), ignore_index=True)
        yield frame.assign(**self.added(frame))

    def close(self) -> None:
        pass


def _keyed(df: DataFrame, keys: Sequence[str], processor: Keyed, out: dict[str, str]) -> DataFrame:
    schema = df.withColumns({name: F.lit(None).cast(kind) for name, kind in out.items()}).schema
    return df.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "ProcessingTime")


class Baseline(Keyed):
    """State of a client's metric: its last values (a list) and their moving average (a value)."""

    def __init__(self, last: int = 200, least: int = 10, threshold: float = 2.5, alpha: float = 0.95):
        self.last, self.least, self.threshold, self.alpha = last, least, threshold, alpha

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getListState("values", "value double", self.ttl_ms)
        self.average = handle.getValueState("average", "ema double", self.ttl_ms)

    def added(self, rows: pd.DataFrame) -> dict[str, Sequence]:
        before = [v[0] for v in self.values.get()] if self.values.exists() else []
        ema = self.average.get()[0] if self.average.exists() else None
        x, n = np.array([*before, *rows["value"]]), len(before)
        z, averages = [], []
        for k in range(n, len(x)):
            past = x[max(0, k - self.last) : k]
            std = past.std() if len(past) >= self.least else 0.0
            z.append((x[k] - past.mean()) / std if std > 0 else None)
            ema = x[k] if ema is None else self.alpha * ema + (1 - self.alpha) * x[k]
            averages.append(ema)
        self.values.put([(float(v),) for v in x[-self.last :]])
        self.average.update((float(ema),))
        return {"z": pd.array(z, dtype="Float64"), "anomaly": [v is not None and abs(v) > self.threshold for v in z], "ema": averages}


def baseline_stream(metrics: DataFrame, **how) -> DataFrame:
    """Metrics (client_id, metric, us, id, value) with z, anomaly (as `baselines.zscore_detect`) and ema (`baselines.ema`)."""
    return _keyed(metrics.select("client_id", "metric", "us", "id", "value"), ["client_id", "metric"], Baseline(**how), {"z": "double", "anomaly": "boolean", "ema": "double"})


class KnownFiles(Keyed):
    """State of a bucket of hashes: a map from hash to its first sight."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getMapState("known", "hash string", "us long", self.ttl_ms)

    def added(self, rows: pd.DataFrame) -> dict[str, Sequence]:
        novel, risk = [], []
        for h, us, r in zip(rows["file_hash"], rows["us"], rows["risk_score"], strict=True):
            seen = h is None or self.known.containsKey((h,))
            novel.append(not seen)
            if not seen:
                self.known.updateValue((h,), (int(us),))
            risk.append(max(0.0, r - 1) if seen and h is not None else r)
        return {"novel": novel, "risk_after": risk}


def known_file_stream(files: DataFrame, buckets: int = HASH_BUCKETS) -> DataFrame:
    """Files (id, us, file_hash, risk_score) with novel and risk_after, as `detectors.hash_novelty`."""
    rows = files.select("id", "us", "file_hash", "risk_score", F.pmod(F.xxhash64("file_hash"), F.lit(buckets)).alias("bucket"))
    return _keyed(rows, ["bucket"], KnownFiles(), {"novel": "boolean", "risk_after": "double"}).drop("bucket")


class Reputation(Keyed):
    """State of a client: its reputation, updates, sum of norms and clips (one value)."""

    order = ("us",)
    names = ("r", "n", "sum", "clips")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("reputation", "r double, n long, sum double, clips long", self.ttl_ms)

    def added(self, rows: pd.DataFrame) -> dict[str, Sequence]:
        state = dict(zip(self.names, self.state.get(), strict=True)) if self.state.exists() else {}
        steps = [reputation_step(state, n, c, q) for n, c, q in zip(rows["post_norm"], rows["was_clipped"], rows["was_quarantined"], strict=True)]
        self.state.update((float(state["r"]), int(state["n"]), float(state["sum"]), int(state["clips"])))
        return dict(zip(("reputation", "mean_norm", "clips"), map(list, zip(*steps, strict=True)), strict=True))


def reputation_stream(contributions: DataFrame, quarantine_on: str = "post_norm", above: float = 15.0) -> DataFrame:
    """Contributions (client_id, us, post_norm, was_clipped, ...) with reputation, as `federated.reputation`."""
    rows = contributions.withColumn("was_quarantined", F.coalesce(F.col(quarantine_on) > above, F.lit(False)))
    return _keyed(rows, ["client_id"], Reputation(), {"reputation": "double", "mean_norm": "double", "clips": "long"})


class History(Keyed):
    """State of a client's remote address: its connections (a value) and the local ports seen (a map)."""

    ttl_ms = 7 * DAY_MS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.count = handle.getValueState("count", "n long, ports long", self.ttl_ms)
        self.ports = handle.getMapState("ports", "port int", "us long", self.ttl_ms)

    def added(self, rows: pd.DataFrame) -> dict[str, Sequence]:
        n, ports = self.count.get() if self.count.exists() else (0, 0)
        conn_n, ports_n = [], []
        for port, us in zip(rows["src_port"], rows["us"], strict=True):
            n += 1
            if not self.ports.containsKey((int(port),)):
                self.ports.updateValue((int(port),), (int(us),))
                ports += 1
            conn_n.append(n)
            ports_n.append(ports)
        self.count.update((n, ports))
        return {"conn_n": conn_n, "ports_n": ports_n}


def history_stream(network: DataFrame) -> DataFrame:
    """Connections with conn_n and ports_n, as `fleet.running_history`."""
    rows = network.select("client_id", "dst_ip", "dst_port", "id", "us", "src_port")
    return _keyed(rows, ["client_id", "dst_ip", "dst_port"], History(), {"conn_n": "long", "ports_n": "long"})
