"""Streaming jobs. Event time is a timestamp column `ts`; rows later than the watermark leave windows and state alone."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.fixed import OTHER_TTL, SERVER_TTL

WATERMARK = "2 minutes"


def window_counts(events: DataFrame, watermark: str = WATERMARK, span: str = "60 seconds") -> DataFrame:
    """Tumbling behaviour windows per client: connections, destinations, bytes, spawns, creations."""
    k = lambda kind: F.col("kind") == kind
    grouped = events.withWatermark("ts", watermark).groupBy("client_id", F.window("ts", span))
    out = grouped.agg(
        F.count_if(k("n")).alias("conns"), F.size(F.collect_set(F.when(k("n"), F.col("name")))).alias("dsts"), F.coalesce(F.sum(F.when(k("n"), F.col("bytes_sent"))), F.lit(0.0)).alias("sent"),
        F.count_if(k("p")).alias("spawns"), F.count_if(k("f") & F.col("flag")).alias("creates"),
    )
    return out.select("client_id", F.unix_micros("window.start").alias("window_us"), "conns", "dsts", "sent", "spawns", "creates")


def sliding_counts(logins: DataFrame, key: str = "source_ip", span: str = "10 minutes", slide: str = "1 minute", least: int = 5, watermark: str = WATERMARK) -> DataFrame:
    """Windows in which a client and key have at least so many logins."""
    out = logins.withWatermark("ts", watermark).groupBy("client_id", key, F.window("ts", span, slide)).agg(F.count("*").alias("n"))
    return out.filter(F.col("n") >= least).select("client_id", key, F.col("window.end").alias("until"), "n")


class TtlDedup(StatefulProcessor):
    """Keeps alerts outside their signature's time to live; state is one expiry per signature, dropped when it is over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.expiry = handle.getValueState("expiry", "us long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows), ignore_index=True)
        frame = frame.assign(us=frame["ts"].astype("datetime64[us]").astype("int64")).sort_values(["us", "id"])
        expiry = self.expiry.get()[0] if self.expiry.exists() else None
        kept = []
        for t, s in zip(frame["us"].tolist(), frame["severity"], strict=True):
            kept.append(expiry is None or expiry < t)
            if kept[-1]:
                expiry = t + 1_000_000 * SERVER_TTL.get(s, OTHER_TTL)
        if expiry is not None:
            self.expiry.update((expiry,))
            self.handle.registerTimer(expiry // 1000 + 1)
        yield frame[kept].drop(columns="us")

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        if self.expiry.exists() and self.expiry.get()[0] // 1000 < expiredTimerInfo.getExpiryTimeInMs():
            self.expiry.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def dedup_stream(alerts: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    """Alerts (signature, id, ts, severity) that stay."""
    timed = alerts.select("signature", "id", "ts", "severity").withWatermark("ts", watermark)
    schema = "signature string, id long, ts timestamp, severity string"
    return timed.groupBy("signature").transformWithStateInPandas(TtlDedup(), schema, "Append", "EventTime")


class Heartbeats(StatefulProcessor):
    """online at a client's first heartbeat, offline once the watermark is two minutes past its last one."""

    span_ms = 120_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        newest = max(int(p["ts"].max().timestamp() * 1000) for p in rows)
        known = self.last.get()[0] if self.last.exists() else None
        if known is None or newest > known:
            self.last.update((newest,))
            self.handle.registerTimer(newest + self.span_ms)
        yield pd.DataFrame({"client_id": [key[0]], "status": ["online"], "ms": [newest]}) if known is None else pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        due = expiredTimerInfo.getExpiryTimeInMs()
        if self.last.exists() and self.last.get()[0] + self.span_ms <= due:
            self.last.clear()
            yield pd.DataFrame({"client_id": [key[0]], "status": ["offline"], "ms": [due]})
        else:
            yield pd.DataFrame()

    def close(self) -> None:
        pass


def heartbeat_stream(beats: DataFrame, watermark: str = "1 second") -> DataFrame:
    timed = beats.select("client_id", "ts").withWatermark("ts", watermark)
    return timed.groupBy("client_id").transformWithStateInPandas(Heartbeats(), "client_id string, status string, ms long", "Append", "EventTime")


class Sessions(StatefulProcessor):
    """login and logout events of a client from its snapshots of open sessions; state is the open ones."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "session string", "ms long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        frame = pd.concat(list(rows), ignore_index=True)
        out = []
        for ts, snap in frame.groupby("ts", sort=True):
            ms = int(ts.timestamp() * 1000)
            now = {s for names in snap["sessions"] for s in names}
            before = {k[0]: v[0] for k, v in self.open.iterator()} if self.open.exists() else {}
            for s in sorted(now - before.keys()):
                self.open.updateValue((s,), (ms,))
                out.append((key[0], s, "login", ms, None))
            for s in sorted(before.keys() - now):
                self.open.removeKey((s,))
                out.append((key[0], s, "logout", ms, (ms - before[s]) / 1000))
        yield pd.DataFrame(out, columns=["client_id", "session", "event", "ms", "duration_s"]).astype({"duration_s": "float64"})

    def close(self) -> None:
        pass


def session_stream(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("client_id").transformWithStateInPandas(Sessions(), "client_id string, session string, event string, ms long, duration_s double", "Append", "ProcessingTime")
