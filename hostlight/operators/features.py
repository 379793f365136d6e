"""Behaviour features: 60-second windows per client, deltas, pattern flags, matrices, robust normalisation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import FEATURES, RANSOMWARE_EXTENSIONS, SUSPICIOUS_PROCESSES
from ..functions.scalars import cleaned, clip, is_local_ip, is_privileged, is_remote
from .carry import key_rows, runs

WINDOW = 60_000_000


def log_clip(c: Column, high: float) -> Column:
    return F.least(F.log1p(c), F.lit(float(high)))


def tagged_events(network: DataFrame, process: DataFrame, filesystem: DataFrame) -> DataFrame:
    """One long table of the three categories, so that windows need one grouping."""
    n = network.select("client_id", "us", F.lit("n").alias("kind"), F.col("dst_ip").alias("name"), F.col("dst_port").cast("long").alias("port"), "bytes_sent", "bytes_recv", F.contains("protocol", F.lit("TCP")).alias("flag"), F.contains("protocol", F.lit("UDP")).alias("other"))
    p = process.select("client_id", "us", F.lit("p").alias("kind"), F.col("name"), F.lit(None).cast("long").alias("port"), F.col("cpu_percent").alias("bytes_sent"), F.col("memory_mb").alias("bytes_recv"), F.lit(False).alias("flag"), F.lit(False).alias("other"))
    f = filesystem.select("client_id", "us", F.lit("f").alias("kind"), F.col("file_hash").alias("name"), F.lit(None).cast("long").alias("port"), F.lit(0.0).alias("bytes_sent"), F.lower("file_ext").isin(".exe", ".dll", ".so").cast("double").alias("bytes_recv"), (F.col("event_type") == "created").alias("flag"), F.lit(False).alias("other"))
    return n.unionByName(p).unionByName(f)


def windows(events: DataFrame, span: int = WINDOW) -> DataFrame:
    """Raw measures per client and window of `tagged_events`.

    Events are counted per (client, window, kind, name, port) first, so that distinct counts, the entropy of ports and the
    busiest destination fold small groups; no count needs its own pass.
    """
    w = (F.floor(F.col("us") / span) * span).cast("long")
    small = events.groupBy("client_id", w.alias("window_us"), "kind", "name", "port").agg(
        F.count("*").alias("n"), F.sum("bytes_sent").alias("a"), F.sum("bytes_recv").alias("b"), F.count_if("flag").alias("flagged"), F.count_if("other").alias("others"),
        F.min(F.when(F.col("flag"), F.col("us"))).alias("first_us"), F.max(F.when(F.col("flag"), F.col("us"))).alias("last_us"),
    )
    # a name or port counts once, where it comes first in its window
    key = ["client_id", "window_us", "kind"]
    by_name, by_port = Window.partitionBy(*key, "name"), Window.partitionBy(*key, "port")
    small = small.withColumns({
        "name_n": F.sum("n").over(by_name), "name_first": F.row_number().over(by_name.orderBy("port")) == 1,
        "port_n": F.sum("n").over(by_port), "port_first": F.row_number().over(by_port.orderBy("name")) == 1,
    })
    k = lambda kind: F.col("kind") == kind
    total = lambda kind, c: F.coalesce(F.sum(F.when(k(kind), F.col(c))), F.lit(0))
    different = lambda kind: F.count_if(k(kind) & F.col("name_first") & F.col("name").isNotNull())
    plogp = F.sum(F.when(k("n") & F.col("port_first"), F.col("port_n") * F.log2("port_n")))
    out = small.groupBy("client_id", "window_us").agg(
        total("n", "n").alias("conns"), different("n").alias("dsts"), total("n", "a").alias("sent"), total("n", "b").alias("received"), total("n", "flagged").alias("tcp"), total("n", "others").alias("udp"), plogp.alias("plogp"),
        F.max(F.when(k("n"), F.col("name_n"))).alias("busiest"), total("p", "n").alias("spawns"), total("p", "a").alias("cpu"), total("p", "b").alias("memory"), different("p").alias("procs"),
        F.coalesce(F.bool_or(k("p") & (F.lower("name").contains("lsass") | F.lower("name").contains("sam"))), F.lit(False)).alias("credential"),
        total("f", "flagged").alias("creates"), total("f", "b").alias("execs"), different("f").alias("hashes"), F.min(F.when(k("f"), F.col("first_us"))).alias("f0"), F.max(F.when(k("f"), F.col("last_us"))).alias("f1"),
    )
    return out.withColumn("entropy", F.when(F.col("conns") > 0, F.greatest(F.lit(0.0), F.log2("conns") - F.col("plogp") / F.col("conns"))).otherwise(0.0)).drop("plogp")


def features(raw: DataFrame, span: int = WINDOW) -> DataFrame:
    """The model features of `windows`, with deltas to the client's window before (0 for its first) and pattern flags."""
    seconds = span / 1e6
    order = Window.partitionBy("client_id").orderBy("window_us")
    delta = lambda c: F.coalesce(F.col(c) - F.lag(c).over(order), F.lit(0)).cast("double")
    out = raw.withColumns({"d_conns": clip(delta("conns"), -10, 10), "d_creates": clip(delta("creates"), -50, 50), "d_spawns": clip(delta("spawns"), -10, 10), "d_hashes": clip(delta("hashes"), -20, 20)})
    # the change now against the change that the window before reports
    out = out.withColumn("accel", clip(F.coalesce(F.col("conns") - F.lag("conns").over(order) - F.lag("d_conns").over(order), F.lit(0.0)), -5, 5))
    d = lambda c: F.col(c).cast("double")
    mean = lambda c: F.when(F.col("spawns") > 0, F.col(c) / F.col("spawns")).otherwise(0.0)
    ransomware = (F.col("creates") > 50) & (F.col("hashes") > 20) & (F.col("f1") - F.col("f0") < 30_000_000)
    c2 = (F.col("conns") > 10) & (F.coalesce("busiest", F.lit(0)) > 5) & (F.col("dsts") < 3)
    return out.select(
        "client_id", "window_us", log_clip(d("conns"), 10).alias("conn_count"), clip(d("dsts"), 0, 50).alias("unique_dst_count"), log_clip(d("sent"), 20).alias("bytes_sent"), log_clip(d("received"), 20).alias("bytes_recv"),
        clip(F.col("entropy"), 0, 8).alias("port_entropy"), (d("tcp") / F.greatest("conns", F.lit(1))).alias("tcp_ratio"), (d("udp") / F.greatest("conns", F.lit(1))).alias("udp_ratio"), clip(d("conns") / seconds, 0, 10).alias("conn_rate"), clip(d("dsts") / seconds, 0, 5).alias("dst_churn_rate"),
        F.col("d_conns").alias("delta_conn_count"), F.col("accel").alias("conn_acceleration"), log_clip(d("spawns"), 8).alias("proc_spawn_count"), F.col("d_spawns").alias("delta_proc_spawn"),
        clip(mean("cpu") / 100, 0, 1).alias("avg_proc_cpu"), clip(F.log1p(mean("memory")) / 10, 0, 1).alias("avg_proc_memory"), clip(d("procs"), 0, 100).alias("unique_proc_names"),
        clip(d("creates"), 0, 100).alias("file_create_count"), F.col("d_creates").alias("delta_file_create"), clip(d("execs"), 0, 20).alias("file_exec_count"), clip(d("hashes"), 0, 50).alias("file_hash_novelty"), F.col("d_hashes").alias("delta_unique_hashes"),
        F.coalesce(ransomware, F.lit(False)).cast("double").alias("ransomware_burst"), c2.cast("double").alias("c2_pattern"), (F.col("credential") & (F.col("spawns") > 2)).cast("double").alias("cred_dump_pattern"),
        F.col("conns").alias("conn_count_raw"), F.col("creates").alias("file_create_raw"), F.col("spawns").alias("proc_spawn_raw"), F.col("hashes").alias("unique_hashes_raw"),
    )


def port_entropy(network: DataFrame, *keys: str, port: str = "dst_port") -> DataFrame:
    """Shannon entropy in bits of a client's ports."""
    counts = network.groupBy(*keys, port).agg(F.count("*").alias("n"))
    sums = counts.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("s"))
    return sums.select(*keys, F.greatest(F.lit(0.0), F.log2("total") - F.col("s") / F.col("total")).alias("entropy"))


def pattern_alerts(found: DataFrame) -> DataFrame:
    """A critical alert for each window with a pattern; the action is that of the last pattern set."""
    names = {"ransomware_burst": ("ransomware_burst", "ISOLATE_HOST"), "c2_pattern": ("c2_beaconing", "BLOCK_DESTINATION"), "cred_dump_pattern": ("credential_dump", "RESET_CREDENTIALS")}
    patterns = F.filter(F.array(*[F.when(F.col(c) > 0, F.lit(n)) for c, (n, _) in names.items()]), lambda x: x.isNotNull())
    action = F.coalesce(*[F.when(F.col(c) > 0, F.lit(a)) for c, (_, a) in reversed(names.items())])
    evidence = F.format_string("conns=%d creates=%d spawns=%d", "conn_count_raw", "file_create_raw", "proc_spawn_raw")
    out = found.select("client_id", "window_us", F.lit("critical").alias("severity"), patterns.alias("patterns"), evidence.alias("evidence"), action.alias("action"))
    return out.filter(F.size("patterns") > 0)


def feature_matrix(found: DataFrame, last: int = 1000) -> DataFrame:
    """The newest windows of each client as vectors of the model features, cleaned (null, NaN and -Inf 0, +Inf 1)."""
    order = Window.partitionBy("client_id").orderBy(F.desc("window_us"))
    vector = F.array(*[cleaned(F.col(c).cast("double")) for c in FEATURES])
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= last).select("client_id", "window_us", vector.alias("vector"))


def _event_vector(**given: Column) -> Column:
    """The 24 model features of one event; what its collector doesn't see is 0."""
    return F.array(*[F.coalesce(given[f].cast("double"), F.lit(0.0)) if f in given else F.lit(0.0) for f in FEATURES]).alias("vector")


def with_window(events: DataFrame, raw: DataFrame, span: int = WINDOW) -> DataFrame:
    """Each event with the raw measures of its client's window."""
    return events.withColumn("window_us", (F.floor(F.col("us") / span) * span).cast("long")).join(raw, ["client_id", "window_us"], "left")


def network_vectors(network: DataFrame, raw: DataFrame) -> DataFrame:
    """Event-level features of connections with conn_n and ports_n (running history of the destination)."""
    n, one = F.col("conns"), F.greatest("conns", F.lit(1))
    c2 = (F.col("conn_n") > 10) & (F.col("ports_n") < 3)
    return with_window(network, raw).select("client_id", "id", "us", _event_vector(
        conn_count=n / 100, unique_dst_count=F.col("dsts") / one, port_entropy=F.col("entropy"), tcp_ratio=F.col("tcp") / one, udp_ratio=F.col("udp") / one, conn_rate=n / 60, dst_churn_rate=F.col("dsts") / 60,
        proc_spawn_count=F.col("spawns") / 10, file_create_count=F.col("creates") / 50, delta_conn_count=n / 10, c2_pattern=c2,
    ))


def process_vectors(process: DataFrame, raw: DataFrame, shells: tuple[str, ...] = ("powershell", "cmd"), risky: tuple[str, ...] = SUSPICIOUS_PROCESSES[:5]) -> DataFrame:
    """Event-level features of processes; a column parent_name, if there is one, tells who started them."""
    name, path = F.lower("name"), F.lower(F.coalesce("path", F.lit("")))
    parent = F.lower("parent_name") if "parent_name" in process.columns else F.lit("")
    has = lambda c, words: F.coalesce(F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w)), F.lit(False))
    return with_window(process, raw).select("client_id", "id", "us", _event_vector(
        conn_count=F.col("conns") / 100, proc_spawn_count=F.col("spawns") / 10, avg_proc_cpu=F.col("cpu_percent") / 100, avg_proc_memory=F.col("memory_mb") / 5000, unique_proc_names=F.lit(1.0),
        file_create_count=F.col("creates") / 50, file_exec_count=F.contains(path, F.lit("temp")), delta_proc_spawn=F.col("spawns") / 10, cred_dump_pattern=has(parent, shells) & has(name, risky),
    ))


def file_vectors(files: DataFrame, raw: DataFrame) -> DataFrame:
    """Event-level features of files; a hash is new where the client has it for the first time."""
    ext = F.lower("file_ext")
    first = F.row_number().over(Window.partitionBy("client_id", "file_hash").orderBy("us", "id")) == 1
    novel = (F.col("file_hash").isNotNull() & first).cast("double")
    return with_window(files.withColumn("_novel", novel), raw).select("client_id", "id", "us", _event_vector(
        conn_count=F.col("conns") / 100, proc_spawn_count=F.col("spawns") / 10, file_create_count=F.col("creates") / 50, file_exec_count=ext.isin(".exe", ".dll", ".so"), file_hash_novelty=F.col("_novel"),
        delta_file_create=F.col("creates") / 50, delta_unique_hashes=F.col("_novel"), ransomware_burst=ext.isin(*RANSOMWARE_EXTENSIONS),
    ))


def user_vectors(logins: DataFrame) -> DataFrame:
    """Twelve numbers of a login with login_hour and new_ip (login context)."""
    order = Window.partitionBy("client_id", "username").orderBy("us", "id").rowsBetween(Window.unboundedPreceding, 0)
    everyone = Window.partitionBy("client_id").orderBy("us", "id").rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy("client_id", "username").orderBy("us", "id")) == 1
    remote = is_remote(F.col("source_ip")).cast("double")
    out = logins.withColumns({"_first": first.cast("int"), "_remote": remote})
    n, hour = F.count("*").over(order), F.col("login_hour")
    return out.select("client_id", "id", "us", F.array(
        is_privileged(F.col("username")).cast("double"), remote, clip(F.col("sessions") / 5, 0, 1), ((hour < 6) | (hour > 22)).cast("double"), hour / 24.0, (~F.col("new_ip")).cast("double"), clip(n / 20.0, 0, 1),
        F.sum("_remote").over(order) / n, F.avg("sessions").over(order) / 5, clip(F.sum("_first").over(everyone) / 10.0, 0, 1), clip(F.count("*").over(everyone) / 100.0, 0, 1),
        (F.pmod(F.floor(F.col("us") / 86_400_000_000) + 3, F.lit(7))) / 7.0,
    ).alias("vector"))


#: Rows whose histories are sorted at a time.
SLICE = 128


def normalized(values: np.ndarray, last: int = 100, least: int = 20, first: np.ndarray | None = None) -> np.ndarray:
    """Robust scores of numbers (rows by columns, or one column) against their last values, the current one included.

    `first` is the row at which each row's history begins, by default the first one. Fewer than `least` values: clipped
    to 3. Else by median and MAD, or by range if the MAD is 0, or 0. Histories are padded with NaN, which sorts last.
    """
    x = np.asarray(values, float)
    if x.ndim == 1:
        return normalized(x[:, None], last, least, first)[:, 0]
    n = len(x)
    out = np.clip(x, -3, 3)
    begin = np.maximum(np.zeros(n, np.int64) if first is None else first, np.arange(n) - last + 1)
    size = np.arange(n) - begin + 1
    padded = np.concatenate([np.full((last - 1, x.shape[1]), np.nan), x])
    rows = np.flatnonzero(size >= least)
    for a in range(0, len(rows), SLICE):
        at = rows[a : a + SLICE]
        place = at[:, None] + np.arange(last)  # in padded: the last rows up to each
        history = np.moveaxis(padded[place], 1, 2)
        history = np.where((place - (last - 1) >= begin[at][:, None])[:, None, :], history, np.nan)
        history.sort(axis=2)
        k = size[at][:, None]
        middle = lambda h, k=k: (np.take_along_axis(h, ((k - 1) // 2)[:, :, None], 2) + np.take_along_axis(h, (k // 2)[:, :, None], 2))[:, :, 0] / 2
        median, low = middle(history), history[:, :, 0]
        high = np.take_along_axis(history, (k - 1)[:, :, None], 2)[:, :, 0]
        mad = middle(np.sort(np.abs(history - median[:, :, None]), axis=2))
        spread = high - low
        out[at] = np.where(mad > 1e-6, (x[at] - median) / (1.4826 * np.maximum(mad, 1e-12)), np.where(spread > 1e-6, (x[at] - low) / np.maximum(spread, 1e-12), 0.0))
    return out


def robust_normalize(found: DataFrame, columns: tuple[str, ...] = FEATURES, last: int = 100, chunk: int | None = None) -> DataFrame:
    """Columns replaced by their robust scores per client in window order.

    Tasks stream through sorted rows and carry the last - 1 rows of the open client. With `chunk`, a client's windows
    are split into that many per key, each with the last - 1 windows before it, so that a busy client isn't one task.
    """
    cols = list(columns)
    order = Window.partitionBy("client_id").orderBy("window_us")
    if chunk is not None:
        numbered = found.withColumn("_place", F.row_number().over(order) - 1)
        part = F.floor(F.col("_place") / chunk).cast("int")
        copies = F.when(F.col("_place") % chunk >= chunk - last + 1, F.array(part, part + 1)).otherwise(F.array(part))
        found = numbered.withColumn("_part", part).withColumn("_for", F.explode(copies)).drop("_place")
    else:
        found = found.withColumns({"_part": F.lit(0), "_for": F.lit(0)})
    keys = ("client_id", "_for")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, carried = None, np.empty((0, len(cols)))
        for pdf in batches:
            spans = list(runs(key_rows(pdf, keys)))
            if not spans:
                continue
            if spans[0][0] != open_key:
                carried = carried[:0]
            x = np.concatenate([carried, pdf[cols].fillna(0.0).to_numpy(float)])
            ahead = len(carried)
            first = np.zeros(len(x), np.int64)
            for _, a, b in spans[1:]:
                first[ahead + a : ahead + b] = ahead + a
            scores = normalized(x, last, first=first)[ahead:]
            open_key, at, _ = spans[-1]
            carried = x[max(ahead + at if len(spans) > 1 else 0, len(x) - last + 1) :]
            pdf = pdf.assign(**{c: scores[:, k] for k, c in enumerate(cols)})
            yield pdf[pdf["_part"] == pdf["_for"]]

    dealt = found.repartition(*keys).sortWithinPartitions(*keys, "window_us")
    return dealt.mapInPandas(run, found.schema).drop("_part", "_for")
