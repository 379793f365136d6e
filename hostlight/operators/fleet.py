"""Fleet views: filters, joins with the registry, counts, top lists, set operations.

Facts have client_id, us (event time in microseconds), risk_score; `as_of` is a column or number of microseconds, by
default the newest event of the input.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import LOCAL_SOURCES

HOUR, DAY = 3_600_000_000, 86_400_000_000
CATEGORIES = ("network", "process", "filesystem", "user_activity")
#: Rows below which a registry is small enough to be sent to every task.
REGISTRY_ROWS = 200_000


def at(df: DataFrame, as_of: int | None) -> int:
    """The given time, or the newest event of `df` (0 for an empty table)."""
    return as_of if as_of is not None else df.agg(F.max("us")).first()[0] or 0


def since(df: DataFrame, span: int, as_of: int | None = None) -> DataFrame:
    return df.filter(F.col("us") >= at(df, as_of) - span)


def filter_alerts(alerts: DataFrame, category: str | None = None, severity: str | None = None, span: int | None = None, client_id: str | None = None, as_of: int | None = None) -> DataFrame:
    """Active alerts, narrowed by whatever is given."""
    out = alerts.filter("status = 'active'")
    for name, value in (("source_category", category), ("severity", severity), ("client_id", client_id)):
        out = out if value is None else out.filter(F.col(name) == value)
    return out if span is None else out.filter(F.col("us") >= at(alerts, as_of) - span)


def filter_network(df: DataFrame, mode: str = "all", client_id: str | None = None) -> DataFrame:
    df = df if client_id is None else df.filter(F.col("client_id") == client_id)
    return df.filter("risk_score > 7.0") if mode == "high_risk" else df.filter("is_anomaly") if mode == "anomalies" else df


def filter_process(df: DataFrame, mode: str = "high_risk") -> DataFrame:
    return df.filter("risk_score > 6.0") if mode == "high_risk" else df.filter(F.size("threat_indicators") > 0)


def filter_filesystem(df: DataFrame, mode: str = "high_risk") -> DataFrame:
    return df.filter("risk_score > 5.0") if mode == "high_risk" else df.filter("is_suspicious")


def filter_user_activity(df: DataFrame, mode: str = "high_risk") -> DataFrame:
    """Modes high_risk, remote, privileged, anomalies."""
    if mode == "remote":
        return df.filter(~F.col("source_ip").isin(*LOCAL_SOURCES))
    if mode == "privileged":
        return df.filter("privilege_escalation")
    if mode == "anomalies":
        return df.filter((F.col("risk_score") > 6) | (F.size("threat_indicators") > 0))
    return df.filter("risk_score > 5")


def display_columns(df: DataFrame, first: int = 3) -> DataFrame:
    """Adds shortened columns for lists, for those of threat_indicators, file_hash, directory, file_size that there are."""
    made = {
        "threat_indicators": ("indicators_shown", lambda c: F.when(F.size(c) > 0, F.array_join(F.slice(c, 1, first), ", ")).otherwise("None")),
        "file_hash": ("hash_shown", lambda c: F.when(c.isNotNull(), F.concat(F.substring(c, 1, 16), F.lit("...")))),
        "directory": ("directory_shown", lambda c: F.when(F.length(c) > 30, F.concat(F.lit("..."), F.right(c, F.lit(27)))).otherwise(c)),
        "file_size": ("size_kb", lambda c: F.round(c / 1024, 1)),
    }
    return df.withColumns({new: shown(F.col(old)) for old, (new, shown) in made.items() if old in df.columns})


def with_hostname(fact: DataFrame, clients: DataFrame) -> DataFrame:
    """Inner join with the registry, which is sent to every task if it is small, else joined by client."""
    names = clients.select("client_id", "hostname")
    small = names.limit(REGISTRY_ROWS + 1).count() <= REGISTRY_ROWS
    return fact.join(F.broadcast(names) if small else names, "client_id")


def client_overview(clients: DataFrame, network: DataFrame, process: DataFrame, filesystem: DataFrame, alerts: DataFrame, as_of: int, limit: int = 100) -> DataFrame:
    """Per client: events and average risk of the last day by category, active alerts of all time, most alerts first.

    Each fact is reduced to a row per client before it is joined.
    """
    out = clients.select("client_id", "hostname", "status")
    for name, fact in (("network", network), ("process", process), ("file", filesystem)):
        day = fact.filter(F.col("us") >= as_of - DAY).groupBy("client_id").agg(F.count("*").alias(f"{name}_events"), F.avg("risk_score").alias(f"{name}_risk"))
        out = out.join(day, "client_id", "left")
    active = alerts.filter("status = 'active'").groupBy("client_id").agg(F.count("*").alias("active_alerts"))
    out = out.join(active, "client_id", "left").na.fill(0)
    total = F.col("network_risk") + F.col("process_risk") + F.col("file_risk")
    return out.orderBy(F.desc("active_alerts"), total.desc(), "client_id").limit(limit)


def client_stats(clients: DataFrame) -> DataFrame:
    online = F.count_if(F.col("status") == "online")
    return clients.agg(F.count("*").alias("total"), online.alias("online"), (F.count("*") - online).alias("offline"), F.count_if("federated_learning").alias("federated"))


def event_counts(tables: Mapping[str, DataFrame], as_of: int) -> DataFrame:
    """Events of the last day by category; a category without events counts 0."""
    parts = [t.filter(F.col("us") >= as_of - DAY).agg(F.count("*").alias("events")).select(F.lit(name).alias("category"), "events") for name, t in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def alert_stats(alerts: DataFrame, as_of: int) -> DataFrame:
    day = alerts.filter((F.col("us") >= as_of - DAY) & (F.col("status") == "active"))
    critical, high = F.count_if(F.col("severity") == "critical"), F.count_if(F.col("severity") == "high")
    return day.agg(F.count("*").alias("total"), critical.alias("critical"), high.alias("high"), F.greatest(F.count("*") - critical - high, F.lit(0)).alias("other"))


def user_stats(users: DataFrame, as_of: int) -> DataFrame:
    day = users.filter(F.col("us") >= as_of - DAY)
    return day.agg(F.count("*").alias("logins"), F.countDistinct("username").alias("users"), F.count_if(~F.col("source_ip").isin(*LOCAL_SOURCES)).alias("remote"), F.count_if(F.col("risk_score") > 5).alias("high_risk"))


def hourly_timeline(df: DataFrame, as_of: int, fill: bool = True) -> DataFrame:
    """Events and average risk per hour of the last 24 hours; with `fill`, hours without events too."""
    hour = F.floor(F.col("us") / HOUR).cast("long")
    found = df.filter((F.col("us") >= as_of - DAY) & (F.col("us") <= as_of)).groupBy(hour.alias("hour")).agg(F.count("*").alias("events"), F.avg("risk_score").alias("avg_risk"))
    if not fill:
        return found
    last = as_of // HOUR
    hours = df.sparkSession.range(last - 24, last + 1).select(F.col("id").alias("hour"))
    return hours.join(found, "hour", "left").select("hour", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("avg_risk", F.lit(0.0)).alias("avg_risk"))


def connection_history(network: DataFrame) -> DataFrame:
    """Per client and remote address: connections, first and last sight, different local ports."""
    return network.groupBy("client_id", "dst_ip", "dst_port").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.countDistinct("src_port").alias("ports"))


def running_history(network: DataFrame) -> DataFrame:
    """Adds conn_n and ports_n: connections and different local ports to the same address up to each event.

    A port counts where it is first seen, so no set grows along the frame.
    """
    key = ["client_id", "dst_ip", "dst_port"]
    first = F.row_number().over(Window.partitionBy(*key, "src_port").orderBy("us", "id")) == 1
    upto = Window.partitionBy(*key).orderBy("us", "id").rowsBetween(Window.unboundedPreceding, 0)
    return network.withColumn("_first", first.cast("int")).withColumns({"conn_n": F.count("*").over(upto), "ports_n": F.sum("_first").over(upto)}).drop("_first")


def network_summary(network: DataFrame, cycle: Column) -> DataFrame:
    """Per client and collection cycle: connections, different destinations, findings of models and rules."""
    return network.groupBy("client_id", cycle.alias("cycle")).agg(F.count("*").alias("connections"), F.countDistinct("dst_ip").alias("destinations"), F.count_if("is_anomaly").alias("ml_detections"), F.count_if(F.col("risk_score") > 6).alias("rule_detections"))


def process_summary(process: DataFrame, cycle: Column, top: int = 5) -> DataFrame:
    """Per client and cycle: processes, busy and large ones, high risk, and the names of the heaviest."""
    ranked = process.withColumn("cycle", cycle)
    order = Window.partitionBy("client_id", "cycle").orderBy((F.col("cpu_percent") + F.col("memory_mb")).desc(), "id")
    ranked = ranked.withColumn("rank", F.row_number().over(order))
    names = F.sort_array(F.collect_list(F.when(F.col("rank") <= top, F.struct("rank", "name"))))
    return ranked.groupBy("client_id", "cycle").agg(
        F.count("*").alias("processes"), F.count_if(F.col("cpu_percent") > 50).alias("high_cpu"), F.count_if(F.col("memory_mb") > 500).alias("high_memory"),
        F.count_if(F.col("risk_score") > 6).alias("high_risk"), F.transform(names, lambda x: x["name"]).alias("top_names"),
    )


def period_stats(tables: Mapping[str, DataFrame], alerts: DataFrame, period: int = DAY) -> DataFrame:
    """Per period: clients seen, events by category, high-risk alerts, average risk; one grouping over the tagged union."""
    tagged = None
    for name, t in tables.items():
        part = t.select("client_id", "us", "risk_score", F.lit(name).alias("category"))
        tagged = part if tagged is None else tagged.unionByName(part)
    tagged = tagged.unionByName(alerts.select("client_id", "us", "risk_score", F.lit("alert").alias("category")))
    counts = [F.count_if(F.col("category") == n).alias(f"{n}_events") for n in tables]
    fact = F.col("category") != "alert"
    return tagged.groupBy(F.floor(F.col("us") / period).cast("long").alias("period")).agg(
        F.countDistinct("client_id").alias("clients"), *counts, F.count_if(~fact & (F.col("risk_score") > 7)).alias("high_risk_alerts"), F.avg(F.when(fact, F.col("risk_score"))).alias("avg_risk")
    )


def active_alerts(alerts: DataFrame, limit: int = 100) -> DataFrame:
    return alerts.filter("status = 'active'").orderBy(F.desc("us"), F.desc("risk_score"), "id").limit(limit)


def recent_alerts_per_client(alerts: DataFrame, as_of: int, span: int = 300_000_000, top: int = 5) -> DataFrame:
    """Active alerts of the last minutes, the riskiest of each client, as 'title: description'."""
    recent = alerts.filter((F.col("status") == "active") & (F.col("us") >= as_of - span))
    order = Window.partitionBy("client_id").orderBy(F.desc("risk_score"), "id")
    return recent.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select("client_id", "rank", "risk_score", F.concat_ws(": ", "title", "description").alias("text"))


def top_risks(details: Mapping[str, tuple[DataFrame, str]], as_of: int, each: int = 5, limit: int = 15) -> DataFrame:
    """Of each category the riskiest rows of the last day above 5, merged under one schema, riskiest first."""
    out = None
    for name, (df, detail) in details.items():
        rows = df.filter((F.col("us") >= as_of - DAY) & (F.col("risk_score") > 5)).orderBy(F.desc("risk_score"), "id").limit(each)
        rows = rows.select(F.lit(name).alias("category"), "client_id", F.col(detail).alias("detail"), F.col("risk_score").alias("risk"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy(F.desc("risk"), "category", "id").limit(limit)


def riskiest(df: DataFrame, limit: int = 500) -> DataFrame:
    return df.orderBy(F.desc("us"), F.desc("risk_score"), "id").limit(limit)


def per_cycle(df: DataFrame, cycle: Column, top: int) -> DataFrame:
    """The riskiest rows of each client and collection cycle."""
    order = Window.partitionBy("client_id", cycle).orderBy(F.desc("risk_score"), "id")
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def by_heartbeat(clients: DataFrame) -> DataFrame:
    return clients.orderBy(F.desc_nulls_last("heartbeat"), "client_id")


def mark_offline(clients: DataFrame, as_of: int, span: int = 120_000_000) -> DataFrame:
    """Clients whose last heartbeat is older than the span are offline."""
    late = (F.col("status") == "online") & (F.col("heartbeat") < as_of - span)
    return clients.withColumn("status", F.when(late, "offline").otherwise(F.col("status")))


def acknowledge(alerts: DataFrame, ids: DataFrame) -> DataFrame:
    """Alerts whose id is in `ids` become acknowledged."""
    known = ids.select("id").distinct().withColumn("_ack", F.lit(True))
    out = alerts.join(known, "id", "left")
    done = F.coalesce("_ack", F.lit(False))
    return out.withColumns({"status": F.when(done, "acknowledged").otherwise(F.col("status")), "acknowledged": done | (F.col("status") == "acknowledged")}).drop("_ack")


def registered_only(updates: DataFrame, clients: DataFrame, registered: bool = True) -> DataFrame:
    return updates.join(clients.select("client_id"), "client_id", "left_semi" if registered else "left_anti")
