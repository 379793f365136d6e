"""Telemetry messages, registry upkeep, exports and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FIELDS = {
    "network": "src_ip string, dst_ip string, src_port int, dst_port int, protocol string, dns_query string, geolocation string, connection_count int, risk_score double, anomaly_score double, is_anomaly boolean, threat_indicators array<string>",
    "processes": "process_name string, parent_name string, executable_path string, executable_hash string, command_line_preview string, privilege_level string, pid int, ppid int, cpu_percent double, memory_mb double, risk_score double, threat_indicators array<string>",
    "filesystem": "event_type string, file_path string, file_name string, file_extension string, file_hash string, directory string, file_size long, is_suspicious boolean, risk_score double, threat_indicators array<string>",
    "user_activity": "event_type string, username string, session_id string, source_ip string, login_success boolean, privilege_escalation boolean, concurrent_sessions int, session_duration double, risk_score double, threat_indicators array<string>",
    "anomaly_alerts": "category string, severity string, ensemble_score double, iso_score double, ae_score double, contributing_features array<string>, explanation string, recommended_action string",
}
#: What a missing field counts as.
DEFAULTS = {"connection_count": 1, "risk_score": 0.0, "anomaly_score": 0.0, "is_anomaly": False, "is_suspicious": False, "source_ip": "local", "login_success": True, "privilege_escalation": False, "concurrent_sessions": 1}


def split_telemetry(messages: DataFrame, text: str = "message") -> dict[str, DataFrame]:
    """JSON messages (client_id, timestamp, categories) to one table per category, and alerts.

    A category may be a list or an object with `details` (processes: `high_risk` too, marked). Missing fields get their
    defaults; an empty list stands for no indicators; file size 0 is null. Unreadable messages give no rows.
    """
    head = messages.select(F.get_json_object(text, "$.client_id").alias("client_id"), F.get_json_object(text, "$.timestamp").try_cast("timestamp").alias("timestamp"), *[F.get_json_object(text, f"$.{c}").alias(c) for c in (*_FIELDS, "ml_anomaly_alerts")])
    head = head.filter(F.col("client_id").isNotNull())
    out = {}
    for category, fields in _FIELDS.items():
        rows = lambda c, fields=fields: F.from_json(c, f"array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>")
        name = F.col(category)
        details = F.coalesce(F.when(name.startswith("["), rows(name)), rows(F.get_json_object(name, "$.details")))
        parts = [head.select("client_id", "timestamp", F.explode(details).alias("r"), F.lit(False).alias("high_risk"))]
        if category == "processes":
            parts.append(head.select("client_id", "timestamp", F.explode(rows(F.get_json_object(name, "$.high_risk"))).alias("r"), F.lit(True).alias("high_risk")))
        if category == "anomaly_alerts":
            parts.append(head.select("client_id", "timestamp", F.explode(rows(F.col("ml_anomaly_alerts"))).alias("r"), F.lit(False).alias("high_risk")))
        both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        both = both.select("client_id", "timestamp", "high_risk", "r.*")
        fills = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in DEFAULTS.items() if c in both.columns}
        if "threat_indicators" in both.columns:
            fills["threat_indicators"] = F.coalesce("threat_indicators", F.array().cast("array<string>"))
        if "file_size" in both.columns:
            fills["file_size"] = F.nullif("file_size", F.lit(0))
        out[category] = both.withColumns(fills) if category == "processes" else both.withColumns(fills).drop("high_risk")
    return out


def upsert_clients(registry: DataFrame, seen: DataFrame) -> DataFrame:
    """Registrations overwrite hostname, ip_address, status, heartbeat and the federated flag; first_seen and others stay."""
    fields = ("hostname", "ip_address", "last_heartbeat", "federated_learning")
    newest = seen.groupBy("client_id").agg(*[F.max_by(c, "last_heartbeat").alias(f"new_{c}") for c in fields], F.min("last_heartbeat").alias("new_first"))
    out = registry.join(newest, "client_id", "full")
    fresh = F.col("new_first").isNotNull()
    made = {c: F.when(fresh, F.col(f"new_{c}")).otherwise(F.col(c)) for c in fields}
    made |= {"status": F.when(fresh, "online").otherwise(F.col("status")), "first_seen": F.coalesce("first_seen", "new_first")}
    return out.withColumns(made).select(registry.columns)


def merge_registry(registry: DataFrame, seen: DataFrame, at: str = "last_heartbeat") -> DataFrame:
    """The newest value that isn't null wins in each column."""
    both = registry.unionByName(seen, allowMissingColumns=True)
    columns = [c for c in registry.columns if c != "client_id"]
    return both.groupBy("client_id").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(at))).alias(c) for c in columns]).select(registry.columns)


#: What an unknown client is registered as.
UNKNOWN = {"telemetry": ("auto-registered-", "workstation", "low", False), "federated": ("fl-client-", "workstation", "medium", True)}


def auto_register(registry: DataFrame, seen: DataFrame, kind: str = "telemetry") -> DataFrame:
    """The registry and a default row for each client of `seen` that it lacks."""
    prefix, role, level, federated = UNKNOWN[kind]
    new = seen.select("client_id").distinct().join(registry.select("client_id"), "client_id", "left_anti")
    new = new.select("client_id", F.concat(F.lit(prefix), F.substring("client_id", 1, 8)).alias("hostname"), F.lit(role).alias("device_role"), F.lit(level).alias("criticality_level"), F.lit("online").alias("status"), F.lit(federated).alias("federated_learning"))
    return registry.unionByName(new.select([c for c in new.columns if c in registry.columns]), allowMissingColumns=True)


def export_alerts(alerts: DataFrame, path: str) -> None:
    """CSV files with a header: Timestamp, Severity, Client, Category, Title, Description, Risk Score."""
    alerts.select(F.col("timestamp").alias("Timestamp"), F.col("severity").alias("Severity"), F.col("hostname").alias("Client"), F.col("source_category").alias("Category"), F.col("title").alias("Title"), F.col("description").alias("Description"), F.col("risk_score").alias("Risk Score")).write.mode("overwrite").csv(path, header=True)


def append_history(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def contribution_history(df: DataFrame, client_id: str | None = None, limit: int = 100) -> DataFrame:
    df = df if client_id is None else df.filter(F.col("client_id") == client_id)
    return df.orderBy(F.desc("us"), "client_id").limit(limit)


def latest_models(cache: DataFrame) -> DataFrame:
    """Each client's newest parameters; autoencoders without scaler are null."""
    newest = cache.groupBy("client_id").agg(F.max_by(F.struct([c for c in cache.columns if c != "client_id"]), "cached_at").alias("m")).select("client_id", "m.*")
    whole = F.col("scaler_mean").isNotNull() & F.col("scaler_scale").isNotNull()
    return newest.withColumn("autoencoder", F.when(whole, F.col("autoencoder")))


SNAPSHOT = "client_id string, host string, timestamp string, os string, osquery_version string, data map<string, array<map<string, string>>>"


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """Inventory snapshots, one JSON file each; those without client or time are left out."""
    return spark.read.schema(SNAPSHOT).json(path, multiLine=True).filter("client_id IS NOT NULL AND timestamp IS NOT NULL")


def write_snapshots(snapshots: DataFrame, path: str) -> None:
    snapshots.write.mode("append").partitionBy("client_id").parquet(path)


#: Typed columns of inventory tables; any other table stays a map.
TYPED = {
    "system_info": "hostname string, cpu_brand string, physical_memory long", "os_version": "name string, version string, platform string", "users": "username string, uid long, directory string", "uptime": "days int, hours int, minutes int, total_seconds long",
    "processes": "pid long, name string, path string, cmdline string, parent long", "listening_ports": "pid long, port int, protocol string, address string", "logged_in_users": "user string, host string, time long", "programs": "name string, version string, publisher string",
    "services": "name string, status string, start_type string, path string", "scheduled_tasks": "name string, action string, enabled int", "startup_items": "name string, path string, source string", "patches": "hotfix_id string, installed_on string",
    "deb_packages": "name string, version string", "rpm_packages": "name string, version string", "crontab": "command string, path string", "authorized_keys": "key string, key_file string", "process_open_sockets": "pid long, remote_address string, remote_port int",
}


def flatten_inventory(snapshots: DataFrame, table: str | None = None) -> DataFrame:
    """(client_id, timestamp, table, row) of every inventory row, or one table with typed columns."""
    rows = snapshots.select("client_id", "timestamp", F.explode("data").alias("table", "rows"))
    rows = (rows if table is None else rows.filter(F.col("table") == table)).select("client_id", "timestamp", "table", F.explode("rows").alias("row"))
    if table is None or table not in TYPED:
        return rows
    columns = [f.strip().split(" ") for f in TYPED[table].split(",")]
    return rows.select("client_id", "timestamp", *[F.col("row")[n].try_cast(t).alias(n) for n, t in columns])


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("client_id").agg(F.max_by(F.struct("timestamp", "data"), "timestamp").alias("s")).select("client_id", "s.*")


def snapshot_history(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("client_id").agg(F.count("*").alias("n"), F.reverse(F.array_sort(F.collect_list("timestamp"))).alias("timestamps"))


def snapshot_at(snapshots: DataFrame, client_id: str, timestamp: str) -> DataFrame:
    return snapshots.filter((F.col("client_id") == client_id) & (F.col("timestamp") == timestamp))


CRAWL = "task_id string, worker_id string, query string, success boolean, raw_output string, error string, execution_time double, timestamp string, darkdump_results struct<total_results: int, websites: array<string>, domains: array<string>, ips: array<string>, emails: array<string>, urls: array<string>, links: array<string>, keywords: array<string>, metadata: map<string, string>>"


def read_crawl(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CRAWL).json(path, multiLine=True)


def write_processed(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def micros(ts: Column) -> Column:
    """Event time of a timestamp column, with or without zone."""
    return F.unix_micros(ts.cast("timestamp"))
