"""Registered queries: each operator over telemetry derived from the given tables, with SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.fixed import FEATURES, WEIGHT_KEYS
from ..models import autoencoder, ensemble, forest
from ..operators import alerts, baselines, crawl, dedup, detectors, evaluate, features, federated, fleet, risk, short_risk
from ..sources.store import dealt, kept
from ..sources.tables import read, telemetry, with_views
from . import feature_sql

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
DAY = 86_400_000_000
CYCLE = 86_400_000_000


def query(sql: str | None = None, *views: str):
    """Registers a function under its name, with SQL over the named views."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = with_views(sql, *views)
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def newest(t: dict[str, DataFrame]) -> int:
    return fleet.at(t["events"], None)


AS_OF = "(SELECT max(us) FROM e)"

# -- filters and joins ----------------------------------------------------------------------------------------


@query(f"SELECT id, client_id, severity, risk_score FROM alerts WHERE status = 'active' AND severity = 'high' AND source_category = 'network' AND us >= (SELECT max(us) FROM alerts) - 7 * {DAY}", "alerts")
def f1_filter_alerts(spark, sf_dir):
    return fleet.filter_alerts(telemetry(spark, sf_dir)["alerts"], "network", "high", 7 * DAY).select("id", "client_id", "severity", "risk_score")


@query("SELECT id, client_id, dst_ip, dst_port FROM network_data WHERE risk_score > 7.0", "network_data")
def f2_filter_network(spark, sf_dir):
    return fleet.filter_network(telemetry(spark, sf_dir)["network_data"], "high_risk").select("id", "client_id", "dst_ip", "dst_port")


@query("SELECT id, client_id, name FROM process_data WHERE risk_score > 6.0", "process_data")
def f3_filter_process(spark, sf_dir):
    return fleet.filter_process(telemetry(spark, sf_dir)["process_data"]).select("id", "client_id", "name")


@query("SELECT id, client_id, file_name FROM filesystem_data WHERE is_suspicious", "filesystem_data")
def f4_filter_filesystem(spark, sf_dir):
    return fleet.filter_filesystem(telemetry(spark, sf_dir)["filesystem_data"], "suspicious").select("id", "client_id", "file_name")


@query("SELECT id, username, source_ip FROM user_activity WHERE source_ip NOT IN ('local', 'localhost', '127.0.0.1', '::1', '')", "user_activity")
def f5_filter_user_activity(spark, sf_dir):
    return fleet.filter_user_activity(telemetry(spark, sf_dir)["user_activity"], "remote").select("id", "username", "source_ip")


@query("SELECT id, CASE WHEN risk_score > 7 THEN 'high' WHEN risk_score > 5 THEN 'medium' WHEN risk_score > 3 THEN 'low' ELSE 'normal' END AS band FROM user_activity", "user_activity")
def f6_risk_band(spark, sf_dir):
    return telemetry(spark, sf_dir)["user_activity"].select("id", scalars.risk_band(F.col("risk_score"), "user").alias("band"))


@query("SELECT id, substr(file_hash, 1, 16) || '...' AS hash_shown, round(file_size / 1024.0, 1) AS size_kb FROM filesystem_data", "filesystem_data")
def f7_display_columns(spark, sf_dir):
    return fleet.display_columns(telemetry(spark, sf_dir)["filesystem_data"]).select("id", "hash_shown", "size_kb")


@query("SELECT a.id, c.hostname, a.severity FROM alerts a JOIN clients c ON c.client_id = a.client_id", "alerts", "clients")
def j1_with_hostname(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return fleet.with_hostname(t["alerts"], t["clients"]).select("id", "hostname", "severity")


def _overview_sql() -> str:
    day = lambda n, v: f"{n}_d AS (SELECT client_id, count(*) AS {n}_events, avg(risk_score) AS {n}_risk FROM {v} WHERE us >= {AS_OF} - {DAY} GROUP BY client_id)"
    return f"""WITH {day("network", "network_data")}, {day("process", "process_data")}, {day("file", "filesystem_data")}, al AS (SELECT client_id, count(*) AS n FROM alerts WHERE status = 'active' GROUP BY client_id)
    SELECT c.client_id, c.hostname, c.status, coalesce(network_events, 0) AS network_events, round(coalesce(network_risk, 0), 6) AS network_risk, coalesce(process_events, 0) AS process_events, round(coalesce(process_risk, 0), 6) AS process_risk,
      coalesce(file_events, 0) AS file_events, round(coalesce(file_risk, 0), 6) AS file_risk, coalesce(al.n, 0) AS active_alerts
    FROM clients c LEFT JOIN network_d USING (client_id) LEFT JOIN process_d USING (client_id) LEFT JOIN file_d USING (client_id) LEFT JOIN al USING (client_id)
    ORDER BY active_alerts DESC, coalesce(network_risk, 0) + coalesce(process_risk, 0) + coalesce(file_risk, 0) DESC, c.client_id LIMIT 100"""


@query(_overview_sql(), "network_data", "process_data", "filesystem_data", "alerts", "clients")
def j2_client_overview(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    out = fleet.client_overview(t["clients"], t["network_data"], t["process_data"], t["filesystem_data"], t["alerts"], newest(t))
    return rounded(out, "network_risk", "process_risk", "file_risk")


# the given logins are sparse, so the range detectors run with a span of a day here


@query(f"SELECT id, attempts FROM (SELECT id, count(*) OVER (PARTITION BY client_id, source_ip ORDER BY us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS attempts FROM user_activity) x WHERE attempts >= 5", "user_activity")
def j3_brute_force(spark, sf_dir):
    return detectors.detect_brute_force(telemetry(spark, sf_dir)["user_activity"], span=DAY).select("id", "attempts")


@query(f"SELECT id, escalations FROM (SELECT id, count(*) OVER (PARTITION BY client_id, username ORDER BY us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS escalations FROM user_activity WHERE privilege_escalation) x WHERE escalations >= 2", "user_activity")
def j4_priv_escalation(spark, sf_dir):
    return detectors.detect_priv_escalation(telemetry(spark, sf_dir)["user_activity"], span=DAY).select("id", "escalations")


@query(f"""SELECT id, source_ip, other_ip FROM (SELECT a.id, a.source_ip, a.us, b.source_ip AS other_ip, b.us AS other_us, row_number() OVER (PARTITION BY a.id ORDER BY b.us DESC, b.id DESC) AS r
    FROM user_activity a JOIN user_activity b ON a.client_id = b.client_id AND a.username = b.username AND a.source_ip <> b.source_ip AND (b.us < a.us OR (b.us = a.us AND b.id < a.id))) x
    WHERE r = 1 AND source_ip <> 'local' AND other_ip <> 'local' AND us - other_us <= {DAY}""", "user_activity")
def j5_impossible_travel(spark, sf_dir):
    return detectors.detect_impossible_travel(telemetry(spark, sf_dir)["user_activity"], DAY).select("id", "source_ip", "other_ip")


_SNAP = f"CAST(floor(us / {DAY}) AS BIGINT)"


def _with_snapshot(df: DataFrame) -> DataFrame:
    return df.withColumn("snapshot", F.floor(F.col("us") / DAY).cast("long"))


@query(f"""WITH p AS (SELECT *, {_SNAP} AS snapshot FROM process_data), q AS (SELECT client_id, snapshot, pid, min_by(name, id) AS parent_name FROM p GROUP BY ALL)
    SELECT p.id, p.name, q.parent_name FROM p LEFT JOIN q ON q.client_id = p.client_id AND q.snapshot = p.snapshot AND q.pid = p.ppid""", "process_data")
def j6_process_parent(spark, sf_dir):
    return detectors.with_parent(_with_snapshot(telemetry(spark, sf_dir)["process_data"])).select("id", "name", "parent_name")


@query("""SELECT id, CASE WHEN r = 1 THEN 'new' WHEN m <> before THEN 'modified' ELSE 'existing' END AS change FROM (SELECT id, file_size AS m, lag(file_size) OVER w AS before, row_number() OVER w AS r FROM filesystem_data
    WINDOW w AS (PARTITION BY client_id, file_path, file_name ORDER BY us, id)) x""", "filesystem_data")
def j7_file_change(spark, sf_dir):
    files = telemetry(spark, sf_dir)["filesystem_data"].withColumn("mtime", F.col("file_size"))
    return detectors.file_change_type(files).select("id", "change")


@query(f"""WITH s AS (SELECT DISTINCT client_id, {_SNAP} AS snapshot, username AS session FROM user_activity), n AS (SELECT client_id, snapshot, row_number() OVER (PARTITION BY client_id ORDER BY snapshot) AS n FROM (SELECT DISTINCT client_id, snapshot FROM s) y),
    x AS (SELECT s.client_id, s.session, n.n, n.snapshot, n.n - row_number() OVER (PARTITION BY s.client_id, s.session ORDER BY n.n) AS island FROM s JOIN n USING (client_id, snapshot)),
    runs AS (SELECT client_id, session, min(snapshot) AS a, max(n) AS last_n FROM x GROUP BY client_id, session, island)
    SELECT client_id, session, 'login' AS event, a AS us, CAST(NULL AS DOUBLE) AS duration_s FROM runs UNION ALL SELECT r.client_id, r.session, 'logout', n.snapshot, (n.snapshot - r.a) / 1e6 FROM runs r JOIN n ON n.client_id = r.client_id AND n.n = r.last_n + 1""", "user_activity")
def j8_session_events(spark, sf_dir):
    snaps = _with_snapshot(telemetry(spark, sf_dir)["user_activity"]).select("client_id", "snapshot", F.col("snapshot").alias("us"), F.col("username").alias("session"))
    return detectors.session_events(snaps)


@query("SELECT id, r = 1 AS novel, round(CASE WHEN r = 1 THEN risk_score ELSE greatest(0.0, risk_score - 1) END, 6) AS risk_after FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY us, id) AS r FROM filesystem_data) x", "filesystem_data")
def j9_hash_novelty(spark, sf_dir):
    return rounded(detectors.hash_novelty(telemetry(spark, sf_dir)["filesystem_data"]).select("id", "novel", "risk_after"), "risk_after")


@query("SELECT id, client_id FROM network_data WHERE client_id IN (SELECT client_id FROM clients WHERE federated_learning)", "network_data", "clients")
def j10_registered_only(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return fleet.registered_only(t["network_data"], t["clients"].filter("federated_learning")).select("id", "client_id")


# -- aggregations ---------------------------------------------------------------------------------------------


@query("SELECT count(*) AS total, count(*) FILTER (WHERE status = 'online') AS online, count(*) FILTER (WHERE status <> 'online') AS offline, count(*) FILTER (WHERE federated_learning) AS federated FROM clients", "clients")
def a1_client_stats(spark, sf_dir):
    return fleet.client_stats(telemetry(spark, sf_dir)["clients"])


_FACTS = {"network": "network_data", "process": "process_data", "filesystem": "filesystem_data", "user_activity": "user_activity"}


@query(" UNION ALL ".join(f"SELECT '{n}' AS category, count(*) AS events FROM {v} WHERE us >= {AS_OF} - {DAY}" for n, v in _FACTS.items()), *_FACTS.values())
def a2_event_counts(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return fleet.event_counts({n: t[v] for n, v in _FACTS.items()}, newest(t))


@query(f"SELECT count(*) AS total, count(*) FILTER (WHERE severity = 'critical') AS critical, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity NOT IN ('critical', 'high')) AS other FROM alerts WHERE status = 'active' AND us >= {AS_OF} - {DAY}", "alerts")
def a3_alert_stats(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return fleet.alert_stats(t["alerts"], newest(t))


@query(f"SELECT count(*) AS logins, count(DISTINCT username) AS users, count(*) FILTER (WHERE source_ip <> 'local') AS remote, count(*) FILTER (WHERE risk_score > 5) AS high_risk FROM user_activity WHERE us >= {AS_OF} - {DAY}", "user_activity")
def a4_user_stats(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return fleet.user_stats(t["user_activity"], newest(t))


@query(f"""WITH h AS (SELECT unnest(range(CAST(floor({AS_OF} / 3600000000) AS BIGINT) - 24, CAST(floor({AS_OF} / 3600000000) AS BIGINT) + 1)) AS hour), n AS (SELECT CAST(floor(us / 3600000000) AS BIGINT) AS hour, count(*) AS events, avg(risk_score) AS avg_risk FROM network_data WHERE us >= {AS_OF} - {DAY} GROUP BY 1)
    SELECT h.hour, coalesce(n.events, 0) AS events, round(coalesce(n.avg_risk, 0.0), 6) AS avg_risk FROM h LEFT JOIN n ON n.hour = h.hour""", "network_data")
def a5_hourly_timeline(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return rounded(fleet.hourly_timeline(t["network_data"], newest(t)), "avg_risk")


@query("SELECT client_id, dst_ip, dst_port, count(*) AS n, min(us) AS first_us, max(us) AS last_us, count(DISTINCT src_port) AS ports FROM network_data GROUP BY 1, 2, 3", "network_data")
def a6_connection_history(spark, sf_dir):
    return fleet.connection_history(telemetry(spark, sf_dir)["network_data"])


@query(f"SELECT client_id, {_SNAP} AS cycle, count(*) AS connections, count(DISTINCT dst_ip) AS destinations, count(*) FILTER (WHERE is_anomaly) AS ml_detections, count(*) FILTER (WHERE risk_score > 6) AS rule_detections FROM network_data GROUP BY 1, 2", "network_data")
def a7_network_summary(spark, sf_dir):
    return fleet.network_summary(telemetry(spark, sf_dir)["network_data"], F.floor(F.col("us") / CYCLE).cast("long"))


@query(f"""SELECT client_id, cycle, count(*) AS processes, count(*) FILTER (WHERE cpu_percent > 50) AS high_cpu, count(*) FILTER (WHERE memory_mb > 500) AS high_memory, count(*) FILTER (WHERE risk_score > 6) AS high_risk, string_agg(CASE WHEN r <= 5 THEN name END, ',' ORDER BY r) AS top_names
    FROM (SELECT *, {_SNAP} AS cycle, row_number() OVER (PARTITION BY client_id, {_SNAP} ORDER BY cpu_percent + memory_mb DESC, id) AS r FROM process_data) x GROUP BY 1, 2""", "process_data")
def a7_process_summary(spark, sf_dir):
    out = fleet.process_summary(telemetry(spark, sf_dir)["process_data"], F.floor(F.col("us") / CYCLE).cast("long"))
    return out.withColumn("top_names", F.array_join("top_names", ","))


@query(f"""WITH u AS ({" UNION ALL ".join(f"SELECT client_id, us, risk_score, '{n}' AS category FROM {v}" for n, v in {**_FACTS, "alert": "alerts"}.items())})
    SELECT {_SNAP} AS period, count(DISTINCT client_id) AS clients, {", ".join(f"count(*) FILTER (WHERE category = '{n}') AS {n}_events" for n in _FACTS)}, count(*) FILTER (WHERE category = 'alert' AND risk_score > 7) AS high_risk_alerts, round(avg(CASE WHEN category <> 'alert' THEN risk_score END), 6) AS avg_risk FROM u GROUP BY 1""", *_FACTS.values(), "alerts")
def a8_period_stats(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return rounded(fleet.period_stats({n: t[v] for n, v in _FACTS.items()}, t["alerts"]), "avg_risk")


_METRICS = "SELECT client_id, event_type AS metric, us, event_id AS id, value FROM e"


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry(spark, sf_dir)["events"].select("client_id", F.col("event_type").alias("metric"), "us", F.col("event_id").alias("id"), "value")


@query(f"SELECT client_id, metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, round(var_pop(value), 4) AS variance, count(*) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY client_id, metric ORDER BY us DESC, id DESC) AS r FROM ({_METRICS}) m) x WHERE r <= 200 GROUP BY 1, 2")
def a9_baseline_stats(spark, sf_dir):
    return rounded(rounded(baselines.baseline_stats(metrics(spark, sf_dir)), "mean", "std"), "variance", digits=4)


@query(f"SELECT client_id, metric, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS q50, round(quantile_cont(value, 0.75), 6) AS q75, round(avg(value), 6) AS mean FROM (SELECT *, row_number() OVER (PARTITION BY client_id, metric ORDER BY us DESC, id DESC) AS r FROM ({_METRICS}) m) x WHERE r <= 50 GROUP BY 1, 2")
def a10_score_distribution(spark, sf_dir):
    return rounded(baselines.score_distribution(metrics(spark, sf_dir)), "q25", "q50", "q75", "mean")


@query("SELECT client_id, round(-sum(n * 1.0 / t * log2(n * 1.0 / t)), 6) AS entropy FROM (SELECT client_id, dst_port, count(*) AS n, sum(count(*)) OVER (PARTITION BY client_id) AS t FROM network_data GROUP BY 1, 2) x GROUP BY 1", "network_data")
def a11_port_entropy(spark, sf_dir):
    return rounded(features.port_entropy(telemetry(spark, sf_dir)["network_data"], "client_id"), "entropy")


# -- windows --------------------------------------------------------------------------------------------------


@query(f"""SELECT id, CASE WHEN us - before < 300000000 THEN true ELSE false END AS rapid, coalesce(n >= 5 AND abs(hour - m) > 6, false) AS odd_hour FROM (SELECT id, us, hour, lag(us) OVER w AS before, count(*) OVER p AS n, avg(hour) OVER p AS m
    FROM (SELECT *, CAST(floor(us / 3600000000) AS BIGINT) % 24 AS hour FROM user_activity) y WINDOW w AS (PARTITION BY client_id, username ORDER BY us, id), p AS (PARTITION BY client_id, username ORDER BY us, id ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING)) x""", "user_activity")
def w2_login_anomaly(spark, sf_dir):
    return detectors.login_anomaly(telemetry(spark, sf_dir)["user_activity"]).select("id", "rapid", "odd_hour")


@query(f"""SELECT id, coalesce(round(CASE WHEN n >= 10 AND s > 0 THEN (value - m) / s END, 5), -999) AS z, coalesce(CASE WHEN n >= 10 AND s > 0 THEN abs((value - m) / s) > 2.5 END, false) AS anomaly FROM (SELECT id, value, count(value) OVER p AS n, avg(value) OVER p AS m, stddev_pop(value) OVER p AS s
    FROM ({_METRICS}) y WINDOW p AS (PARTITION BY client_id, metric ORDER BY us, id ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING)) x""")
def w3_zscore_detect(spark, sf_dir):
    out = baselines.zscore_detect(metrics(spark, sf_dir)).select("id", "z", "anomaly")
    return out.withColumn("z", F.coalesce(F.round("z", 5), F.lit(-999.0)))


@query(f"""WITH RECURSIVE m AS (SELECT *, row_number() OVER (PARTITION BY client_id, metric ORDER BY us, id) AS k FROM ({_METRICS}) y),
    r AS (SELECT client_id, metric, us, id, k, value AS ema FROM m WHERE k = 1
        UNION ALL SELECT m.client_id, m.metric, m.us, m.id, m.k, CAST(0.95 AS DOUBLE) * r.ema + CAST(0.05 AS DOUBLE) * m.value FROM r JOIN m ON m.client_id = r.client_id AND m.metric = r.metric AND m.k = r.k + 1)
    SELECT client_id, metric, us, id, round(ema + 1e-9, 6) AS ema FROM r""")  # values with few digits would be ties
def w4_ema(spark, sf_dir):
    return rounded(baselines.ema(metrics(spark, sf_dir)).select("client_id", "metric", "us", "id", (F.col("ema") + 1e-9).alias("ema")), "ema")


@query(feature_sql.robust_rows(3_600_000_000), *feature_sql.TABLES)
def w5_robust_normalize(spark, sf_dir):
    return lifted(features.robust_normalize(window_features(spark, sf_dir), chunk=5_000))


@query(f"""SELECT id, CASE WHEN n <= 20 THEN 1.0 WHEN metric = 'network' AND v > 15 THEN 1.05 WHEN metric = 'network' AND v < 3 THEN 0.95 WHEN metric = 'process' AND v > 8 THEN 1.05 WHEN metric = 'process' AND v < 2 THEN 0.95 ELSE 1.0 END AS factor
    FROM (SELECT id, metric, var_pop(value) OVER (PARTITION BY client_id, metric ORDER BY us, id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS v, count(*) OVER (PARTITION BY client_id, metric ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n
    FROM (SELECT client_id, CASE WHEN event_type IN ('click', 'view') THEN 'network' ELSE 'process' END AS metric, us, event_id AS id, value / 20 AS value FROM e) y) x""")
def w6_adapt_sensitivity(spark, sf_dir):
    m = metrics(spark, sf_dir).withColumns({"metric": F.when(F.col("metric").isin("click", "view"), "network").otherwise("process"), "value": F.col("value") / 20})
    return baselines.adapt_sensitivity(m).select("id", F.col("factor").cast("double").alias("factor"))


@query(f"""WITH RECURSIVE y AS (SELECT client_id, CASE WHEN event_type IN ('click', 'view') THEN 'network' ELSE 'process' END AS metric, us, event_id AS id, value / 20 AS value FROM e),
    x AS (SELECT client_id, metric, id, row_number() OVER w AS k, var_pop(value) OVER (PARTITION BY client_id, metric ORDER BY us, id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS v FROM y WINDOW w AS (PARTITION BY client_id, metric ORDER BY us, id)),
    f AS (SELECT client_id, metric, id, k, CAST(CASE WHEN k <= 20 THEN 1.0 WHEN metric = 'network' AND v > 15 THEN 1.05 WHEN metric = 'network' AND v < 3 THEN 0.95 WHEN metric = 'process' AND v > 8 THEN 1.05 WHEN metric = 'process' AND v < 2 THEN 0.95 ELSE 1.0 END AS DOUBLE) AS factor FROM x),
    r AS (SELECT client_id, metric, id, k, least(2.0, greatest(0.5, factor)) AS sensitivity FROM f WHERE k = 1
        UNION ALL SELECT f.client_id, f.metric, f.id, f.k, least(2.0, greatest(0.5, r.sensitivity * f.factor)) FROM r JOIN f ON f.client_id = r.client_id AND f.metric = r.metric AND f.k = r.k + 1)
    SELECT id, round(sensitivity, 6) AS sensitivity FROM r""")
def w6_running_sensitivity(spark, sf_dir):
    m = metrics(spark, sf_dir).withColumns({"metric": F.when(F.col("metric").isin("click", "view"), "network").otherwise("process"), "value": F.col("value") / 20})
    return rounded(baselines.running_sensitivity(m).select("id", "sensitivity"), "sensitivity")


@query(f"SELECT id, creations, round(CASE WHEN creations > 3 THEN least(10.0, risk_score + 2) ELSE risk_score END, 6) AS boosted FROM (SELECT *, count(CASE WHEN event_type = 'created' THEN 1 END) OVER (PARTITION BY client_id ORDER BY us RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS creations FROM filesystem_data) x", "filesystem_data")
def w7_rapid_creation(spark, sf_dir):
    return rounded(detectors.rapid_creation_boost(telemetry(spark, sf_dir)["filesystem_data"], 3, DAY).select("id", "creations", "boosted"), "boosted")


@query(f"SELECT id, count(*) OVER (PARTITION BY client_id, {_SNAP}, username) AS concurrent FROM user_activity", "user_activity")
def w8_concurrent_sessions(spark, sf_dir):
    return detectors.concurrent_sessions(_with_snapshot(telemetry(spark, sf_dir)["user_activity"])).select("id", "concurrent")


_HISTORY = """SELECT *, count(*) OVER w AS conn_n, CAST(sum(f) OVER w AS BIGINT) AS ports_n FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY client_id, dst_ip, dst_port, src_port ORDER BY us, id) = 1 THEN 1 ELSE 0 END AS f FROM network_data) x
    WINDOW w AS (PARTITION BY client_id, dst_ip, dst_port ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


@query(f"SELECT id, conn_n, ports_n FROM ({_HISTORY}) h", "network_data")
def w9_running_history(spark, sf_dir):
    return fleet.running_history(telemetry(spark, sf_dir)["network_data"]).select("id", "conn_n", "ports_n")


@query("""WITH RECURSIVE x AS (SELECT id, client_id, us, row_number() OVER (PARTITION BY client_id ORDER BY us, id) AS k FROM alerts),
    r AS (SELECT id, client_id, k, true AS kept, [us] AS times FROM x WHERE k = 1
        UNION ALL SELECT x.id, x.client_id, x.k, len(t.live) < 2, CASE WHEN len(t.live) < 2 THEN list_append(t.live, x.us) ELSE t.live END
        FROM r JOIN x ON x.client_id = r.client_id AND x.k = r.k + 1, LATERAL (SELECT list_filter(r.times, lambda u: u > x.us - 3600000000) AS live) t)
    SELECT id, kept FROM r""", "alerts")
def w10_rate_limit(spark, sf_dir):
    return dedup.rate_limit(telemetry(spark, sf_dir)["alerts"], 2, 3_600_000_000).select("id", "kept")


# -- top lists and sets ---------------------------------------------------------------------------------------


@query("SELECT id, client_id, us, risk_score FROM alerts WHERE status = 'active' ORDER BY us DESC, risk_score DESC, id LIMIT 100", "alerts")
def t1_active_alerts(spark, sf_dir):
    return fleet.active_alerts(telemetry(spark, sf_dir)["alerts"]).select("id", "client_id", "us", "risk_score")


@query(f"SELECT client_id, r AS rank, risk_score, text FROM (SELECT client_id, risk_score, title || ': ' || description AS text, row_number() OVER (PARTITION BY client_id ORDER BY risk_score DESC, id) AS r FROM alerts WHERE status = 'active' AND us >= {AS_OF} - {DAY}) x WHERE r <= 5", "alerts")
def t2_recent_alerts(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return fleet.recent_alerts_per_client(t["alerts"], newest(t), DAY)


_TOP = {"network": ("network_data", "dst_ip"), "process": ("process_data", "name"), "filesystem": ("filesystem_data", "file_name")}


@query("SELECT category, client_id, detail, risk, id FROM (" + " UNION ALL ".join(f"(SELECT '{n}' AS category, client_id, {d} AS detail, risk_score AS risk, id FROM {v} WHERE us >= {AS_OF} - {DAY} AND risk_score > 5 ORDER BY risk_score DESC, id LIMIT 5)" for n, (v, d) in _TOP.items()) + ") u ORDER BY risk DESC, category, id LIMIT 15", *[v for v, _ in _TOP.values()])
def t3_top_risks(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return fleet.top_risks({n: (t[v], d) for n, (v, d) in _TOP.items()}, newest(t))


@query("SELECT id, us, risk_score FROM network_data ORDER BY us DESC, risk_score DESC, id LIMIT 500", "network_data")
def t4_riskiest(spark, sf_dir):
    return fleet.riskiest(telemetry(spark, sf_dir)["network_data"]).select("id", "us", "risk_score")


@query(f"SELECT id, r AS rank FROM (SELECT id, row_number() OVER (PARTITION BY client_id, {_SNAP} ORDER BY risk_score DESC, id) AS r FROM filesystem_data) x WHERE r <= 3", "filesystem_data")
def t5_per_cycle(spark, sf_dir):
    return fleet.per_cycle(telemetry(spark, sf_dir)["filesystem_data"], F.floor(F.col("us") / CYCLE), 3).select("id", "rank")


@query("SELECT client_id, hostname, heartbeat FROM clients ORDER BY heartbeat DESC NULLS LAST, client_id", "clients")
def t6_by_heartbeat(spark, sf_dir):
    return fleet.by_heartbeat(telemetry(spark, sf_dir)["clients"]).select("client_id", "hostname", "heartbeat")


@query("SELECT client_id, first_us, us AS last_us, id AS last_id FROM (SELECT client_id, us, id, min(us) OVER (PARTITION BY client_id) AS first_us, row_number() OVER (PARTITION BY client_id ORDER BY us DESC, id DESC) AS r FROM network_data) x WHERE r = 1", "network_data")
def t7_latest_per_client(spark, sf_dir):
    n = telemetry(spark, sf_dir)["network_data"]
    return n.groupBy("client_id").agg(F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.max_by("id", F.struct("us", "id")).alias("last_id"))


# -- risk scores ----------------------------------------------------------------------------------------------

_LOCAL = "(" + " OR ".join(f"dst_ip LIKE '{p}%'" for p in ("10.", "192.168.", "172.", "127.", "169.254.")) + ")"
_SAFE = "(coalesce(lower(dns), '') IN ({0}) OR {1})".format(", ".join(f"'{d}'" for d in scalars.fixed.SAFE_DOMAINS), " OR ".join(f"coalesce(lower(dns), '') LIKE '%.{d}'" for d in scalars.fixed.SAFE_DOMAINS))


def _scored_sql(scorer, source: str) -> str:
    points, says = scorer.duckdb()
    return f"SELECT id, round({points}, 6) AS risk, {says} AS indicators FROM ({source}) src"


def _scored(df: DataFrame) -> DataFrame:
    return df.select("id", F.round("risk", 6).alias("risk"), F.array_join("indicators", ",").alias("indicators"))


_NET = f"SELECT *, {_LOCAL} AS local, {_SAFE} AS safe_domain FROM ({_HISTORY}) h"


@query(_scored_sql(risk.network_scorer(), _NET), "network_data")
def r1_network_risk_full(spark, sf_dir):
    return _scored(risk.network_risk_full(fleet.running_history(telemetry(spark, sf_dir)["network_data"])))


@query(_scored_sql(risk.NETWORK_LIVE, _NET), "network_data")
def r2_network_rules_live(spark, sf_dir):
    rows = risk._network_columns(fleet.running_history(telemetry(spark, sf_dir)["network_data"]))
    return _scored(risk.NETWORK_LIVE.apply(rows))


_PARENTS = f"""SELECT p.*, q.parent_name FROM (SELECT *, {_SNAP} AS snapshot FROM process_data) p LEFT JOIN (SELECT client_id, {_SNAP} AS snapshot, pid AS ppid, min_by(name, id) AS parent_name FROM process_data GROUP BY ALL) q USING (client_id, snapshot, ppid)"""


@query(_scored_sql(risk.PROCESS_FULL, _PARENTS), "process_data")
def r3_process_risk_full(spark, sf_dir):
    return _scored(risk.process_risk_full(detectors.with_parent(_with_snapshot(telemetry(spark, sf_dir)["process_data"]))))


_LINEAGE = "CASE " + " ".join(f"WHEN contains(lower(parent_name), '{a}') AND contains(lower(name), '{b}') THEN '{a}>{b}'" for a, b in scalars.fixed.LINEAGE) + " END"


@query(_scored_sql(risk.PROCESS_LIVE, f"SELECT *, {_LINEAGE} AS lineage, name = 'chrome.exe' AS trusted FROM ({_PARENTS}) pp"), "process_data")
def r4_process_rules_live(spark, sf_dir):
    rows = detectors.with_parent(_with_snapshot(telemetry(spark, sf_dir)["process_data"]))
    rows = rows.withColumns({"lineage": detectors.lineage(F.col("parent_name"), F.col("name")), "trusted": F.col("name") == "chrome.exe"})
    return _scored(risk.PROCESS_LIVE.apply(rows))


_FILE = "SELECT * , event_type = 'created' AS is_new, id % 900 AS age_s, false AS windows FROM filesystem_data"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = telemetry(spark, sf_dir)["filesystem_data"]
    return f.withColumns({"is_new": F.col("event_type") == "created", "age_s": F.col("id") % 900, "windows": F.lit(False), "sampled": F.col("id") % 10 == 0})


@query(_scored_sql(risk.file_scorer(), _FILE), "filesystem_data")
def r5_file_risk_full(spark, sf_dir):
    return _scored(risk.file_risk_full(_files(spark, sf_dir)))


@query(_scored_sql(risk.FILE_LIVE, _FILE), "filesystem_data")
def r6_file_rules_live(spark, sf_dir):
    return _scored(risk.FILE_LIVE.apply(_files(spark, sf_dir)))


@query(f"SELECT id, file_name FROM filesystem_data WHERE {risk.POTENTIALLY_SUSPICIOUS}", "filesystem_data")
def r7_potentially_suspicious(spark, sf_dir):
    return risk.potentially_suspicious(_files(spark, sf_dir)).select("id", "file_name")


_LOGIN = """SELECT *, CAST(floor(us / 3600000000) AS BIGINT) % 24 AS login_hour, row_number() OVER (PARTITION BY client_id, username, source_ip ORDER BY us, id) = 1 AND row_number() OVER (PARTITION BY client_id, username ORDER BY us, id) > 1 AS new_ip,
    coalesce(us - lag(us) OVER (PARTITION BY client_id, username ORDER BY us, id) < 3600000000, false) AS recent_login, count(CASE WHEN NOT login_success THEN 1 END) OVER (PARTITION BY client_id, source_ip ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS failed_logins,
    lower(username) IN ('root', 'administrator', 'admin', 'system', 'sudo') AS privileged, source_ip NOT IN ('local', 'localhost', '127.0.0.1', '::1', '') AS remote FROM user_activity"""


@query(_scored_sql(risk.USER_FULL, _LOGIN), "user_activity")
def r8_user_risk_full(spark, sf_dir):
    return _scored(risk.user_risk_full(detectors.login_context(telemetry(spark, sf_dir)["user_activity"])))


def _user_live_sql() -> str:
    points, _ = risk.USER_LIVE.duckdb()
    return f"SELECT id, round(CASE WHEN rr > 5 THEN rr WHEN privileged OR remote THEN 2.0 ELSE 1.0 END, 6) AS risk, CASE WHEN rr > 5 THEN 'rule' ELSE 'baseline' END AS method FROM (SELECT *, {points} AS rr FROM ({_LOGIN}) l) x"


@query(_user_live_sql(), "user_activity")
def r9_user_risk_live(spark, sf_dir):
    out = risk.user_risk_live(detectors.login_context(telemetry(spark, sf_dir)["user_activity"]))
    return rounded(out.select("id", "risk", "method"), "risk")


@query("SELECT id, CASE severity WHEN 'high' THEN 9.0 WHEN 'medium' THEN 6.5 WHEN 'low' THEN 4.5 ELSE 5.0 END AS risk FROM alerts", "alerts")
def r11_ml_risk(spark, sf_dir):
    return telemetry(spark, sf_dir)["alerts"].select("id", risk.ml_risk("severity", "network").cast("double").alias("risk"))


@query(_scored_sql(risk.network_scorer("v2"), _NET), "network_data")
def r12_network_risk_strict(spark, sf_dir):
    return _scored(risk.network_risk_full(fleet.running_history(telemetry(spark, sf_dir)["network_data"]), "v2"))


@query(_scored_sql(risk.file_scorer("v2"), _FILE), "filesystem_data")
def r12_file_risk_strict(spark, sf_dir):
    return _scored(risk.file_risk_full(_files(spark, sf_dir), "v2"))


@query(_scored_sql(short_risk.NETWORK, _NET), "network_data")
def r10_network_risk_short(spark, sf_dir):
    return _scored(short_risk.NETWORK.apply(risk._network_columns(fleet.running_history(telemetry(spark, sf_dir)["network_data"]))))


@query(_scored_sql(short_risk.PROCESS, "SELECT * FROM process_data"), "process_data")
def r10_process_risk_short(spark, sf_dir):
    return _scored(short_risk.PROCESS.apply(telemetry(spark, sf_dir)["process_data"]))


@query(_scored_sql(short_risk.FILE, "SELECT * FROM filesystem_data"), "filesystem_data")
def r10_file_risk_short(spark, sf_dir):
    return _scored(short_risk.FILE.apply(telemetry(spark, sf_dir)["filesystem_data"]))


@query(_scored_sql(short_risk.USER, _LOGIN), "user_activity")
def r10_user_risk_short(spark, sf_dir):
    return _scored(short_risk.USER.apply(detectors.login_context(telemetry(spark, sf_dir)["user_activity"])))


# -- features, models, alerts ---------------------------------------------------------------------------------

SPAN_US = 3_600_000_000  # hours: the given events are sparse


def raw_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry(spark, sf_dir)
    return features.windows(features.tagged_events(t["network_data"], t["process_data"], t["filesystem_data"]), SPAN_US)


def window_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.features(raw_windows(spark, sf_dir), SPAN_US)


_W = f"CAST(floor(us / {SPAN_US}) * {SPAN_US} AS BIGINT)"


@query(f"""WITH n AS (SELECT client_id, {_W} AS w, count(*) AS conns, count(DISTINCT dst_ip) AS dsts, sum(bytes_sent) AS sent FROM network_data GROUP BY 1, 2), p AS (SELECT client_id, {_W} AS w, count(*) AS spawns, count(DISTINCT name) AS procs FROM process_data GROUP BY 1, 2),
    f AS (SELECT client_id, {_W} AS w, count(*) FILTER (WHERE event_type = 'created') AS creates, count(DISTINCT file_hash) AS hashes FROM filesystem_data GROUP BY 1, 2), b AS (SELECT client_id, w, max(k) AS busiest FROM (SELECT client_id, {_W} AS w, dst_ip, count(*) AS k FROM network_data GROUP BY 1, 2, 3) y GROUP BY 1, 2),
    h AS (SELECT client_id, w, -sum(k * 1.0 / t * log2(k * 1.0 / t)) AS entropy FROM (SELECT client_id, {_W} AS w, dst_port, count(*) AS k, sum(count(*)) OVER (PARTITION BY client_id, {_W}) AS t FROM network_data GROUP BY 1, 2, 3) z GROUP BY 1, 2),
    a AS (SELECT client_id, w FROM n UNION SELECT client_id, w FROM p UNION SELECT client_id, w FROM f)
    SELECT a.client_id, a.w AS window_us, coalesce(conns, 0) AS conns, coalesce(dsts, 0) AS dsts, round(coalesce(sent, 0), 6) AS sent, coalesce(busiest, 0) AS busiest, coalesce(spawns, 0) AS spawns, coalesce(procs, 0) AS procs, coalesce(creates, 0) AS creates, coalesce(hashes, 0) AS hashes, round(coalesce(entropy, 0), 6) AS entropy
    FROM a LEFT JOIN n USING (client_id, w) LEFT JOIN p USING (client_id, w) LEFT JOIN f USING (client_id, w) LEFT JOIN b USING (client_id, w) LEFT JOIN h USING (client_id, w)""", "network_data", "process_data", "filesystem_data")
def fw1_windows(spark, sf_dir):
    out = raw_windows(spark, sf_dir).withColumn("busiest", F.coalesce("busiest", F.lit(0)))
    return rounded(out.select("client_id", "window_us", "conns", "dsts", "sent", "busiest", "spawns", "procs", "creates", "hashes", "entropy"), "sent", "entropy")


def lifted(df: DataFrame) -> DataFrame:
    """The features to 6 digits; what ends in a 5 there is rounded up by any engine."""
    return rounded(df.withColumns({c: F.col(c) + 1e-9 for c in FEATURES}), *FEATURES)


@query(feature_sql.feature_rows(SPAN_US), *feature_sql.TABLES)
def fw2_features(spark, sf_dir):
    return lifted(window_features(spark, sf_dir))


@query(feature_sql.pattern_rows(7 * DAY), *feature_sql.TABLES)
def fw4_pattern_alerts(spark, sf_dir):
    """Windows of a week, as the given events are sparse."""
    t = telemetry(spark, sf_dir)
    raw = features.windows(features.tagged_events(t["network_data"], t["process_data"], t["filesystem_data"]), 7 * DAY)
    found = features.pattern_alerts(features.features(raw, 7 * DAY))
    return found.withColumn("patterns", F.array_join("patterns", ","))


def unpacked(df: DataFrame, *keys: str) -> DataFrame:
    """A row per number of `vector`."""
    return rounded(df.select(*keys, F.posexplode("vector").alias("position", "value")).withColumn("value", F.col("value") + 1e-9), "value")


@query(f"WITH {feature_sql.features(SPAN_US)}, r AS (SELECT client_id, window_us, row_number() OVER (PARTITION BY client_id ORDER BY window_us DESC) AS n, [{', '.join(FEATURES)}] AS v FROM ft) SELECT client_id, window_us, CAST(unnest(range(0, {len(FEATURES)})) AS INT) AS position, round(unnest(v) + 1e-9, 6) AS value FROM r WHERE n <= 1000", *feature_sql.TABLES)
def fw5_feature_matrix(spark, sf_dir):
    return unpacked(features.feature_matrix(window_features(spark, sf_dir)), "client_id", "window_us")


@query()
def fw6_event_vectors(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    raw = features.windows(features.tagged_events(t["network_data"], t["process_data"], t["filesystem_data"]))
    parts = features.network_vectors(fleet.running_history(t["network_data"]), raw), features.process_vectors(t["process_data"], raw), features.file_vectors(t["filesystem_data"], raw)
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""WITH l AS ({_LOGIN}), x AS (SELECT *, count(*) OVER u AS n, sum(CAST(remote AS INT)) OVER u AS far, avg(sessions) OVER u AS often, sum(first) OVER c AS people, count(*) OVER c AS all_n
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY client_id, username ORDER BY us, id) = 1 AS INT) AS first FROM l) y WINDOW u AS (PARTITION BY client_id, username ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), c AS (PARTITION BY client_id ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    v AS (SELECT client_id, id, us, [CAST(privileged AS DOUBLE), CAST(remote AS DOUBLE), least(sessions / 5.0, 1.0), CAST(login_hour < 6 OR login_hour > 22 AS DOUBLE), login_hour / 24.0, CAST(NOT new_ip AS DOUBLE), least(n / 20.0, 1.0), far / CAST(n AS DOUBLE), often / 5,
        least(people / 10.0, 1.0), least(all_n / 100.0, 1.0), (CAST(floor(us / {DAY}) AS BIGINT) + 3) % 7 / 7.0] AS vector FROM x)
    SELECT client_id, id, us, CAST(unnest(range(0, 12)) AS INT) AS position, round(unnest(vector) + 1e-9, 6) AS value FROM v""", "user_activity")
def fw7_user_vectors(spark, sf_dir):
    return unpacked(features.user_vectors(detectors.login_context(telemetry(spark, sf_dir)["user_activity"])), "client_id", "id", "us")


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 24 numbers of each embedding, as feature vectors."""
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform(F.slice("embedding", 1, len(FEATURES)), lambda x: x.cast("double")).alias("vector"), (F.col("label") == 0).alias("label"))


_N = range(1, len(FEATURES) + 1)
_COLS = ", ".join(f"quantile_cont(CAST(embedding[{k}] AS DOUBLE), 0.25) AS a{k}, quantile_cont(CAST(embedding[{k}] AS DOUBLE), 0.75) AS b{k}" for k in _N)
_IN = " AND ".join(f"embedding[{k}] BETWEEN a{k} - 3 * (b{k} - a{k}) AND b{k} + 3 * (b{k} - a{k})" for k in _N)


@query(f"SELECT vec_id AS id FROM embeddings, (SELECT {_COLS} FROM embeddings) q WHERE {_IN}")
def m1_iqr_clean(spark, sf_dir):
    m = matrix(spark, sf_dir).select("id", *[F.col("vector")[k].alias(f"x{k}") for k in range(len(FEATURES))])
    return baselines.iqr_clean(m, [f"x{k}" for k in range(len(FEATURES))]).select("id")


@query()
def m2_isolation_forest(spark, sf_dir):
    m = matrix(spark, sf_dir)
    return forest.score(m, forest.train(m)).select("id", "iso_score")


@query()
def m3_autoencoder(spark, sf_dir):
    m = matrix(spark, sf_dir)
    model = autoencoder.train(m)
    return autoencoder.score(m, model).select("id", "ae_error", (F.col("ae_error") > model.threshold).alias("anomaly"))


def scored(spark: SparkSession, sf_dir: str, share: float = 0.9) -> tuple[DataFrame, float]:
    """Both models' scores, and the autoencoder's threshold."""
    m = matrix(spark, sf_dir)
    trees, model = forest.train(m), autoencoder.train(m, share=share)
    return autoencoder.score(forest.score(m, trees), model), model.threshold


@query()
def m5_ensemble(spark, sf_dir):
    both, threshold = scored(spark, sf_dir)
    out = ensemble.contributing(ensemble.severity(ensemble.scores(both, ae_threshold=threshold)))
    return out.select("id", "ensemble_score", "severity", "contributing_features")


@query()
def m9_tiered(spark, sf_dir):
    both, threshold = scored(spark, sf_dir, 0.995)
    return ensemble.tiered(both, forest.threshold(both, 0.01), threshold).select("id", "tier", "severity", "features")


_AL = """SELECT id, client_id, 'high' AS severity, round(risk_score, 6) AS alert_risk, 'network' AS source_category FROM network_data WHERE risk_score > 7
    UNION ALL SELECT id, client_id, CASE WHEN risk_score > 8 THEN 'critical' WHEN risk_score > 6 THEN 'high' ELSE 'medium' END, round(risk_score, 6), 'process' FROM process_data WHERE risk_score > 5
    UNION ALL SELECT id, client_id, CASE WHEN file_ext = '.locked' THEN 'critical' WHEN risk_score > 8 THEN 'high' ELSE 'medium' END, round(risk_score, 6), 'filesystem' FROM filesystem_data WHERE risk_score > 6"""


@query(_AL, "network_data", "process_data", "filesystem_data")
def al1_threshold_alerts(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    out = alerts.threshold_alerts(t["network_data"], t["process_data"], t["filesystem_data"])
    return rounded(out.select("id", "client_id", "severity", "alert_risk", "source_category"), "alert_risk")


@query("""SELECT id, 'brute_force' AS alert_type, 'high' AS severity, 8.0 AS alert_risk FROM (SELECT id, count(*) OVER (PARTITION BY client_id, source_ip ORDER BY us RANGE BETWEEN 600000000 PRECEDING AND CURRENT ROW) AS k FROM user_activity) x WHERE k >= 5
    UNION ALL SELECT id, 'privilege_escalation', 'critical', 9.0 FROM (SELECT id, count(*) OVER (PARTITION BY client_id, username ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS k FROM user_activity WHERE privilege_escalation) x WHERE k >= 2
    UNION ALL SELECT id, 'impossible_travel', 'medium', 6.5 FROM (SELECT a.id, a.source_ip, a.us, b.source_ip AS other_ip, b.us AS other_us, row_number() OVER (PARTITION BY a.id ORDER BY b.us DESC, b.id DESC) AS r FROM user_activity a
        JOIN user_activity b ON a.client_id = b.client_id AND a.username = b.username AND a.source_ip <> b.source_ip AND (b.us < a.us OR (b.us = a.us AND b.id < a.id))) x WHERE r = 1 AND source_ip <> 'local' AND other_ip <> 'local' AND us - other_us <= 3600000000
    UNION ALL SELECT id, 'off_hours_privileged', 'medium', 5.5 FROM user_activity WHERE privilege_escalation AND (CAST(floor(us / 3600000000) AS BIGINT) % 24 < 6 OR CAST(floor(us / 3600000000) AS BIGINT) % 24 > 22)
    UNION ALL SELECT id, 'multiple_sessions', 'medium', 5.0 FROM user_activity WHERE sessions >= 3""", "user_activity")
def al2_user_alerts(spark, sf_dir):
    return alerts.user_alerts(telemetry(spark, sf_dir)["user_activity"]).select("id", "alert_type", "severity", "alert_risk")


def _ml_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = telemetry(spark, sf_dir)["alerts"]
    names = F.array(*[F.lit(n) for n in FEATURES])
    picked = F.transform(F.array(F.lit(0), F.lit(5), F.lit(11)), lambda k: F.get(names, ((F.col("id") + k) % len(FEATURES)).cast("int")))
    return a.select("client_id", "id", "us", F.upper("severity").alias("severity"), F.col("source_category").alias("category"), F.when(F.col("id") % 3 == 0, F.col("risk_score")).alias("ensemble_score"), (-F.col("risk_score") / 12).alias("iso_score"), F.lit(None).cast("double").alias("ae_score"), picked.alias("contributing_features"), F.col("description").alias("explanation"))


@query("SELECT id, severity, round(CASE WHEN id % 3 = 0 THEN risk_score ELSE least(10.0, risk_score / 12 * 10) END, 6) AS alert_risk, 'ml_' || source_category || '_anomaly' AS alert_type FROM alerts", "alerts")
def al3_normalize_ml(spark, sf_dir):
    return rounded(alerts.normalize_ml(_ml_alerts(spark, sf_dir)).select("id", "severity", "alert_risk", "alert_type"), "alert_risk")


def _ttl_sql(name: str, source: str, ttl: dict[str, int]) -> str:
    """CTEs that fold `source` (id, us, severity, signature) in time: `name` has id and kept."""
    span = "CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in ttl.items()) + " ELSE 180 END * 1000000"
    return f"""{name}_x AS (SELECT id, us, signature, {span} AS span, row_number() OVER (PARTITION BY signature ORDER BY us, id) AS k FROM {source}),
    {name} AS (SELECT id, signature, k, true AS kept, us + span AS expiry FROM {name}_x WHERE k = 1
        UNION ALL SELECT x.id, x.signature, x.k, r.expiry < x.us, CASE WHEN r.expiry < x.us THEN x.us + x.span ELSE r.expiry END FROM {name} r JOIN {name}_x x ON x.signature = r.signature AND x.k = r.k + 1)"""


_NAMES = "[" + ", ".join(f"'{n}'" for n in FEATURES) + "]"
_ML = f"""SELECT id, client_id, us, severity, source_category AS category, CASE WHEN id % 3 = 0 THEN risk_score ELSE least(10.0, risk_score / 12 * 10) END AS alert_risk,
    list_transform([0, 5, 11], lambda k: ({_NAMES})[CAST((id + k) % {len(FEATURES)} AS INT) + 1]) AS features FROM alerts"""


def _group_sql(name: str) -> str:
    return "CASE " + " ".join(f"WHEN {' OR '.join(f"contains({name}, '{w}')" for w in words)} THEN '{group}'" for group, words in scalars.GROUPS.items()) + " ELSE 'other' END"


@query(f"""WITH RECURSIVE ml AS ({_ML}), signed AS (SELECT *, concat_ws('_', client_id, category, severity, array_to_string(list_sort(features), ',')) AS signature FROM ml), {_ttl_sql("once", "signed", {"critical": 600, "high": 300, "medium": 180, "low": 60})}
    SELECT s.id, s.signature, s.severity, round(s.alert_risk, 6) AS alert_risk FROM signed s JOIN once o ON o.id = s.id WHERE o.kept AND s.alert_risk > 4""", "alerts")
def al4_server_dedup(spark, sf_dir):
    return rounded(alerts.server_ml_alerts(alerts.normalize_ml(_ml_alerts(spark, sf_dir))).select("id", "signature", "severity", "alert_risk"), "alert_risk")


@query(f"""WITH RECURSIVE ml AS ({_ML}), signed AS (SELECT *, concat_ws('_', client_id, 'system', severity, array_to_string(list_sort(features), ',')) AS signature FROM ml), {_ttl_sql("once", "signed", {"critical": 300, "high": 180, "medium": 120, "low": 60})},
    grouped AS (SELECT ml.id, us, severity, concat_ws('_', client_id, severity, category, array_to_string(list_sort(list_distinct(list_transform(features, lambda f: {_group_sql("f")})))[1:3], ',')) AS signature FROM ml JOIN once ON once.id = ml.id WHERE once.kept),
    {_ttl_sql("twice", "grouped", {"critical": 300, "high": 180, "medium": 120, "low": 60})}
    SELECT g.id, g.signature, g.severity FROM grouped g JOIN twice t ON t.id = g.id WHERE t.kept""", "alerts")
def al5_agent_dedup(spark, sf_dir):
    return alerts.agent_alerts(alerts.normalize_ml(_ml_alerts(spark, sf_dir))).select("id", "signature", "severity")


@query(f"""WITH RECURSIVE x AS (SELECT id, client_id, concat_ws('_', category, upper(severity)) AS signature, row_number() OVER (PARTITION BY client_id ORDER BY us, id) AS k FROM ({_ML}) ml),
    r AS (SELECT id, client_id, k, true AS kept, [signature] AS recent FROM x WHERE k = 1
        UNION ALL SELECT x.id, x.client_id, x.k, NOT list_contains(r.recent, x.signature), CASE WHEN list_contains(r.recent, x.signature) THEN r.recent ELSE list_append(r.recent, x.signature)[-10:] END
        FROM r JOIN x ON x.client_id = r.client_id AND x.k = r.k + 1)
    SELECT id, kept FROM r""", "alerts")
def al6_recent_dedup(spark, sf_dir):
    signed = _ml_alerts(spark, sf_dir).withColumn("signature", F.concat_ws("_", "category", "severity"))
    return dedup.recent_dedup(signed).select("id", "kept")


def _texts_sql() -> str:
    """The alert texts over contributing features 0, 5 and 11 after the id, in the order of the features."""
    names = "[" + ", ".join(f"'{n}'" for n in FEATURES) + "]"
    has = lambda *words: " OR ".join(f"a LIKE '%{w}%'" for w in words)
    return f"""SELECT id,
        CASE c WHEN 'network' THEN CASE WHEN {has("c2_pattern")} THEN '⚠️ Possible C2 Communication Detected' WHEN {has("port_entropy")} THEN '⚠️ Port Scanning Activity Detected' ELSE 'Suspicious Network Activity - ' || s END
            WHEN 'process' THEN CASE WHEN {has("cred_dump_pattern")} THEN '⚠️ CRITICAL: Credential Theft Attempt' WHEN {has("proc_spawn")} THEN '⚠️ Unusual Process Spawning Detected' ELSE 'Suspicious Process Behavior - ' || s END
            WHEN 'filesystem' THEN CASE WHEN {has("ransomware_burst")} THEN '⚠️ RANSOMWARE ACTIVITY DETECTED' WHEN {has("file_create_count")} THEN '⚠️ Mass File Modification Detected' ELSE 'Suspicious File Activity - ' || s END
            ELSE 'ML Anomaly: ' || s || ' - ' || upper(c) END AS title,
        CASE WHEN s = 'CRITICAL' AND c = 'filesystem' AND ({has("ransomware")}) THEN '🚨 IMMEDIATE: RANSOMWARE SUSPECTED - Isolate host, kill processes, restore from backup'
            WHEN s = 'CRITICAL' AND c = 'filesystem' THEN 'IMMEDIATE: Quarantine affected files, analyze hashes, block execution'
            WHEN s = 'CRITICAL' AND c = 'network' AND ({has("c2")}) THEN '🚨 IMMEDIATE: C2 COMMUNICATION SUSPECTED - Block IPs, isolate host, capture traffic'
            WHEN s = 'CRITICAL' AND c = 'network' THEN 'IMMEDIATE: Isolate host from network, block suspicious IPs, analyze traffic'
            WHEN s = 'CRITICAL' AND c = 'process' AND ({has("cred", "dump")}) THEN '🚨 IMMEDIATE: CREDENTIAL THEFT SUSPECTED - Terminate processes, force password reset'
            WHEN s = 'CRITICAL' AND c = 'process' THEN 'IMMEDIATE: Quarantine process, collect memory dump, analyze parent chain' WHEN s = 'CRITICAL' THEN 'IMMEDIATE: Isolate system and investigate'
            WHEN s = 'HIGH' AND c = 'network' THEN 'URGENT: Review firewall logs, block suspicious destinations, monitor for persistence'
            WHEN s = 'HIGH' AND c = 'process' THEN 'URGENT: Investigate parent processes, check for persistence mechanisms, analyze binary'
            WHEN s = 'HIGH' AND c = 'filesystem' THEN 'URGENT: Stop file operations, review recent changes, check for data exfiltration' WHEN s = 'HIGH' THEN 'URGENT: Investigate immediately, track behavior, prepare for escalation'
            WHEN s = 'MEDIUM' THEN 'MONITOR: Track ' || c || ' activity, correlate with other events, set alerts for escalation' ELSE 'LOG: Record for pattern analysis and baseline adjustment' END AS action
        FROM (SELECT id, upper(severity) AS s, source_category AS c, array_to_string(list_transform([0, 5, 11], lambda k: ({names})[CAST((id + k) % {len(FEATURES)} AS INT) + 1]), ',') AS a FROM alerts) x"""


@query(_texts_sql(), "alerts")
def al7_al10_titles_actions(spark, sf_dir):
    a, names, severity = _ml_alerts(spark, sf_dir), F.col("contributing_features"), F.lower("severity")
    return a.select("id", alerts.alert_title(F.col("category"), names, severity).alias("title"), alerts.recommended_action(severity, F.col("category"), names).alias("action"))


@query()
def al8_al9_descriptions(spark, sf_dir):
    a, names = _ml_alerts(spark, sf_dir), F.col("contributing_features")
    value = lambda f: F.when(F.array_contains(names, f), F.col("ensemble_score"))
    said, shown = alerts.explain(F.col("category"), value, F.coalesce("ensemble_score", F.lit(0.0)), names)
    return a.select("id", alerts.alert_description(F.col("category"), names, F.col("explanation"), F.col("ensemble_score")).alias("description"), said.alias("explanation"), shown.alias("evidence"), alerts.dominant_category(names).alias("dominant"))


@query("SELECT id, CASE WHEN id % 7 = 0 THEN 'acknowledged' ELSE status END AS status FROM alerts", "alerts")
def al13_acknowledge(spark, sf_dir):
    a = telemetry(spark, sf_dir)["alerts"]
    return fleet.acknowledge(a, a.filter("id % 7 = 0").select("id")).select("id", "status")


@query(f"SELECT client_id, CASE WHEN status = 'online' AND heartbeat < {AS_OF} - 3600000000 THEN 'offline' ELSE status END AS status FROM clients", "clients")
def al14_mark_offline(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return fleet.mark_offline(t["clients"], newest(t), 3_600_000_000).select("client_id", "status")


@query("""SELECT id, 'network' AS source_category, CASE WHEN risk_score > 8 THEN 'high' ELSE 'medium' END AS severity FROM network_data WHERE (risk_score > 7 AND is_anomaly) OR risk_score > 8.5
    UNION ALL SELECT id, 'process', CASE WHEN risk_score > 8.5 THEN 'critical' ELSE 'high' END FROM process_data WHERE risk_score > 7 UNION ALL SELECT id, 'filesystem', CASE WHEN risk_score > 8.5 THEN 'critical' ELSE 'high' END FROM filesystem_data WHERE risk_score > 7""", "network_data", "process_data", "filesystem_data")
def al16_gated_alerts(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return alerts.gated_alerts(t["network_data"], t["process_data"], t["filesystem_data"]).select("id", "source_category", "severity")


@query("""SELECT id, 'process' AS source_category, CASE WHEN risk_score > 8 THEN 'high' ELSE 'medium' END AS severity FROM process_data WHERE risk_score > 7 UNION ALL SELECT id, 'filesystem', CASE WHEN risk_score > 8 THEN 'critical' ELSE 'high' END FROM filesystem_data WHERE risk_score > 6""", "process_data", "filesystem_data")
def al15_event_alerts(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return alerts.event_alerts(t["process_data"], t["filesystem_data"]).select("id", "source_category", "severity")


# -- federated rounds -----------------------------------------------------------------------------------------

_FL = """SELECT month(o_orderdate) AS round, 'client_' || CAST(o_custkey AS STRING) AS client_id, 1 + avg(o_totalprice) / 100000 AS network_threshold, 1 + min(o_totalprice) / 100000 AS process_threshold, 1 + max(o_totalprice) / 100000 AS file_threshold,
    0.5 + count(*) / CAST(20 AS DOUBLE) AS network_sensitivity, 0.5 + count(*) / CAST(30 AS DOUBLE) AS process_sensitivity, 0.5 + count(*) / CAST(40 AS DOUBLE) AS file_sensitivity, count(*) * 10 AS samples, avg(CASE WHEN o_orderstatus = 'F' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS anomaly_rate, coalesce(var_pop(o_totalprice / 1000), 0) AS variance
    FROM {orders} GROUP BY 1, 2"""
_LONG = "SELECT round, client_id, samples, unnest([" + ", ".join(f"'{k}'" for k in WEIGHT_KEYS) + "]) AS key, unnest([" + ", ".join(WEIGHT_KEYS) + "]) AS value FROM fl"


def most_updates(spark: SparkSession, sf_dir: str) -> int:
    """No more updates than orders."""
    return read(spark, sf_dir, "orders").count()


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    fl = spark.sql(_FL, orders=dealt(read(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus"), most_updates(spark, sf_dir), "o_custkey"))
    weights = F.map_from_arrays(F.array(*[F.lit(k) for k in WEIGHT_KEYS]), F.array(*[F.col(k).cast("double") for k in WEIGHT_KEYS]))
    one = F.create_map(F.lit("network"), F.lit(1.0))
    return fl.select("round", "client_id", (F.col("round") * DAY).alias("us"), weights.alias("weights"), one.alias("statistics"), one.alias("data_quality"), "samples", F.col("anomaly_rate").cast("double").alias("anomaly_rate"), F.col("variance").cast("double").alias("variance"))


def _fl(sql: str) -> str:
    return sql.replace("WITH fl", "WITH fl AS (" + _FL.replace("{orders}", "orders") + ")")


def _rounds(sql: str) -> str:
    """SQL over: fl; o (clipped updates, the k-th of each client); rep (with reputation); shares; means and g (the model)."""
    norm = "sqrt(" + " + ".join(f"({k} - 1) * ({k} - 1)" for k in WEIGHT_KEYS) + ")"
    quality = "least(2.0, greatest(0.1, least(1.0, samples / 100.0)) * CASE WHEN variance > 0 THEN least(variance / 50, 1.2) ELSE 1.0 END * least(1 + anomaly_rate / 2, 1.3))"

    def step(r: str) -> str:
        r = f"(CASE WHEN o.n <= 2 THEN least(2.0, {r} * 1.02) ELSE {r} END)"
        r = f"least(2.0, {r} * CASE WHEN o.k > 10 THEN 1.01 ELSE 1 END)"
        return f"greatest(0.1, {r} * CASE WHEN o.n > 2 THEN 0.98 ELSE 1 END)"

    def model(value: str, speed: str, rate: float, momentum: float, bounded: bool) -> tuple[str, str]:
        new = f"({momentum} * {speed} + {1 - momentum:.1f} * (m.value - {value}))"
        at = f"({value} + {rate} * {new})"
        return new, f"CASE WHEN m.key LIKE '%threshold%' THEN greatest(1.0, least(5.0, {at})) ELSE greatest(0.3, least(2.0, {at})) END" if bounded else at

    def fold(name: str, means: str, *how) -> str:
        first, later = model("CAST(1 AS DOUBLE)", "CAST(0 AS DOUBLE)", *how), model("p.model", "p.speed", *how)
        return f"""{name} AS (SELECT m.key, m.round, m.i, m.value, m.clients, CAST({first[0]} AS DOUBLE) AS speed, CAST({first[1]} AS DOUBLE) AS model FROM {means} m WHERE m.i = 1
            UNION ALL SELECT m.key, m.round, m.i, m.value, m.clients, {later[0]}, {later[1]} FROM {name} p JOIN {means} m ON m.key = p.key AND m.i = p.i + 1)"""

    return f"""WITH RECURSIVE fl AS ({_FL.replace("{orders}", "orders")}),
    o AS (SELECT *, {norm} AS n, {quality} AS quality, row_number() OVER (PARTITION BY client_id ORDER BY round) AS k FROM fl),
    rep AS (SELECT o.client_id, o.round, o.k, o.n, o.quality, CAST({step("1.0")} AS DOUBLE) AS reputation FROM o WHERE o.k = 1
        UNION ALL SELECT o.client_id, o.round, o.k, o.n, o.quality, {step("r.reputation")} FROM rep r JOIN o ON o.client_id = r.client_id AND o.k = r.k + 1),
    shares AS (SELECT round, client_id, 0.6 * reputation / sum(reputation) OVER (PARTITION BY round) + 0.4 * quality / sum(quality) OVER (PARTITION BY round) AS share FROM rep),
    lo AS ({_LONG}),
    means AS (SELECT round, key, sum(value * share) / sum(share) AS value, count(*) AS clients, row_number() OVER (PARTITION BY key ORDER BY round) AS i FROM lo JOIN shares USING (round, client_id) GROUP BY 1, 2),
    plain AS (SELECT round, key, sum(value * samples) / sum(samples) AS value, count(*) AS clients, row_number() OVER (PARTITION BY key ORDER BY round) AS i FROM lo GROUP BY 1, 2),
    {fold("g", "means", 0.5, 0.9, True)}, {fold("simple", "plain", 0.3, 0.0, False)} {sql}"""


def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = F.create_map(*[x for k in WEIGHT_KEYS for x in (F.lit(k), F.lit(1.0))])
    clipped = federated.delta_clip(updates(spark, sf_dir), current, 2.0)
    return clipped.withColumn("quality", federated.quality(F.col("samples"), F.col("variance"), F.col("anomaly_rate")))


@query(_fl("WITH fl SELECT round, client_id, 'accepted' AS status FROM fl"))
def fl1_validate(spark, sf_dir):
    return federated.validate(updates(spark, sf_dir)).select("round", "client_id", "status")


@query(_fl("WITH fl SELECT round, client_id, samples >= 20 AND " + "sqrt(" + " + ".join(f"({k} - 1) * ({k} - 1)" for k in WEIGHT_KEYS) + ") <= 4 AS accepted, CASE WHEN anomaly_rate > 0.5 THEN 'high_anomaly_rate' ELSE '' END AS warning FROM fl"))
def fl2_screen(spark, sf_dir):
    out = federated.screen(contributions(spark, sf_dir), least=20, norm=4)
    return out.select("round", "client_id", "accepted", F.coalesce("warning", F.lit("")).alias("warning"))


@query(_fl(f"WITH fl SELECT round, client_id, round(n, 6) AS pre_norm, n > 2.0 AS was_clipped, round(least(n, 2.0), 6) AS post_norm FROM (SELECT round, client_id, sqrt({' + '.join(f'({k} - 1) * ({k} - 1)' for k in WEIGHT_KEYS)}) AS n FROM fl) x"))
def fl3_delta_clip(spark, sf_dir):
    return rounded(contributions(spark, sf_dir).select("round", "client_id", "pre_norm", "was_clipped", "post_norm"), "pre_norm", "post_norm")


@query(_fl("WITH fl SELECT round, client_id, round(least(2.0, greatest(0.1, least(1.0, samples / 100.0)) * CASE WHEN variance > 0 THEN least(variance / 50, 1.2) ELSE 1.0 END * least(1 + anomaly_rate / 2, 1.3)), 6) AS quality FROM fl"))
def fl4_quality(spark, sf_dir):
    return rounded(contributions(spark, sf_dir).select("round", "client_id", "quality"), "quality")


def reputations(spark: SparkSession, sf_dir: str, *more) -> DataFrame:
    newest = federated.latest_per_round(contributions(spark, sf_dir), most_updates(spark, sf_dir))
    return federated.reputation(newest.select("round", "client_id", "us", "pre_norm", "post_norm", "was_clipped", "quality", *more))


def global_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clipping, reputation, shares and the momentum step, round after round; computed once and kept (a row per round and key)."""
    newest = reputations(spark, sf_dir, *[F.col("weights")[k].alias(k) for k in WEIGHT_KEYS])
    return kept(federated.global_rounds(federated.column_means(federated.client_weights(newest), WEIGHT_KEYS), {k: 1.0 for k in WEIGHT_KEYS}))


@query(_rounds("SELECT round, client_id, round(n, 6) AS pre_norm, round(least(n, 2.0), 6) AS post_norm, n > 2 AS was_clipped, round(reputation, 6) AS reputation FROM rep"))
def fl5_reputation(spark, sf_dir):
    return rounded(reputations(spark, sf_dir).select("round", "client_id", "pre_norm", "post_norm", "was_clipped", "reputation"), "pre_norm", "post_norm", "reputation")


@query(_rounds("SELECT round, client_id, round(share, 9) AS share FROM shares"))
def fl6_client_weights(spark, sf_dir):
    return rounded(federated.client_weights(reputations(spark, sf_dir)).select("round", "client_id", "share"), "share", digits=9)


@query(_rounds("SELECT round, key, clients, round(value, 6) AS value, round(model, 6) AS model FROM g"))
def fl7_global_rounds(spark, sf_dir):
    return rounded(global_models(spark, sf_dir).select("round", "key", "clients", "value", "model"), "value", "model")


@query(_fl(f"""WITH fl, lo AS ({_LONG}), r AS (SELECT *, count(*) OVER (PARTITION BY round, key) AS n, row_number() OVER (PARTITION BY round, key ORDER BY value, client_id) AS i FROM lo)
    SELECT round, key, round(avg(value), 6) AS value, count(*) AS kept FROM r WHERE n <= 2 * greatest(1, floor(n * 0.1)) OR (i > greatest(1, floor(n * 0.1)) AND i <= n - greatest(1, floor(n * 0.1))) GROUP BY 1, 2"""))
def fl8_trimmed_mean(spark, sf_dir):
    return rounded(federated.trimmed_mean(federated.long_form(updates(spark, sf_dir))), "value")


@query()
def fl9_gaussian_noise(spark, sf_dir):
    return federated.gaussian_noise(federated.fed_avg(federated.long_form(updates(spark, sf_dir))))


@query(_fl(f"WITH fl, lo AS ({_LONG}) SELECT round, key, round(avg(value - 0.01 * (value - 1.0)), 6) AS value, count(*) AS clients FROM lo GROUP BY 1, 2"))
def fl10_fed_prox(spark, sf_dir):
    return rounded(federated.fed_avg(federated.fed_prox(federated.long_form(updates(spark, sf_dir)), F.lit(1.0))), "value")


@query(_fl(f"WITH fl, lo AS ({_LONG}) SELECT round, key, round(sum(value * samples) / sum(samples), 6) AS value, count(*) AS clients FROM lo GROUP BY 1, 2"))
def fl11_weighted_average(spark, sf_dir):
    return rounded(federated.fed_avg(federated.long_form(updates(spark, sf_dir)), "samples"), "value")


@query(_rounds(f"""SELECT client_id, count(*) AS updates, round(arg_max(quality, round), 6) AS quality, round(arg_max(reputation, round), 6) AS reputation, round(avg(least(n, 2.0)), 6) AS avg_norm, round(avg(CAST(n > 2 AS INT)), 6) AS clip_ratio,
    CASE WHEN (12 - max(round)) * {DAY // 10**6} < 600 THEN 'Active' WHEN (12 - max(round)) * {DAY // 10**6} < 3600 THEN 'Idle' ELSE 'Inactive' END AS status FROM rep GROUP BY 1"""))
def fl13_leaderboard(spark, sf_dir):
    out = federated.leaderboard(reputations(spark, sf_dir), 12 * DAY).select("client_id", "updates", "quality", "reputation", "avg_norm", "clip_ratio", "status")
    return rounded(out, "quality", "reputation", "avg_norm", "clip_ratio")


@query(_rounds("""SELECT round, round(delta, 6) AS delta, CASE WHEN delta < 0.01 THEN 'Stable' ELSE 'Converging' END AS status FROM
    (SELECT round, sqrt(avg(d * d)) AS delta FROM (SELECT round, model - lag(model) OVER (PARTITION BY key ORDER BY round) AS d FROM g) x GROUP BY 1) y WHERE delta IS NOT NULL ORDER BY round DESC LIMIT 20"""))
def fl14_convergence(spark, sf_dir):
    return rounded(federated.convergence(global_models(spark, sf_dir)), "delta")


@query(_rounds("SELECT round, key, clients, round(value, 6) AS value, round(model, 6) AS model FROM simple"))
def fl17_simple_aggregation(spark, sf_dir):
    means = federated.fed_avg(federated.long_form(updates(spark, sf_dir)), "samples")
    return rounded(federated.global_rounds(means, {}, simple=True).select("round", "key", "clients", "value", "model"), "value", "model")


# -- evaluation and text --------------------------------------------------------------------------------------


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang")
    return read(spark, sf_dir, "labels").join(docs, "doc_id").select(F.col("lang").alias("model"), F.col("doc_id").alias("id"), (F.col("n_chars") % 1000 / 100).alias("score"), (F.col("quality") == 1).alias("label"))


_LAB = "SELECT d.lang AS model, l.doc_id AS id, (d.n_chars % 1000) / 100.0 AS score, l.quality = 1 AS label FROM labels l JOIN documents d ON d.doc_id = l.doc_id"


@query(f"""WITH l AS ({_LAB}), g AS (SELECT model, score, count(*) FILTER (WHERE label) AS p, count(*) FILTER (WHERE NOT label) AS n FROM l GROUP BY 1, 2), c AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY model) AS ap, sum(n) OVER (PARTITION BY model) AS an FROM g WINDOW w AS (PARTITION BY model ORDER BY score DESC))
    SELECT model, round(sum(n * (tp + tp - p) / 2.0) / max(ap * an), 6) AS auc FROM c GROUP BY 1""")
def ev2_auc(spark, sf_dir):
    return rounded(evaluate.auc(labelled(spark, sf_dir)), "auc")


@query(f"""WITH l AS ({_LAB}), g AS (SELECT model, score, count(*) FILTER (WHERE label) AS p, count(*) AS k FROM l GROUP BY 1, 2), c AS (SELECT *, sum(p) OVER w AS tp, sum(k) OVER w AS s, sum(p) OVER (PARTITION BY model) AS ap FROM g WINDOW w AS (PARTITION BY model ORDER BY score DESC))
    SELECT model, round(score, 6) AS score, round(tp / s, 6) AS precision, round(tp / ap, 6) AS recall FROM c""")
def ev3_pr_points(spark, sf_dir):
    return rounded(evaluate.pr_points(labelled(spark, sf_dir)), "score", "precision", "recall")


@query(f"SELECT model, label, score > 5.0 AS predicted, count(*) AS n FROM ({_LAB}) l GROUP BY 1, 2, 3")
def ev4_confusion(spark, sf_dir):
    return evaluate.confusion(labelled(spark, sf_dir))


@query(f"SELECT model, id, r > floor(n * 0.9) AS label FROM (SELECT model, id, row_number() OVER (PARTITION BY model ORDER BY id) AS r, count(*) OVER (PARTITION BY model) AS n FROM ({_LAB}) l) x")
def ev5_placeholder_labels(spark, sf_dir):
    return evaluate.placeholder_labels(labelled(spark, sf_dir)).select("model", "id", "label")


def crawled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as crawl results without tool lists."""
    kind = "struct<urls: array<string>, domains: array<string>, emails: array<string>, ips: array<string>, keywords: array<string>>"
    return read(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("task_id"), F.concat_ws(" ", "url", "html").alias("raw_output"), F.lit(None).cast(kind).alias("darkdump_results"))


def _found(pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    return f"list_sort(list_distinct(regexp_extract_all(t, '{quoted}')))"


_PAGES = rf"SELECT CAST(page_id AS STRING) AS task_id, regexp_replace(concat_ws(' ', url, html), '\x1b\[[0-9;]*[A-Za-z]', '', 'g') AS t FROM pages"
_ENTITIES = f"""SELECT task_id, {_found(crawl.ONION_URL)} AS urls, list_sort(list_distinct(regexp_extract_all(t, 'http://([a-z2-7]{{16,56}}\\.onion)', 1))) AS onion_domains, {_found(crawl.EMAIL)} AS emails, {_found(crawl.DOCUMENT)} AS document_links FROM ({_PAGES}) p"""


@query(f"""SELECT task_id, array_to_string(urls, ' ') AS urls, array_to_string(onion_domains, ' ') AS onion_domains, '' AS clearnet_domains, array_to_string(emails, ' ') AS emails, '' AS ips, '' AS keywords, array_to_string(document_links, ' ') AS document_links FROM ({_ENTITIES}) e""")
def tx5_entities(spark, sf_dir):
    found = crawl.entities(crawled(spark, sf_dir))
    return found.select("task_id", *[F.array_join(c, " ").alias(c) for c in found.columns if c != "task_id"])


@query(r"SELECT doc_id, CAST(len(list_distinct(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'))) AS INTEGER) AS emails FROM documents")
def tx5_document_emails(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.size(crawl.all_of(F.col("text"), crawl.EMAIL.replace(r"\b", ""))).alias("emails"))


@query(f"""SELECT task_id, len(onion_domains) AS onion_domains, 0 AS clearnet_domains, len(urls) AS total_urls, len(urls) AS onion_urls, 0 AS clearnet_urls, len(emails) AS total_emails, 0 AS total_ips, 0 AS total_keywords, len(document_links) AS document_links,
    0 AS total_websites, 0 AS with_metadata, 0 AS with_keywords, 0 AS with_sentiment FROM ({_ENTITIES}) e""")  # given pages have no entries of sites
def tx6_statistics(spark, sf_dir):
    c = crawled(spark, sf_dir)
    return crawl.statistics(crawl.entities(c), crawl.sites(c))


@query(r"SELECT id, CASE WHEN dst_ip LIKE '10.%' OR dst_ip LIKE '192.168.%' OR dst_ip LIKE '172.%' OR dst_ip LIKE '127.%' OR dst_ip LIKE '169.254.%' THEN 'Local Network' ELSE 'External' END AS geo FROM network_data", "network_data")
def x1_geolocation(spark, sf_dir):
    return telemetry(spark, sf_dir)["network_data"].select("id", scalars.geolocation(F.col("dst_ip")).alias("geo"))


@query("SELECT id, CASE " + " ".join(f"WHEN dst_port = {p} THEN 'TCP/{n}'" for p, n in scalars.fixed.PROTOCOLS.items()) + " ELSE 'TCP:' || CAST(dst_port AS STRING) END AS name FROM network_data", "network_data")
def x2_protocol_name(spark, sf_dir):
    return telemetry(spark, sf_dir)["network_data"].select("id", scalars.protocol_name(F.lit("TCP"), F.col("dst_port")).alias("name"))


@query("SELECT client_id, substr(sha256(hostname || '_' || department || '_' || status), 1, 16) AS stable FROM clients", "clients")
def x9_client_id(spark, sf_dir):
    return telemetry(spark, sf_dir)["clients"].select("client_id", scalars.client_id(F.col("hostname"), F.col("department"), F.col("status")).alias("stable"))


@query("SELECT CAST(l_suppkey AS STRING) AS client, CAST(CAST(l_shipdate AS DATE) AS STRING) AS day, count(*) AS flows, count(DISTINCT l_partkey) AS destinations FROM lineitem GROUP BY 1, 2")
def scale_flow_counts(spark, sf_dir):
    """Flows are counted by client, day and destination, and these counts folded by client and day."""
    flows = read(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_shipdate").cast("date").alias("day"), "l_partkey")
    n = flows.count()
    each = dealt(flows, n, "l_suppkey", "day", "l_partkey").groupBy("l_suppkey", "day", "l_partkey").agg(F.count("*").alias("flows"))
    out = dealt(each, n, "l_suppkey", "day").groupBy("l_suppkey", "day").agg(F.sum("flows").alias("flows"), F.count("l_partkey").alias("destinations"))
    return out.select(F.col("l_suppkey").cast("string").alias("client"), F.col("day").cast("string").alias("day"), "flows", "destinations")


@query(f"SELECT round(min(-value), 6) AS low, round(max((-value - lo) / (hi - lo + 1e-9)), 6) AS top, count(*) AS n FROM e, (SELECT min(-value) AS lo, max(-value) AS hi FROM e) q")
def ev1_scaled_scores(spark, sf_dir):
    scaled = evaluate.scaled_scores(telemetry(spark, sf_dir)["events"], "value")
    return scaled.agg(F.round(F.min(-F.col("value")), 6).alias("low"), F.round(F.max("scaled"), 6).alias("top"), F.count("*").alias("n"))


_TWO = f"SELECT l.model AS client_id, m.model, CASE WHEN m.model = 'iso' THEN (id * 7919 + CAST(score * 100 AS BIGINT)) % 1000 / 100.0 ELSE score END AS score, label FROM ({_LAB}) l, (VALUES ('ensemble'), ('iso')) m(model)"


@query(f"""WITH l AS ({_TWO}), g AS (SELECT client_id, model, score, count(*) FILTER (WHERE label) AS p, count(*) FILTER (WHERE NOT label) AS n FROM l GROUP BY 1, 2, 3), c AS (SELECT *, sum(p) OVER w AS tp, sum(p) OVER (PARTITION BY client_id, model) AS ap, sum(n) OVER (PARTITION BY client_id, model) AS an FROM g WINDOW w AS (PARTITION BY client_id, model ORDER BY score DESC)),
    u AS (SELECT client_id, model, sum(n * (tp + tp - p) / 2.0) / max(ap * an) AS auc FROM c GROUP BY 1, 2)
    SELECT client_id, (SELECT count(*) FROM l WHERE l.client_id = u.client_id AND l.model = 'ensemble') AS samples, {len(FEATURES)} AS features, round(max(CASE WHEN model = 'ensemble' THEN auc END), 6) AS ensemble_auc, round(max(CASE WHEN model = 'iso' THEN auc END), 6) AS iso_auc, CAST(NULL AS DOUBLE) AS ae_auc, 0 AS server_model_version FROM u GROUP BY 1""")
def ev6_summary(spark, sf_dir):
    """Two models with scores of their own; the third there isn't."""
    both = labelled(spark, sf_dir).select(F.col("model").alias("client_id"), "id", "score", "label", F.explode(F.array(F.lit("ensemble"), F.lit("iso"))).alias("model"))
    other = (F.col("id") * 7919 + F.round(F.col("score") * 100).cast("long")) % 1000 / 100
    return rounded(evaluate.summary(both.withColumn("score", F.when(F.col("model") == "iso", other).otherwise(F.col("score"))), len(FEATURES)), "ensemble_auc", "iso_auc")


@query("SELECT id, round(least(greatest(value, 1), 100), 6) AS clipped, round(ln(1 + value), 6) AS logged FROM (SELECT event_id AS id, value FROM e) x")
def x10_clip_and_log(spark, sf_dir):
    e = telemetry(spark, sf_dir)["events"]
    return e.select(F.col("event_id").alias("id"), F.round(scalars.clip(F.col("value"), 1, 100), 6).alias("clipped"), F.round(F.log1p("value"), 6).alias("logged"))


@query("SELECT id, lower(username) IN ('root', 'administrator', 'admin', 'system', 'sudo') AS privileged, (CAST(floor(us / 3600000000) AS BIGINT) % 24 < 6 OR CAST(floor(us / 3600000000) AS BIGINT) % 24 > 22) AS late FROM user_activity", "user_activity")
def x5_x6_user_tests(spark, sf_dir):
    u = telemetry(spark, sf_dir)["user_activity"]
    return u.select("id", scalars.is_privileged(F.col("username")).alias("privileged"), scalars.off_hours(F.timestamp_micros("us")).alias("late"))


@query(f"SELECT id, {_SAFE} AS safe FROM network_data", "network_data")
def x3_safe_domain(spark, sf_dir):
    return telemetry(spark, sf_dir)["network_data"].select("id", scalars.is_safe_domain(F.col("dns")).alias("safe"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry to windows to robust features to pattern severities."""
    found = features.robust_normalize(window_features(spark, sf_dir), chunk=5_000)
    return ensemble.heuristic(features.feature_matrix(found))


from . import more_queries  # noqa: E402, F401  the rest of the registry
