"""Loading the given tables, and the telemetry that is derived from them by plain arithmetic.

The given tables hold no security telemetry. `VIEWS` maps them to the telemetry model with SQL that Spark and other
engines read alike; event time is microseconds since the epoch (`us`), so that ranges are exact integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(by: str, values) -> str:
    show = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {by} " + " ".join(f"WHEN {k} THEN {show(v)}" for k, v in enumerate(values)) + " END"


_PORTS = (80, 443, 4444, 8080, 3389, 5432, 9050, 6667, 53, 31337, 22, 1030)
_DNS = (None, "cdn.googleapis.com", "evil-host.example", "x.cloudfront.net", "db.internal")
_NAMES = ("chrome.exe", "powershell.exe", "mimikatz.exe", "winword.exe", "cmd.exe", "updater.exe", "lsass.exe")
_COMMANDS = ("chrome.exe --type=renderer", "powershell -enc SQBFAFgA -w hidden", "cmd.exe /c net user", "updater.exe /silent")
_PATHS = ("c:/program files/app/", "c:/users/a/downloads/", "c:/windows/temp/", "c:/data/")
_FILES = ("report.pdf", "invoice.pdf.exe", "a.locked", "setup.exe", "notes.txt", "keygen.exe")
_EXTENSIONS = (".pdf", ".exe", ".locked", ".exe", ".txt", ".exe")

#: The telemetry views over e (events with `us`), customer, orders; {E} is the base view's name.
VIEWS: dict[str, str] = {
    "network_data": f"""SELECT event_id AS id, client_id, us, CASE event_id % 4 WHEN 0 THEN '10.0.0.' WHEN 1 THEN '192.168.1.' WHEN 2 THEN '203.0.113.' ELSE '198.51.100.' END || CAST(event_id % 7 AS STRING) AS dst_ip,
        {pick("event_id % 12", _PORTS)} AS dst_port, CAST(49152 + event_id % 50 AS INT) AS src_port, {pick("event_id % 5", _DNS)} AS dns, 'TCP' AS protocol,
        least(value / 20, 10.0) AS risk_score, value > 150 AS is_anomaly, value * 10 AS bytes_sent, value AS bytes_recv FROM e WHERE event_type IN ('click', 'view')""",
    "process_data": f"""SELECT event_id AS id, client_id, us, {pick("event_id % 7", _NAMES)} AS name, event_id % 400 AS pid, (event_id * 7) % 400 AS ppid, value % 100 AS cpu_percent, value * 20 AS memory_mb,
        {pick("event_id % 4", _COMMANDS)} AS cmdline, {pick("event_id % 4", _PATHS)} AS path, least(value / 20, 10.0) AS risk_score FROM e WHERE event_type = 'purchase'""",
    "filesystem_data": f"""SELECT event_id AS id, client_id, us, {pick("event_id % 6", _FILES)} AS file_name, {pick("event_id % 6", _EXTENSIONS)} AS file_ext, {pick("event_id % 4", _PATHS)} AS file_path,
        event_id * 1024 AS file_size, md5(CAST(event_id % 300 AS STRING)) AS file_hash, CASE WHEN event_id % 3 > 0 THEN 'created' ELSE 'modified' END AS event_type, value > 150 AS is_suspicious,
        least(value / 20, 10.0) AS risk_score FROM e WHERE event_type = 'error'""",
    "user_activity": """SELECT event_id AS id, client_id, us, CASE WHEN user_id % 25 = 0 THEN 'admin' ELSE 'user_' || CAST(user_id AS STRING) END AS username,
        CASE event_id % 3 WHEN 0 THEN 'local' WHEN 1 THEN '203.0.113.' || CAST(event_id % 7 AS STRING) ELSE '198.51.100.' || CAST(event_id % 7 AS STRING) END AS source_ip,
        user_id % 25 = 0 AS privilege_escalation, 1 + event_id % 5 AS sessions, least(value / 20, 10.0) AS risk_score, event_id % 6 > 0 AS login_success FROM e WHERE event_type = 'signup'""",
    "alerts": """SELECT event_id AS id, client_id, us, CASE WHEN value > 180 THEN 'critical' WHEN value > 140 THEN 'high' ELSE 'medium' END AS severity, least(value / 20, 10.0) AS risk_score,
        CASE WHEN event_id % 10 > 0 THEN 'active' ELSE 'acknowledged' END AS status, CASE event_id % 4 WHEN 0 THEN 'network' WHEN 1 THEN 'process' WHEN 2 THEN 'filesystem' ELSE 'user_activity' END AS source_category,
        'Alert on ' || event_type AS title, 'value ' || CAST(CAST(floor(value) AS INT) AS STRING) AS description FROM e WHERE value / 20 > 5""",
    "clients": """SELECT 'client_' || CAST(c.c_custkey AS STRING) AS client_id, c.c_name AS hostname, c.c_mktsegment AS department, c.c_custkey % 2 = 0 AS federated_learning, h.heartbeat,
        CASE WHEN h.heartbeat >= m.as_of - 86400000000 THEN 'online' ELSE 'offline' END AS status
        FROM customer c LEFT JOIN (SELECT client_id, max(us) AS heartbeat FROM e GROUP BY client_id) h ON h.client_id = 'client_' || CAST(c.c_custkey AS STRING) CROSS JOIN (SELECT max(us) AS as_of FROM e) m""",
}
_EVENTS = "SELECT event_id, user_id, event_type, value, 'client_' || CAST(user_id AS STRING) AS client_id, {us} AS us FROM {events}"


def telemetry(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The telemetry tables by name, and `events` with client_id and us."""
    return derived(with_time(read(spark, sf_dir, "events")), read(spark, sf_dir, "customer"))


def with_time(events: DataFrame) -> DataFrame:
    """Given events with client_id and us."""
    return events.sparkSession.sql(_EVENTS.format(us="unix_micros(CAST(ts AS TIMESTAMP))", events="{events}"), events=events)


def derived(e: DataFrame, customer: DataFrame | None = None) -> dict[str, DataFrame]:
    """The telemetry tables of events with client_id and us; `clients` only with the customers."""
    spark, out = e.sparkSession, {"events": e}
    for name, text in VIEWS.items():
        if "customer" in text and customer is None:
            continue
        named = {"e": e} | ({"customer": customer} if "customer" in text else {})
        for frame in named:
            text = text.replace(f"FROM {frame} ", f"FROM {{{frame}}} ").replace(f"FROM {frame})", f"FROM {{{frame}}})")
        if text.endswith("FROM e"):
            text = text[:-1] + "{e}"
        out[name] = spark.sql(text, **named)
    return out


def with_views(sql: str, *names: str) -> str:
    """SQL that can use the telemetry views, for an engine with the given tables as views."""
    parts = ["e AS (" + _EVENTS.format(us="epoch_us(ts)", events="events") + ")"]
    parts += [f"{n} AS ({VIEWS[n]})" for n in names]
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ", ".join(parts) + ", " + body[15:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ", ".join(parts) + ", " + body[5:]
    return "WITH " + ", ".join(parts) + " " + body
