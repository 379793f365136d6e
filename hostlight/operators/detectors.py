"""Detections over time: logins, escalations, travel, lineage, file changes, sessions, rhythm.

Time is `us`, microseconds. Range frames end at the event itself; nothing joins a table with itself by range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import LINEAGE, LOCAL_SOURCES

MINUTE, HOUR = 60_000_000, 3_600_000_000


def _trailing(span: int, *keys: str):
    return Window.partitionBy(*keys).orderBy("us").rangeBetween(-span, 0)


def detect_brute_force(logins: DataFrame, n: int = 5, span: int = 10 * MINUTE) -> DataFrame:
    """Logins with at least n of the same client and address in the span up to them: high, 8.0."""
    out = logins.withColumn("attempts", F.count("*").over(_trailing(span, "client_id", "source_ip"))).filter(F.col("attempts") >= n)
    return out.withColumns({"severity": F.lit("high"), "alert_risk": F.lit(8.0)})


def detect_priv_escalation(logins: DataFrame, n: int = 2, span: int = HOUR) -> DataFrame:
    """Escalations with at least n of the same client and user in the hour up to them: critical, 9.0."""
    found = logins.filter("privilege_escalation")
    out = found.withColumn("escalations", F.count("*").over(_trailing(span, "client_id", "username"))).filter(F.col("escalations") >= n)
    return out.withColumns({"severity": F.lit("critical"), "alert_risk": F.lit(9.0)})


def detect_impossible_travel(logins: DataFrame, span: int = HOUR) -> DataFrame:
    """Remote logins whose latest login from another address, within the span before, was remote too: medium, 6.5.

    The latest login from another address is the last one of the run before the current run of equal addresses, so a lag
    over runs is enough; logins at the same moment are ordered by id.
    """
    order = Window.partitionBy("client_id", "username").orderBy("us", "id")
    change = F.coalesce((F.lag("source_ip").over(order) != F.col("source_ip")).cast("int"), F.lit(1))
    marked = logins.withColumn("_starts", change).withColumns({"_before_ip": F.lag("source_ip").over(order), "_before_us": F.lag("us").over(order)})
    last = lambda c: F.last(F.when(F.col("_starts") == 1, F.struct(c)), True).over(order.rowsBetween(Window.unboundedPreceding, 0))[c]
    out = marked.withColumns({"other_ip": last("_before_ip"), "other_us": last("_before_us")})
    remote = lambda c: ~F.col(c).isin(*LOCAL_SOURCES)
    out = out.filter(remote("source_ip") & remote("other_ip") & (F.col("us") - F.col("other_us") <= span))
    return out.withColumns({"severity": F.lit("medium"), "alert_risk": F.lit(6.5)}).drop("_starts", "_before_ip", "_before_us")


def with_parent(processes: DataFrame, snapshot: str = "snapshot") -> DataFrame:
    """Adds parent_name: the process with pid = ppid of the same client and snapshot (the first by id), else null."""
    parents = processes.groupBy("client_id", snapshot, F.col("pid").alias("ppid")).agg(F.min_by("name", "id").alias("parent_name"))
    known = processes.filter(F.col("ppid").isNotNull()).join(parents, ["client_id", snapshot, "ppid"], "left")
    rest = processes.filter(F.col("ppid").isNull()).withColumn("parent_name", F.lit(None).cast("string"))
    return known.unionByName(rest)


def lineage(parent: Column, child: Column) -> Column:
    """The suspicious pair that a parent and a child match, as 'parent>child', else null."""
    p, c = F.lower(parent), F.lower(child)
    return F.coalesce(*[F.when(p.contains(a) & c.contains(b), f"{a}>{b}") for a, b in LINEAGE])


def suspicious_lineage(processes: DataFrame) -> DataFrame:
    """Rows with parent_name whose parent and child are a suspicious pair."""
    return processes.withColumn("lineage", lineage(F.col("parent_name"), F.col("name"))).filter(F.col("lineage").isNotNull())


def file_change_type(scans: DataFrame) -> DataFrame:
    """Adds change: new, modified or existing against the scan of the same client and path before."""
    order = Window.partitionBy("client_id", "file_path", "file_name").orderBy("us", "id")
    before = F.lag("mtime").over(order)
    first = F.row_number().over(order) == 1
    return scans.withColumn("change", F.when(first, "new").when(F.col("mtime") != before, "modified").otherwise("existing"))


def session_events(snapshots: DataFrame) -> DataFrame:
    """Logins and logouts from snapshots of open sessions (client_id, snapshot 1, 2, ..., us, session).

    A run of consecutive snapshots is one session; it logs out at the first snapshot without it.
    """
    numbers = snapshots.select("client_id", "snapshot", "us").distinct()
    numbers = numbers.withColumn("n", F.row_number().over(Window.partitionBy("client_id").orderBy("snapshot")))
    rows = snapshots.select("client_id", "snapshot", "session").distinct().join(numbers, ["client_id", "snapshot"])
    island = F.col("n") - F.row_number().over(Window.partitionBy("client_id", "session").orderBy("n"))
    runs = rows.withColumn("island", island).groupBy("client_id", "session", "island").agg(F.min("us").alias("login_us"), F.max("n").alias("last_n"))
    after = numbers.select("client_id", (F.col("n") - 1).alias("last_n"), F.col("us").alias("logout_us"))
    runs = runs.join(after, ["client_id", "last_n"], "left")
    logins = runs.select("client_id", "session", F.lit("login").alias("event"), F.col("login_us").alias("us"), F.lit(None).cast("double").alias("duration_s"))
    logouts = runs.filter(F.col("logout_us").isNotNull()).select("client_id", "session", F.lit("logout").alias("event"), F.col("logout_us").alias("us"), ((F.col("logout_us") - F.col("login_us")) / 1e6).alias("duration_s"))
    return logins.unionByName(logouts)


def hash_novelty(files: DataFrame) -> DataFrame:
    """Adds novel (first sight of the content) and risk after a discount of 1, not below 0, for known content.

    Files without a hash are never novel and never discounted.
    """
    known = files.filter(F.col("file_hash").isNotNull())
    first = F.row_number().over(Window.partitionBy("file_hash").orderBy("us", "id")) == 1
    known = known.withColumn("novel", first).withColumn("risk_after", F.when(first, F.col("risk_score")).otherwise(F.greatest(F.lit(0.0), F.col("risk_score") - 1)))
    return known.unionByName(files.filter(F.col("file_hash").isNull()).withColumns({"novel": F.lit(False), "risk_after": F.col("risk_score")}))


def login_anomaly(logins: DataFrame, gap: int = 300_000_000, history: int = 20, least: int = 5) -> DataFrame:
    """Adds rapid (less than the gap since the login before) and odd_hour (over 6 hours from the mean hour of earlier logins)."""
    order = Window.partitionBy("client_id", "username").orderBy("us", "id")
    hour = (F.floor(F.col("us") / HOUR) % 24).cast("int")
    past = order.rowsBetween(-(history - 1), -1)
    out = logins.withColumn("hour", hour)
    rapid = F.coalesce(F.col("us") - F.lag("us").over(order) < gap, F.lit(False))
    odd = (F.count("*").over(past) >= least) & (F.abs(F.col("hour") - F.avg("hour").over(past)) > 6)
    return out.withColumns({"rapid": rapid, "odd_hour": F.coalesce(odd, F.lit(False))})


def rapid_creation_boost(files: DataFrame, n: int = 20, span: int = MINUTE) -> DataFrame:
    """Over n creations of a client in the span up to an event: 2 more risk, at most 10."""
    made = F.col("event_type") == "created"
    count = F.count(F.when(made, 1)).over(_trailing(span, "client_id"))
    return files.withColumn("creations", count).withColumn("boosted", F.when(F.col("creations") > n, F.least(F.lit(10.0), F.col("risk_score") + 2)).otherwise(F.col("risk_score")))


def concurrent_sessions(logins: DataFrame, snapshot: str = "snapshot") -> DataFrame:
    return logins.withColumn("concurrent", F.count("*").over(Window.partitionBy("client_id", snapshot, "username")))


def login_context(logins: DataFrame, span: int = HOUR) -> DataFrame:
    """Adds what the user scorers need: login_hour, new_ip, recent_login, failed_logins."""
    order = Window.partitionBy("client_id", "username").orderBy("us", "id")
    seen = F.row_number().over(Window.partitionBy("client_id", "username", "source_ip").orderBy("us", "id"))
    failed = F.count(F.when(~F.col("login_success"), 1)).over(Window.partitionBy("client_id", "source_ip").orderBy("us", "id").rowsBetween(Window.unboundedPreceding, 0))
    return logins.withColumns({
        "login_hour": (F.floor(F.col("us") / HOUR) % 24).cast("int"), "new_ip": (seen == 1) & (F.row_number().over(order) > 1),
        "recent_login": F.coalesce(F.col("us") - F.lag("us").over(order) < span, F.lit(False)), "failed_logins": failed,
    })
