"""Scalar columns: addresses, ports, names, hashes, cleaning of numbers."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def any_of(tests: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def contains_any(c: Column, words: Iterable[str]) -> Column:
    """Whether a lower-cased text holds one of the words; null counts as empty."""
    text = F.coalesce(F.lower(c), F.lit(""))
    return any_of(text.contains(w) for w in words)


def is_local_ip(ip: Column) -> Column:
    return F.coalesce(any_of(ip.startswith(p) for p in fixed.LOCAL_PREFIXES), F.lit(False))


def geolocation(ip: Column) -> Column:
    return F.when(is_local_ip(ip), "Local Network").otherwise("External")


def protocol_name(base: Column, port: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in fixed.PROTOCOLS.items() for x in pair])
    known = F.try_element_at(names, port.cast("int"))
    return F.when(known.isNotNull(), F.concat(base, F.lit("/"), known)).otherwise(F.concat(base, F.lit(":"), port.cast("string")))


def is_safe_domain(name: Column) -> Column:
    """The name is on the allow-list, or below a name on it."""
    n = F.coalesce(F.lower(name), F.lit(""))
    return any_of((n == d) | n.endswith(f".{d}") for d in fixed.SAFE_DOMAINS)


def is_safe_process_path(path: Column) -> Column:
    return contains_any(path, fixed.SAFE_PROCESS_PATHS)


def is_safe_file_path(path: Column) -> Column:
    return contains_any(path, fixed.SAFE_FILE_PATHS)


def is_privileged(user: Column) -> Column:
    return F.coalesce(F.lower(user).isin(*fixed.PRIVILEGED_USERS), F.lit(False))


def is_remote(source: Column) -> Column:
    return F.coalesce(~source.isin(*fixed.LOCAL_SOURCES), F.lit(False))


def off_hours(ts: Column) -> Column:
    return (F.hour(ts) < 6) | (F.hour(ts) > 22)


def content_hash(content: Column, limit: int = 100 << 20) -> Column:
    """SHA-256 of bytes up to a size, else null."""
    return F.when(F.octet_length(content) <= limit, F.sha2(content, 256))


def client_id(host: Column, mac: Column, system: Column) -> Column:
    """First 16 hex digits of the hash of host, address and system."""
    return F.substring(F.sha2(F.concat_ws("_", host, mac, system), 256), 1, 16)


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c))


def min_max(c: Column, low: Column, high: Column, epsilon: float = 1e-9) -> Column:
    return (c - low) / (high - low + epsilon)


def norm(values: Column) -> Column:
    """Euclidean length of an array."""
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x))


def cleaned(c: Column) -> Column:
    """NaN and null to 0, +Inf to 1, -Inf to 0."""
    return F.when(c.isNull() | F.isnan(c), 0.0).when(c == float("inf"), 1.0).when(c == float("-inf"), 0.0).otherwise(c)


#: Labels of features.
LABELS = {
    "conn_count": "Connection Count", "unique_dst_count": "Unique Destinations", "bytes_sent": "Data Sent", "bytes_recv": "Data Received", "port_entropy": "Port Randomness",
    "conn_rate": "Connection Rate", "dst_churn_rate": "Destination Changes", "proc_spawn_count": "Process Creation", "avg_proc_cpu": "CPU Usage", "avg_proc_memory": "Memory Usage",
    "unique_proc_names": "Unique Processes", "file_create_count": "File Creation", "file_exec_count": "Executable Files", "file_hash_novelty": "Unique File Hashes", "ransomware_burst": "Ransomware Pattern",
}


def feature_label(name: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, name), F.initcap(F.replace(name, F.lit("_"), F.lit(" "))))


#: Substrings that put a feature in a group; the first group with a hit wins.
GROUPS = {
    "network": ("conn", "dst", "bytes", "port", "tcp", "c2"),
    "process": ("proc", "cpu", "mem", "spawn", "cred"),
    "file": ("file", "hash", "exec", "ransom"),
    "user": ("user", "login", "session"),
}


def feature_group(name: Column) -> Column:
    out = F.lit("other")
    for group, words in reversed(GROUPS.items()):
        out = F.when(contains_any(name, words), F.lit(group)).otherwise(out)
    return out


def group_risk(values: Column) -> Column:
    """Mean size of an array of numbers, at most 10; 0 for none."""
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.abs(x))
    return F.when(F.size(values) > 0, F.least(F.lit(10.0), total / F.size(values))).otherwise(0.0)


def shown_score(*candidates: Column) -> Column:
    """The first score there is, with two digits, else N/A."""
    return F.coalesce(F.format_string("%.2f", F.coalesce(*candidates)), F.lit("N/A"))


def risk_band(risk: Column, profile: str = "default") -> Column:
    """high above 7, medium above 5 (users: low above 3, else normal; alerts: critical above 8, high above 6)."""
    if profile == "alerts":
        return F.when(risk > 8, "critical").when(risk > 6, "high").otherwise("medium")
    if profile == "user":
        return F.when(risk > 7, "high").when(risk > 5, "medium").when(risk > 3, "low").otherwise("normal")
    return F.when(risk > 7, "high").when(risk > 5, "medium").otherwise("low")
