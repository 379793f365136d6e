"""Alerts from scored rows and model findings: thresholds, normalisation, texts, routing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import alert_texts as texts
from ..functions.fixed import AGENT_TTL, RANSOMWARE_EXTENSIONS, SERVER_TTL
from ..functions.scalars import feature_group
from .carry import fold
from .dedup import signature, ttl_dedup

TEXT = ("client_id", "id", "us", "severity", "alert_risk", "source_category", "title", "description")


def network_alerts(df: DataFrame, above: float = 7.0) -> DataFrame:
    rows = df.filter(F.col("risk_score") > above)
    return rows.select("client_id", "id", "us", F.lit("high").alias("severity"), F.col("risk_score").alias("alert_risk"), F.lit("network").alias("source_category"), F.lit("High risk network connection").alias("title"), F.concat(F.lit("Connection to "), "dst_ip", F.lit(":"), F.col("dst_port").cast("string")).alias("description"))


def process_alerts(df: DataFrame) -> DataFrame:
    """High-risk rows above 6: critical above 8, else high; others above 5: medium."""
    r = F.col("risk_score")
    level = F.when(r > 8, "critical").when(r > 6, "high").otherwise("medium")
    return df.filter(r > 5).select("client_id", "id", "us", level.alias("severity"), r.alias("alert_risk"), F.lit("process").alias("source_category"), F.lit("Suspicious process").alias("title"), F.concat(F.lit("Process "), "name", F.lit(" pid "), F.col("pid").cast("string")).alias("description"))


def file_alerts(df: DataFrame) -> DataFrame:
    """Above 6: critical for ransomware extensions, high above 8, else medium."""
    r = F.col("risk_score")
    level = F.when(F.lower("file_ext").isin(*RANSOMWARE_EXTENSIONS), "critical").when(r > 8, "high").otherwise("medium")
    return df.filter(r > 6).select("client_id", "id", "us", level.alias("severity"), r.alias("alert_risk"), F.lit("filesystem").alias("source_category"), F.lit("Suspicious file").alias("title"), F.concat(F.lit("File "), "file_name").alias("description"))


def threshold_alerts(network: DataFrame, process: DataFrame, filesystem: DataFrame) -> DataFrame:
    return network_alerts(network).unionByName(process_alerts(process)).unionByName(file_alerts(filesystem))


def with_last_model(events: DataFrame, findings: DataFrame, within: int = 60_000_000) -> DataFrame:
    """Adds ml: whether the client's last model finding (client_id, us), at the event's time or before, is recent enough.

    Findings and events are one sorted stream per client, through which the last finding is carried; nothing is joined.
    """
    both = events.withColumns({"_event": F.lit(1), "_order": F.col("id")}).unionByName(findings.select("client_id", "us", F.lit(0).alias("_event"), F.lit(0).cast("long").alias("_order")), allowMissingColumns=True)

    def step(last: dict, us: int, event: int) -> tuple[bool]:
        if not event:
            last["us"] = us
            return (False,)
        return ("us" in last and us - last["us"] <= within,)

    return fold(both, ["client_id"], ["us", "_event"], dict, step, {"ml": "boolean"}, ("us", "_event", "_order")).filter("_event = 1").drop("_event", "_order")


def gated_alerts(network: DataFrame, process: DataFrame, filesystem: DataFrame, ml: str = "is_anomaly") -> DataFrame:
    """By detection method: network above 7 with a model finding or above 8.5; processes and files above 7."""
    r = F.col("risk_score")
    method = F.when(F.col(ml), "ML").otherwise("RULE")
    text = F.concat(F.lit("Connection: "), "dst_ip", F.lit(":"), F.col("dst_port").cast("string"), F.lit(" ("), "protocol", F.lit(") | Detection: "), method)
    net = network.filter(((r > 7) & F.col(ml)) | (r > 8.5)).select("client_id", "id", "us", F.lit("network").alias("source_category"), F.when(r > 8, "high").otherwise("medium").alias("severity"), r.alias("alert_risk"), text.alias("description"))
    named = {"process": F.concat(F.lit("Process: "), "name", F.lit(" (PID: "), F.col("pid").cast("string"), F.lit(") | Path: "), F.coalesce("path", F.lit("unknown"))), "filesystem": F.concat(F.lit("File: "), "file_name", F.lit(" ("), "file_ext", F.lit(") | Hash: "), F.coalesce(F.substring("file_hash", 1, 16), F.lit("N/A")))}
    rest = lambda df, name: df.filter(r > 7).select("client_id", "id", "us", F.lit(name).alias("source_category"), F.when(r > 8.5, "critical").otherwise("high").alias("severity"), r.alias("alert_risk"), named[name].alias("description"))
    return net.unionByName(rest(process, "process")).unionByName(rest(filesystem, "filesystem"))


def model_alerts(findings: DataFrame) -> DataFrame:
    """Model findings (severity, iso_score, ae_score, contributing_features) above a risk of 5, or of high severity.

    The risk is 15 times the forest's score, 5 at least; without one, 100 times the autoencoder's error, 10 at most; else 5.
    """
    risk = F.coalesce(F.greatest(F.abs("iso_score") * 15, F.lit(5.0)), F.least(F.col("ae_score") * 100, F.lit(10.0)), F.lit(5.0))
    first = F.coalesce(F.try_element_at("contributing_features", F.lit(1)), F.lit("Multiple Features"))
    parts = F.concat_ws(
        " | ", "explanation", F.when(F.size("contributing_features") > 0, F.concat(F.lit("Contributing Features: "), F.array_join(F.slice("contributing_features", 1, 5), ", "))),
        F.when(F.col("iso_score").isNotNull(), F.format_string("Isolation Forest Score: %.4f", "iso_score")), F.when(F.col("ae_score").isNotNull(), F.format_string("Autoencoder Error: %.4f", "ae_score")),
    )
    out = findings.withColumns({"alert_risk": risk, "title": F.concat(F.lit("ML Anomaly: "), F.upper("severity"), F.lit(" - "), first), "description": parts})
    return out.filter((F.col("alert_risk") > 5) | (F.col("severity") == "high"))


def network_model_alerts(network: DataFrame, ml: str = "ml") -> DataFrame:
    """From the agent: connections that a model found odd, high above 8."""
    text = F.concat(F.lit("ML-detected anomalous network connection to "), "dst_ip", F.lit(":"), F.col("dst_port").cast("string"))
    return network.filter(F.col(ml) & F.col("is_anomaly")).select("client_id", "id", "us", F.lit("network").alias("source_category"), F.when(F.col("risk_score") > 8, "high").otherwise("medium").alias("severity"), F.col("risk_score").alias("alert_risk"), text.alias("description"))


def event_alerts(process: DataFrame, filesystem: DataFrame) -> DataFrame:
    """From the agent's scorers: processes above 7 (high above 8), files above 6 (critical above 8)."""
    r = F.col("risk_score")
    p = process.filter(r > 7).select("client_id", "id", "us", F.lit("process").alias("source_category"), F.when(r > 8, "high").otherwise("medium").alias("severity"), r.alias("alert_risk"))
    f = filesystem.filter(r > 6).select("client_id", "id", "us", F.lit("filesystem").alias("source_category"), F.when(r > 8, "critical").otherwise("high").alias("severity"), r.alias("alert_risk"))
    return p.unionByName(f)


def user_alerts(logins: DataFrame) -> DataFrame:
    """Brute force, escalation, travel, privileged logins off hours (5.5) and three or more sessions (5.0)."""
    from .detectors import detect_brute_force, detect_impossible_travel, detect_priv_escalation

    keep = lambda df, kind: df.select("client_id", "id", "us", F.lit(kind).alias("alert_type"), "severity", "alert_risk")
    hour = F.floor(F.col("us") / 3_600_000_000) % 24
    medium = lambda df, risk: df.withColumns({"severity": F.lit("medium"), "alert_risk": F.lit(risk)})
    out = keep(detect_brute_force(logins), "brute_force").unionByName(keep(detect_priv_escalation(logins), "privilege_escalation")).unionByName(keep(detect_impossible_travel(logins), "impossible_travel"))
    out = out.unionByName(keep(medium(logins.filter(F.col("privilege_escalation") & ((hour < 6) | (hour > 22))), 5.5), "off_hours_privileged"))
    return out.unionByName(keep(medium(logins.filter(F.col("sessions") >= 3), 5.0), "multiple_sessions"))


def normalize_ml(alerts: DataFrame, strict: bool = False) -> DataFrame:
    """Severity in lower case, unknown ones medium (strict: critical too); risk from the scores there are; type and short text."""
    known = ("high", "medium", "low") if strict else ("critical", "high", "medium", "low")
    s = F.lower("severity")
    risk = F.coalesce(F.col("ensemble_score"), F.least(F.lit(10.0), F.abs(F.col("iso_score")) * 10), F.least(F.lit(10.0), F.col("ae_score") * 100), F.lit(5.0))
    return alerts.withColumns({"severity": F.when(s.isin(*known), s).otherwise("medium"), "alert_risk": risk, "alert_type": F.concat(F.lit("ml_"), F.col("category"), F.lit("_anomaly")), "explanation": F.substring(F.coalesce("explanation", F.lit("")), 1, 500)})


def server_ml_alerts(alerts: DataFrame, above: float = 4.0) -> DataFrame:
    """Normalised model alerts outside their signature's time to live, above a risk; low ones suppress others too."""
    signed = alerts.withColumn("signature", signature(F.col("client_id"), F.col("category"), F.col("severity"), features=F.col("contributing_features")))
    return ttl_dedup(signed, ttl=SERVER_TTL).filter(F.col("kept") & (F.col("alert_risk") > above)).drop("kept")


def agent_alerts(alerts: DataFrame, strict: bool = True) -> DataFrame:
    """The agent's two caches in sequence: by features, then by severity, category and feature groups.

    strict: the first signature names every category 'system'.
    """
    category = F.lit("system") if strict else F.col("category")
    first = alerts.withColumn("signature", signature(F.col("client_id"), category, F.col("severity"), features=F.col("contributing_features")))
    once = ttl_dedup(first, ttl=AGENT_TTL).filter("kept").drop("kept", "signature")
    groups = F.array_sort(F.array_distinct(F.transform("contributing_features", feature_group)))
    second = once.withColumn("signature", signature(F.col("client_id"), F.col("severity"), F.col("category"), features=groups))
    return ttl_dedup(second, ttl=AGENT_TTL).filter("kept").drop("kept")


def _names(features: Column, *words: str) -> Column:
    """Whether a feature's name holds one of the words."""
    return F.coalesce(F.exists(features, lambda x: F.lower(x).rlike("|".join(words))), F.lit(False))


def _by_category(category: Column, choices: dict[str, Column], otherwise: Column) -> Column:
    out = otherwise
    for name, value in choices.items():
        out = F.when(category == name, value).otherwise(out)
    return out


def alert_title(category: Column, features: Column, severity: Column) -> Column:
    """By the first telling feature of the category; else the category's title with the severity."""
    level = F.upper(severity)
    choices = {}
    for name, rules in texts.TITLES.items():
        out = F.concat(F.lit(texts.PLAIN_TITLES[name] + " - "), level)
        for word, title in reversed(rules):
            out = F.when(_names(features, word), F.lit(title)).otherwise(out)
        choices[name] = out
    return _by_category(category, choices, F.concat(F.lit("ML Anomaly: "), level, F.lit(" - "), F.upper(category)))


def alert_description(category: Column, features: Column, explanation: Column, forest: Column | None = None, autoencoder: Column | None = None) -> Column:
    """Parts joined by ' | ': a sentence per telling feature and the models' scores; without any, the explanation (200 characters)."""
    words = _by_category(category, {name: F.array(*[F.when(_names(features, w), F.lit(t)) for w, t in rules]) for name, rules in texts.SENTENCES.items()}, F.array().cast("array<string>"))
    scores = [F.when(c.isNotNull(), F.format_string(f"{name}: %.1f/10", c)) for name, c in (("Anomaly Detection", forest), ("Pattern Recognition", autoencoder)) if c is not None]
    said = F.concat_ws(", ", *scores) if scores else F.lit("")
    parts = F.concat_ws(" | ", F.array_compact(words), F.when(said != "", F.concat(F.lit("AI Analysis: "), said)))
    plain = F.when(F.length(explanation) > 0, F.substring(explanation, 1, 200)).otherwise(F.lit(texts.NO_SENTENCE))
    return F.when(parts != "", parts).otherwise(plain)


def explain(category: Column, value: Callable[[str], Column], score: Column, features: Column) -> tuple[Column, Column]:
    """(explanation, evidence) as arrays, from the category's values that stand out; `value` gives a feature's value."""
    says, shows = {}, {}
    for name, rules in texts.EXPLANATIONS.items():
        found = []
        for feature, least, factor, form, evidence in rules:
            v = F.coalesce(value(feature), F.lit(0.0))
            test = v == 1.0 if least is None else v > least
            number = (v * factor).cast("int") if "%d" in form else v * factor
            found.append((F.when(test, F.format_string(form, number) if least is not None else F.lit(form)), F.when(test, F.lit(evidence))))
        says[name], shows[name] = (F.array_compact(F.array(*x)) for x in zip(*found, strict=True))
    none = F.array().cast("array<string>")
    level = F.when(score != 0, F.array(F.format_string("Threat Level: %.1f/10", score))).otherwise(none)
    said, shown = F.concat(level, _by_category(category, says, none)), _by_category(category, shows, none)
    silent = F.size(said) == 0
    top = F.concat(F.lit("Top features: "), F.array_join(F.slice(features, 1, 3), ", "))
    return F.when(silent, F.array(F.lit(texts.NO_EXPLANATION))).otherwise(said), F.when(silent, F.array(top)).otherwise(shown)


def recommended_action(severity: Column, category: Column, features: Column) -> Column:
    """By severity and category; a critical one also by the feature that names the pattern."""
    out = F.when(severity == "medium", F.concat(F.lit(texts.MEDIUM_ACTION[0]), category, F.lit(texts.MEDIUM_ACTION[1]))).otherwise(F.lit(texts.LOW_ACTION))
    for level, by_category in texts.ACTIONS.items():
        choices = {name: F.when(_names(features, *special[0]), F.lit(special[1])).otherwise(F.lit(plain)) if special else F.lit(plain) for name, (special, plain) in by_category.items()}
        other = choices.pop(None)
        out = F.when(severity == level, _by_category(category, choices, other)).otherwise(out)
    return out


def dominant_category(features: Column) -> Column:
    """The group with most features (network, process, filesystem, user; ties in that order), else system."""
    groups = F.transform(features, feature_group)
    hits = lambda g: F.size(F.filter(groups, lambda x: x == g))
    count = {name: hits(g) for name, g in (("network", "network"), ("process", "process"), ("filesystem", "file"), ("user", "user"))}
    most = F.greatest(*count.values())
    out = F.lit("system")
    for name, n in reversed(count.items()):
        out = F.when((n == most) & (most > 0), F.lit(name)).otherwise(out)
    return out


def source_category(alert_type: Column) -> Column:
    out = F.lit("system")
    for name, word in reversed((("network", "network"), ("process", "process"), ("filesystem", "file"), ("user_activity", "user"))):
        out = F.when(F.lower(alert_type).contains(word), F.lit(name)).otherwise(out)
    return out
