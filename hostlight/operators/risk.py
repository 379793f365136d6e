"""Rule-based risk of network, process, file and user rows: the full scorers and the live ones.

Inputs are rows with the columns named in each function; each adds `risk` (double) and `indicators` (array of
string). Columns that come from other operators: `conn_n` and `ports_n` (running history), `parent_name` and
`lineage` (process lineage), `is_new`, `age_s` (file changes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.scalars import is_local_ip, is_privileged, is_remote, is_safe_domain
from .rules import Rule, Scorer, common, first_word, holds_any, how_many, quoted, rule

_BAD_PORT = f"dst_port IN ({quoted(fixed.MALICIOUS_PORTS)})"
_RANGE = "(" + " OR ".join(f"dst_port BETWEEN {a} AND {b}" for a, b in fixed.PORT_RANGES) + ")"
_SAFE_IP = "(" + " OR ".join(f"dst_ip LIKE '{p}%'" for p in fixed.SAFE_IP_PREFIXES) + ")"
_NO_DNS = "(dns IS NULL OR dns = '')"


def network_scorer(profile: str = "v1", own_server: tuple[str, int] = ("127.0.0.1", 9999)) -> Scorer:
    """profile 'v2': the same structure with stricter weights and without the soft early outs."""
    v2 = profile == "v2"
    early = [
        rule(f"dst_ip = '{own_server[0]}' AND dst_port = {own_server[1]}", 0.0, "own_server_connection"),
        rule("dst_ip IN ('127.0.0.1', '::1', 'localhost')", 0.0, "localhost_connection"),
        rule(_SAFE_IP, 1.0 if v2 else 0.5, "local_network_connection"),
        rule(f"NOT {_NO_DNS} AND safe_domain", 0.5, "known_safe_domain"),
    ]
    if not v2:
        early.append(rule(f"dst_port = 443 AND NOT {_NO_DNS} AND {holds_any('lower(dns)', fixed.CLOUD_NAMES)}", 1.0, "https_cloud_service"))
    pick = lambda first, second: second if v2 else first
    groups = [
        [rule(_BAD_PORT, pick(7.0, 8.0), "known_malicious_port", "dst_port")],
        [rule(_RANGE, pick(4.0, 5.0), "suspicious_port_range", "dst_port")],
        [rule("(contains(protocol, 'FTP') OR contains(protocol, 'Telnet') OR contains(protocol, 'HTTP:')) AND NOT local", pick(2.5, 3.0), "unencrypted_protocol_external")],
        [rule(f"contains(protocol, 'Unknown') AND (dst_port < 1024 OR {_BAD_PORT})", pick(1.5, 2.0), "unknown_protocol_suspicious_port")],
        [Rule("NOT local", pick(0.5, 1.5), "CAST(NULL AS STRING)")],
        [rule(f"NOT local AND {_NO_DNS}", pick(1.5, 2.0), "no_reverse_dns_external"), rule("NOT local AND NOT safe_domain", pick(0.5, 1.0), "unknown_external_domain")],
        [rule("conn_n > 500", pick(2.0, 3.0), "very_high_frequency", "conn_n"), rule("conn_n > 200", pick(1.0, 2.0), "high_frequency_connection", "conn_n")],
        [rule("ports_n > 30", pick(3.0, 4.0), "port_scanning", "ports_n"), rule("ports_n > 15", pick(1.5, 4.0), "multiple_ports_probing", "ports_n")],
        [rule(f"conn_n = 1 AND {_BAD_PORT}", pick(2.0, 3.0), "first_connection_malicious_port"), rule(f"conn_n = 1 AND NOT local AND {_NO_DNS}", pick(1.0, 1.5), "new_external_no_dns")],
        [rule(f"dst_port IN ({quoted(fixed.DATABASE_PORTS)}) AND NOT local", pick(5.0, 6.0), "database_port_external", "dst_port"), rule(f"dst_port IN ({quoted(fixed.DATABASE_PORTS)}) AND conn_n > 50", pick(1.5, 2.0), "high_frequency_database_access", "dst_port")],
        [rule(f"dst_port IN ({quoted(fixed.PROXY_PORTS)})", pick(3.0, 4.0), "anonymization_detected")],
        [rule("dst_port = 3389 AND NOT local", pick(4.0, 5.0), "external_rdp_connection")],
        [rule(f"dst_port IN ({quoted(fixed.IRC_PORTS)})", pick(4.0, 5.0), "irc_potential_botnet")],
    ]
    return Scorer(early, groups)


def _network_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({"local": is_local_ip(F.col("dst_ip")), "safe_domain": is_safe_domain(F.col("dns"))})


def network_risk_full(df: DataFrame, profile: str = "v1") -> DataFrame:
    """Needs dst_ip, dst_port, protocol, dns, conn_n, ports_n."""
    return network_scorer(profile).apply(_network_columns(df)).drop("local", "safe_domain")


NETWORK_LIVE = Scorer(
    [],
    [
        [rule(f"{_BAD_PORT} AND NOT local", 7.0, "malicious_port", "dst_port")],
        [rule(f"{_NO_DNS} AND NOT local AND dst_port < 1024", 4.0, "suspicious_no_dns_privileged_port")],
        [rule("conn_n > 1000", 3.0, "extreme_frequency", "conn_n")],
        [rule("ports_n > 50", 5.0, "port_scanning", "ports_n")],
    ],
    None,
)


def network_risk_live(df: DataFrame, ml: str | None = None) -> DataFrame:
    """Adds risk, indicators and method: ml (a column with the model's score, null if it found nothing), else rules above
    6, else a first external contact (2) or an internal bad port (3); risk is null where nothing is reported."""
    scored = NETWORK_LIVE.apply(_network_columns(df), "rule_risk", "rule_indicators")
    model = F.col(ml) if ml else F.lit(None).cast("double")
    first, inside = (F.col("conn_n") == 1) & ~F.col("local"), F.expr(_BAD_PORT) & F.col("local")
    by_rule = F.col("rule_risk") > 6
    risk = F.coalesce(model, F.when(by_rule, F.col("rule_risk")).when(first, 2.0).when(inside, 3.0))
    says = F.when(model.isNotNull(), F.array(F.lit("ml_anomaly"))).when(by_rule, F.col("rule_indicators"))
    says = says.when(first, F.array(F.lit("new_external_connection"))).when(inside, F.array(F.lit("internal_suspicious_port")))
    method = F.when(model.isNotNull(), "ml").when(by_rule, "rule").when(first | inside, "baseline")
    return scored.withColumns({"risk": risk, "indicators": says, "method": method}).drop("local", "safe_domain", "rule_risk", "rule_indicators")


_NAME, _PATH, _CMD, _PARENT = (common(f"coalesce(lower({c}), '')") for c in ("name", "path", "cmdline", "parent_name"))
_ENCODED = ("bypass", "-enc", "invoke-expression", "downloadstring")
_COMMANDS = common(how_many(_CMD, fixed.COMMAND_PATTERNS), 1)
_FIRST_COMMAND = common(first_word(_CMD, fixed.COMMAND_PATTERNS), 1)
_DOWNLOADS = "contains({0}, '{1}downloads{1}')"


def _slash(column: str, *names: str) -> str:
    return "(" + " OR ".join(f"contains({column}, '/{n}/')" for n in names) + ")"


_P = common(f"replace({_PATH}, '\\\\', '/')")  # paths with one kind of separator
_SAFE_PROCESS = common(holds_any(_P, [w.replace("\\", "/") for w in fixed.SAFE_PROCESS_PATHS]), 1)

PROCESS_FULL = Scorer(
    [
        rule(f"{_SAFE_PROCESS} AND {holds_any(_CMD, _ENCODED)}", 6.0, "suspicious_cmdline_safe_path"),
        rule(_SAFE_PROCESS, 0.5, "safe_location"),
        rule(holds_any(_NAME, fixed.CRITICAL_PROCESSES), 9.0, "critical_malware", first_word(_NAME, fixed.CRITICAL_PROCESSES)),
    ],
    [
        [rule(holds_any(_NAME, fixed.SUSPICIOUS_PROCESSES), 8.0, "known_suspicious_process", first_word(_NAME, fixed.SUSPICIOUS_PROCESSES))],
        [
            rule(_slash(_P, "downloads", "desktop", "public"), 4.0, "user_directory_execution"),
            rule(f"{holds_any(_P, ('temp', 'tmp'))} AND NOT {holds_any(_P, ('microsoft', 'google', 'windows'))}", 3.0, "temp_execution"),
            Rule(holds_any(_P, ("temp", "tmp")), 0.0, "CAST(NULL AS STRING)"),
            rule(f"contains({_P}, 'appdata/roaming') AND {holds_any(_NAME, fixed.SUSPICIOUS_PROCESSES[:5])}", 3.0, "appdata_roaming_suspicious"),
            Rule(f"contains({_P}, 'appdata/roaming')", 0.0, "CAST(NULL AS STRING)"),
            rule(f"contains({_P}, 'programdata')", 2.0, "programdata_execution"),
        ],
        [
            rule(f"{_COMMANDS} >= 3", 8.0, "highly_suspicious_cmdline", _FIRST_COMMAND),
            rule(f"{_COMMANDS} = 2", 6.0, "suspicious_cmdline", _FIRST_COMMAND),
            rule(f"{_COMMANDS} = 1", 3.0, "suspicious_cmdline_pattern", _FIRST_COMMAND),
        ],
        [
            rule(f"contains({_NAME}, 'powershell') AND {holds_any(_CMD, ('-enc', '-encodedcommand', 'frombase64string'))}", 7.0, "powershell_encoded_command"),
            rule(f"contains({_NAME}, 'powershell') AND contains({_CMD}, 'bypass')", 6.0, "powershell_execution_policy_bypass"),
            rule(f"contains({_NAME}, 'powershell') AND {holds_any(_CMD, ('-w hidden', 'windowstyle hidden'))}", 5.0, "powershell_hidden_window"),
        ],
        [rule("memory_mb > 5000", 2.5, "very_high_memory"), rule("memory_mb > 3000", 1.5, "high_memory")],
        [rule("cpu_percent > 95", 2.0, "very_high_cpu"), rule("cpu_percent > 85", 1.0, "high_cpu")],
        [rule(holds_any(_PARENT, fixed.SCRIPT_HOSTS), 4.0, "script_spawned_process", _PARENT)],
        [rule(f"{_slash(_P, 'downloads')} AND {holds_any(_PARENT, fixed.SCRIPT_HOSTS)}", 5.0, "download_script_execution")],
        [rule(f"{_PARENT} IN ({quoted(fixed.OFFICE)})", 6.0, "office_macro_spawned_process")],
    ],
)


def process_risk_full(df: DataFrame) -> DataFrame:
    """Needs name, path, cmdline, memory_mb, cpu_percent, parent_name."""
    return PROCESS_FULL.apply(df)


PROCESS_LIVE = Scorer(
    [],
    [
        [rule(holds_any(_NAME, fixed.CRITICAL_PROCESSES_LIVE), 9.5, "critical_malware_process"), rule(holds_any(_NAME, fixed.SUSPICIOUS_PROCESSES), 8.0, "suspicious_process")],
        [rule("lineage IS NOT NULL", 7.5, "malicious_lineage", "lineage")],
        [rule(f"contains({_P}, 'temp') AND NOT trusted AND {holds_any(_NAME, ('crack', 'keygen', 'hack', 'exploit', 'payload'))}", 7.0, "temp_execution_suspicious_name")],
        [rule(f"contains({_NAME}, 'powershell') AND {holds_any(_CMD, fixed.OBFUSCATION)}", 8.0, "powershell_obfuscation")],
        [rule(f"{holds_any(_PARENT, ('winword', 'excel', 'powerpnt'))} AND {_PATH} <> '' AND NOT {_SAFE_PROCESS}", 7.0, "office_macro_execution")],
        [rule(f"(contains({_P}, 'downloads/') OR contains({_P}, 'desktop/')) AND NOT trusted", 3.0, "user_directory_execution")],
    ],
    None,
)


def process_risk_live(df: DataFrame, ml: str | None = None) -> DataFrame:
    """Needs name, path, cmdline, parent_name, lineage, trusted, cpu_percent, memory_mb, and sampled or pid. Adds risk, indicators,
    method; sampled processes (by default every 30th pid) count 1.0; trusted rows below 5 and unreported rows have a null risk."""
    scored = PROCESS_LIVE.apply(df, "rule_risk", "rule_indicators")
    model = F.col(ml) if ml else F.lit(None).cast("double")
    by_rule, busy, sampled = F.col("rule_risk") > 6, (F.col("cpu_percent") > 80) | (F.col("memory_mb") > 2000), F.col("sampled") if "sampled" in df.columns else F.col("pid") % 30 == 0
    risk = F.coalesce(model, F.when(by_rule, F.col("rule_risk")).when(busy, 3.0).when(sampled, 1.0))
    says = F.when(model.isNotNull(), F.array(F.lit("ml_anomaly"))).when(by_rule, F.col("rule_indicators")).when(busy, F.array(F.lit("high_resource_usage"))).when(sampled, F.array(F.lit("sampled_process")))
    method = F.when(model.isNotNull(), "ml").when(by_rule, "rule").when(busy, "resource").when(sampled, "baseline")
    gone = F.col("trusted") & (F.coalesce(risk, F.lit(0.0)) < 5)
    return scored.withColumns({"risk": F.when(~gone, risk), "indicators": F.when(~gone, says), "method": F.when(~gone, method)}).drop("rule_risk", "rule_indicators")


_FILE, _FP, _EXT = (common(x) for x in ("coalesce(lower(file_name), '')", "replace(coalesce(lower(file_path), ''), '\\\\', '/')", "coalesce(lower(file_ext), '')"))
_SAFE_FILE = common(holds_any(_FP, [w.replace("\\", "/") for w in fixed.SAFE_FILE_PATHS]), 1)
_RANSOM = f"{_EXT} IN ({quoted(fixed.RANSOMWARE_EXTENSIONS)})"
_RISKY = f"{_EXT} IN ({quoted(fixed.HIGH_RISK_EXTENSIONS)})"
_DOUBLE = "(" + " OR ".join(f"{_FILE} LIKE '%{x}'" for x in fixed.DOUBLE_EXTENSIONS) + ")"
_HIDDEN = "(" + " OR ".join(f"{_FILE} LIKE '%_.{a}.{b}'" for a in ("pdf", "doc", "docx", "xls", "xlsx", "jpg", "png", "txt") for b in ("exe", "scr", "bat", "cmd", "vbs", "js")) + ")"
_PATTERNS = common(how_many(_FILE, fixed.FILE_PATTERNS), 1)


def file_scorer(profile: str = "v1") -> Scorer:
    """profile 'v2': stricter weights; critical words add up instead of ending the score."""
    v2 = profile == "v2"
    pick = lambda first, second: second if v2 else first
    user_dirs, temp = holds_any(_FP, ("downloads", "desktop", "documents")), holds_any(_FP, ("temp", "tmp"))
    first_critical, first_high, first_pattern = (first_word(_FILE, w) for w in (fixed.CRITICAL_FILE_WORDS, fixed.HIGH_FILE_WORDS, fixed.FILE_PATTERNS))
    critical = rule(holds_any(_FILE, fixed.CRITICAL_FILE_WORDS), pick(9.5, 9.0), "critical_malware_keyword", first_critical)
    early = [
        rule(f"{_SAFE_FILE} AND {_RANSOM} AND {_EXT} <> '.enc'", pick(9.0, 8.0), "ransomware_extension_safe_location", _EXT),
        rule(f"{_SAFE_FILE} AND {_EXT} = '.enc'", 0.5, "encrypted_file_safe_location"),
        rule(_SAFE_FILE, 0.0, "safe_location"),
    ]
    groups = [
        [rule(holds_any(_FILE, fixed.HIGH_FILE_WORDS), pick(6.0, 7.0), "high_risk_keyword", first_high)],
        [rule(_RISKY, pick(2.0, 4.0), "high_risk_extension", _EXT)],
        [
            rule(f"{_EXT} = '.enc' AND {user_dirs}", pick(8.5, 7.0), "enc_file_user_directory", _EXT),
            rule(f"{_EXT} = '.enc' AND is_new AND age_s < 60", pick(7.0, 5.0), "recent_enc_file", _EXT),
            rule(f"{_RANSOM} AND {_EXT} <> '.enc'", pick(9.5, 9.0), "ransomware_extension", _EXT),
        ],
        [rule(_DOUBLE, 8.0, "double_extension_trick")],
        [rule(_HIDDEN, 7.0, "hidden_executable_extension")],
        [rule(f"{_PATTERNS} >= 2", pick(7.0, 8.0), "multiple_suspicious_keywords", first_pattern), rule(f"{_PATTERNS} = 1", pick(4.0, 5.0), "suspicious_keyword", first_pattern)],
        [rule(f"{temp} AND {_RISKY}", pick(2.0, 4.0), "executable_in_temp"), rule(f"{temp} AND {_EXT} IN ('.ps1', '.bat', '.cmd', '.vbs')", pick(3.0, 5.0), "script_in_temp")],
        [rule(f"contains({_FP}, 'download') AND {_RISKY} AND is_new", pick(2.0, 3.0), "new_executable_in_downloads")],
        [rule(holds_any(_FP, ("startup", "autostart")), pick(5.0, 6.0), "persistence:startup_folder")],
        [rule(f"contains({_FP}, '$recycle.bin') AND {_RISKY}", pick(6.0, 7.0), "executable_in_recycle_bin")],
        [rule(f"{holds_any(_FP, ('windows/system32', 'windows/syswow64'))} AND {_EXT} IN ('.exe', '.dll') AND is_new", pick(4.0, 5.0), "new_file_in_system32")],
        [rule(f"{_EXT} IN ('.exe', '.dll') AND file_size < 10240", pick(2.0, 3.0), "tiny_executable"), rule(f"{_EXT} IN ('.exe', '.dll') AND file_size > 524288000", pick(1.5, 2.0), "unusually_large_executable")],
        [rule(f"is_new AND age_s < 10 AND {_RISKY}", pick(1.5, 2.0), "very_recent_executable")],
        [rule(f"{_FILE} LIKE '.%' AND {_RISKY} AND NOT windows", pick(2.0, 3.0), "hidden_executable")],
    ]
    return Scorer(early, [[critical], *groups]) if v2 else Scorer([*early, critical], groups)


def file_risk_full(df: DataFrame, profile: str = "v1") -> DataFrame:
    """Needs file_name, file_path, file_ext, file_size, is_new, age_s, windows."""
    return file_scorer(profile).apply(df)


FILE_LIVE = Scorer([], [[rule(f"{_RANSOM} AND {_EXT} <> '.enc'", 8.0, "ransomware_ext", _EXT)], [rule(_DOUBLE, 8.0, "double_ext")], [rule(holds_any(_FILE, ("mimikatz", "keylog", "ransom", "cryptolocker")), 8.0, "malware_keyword")]], None)


def file_risk_live(df: DataFrame, ml: str | None = None) -> DataFrame:
    """Needs file_name, file_path, file_ext, is_new, age_s, sampled (one of the first 20 of a cycle). Adds risk, indicators, method."""
    scored = FILE_LIVE.apply(df, "rule_risk", "rule_indicators")
    model = F.col(ml) if ml else F.lit(None).cast("double")
    by_rule, recent = F.col("rule_risk") > 7, F.col("is_new") | (F.col("age_s") < 600)
    risk = F.when(model.isNotNull(), F.greatest(model, F.col("rule_risk"))).when(by_rule, F.col("rule_risk")).when(recent, 2.0).when(F.col("sampled"), 1.0)
    says = F.when(model.isNotNull(), F.concat(F.array(F.lit("ml_anomaly")), F.slice("rule_indicators", 1, 1))).when(by_rule, F.col("rule_indicators"))
    says = says.when(recent, F.array(F.lit("recent_file_activity"))).when(F.col("sampled"), F.array(F.lit("sampled_file")))
    method = F.when(model.isNotNull(), "ml").when(by_rule, "rule").when(recent | F.col("sampled"), "baseline")
    gone = F.expr(_SAFE_FILE) & model.isNull() & (F.col("rule_risk") < 6)
    return scored.withColumns({"risk": F.when(~gone, risk), "indicators": F.when(~gone, says), "method": F.when(~gone, method)}).drop("rule_risk", "rule_indicators")


POTENTIALLY_SUSPICIOUS = f"{_RISKY} OR {_RANSOM} OR {holds_any(_FILE, fixed.FILE_PATTERNS[:10])} OR ({_FILE} LIKE '.%' AND NOT contains({_FP}, 'appdata'))"


def potentially_suspicious(df: DataFrame) -> DataFrame:
    """Files that deserve the full scorer."""
    return df.filter(F.expr(POTENTIALLY_SUSPICIOUS))


USER_FULL = Scorer(
    [],
    [
        [rule("privileged", 2.0, "privileged_account")],
        [rule("remote", 2.0, "remote_login")],
        [rule("remote AND new_ip", 2.0, "new_source_ip")],
        [rule("sessions >= 3", 3.0, "multiple_sessions", "sessions")],
        [rule("login_hour < 6 OR login_hour > 22", 1.5, "off_hours_login", "login_hour")],
    ],
)


def user_risk_full(df: DataFrame) -> DataFrame:
    """Needs username, source_ip, sessions, login_hour, new_ip."""
    return USER_FULL.apply(df.withColumns({"privileged": is_privileged(F.col("username")), "remote": is_remote(F.col("source_ip"))}))


USER_LIVE = Scorer(
    [],
    [
        [rule("remote AND new_ip AND recent_login", 7.0, "impossible_travel")],
        [rule("privileged AND remote AND (login_hour < 6 OR login_hour > 22)", 6.0, "privileged_remote_offhours")],
        [rule("sessions >= 5", 5.0, "excessive_concurrent_sessions", "sessions")],
        [rule("failed_logins >= 5", 7.0, "brute_force_detected", "failed_logins")],
    ],
    None,
)


def user_risk_live(df: DataFrame, ml: str | None = None) -> DataFrame:
    """Needs username, source_ip, sessions, login_hour, new_ip, recent_login, failed_logins. Adds risk, indicators, method."""
    scored = USER_LIVE.apply(df.withColumns({"privileged": is_privileged(F.col("username")), "remote": is_remote(F.col("source_ip"))}), "rule_risk", "rule_indicators")
    model = F.col(ml) if ml else F.lit(None).cast("double")
    by_rule, watched = F.col("rule_risk") > 5, F.col("privileged") | F.col("remote")
    risk = F.coalesce(model, F.when(by_rule, F.col("rule_risk")).when(watched, 2.0).otherwise(1.0))
    says = F.when(model.isNotNull(), F.array(F.lit("ml_anomaly"))).when(by_rule, F.col("rule_indicators")).when(watched, F.array(F.lit("monitored_session"))).otherwise(F.array().cast("array<string>"))
    method = F.when(model.isNotNull(), "ml").when(by_rule, "rule").otherwise("baseline")
    return scored.withColumns({"risk": risk, "indicators": says, "method": method}).drop("rule_risk", "rule_indicators")


#: Risk of a model finding by category and severity (else the last).
ML_RISK = {
    "network": {"high": 9.0, "medium": 6.5, "low": 4.5, "other": 5.0}, "user": {"high": 9.0, "medium": 6.5, "low": 4.5, "other": 5.0},
    "process": {"critical": 9.5, "high": 9.0, "medium": 6.5, "low": 4.5, "other": 5.0}, "file": {"critical": 9.5, "high": 8.0, "medium": 6.5, "low": 5.0, "other": 5.0},
}


def ml_risk(severity: str, category: str):
    """Column: the risk of a model finding."""
    out = F.lit(ML_RISK[category]["other"])
    for name, score in ML_RISK[category].items():
        if name != "other":
            out = F.when(F.col(severity) == name, score).otherwise(out)
    return out
