"""Texts of alerts by category. All strings and thresholds in this file are fixed values that results must equal."""

#: By category: feature that contributes, title; and the title without any.
TITLES = {
    "network": (("c2_pattern", "⚠️ Possible C2 Communication Detected"), ("port_entropy", "⚠️ Port Scanning Activity Detected")),
    "process": (("cred_dump_pattern", "⚠️ CRITICAL: Credential Theft Attempt"), ("proc_spawn", "⚠️ Unusual Process Spawning Detected")),
    "filesystem": (("ransomware_burst", "⚠️ RANSOMWARE ACTIVITY DETECTED"), ("file_create_count", "⚠️ Mass File Modification Detected")),
}
PLAIN_TITLES = {"network": "Suspicious Network Activity", "process": "Suspicious Process Behavior", "filesystem": "Suspicious File Activity"}

#: By category: feature that contributes, sentence of the description.
SENTENCES = {
    "network": (
        ("c2_pattern", "Repeated connections to same destination suggest Command & Control (C2) communication"),
        ("port_entropy", "Multiple different ports accessed in short time indicates port scanning"),
        ("conn_count", "Unusually high number of network connections detected"),
    ),
    "process": (
        ("cred_dump_pattern", "Process attempting to access sensitive credential stores (lsass.exe or SAM database)"),
        ("proc_spawn", "Rapid creation of multiple processes detected"),
    ),
    "filesystem": (
        ("ransomware_burst", "Mass file encryption detected - characteristic of ransomware attack"),
        ("file_create_count", "Unusually large number of files created/modified in short time"),
    ),
}
NO_SENTENCE = "Multiple anomalous behaviors detected"

#: By category: feature, least value (flags: equal to 1), factor, format of the explanation, evidence.
EXPLANATIONS = {
    "network": (
        ("c2_pattern", None, 1, "⚠️ Possible Command & Control (C2) communication detected", "Repeated connections to same destination with regular timing"),
        ("conn_count", 5, 100, "High network activity: %d connections", None),
        ("unique_dst_count", 3, 1, "Multiple destinations accessed: %d unique IPs", None),
        ("port_entropy", 4, 1, "Port scanning behavior detected (entropy: %.1f)", "Many different ports accessed in short time"),
    ),
    "process": (
        ("cred_dump_pattern", None, 1, "🚨 CRITICAL: Credential dumping activity detected", "Process accessing sensitive credential stores (lsass/SAM)"),
        ("proc_spawn_count", 3, 10, "Rapid process creation: %d processes spawned", "Unusual process spawning pattern detected"),
        ("avg_proc_cpu", 0.7, 100, "High CPU usage: %.1f%%", None),
        ("avg_proc_memory", 0.5, 5000, "High memory consumption: %.0f MB", None),
    ),
    "filesystem": (
        ("ransomware_burst", None, 1, "🚨 CRITICAL: RANSOMWARE PATTERN DETECTED", "Rapid mass file creation with encryption indicators"),
        ("file_create_count", 50, 1, "Mass file activity: %d files created/modified", "File creation rate exceeds normal baseline"),
        ("file_exec_count", 5, 1, "Executable file activity: %d .exe/.dll files", "New executable files detected"),
    ),
}
NO_EXPLANATION = "Multiple statistical anomalies detected"

#: By severity and category: words in a contributing feature with their action, and the action otherwise.
ACTIONS = {
    "critical": {
        "filesystem": ((("ransomware",), "🚨 IMMEDIATE: RANSOMWARE SUSPECTED - Isolate host, kill processes, restore from backup"), "IMMEDIATE: Quarantine affected files, analyze hashes, block execution"),
        "network": ((("c2",), "🚨 IMMEDIATE: C2 COMMUNICATION SUSPECTED - Block IPs, isolate host, capture traffic"), "IMMEDIATE: Isolate host from network, block suspicious IPs, analyze traffic"),
        "process": ((("cred", "dump"), "🚨 IMMEDIATE: CREDENTIAL THEFT SUSPECTED - Terminate processes, force password reset"), "IMMEDIATE: Quarantine process, collect memory dump, analyze parent chain"),
        None: (None, "IMMEDIATE: Isolate system and investigate"),
    },
    "high": {
        "network": (None, "URGENT: Review firewall logs, block suspicious destinations, monitor for persistence"),
        "process": (None, "URGENT: Investigate parent processes, check for persistence mechanisms, analyze binary"),
        "filesystem": (None, "URGENT: Stop file operations, review recent changes, check for data exfiltration"),
        None: (None, "URGENT: Investigate immediately, track behavior, prepare for escalation"),
    },
}
MEDIUM_ACTION = ("MONITOR: Track ", " activity, correlate with other events, set alerts for escalation")
LOW_ACTION = "LOG: Record for pattern analysis and baseline adjustment"
