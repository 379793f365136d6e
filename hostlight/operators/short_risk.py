"""The short scorers: one sum of a few rules per category, capped at 10."""

from __future__ import annotations

from .risk import _CMD, _EXT, _FILE, _FP, _NAME, _P
from .rules import Scorer, first_word, holds_any, quoted, rule

#: Fixed values of the short rules.
BAD_PORTS = (4444, 5555, 6666, 31337, 12345, 1337)
ALTERNATIVE_PORTS = (8080, 8443, 9050, 9150)
BAD_NAMES = ("mimikatz", "psexec", "procdump", "netcat", "nc.exe", "pwdump", "wce.exe", "gsecdump", "fgdump", "crackmapexec", "metasploit", "meterpreter", "beacon", "cobalt")
BAD_EXTENSIONS = (".exe", ".dll", ".scr", ".bat", ".cmd", ".ps1", ".vbs", ".js", ".jar", ".hta", ".msi", ".reg", ".lnk", ".com", ".pif")
FILE_WORDS = ("crack", "keygen", "patch", "loader", "inject", "dump", "bypass", "exploit", "payload", "shell")
INSTALLERS = ("setup", "install", "update", "virtualbox", "proton", "seb")
COMMANDS = ("powershell -enc", "invoke-", "downloadstring", "iex", "bypass", "-nop", "-w hidden")

_MANY_DOTS = f"length({_FILE}) - length(replace({_FILE}, '.', '')) > 1"
SUSPICIOUS_FILE = (
    f"(({_EXT} IN ({quoted(BAD_EXTENSIONS)}) AND {holds_any(_FILE, FILE_WORDS)})"
    f" OR ({_MANY_DOTS} AND {_EXT} IN ('.exe', '.scr', '.com', '.bat') AND NOT {holds_any(_FILE, INSTALLERS)}))"
)
_APPDATA = f"contains({_FP}, 'appdata')"

NETWORK = Scorer(
    [],
    [
        [rule("NOT local", 1.0, "external")],
        [rule(f"dst_port IN ({quoted(BAD_PORTS)})", 6.0, "suspicious_port"), rule(f"dst_port IN ({quoted(ALTERNATIVE_PORTS)})", 3.0, "common_malware_port")],
        [rule("dst_port > 49152", 1.5, "high_port")],
        [rule("contains(protocol, 'Unknown') AND NOT local", 2.0, "unknown_protocol")],
        [rule("conn_n > 100", 2.0, "very_frequent"), rule("conn_n > 50", 1.0, "frequent")],
        [rule("contains(protocol, 'Telnet') OR contains(protocol, 'FTP')", 2.0, "weak_protocol")],
    ],
)
PROCESS = Scorer(
    [],
    [
        [rule(holds_any(_NAME, BAD_NAMES), 7.0, "suspicious_name", first_word(_NAME, BAD_NAMES))],
        [rule(holds_any(_P, ("temp", "tmp")), 3.0, "temp_location"), rule(holds_any(_P, ("appdata", "programdata")), 2.0, "data_location")],
        [rule("memory_mb > 2000", 2.0, "very_high_memory"), rule("memory_mb > 1000", 1.0, "high_memory")],
        [rule("cpu_percent > 80", 2.0, "very_high_cpu"), rule("cpu_percent > 50", 1.0, "high_cpu")],
        [rule(holds_any(_CMD, COMMANDS), 0.0, "suspicious_cmdline", first_word(_CMD, COMMANDS))],
    ],
)
FILE = Scorer(
    # scripts of applications in their data folder: only a tiny executable could add to 0, and they are none
    [rule(f"{_EXT} IN ('.js', '.json') AND {_APPDATA}", 0.0, "application_script")],
    [
        [rule(SUSPICIOUS_FILE, 5.0, "suspicious_name_or_extension"), rule(f"{_EXT} IN ('.exe', '.dll', '.msi')", 1.0, "executable")],
        [
            rule(holds_any(_FP, ("temp", "tmp")), 2.0, "temp_directory"),
            rule(f"contains({_FP}, 'download')", 0.5, "downloads_directory"),
            rule(f"{_APPDATA} AND {_EXT} IN ('.exe', '.dll') AND NOT {holds_any(_FP, ('microsoft', 'google', 'npm', 'node'))}", 1.5, "appdata_directory"),
        ],
        [rule(f"file_size < 1024 AND {_EXT} IN ('.exe', '.dll')", 1.5, "tiny_executable")],
    ],
)
USER = Scorer(
    [],
    [
        [rule("lower(username) IN ('root', 'administrator', 'admin')", 2.0, "privileged_account")],
        [rule("source_ip <> 'local' AND source_ip <> ''", 1.0, "remote_login")],
        [rule("failed_logins > 3", 5.0, "failed_logins", "failed_logins")],
    ],
)
SCORERS = {"network": NETWORK, "process": PROCESS, "file": FILE, "user": USER}
