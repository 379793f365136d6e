"""Fixed values of the detection rules: ports, names, patterns and thresholds that results depend on."""

from __future__ import annotations

MALICIOUS_PORTS = (
    4444, 5555, 6666, 7777, 8888, 31337, 12345, 1337, 1234, 6667, 6668, 6669, 6697, 9001, 9030, 9050, 9150, 9051, 1080, 1081,
    3128, 8080, 8118, 5900, 5901, 5902, 2323, 4443, 8443, 9999, 10000, 20, 21, 23, 25, 465, 587, 110, 995, 143, 993,
    137, 138, 139, 445, 1433, 1434, 3306, 5432, 27017, 27018, 6379, 11211,
)
PORT_RANGES = ((1024, 1100), (4440, 4450), (5550, 5560), (6660, 6670), (31330, 31340))
DATABASE_PORTS = (1433, 1434, 3306, 5432, 27017, 6379, 11211)
PROXY_PORTS = (9050, 9150, 1080, 1081, 3128, 8080)
IRC_PORTS = (6667, 6668, 6669, 6697)
PROTOCOLS = {
    20: "FTP-Data", 21: "FTP", 22: "SSH", 23: "Telnet", 25: "SMTP", 53: "DNS", 67: "DHCP", 68: "DHCP", 80: "HTTP", 110: "POP3", 119: "NNTP",
    123: "NTP", 143: "IMAP", 161: "SNMP", 162: "SNMP-Trap", 389: "LDAP", 443: "HTTPS", 445: "SMB", 465: "SMTPS", 587: "SMTP-Sub", 636: "LDAPS",
    993: "IMAPS", 995: "POP3S", 1433: "MSSQL", 1434: "MSSQL-Browser", 3306: "MySQL", 3389: "RDP", 5432: "PostgreSQL", 5900: "VNC", 6379: "Redis",
    8080: "HTTP-Proxy", 8443: "HTTPS-Alt", 9050: "Tor-SOCKS", 27017: "MongoDB",
}
LOCAL_PREFIXES = ("10.", "192.168.", "172.", "127.", "169.254.")
SAFE_IP_PREFIXES = ("192.168.", "10.", "172.16.", "172.17.", "172.18.", "172.19.", "127.", "169.254.")
SAFE_DOMAINS = (
    "microsoft.com", "windows.com", "windowsupdate.com", "live.com", "azure.com", "msedge.net", "office.com", "office365.com", "msftconnecttest.com", "msftncsi.com",
    "google.com", "googleapis.com", "gstatic.com", "googlevideo.com", "youtube.com", "ytimg.com", "ggpht.com", "googleusercontent.com",
    "amazon.com", "amazonaws.com", "cloudfront.net", "awsstatic.com", "cloudflare.com", "cloudflare-dns.com", "cloudflareinsights.com",
    "apple.com", "icloud.com", "cdn-apple.com", "facebook.com", "fbcdn.net", "instagram.com", "whatsapp.com",
    "akamai.net", "akamaized.net", "akadns.net", "fastly.net", "github.com", "githubusercontent.com", "npmjs.org", "pypi.org",
    "slack.com", "zoom.us", "teams.microsoft.com", "discord.com", "stackoverflow.com", "reddit.com", "twitter.com", "linkedin.com", "medium.com", "wikipedia.org",
)
CLOUD_NAMES = ("amazonaws", "cloudfront", "azure", "googleusercontent", "cloudflare", "akamai", "fastly", "cdn", "facebook", "fbcdn")
LOCAL_SOURCES = ("local", "localhost", "127.0.0.1", "::1", "")
PRIVILEGED_USERS = ("root", "administrator", "admin", "system", "sudo")

SUSPICIOUS_PROCESSES = (
    "mimikatz", "psexec", "procdump", "netcat", "nc.exe", "pwdump", "wce.exe", "gsecdump", "fgdump", "crackmapexec",
    "metasploit", "meterpreter", "beacon", "cobalt", "empire", "lazagne", "dumpert", "nanodump", "sqlmap", "hydra",
)
CRITICAL_PROCESSES = (
    "mimikatz", "keylog", "pwdump", "gsecdump", "wce", "lazagne", "dumpert", "nanodump", "procdump",
    "metasploit", "meterpreter", "beacon", "cobalt", "empire", "crackmapexec", "psexec",
)
CRITICAL_PROCESSES_LIVE = ("mimikatz", "psexec", "procdump", "pwdump", "gsecdump")
SAFE_PROCESS_PATHS = (
    "program files", "program files (x86)", "windows\\system32", "windows\\syswow64", "google", "microsoft", "adobe", "mozilla", "apple",
    "steam", "epic games", "nvidia", "amd", "intel", "python", "node", "npm", "java", "git", "visual studio", "vscode", "pycharm", "intellij",
    "slack", "discord", "zoom", "teams", "chrome", "firefox",
)
COMMAND_PATTERNS = (
    "powershell -enc", "-encodedcommand", "-e ", "-nop", "-w hidden", "invoke-expression", "invoke-webrequest", "downloadstring", "iex",
    "bypass", "-noni", "hidden", "-windowstyle hidden", "sekurlsa", "lsadump", "sam", "credentials", "passwords",
    "psexec", "wmic process call create", "schtasks /create", "ncat", "nc.exe", "powercat", "tcp", "shell",
    "base64", "frombase64string", "gzip", "compress", "net user", "net group", "net localgroup", "nltest", "dsquery",
)
LINEAGE = (
    ("powershell.exe", "mshta.exe"), ("powershell.exe", "regsvr32.exe"), ("cmd.exe", "bitsadmin.exe"), ("cmd.exe", "certutil.exe"),
    ("winword.exe", "powershell.exe"), ("winword.exe", "cmd.exe"), ("excel.exe", "powershell.exe"), ("excel.exe", "cmd.exe"),
    ("wscript.exe", "powershell.exe"), ("cscript.exe", "cmd.exe"), ("explorer.exe", "regsvr32.exe"), ("svchost.exe", "cmd.exe"),
)
SCRIPT_HOSTS = ("powershell", "cmd.exe", "wscript.exe", "cscript.exe", "mshta.exe")
OFFICE = ("winword.exe", "excel.exe", "powerpnt.exe")
OBFUSCATION = ("-enc", "-encodedcommand", "bypass", "-w hidden", "invoke-expression", "downloadstring", "iex")

HIGH_RISK_EXTENSIONS = (
    ".exe", ".scr", ".pif", ".com", ".hta", ".vbs", ".vbe", ".ws", ".wsf", ".wsc", ".wsh", ".ps1", ".psm1", ".psd1", ".bat", ".cmd", ".msp", ".mst",
    ".dll", ".ocx", ".cpl", ".drv", ".sys", ".scf", ".inf", ".reg", ".hiv", ".docm", ".xlsm", ".pptm", ".dotm", ".jar", ".jnlp", ".appx", ".appxbundle", ".msix",
)
DOUBLE_EXTENSIONS = (
    ".pdf.exe", ".doc.exe", ".jpg.exe", ".png.exe", ".mp3.exe", ".txt.scr", ".pdf.scr", ".doc.scr", ".jpg.scr", ".pdf.js", ".doc.js", ".txt.js",
    ".pdf.vbs", ".doc.vbs", ".txt.vbs", ".doc.bat", ".pdf.bat", ".txt.bat",
)
FILE_PATTERNS = (
    "crack", "keygen", "patch", "loader", "activator", "serial", "hack", "cheat", "exploit", "payload", "inject", "dump", "mimikatz", "pwdump", "gsecdump", "wce", "lazagne",
    "shell", "backdoor", "trojan", "virus", "malware", "ransom", "cryptolocker", "wannacry", "petya", "locky", "keylog", "stealer", "rat", "botnet", "rootkit",
    "bypass", "disable", "kill_av", "killav", "stop_av",
)
CRITICAL_FILE_WORDS = (
    "mimikatz", "keylog", "ransom", "cryptolocker", "wannacry", "petya", "locky", "cerber", "trojan", "backdoor", "rootkit", "virus", "worm", "spyware", "stealer", "rat", "botnet",
)
HIGH_FILE_WORDS = ("crack", "keygen", "patch", "loader", "activator", "hack", "exploit", "payload", "inject", "dump", "pwdump", "gsecdump", "wce", "lazagne")
SAFE_FILE_PATHS = (
    "microsoft", "google", "mozilla", "adobe", "oracle", "java", "python", "nodejs", "npm", "git", "vscode", "visual studio", "intellij", "jetbrains", "slack", "discord", "zoom", "teams",
    "chrome", "firefox", "edge", "opera", "brave", "steam", "epic games", "nvidia", "amd", "intel", "windows defender", "kaspersky", "norton", "avast", "malwarebytes",
    "program files", "program files (x86)", "windows\\system32",
)
RANSOMWARE_EXTENSIONS = (
    ".encrypted", ".locked", ".crypto", ".crypt", ".enc", ".encoded", ".locky", ".cerber", ".zepto", ".odin", ".thor", ".zzzzz", ".micro", ".mp3", ".vvv", ".ccc", ".xyz", ".aaa", ".abc",
    ".exx", ".ezz", ".ecc", ".xxx", ".ttt", ".qqq", ".crinf", ".r5a", ".xrnt", ".xtbl", ".lol!", ".fun", ".gws", ".btc",
)

#: Seconds during which an alert suppresses its like.
#: Processes of low risk that aren't reported.
TRUSTED_PROCESSES = (
    "explorer.exe", "chrome.exe", "firefox.exe", "msedge.exe", "brave.exe", "opera.exe", "vivaldi.exe", "iexplore.exe",
    "code.exe", "pycharm64.exe", "notepad.exe", "notepad++.exe", "python.exe", "pythonw.exe", "node.exe", "java.exe", "javaw.exe",
    "conhost.exe", "cmd.exe", "powershell.exe", "svchost.exe", "dwm.exe", "csrss.exe", "wininit.exe", "services.exe", "taskmgr.exe", "taskhostw.exe", "sihost.exe",
    "discord.exe", "slack.exe", "teams.exe", "zoom.exe", "outlook.exe", "thunderbird.exe",
    "spotify.exe", "vlc.exe", "winamp.exe", "foobar2000.exe", "steam.exe", "epicgameslauncher.exe", "origin.exe", "dropbox.exe", "onedrive.exe", "googledrivesync.exe",
)
SERVER_TTL = {"critical": 600, "high": 300, "medium": 180, "low": 60}
AGENT_TTL = {"critical": 300, "high": 180, "medium": 120, "low": 60}
OTHER_TTL = 180

#: Names of the 24 model features (window columns without raw counters).
FEATURES = (
    "conn_count", "unique_dst_count", "bytes_sent", "bytes_recv", "port_entropy", "tcp_ratio", "udp_ratio", "conn_rate", "dst_churn_rate",
    "proc_spawn_count", "avg_proc_cpu", "avg_proc_memory", "unique_proc_names", "file_create_count", "file_exec_count", "file_hash_novelty",
    "delta_conn_count", "delta_file_create", "delta_proc_spawn", "delta_unique_hashes", "conn_acceleration", "ransomware_burst", "c2_pattern", "cred_dump_pattern",
)
WEIGHT_KEYS = ("network_threshold", "process_threshold", "file_threshold", "network_sensitivity", "process_sensitivity", "file_sensitivity")
