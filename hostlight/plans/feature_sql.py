"""SQL of the windowed features, written by hand from the rules, for comparison with the Spark plans."""

from __future__ import annotations

from ..functions.fixed import FEATURES

TABLES = ("network_data", "process_data", "filesystem_data")


def features(span: int) -> str:
    """CTEs that end in `ft`: client_id, window_us, the 24 features and the 4 raw counts."""
    w = f"CAST(floor(us / {span}) * {span} AS BIGINT)"
    seconds = span / 1e6
    clip = lambda c, low, high: f"greatest({low}::DOUBLE, least({high}::DOUBLE, {c}))"
    log = lambda c, high: f"least(ln(1 + {c}), {high}::DOUBLE)"
    delta = lambda c, low, high: clip(f"coalesce(CAST({c} - lag({c}) OVER o AS DOUBLE), 0.0)", low, high)
    return f"""
    n AS (SELECT client_id, {w} AS w, count(*) AS conns, count(DISTINCT dst_ip) AS dsts, sum(bytes_sent) AS sent, sum(bytes_recv) AS received, count(*) FILTER (WHERE contains(protocol, 'TCP')) AS tcp, count(*) FILTER (WHERE contains(protocol, 'UDP')) AS udp FROM network_data GROUP BY 1, 2),
    b AS (SELECT client_id, w, max(k) AS busiest FROM (SELECT client_id, {w} AS w, dst_ip, count(*) AS k FROM network_data GROUP BY 1, 2, 3) y GROUP BY 1, 2),
    h AS (SELECT client_id, w, greatest(0.0, -sum(k * 1.0 / t * log2(k * 1.0 / t))) AS entropy FROM (SELECT client_id, {w} AS w, dst_port, count(*) AS k, sum(count(*)) OVER (PARTITION BY client_id, {w}) AS t FROM network_data GROUP BY 1, 2, 3) z GROUP BY 1, 2),
    p AS (SELECT client_id, {w} AS w, count(*) AS spawns, sum(cpu_percent) AS cpu, sum(memory_mb) AS memory, count(DISTINCT name) AS procs, bool_or(contains(lower(name), 'lsass') OR contains(lower(name), 'sam')) AS credential FROM process_data GROUP BY 1, 2),
    f AS (SELECT client_id, {w} AS w, count(*) FILTER (WHERE event_type = 'created') AS creates, count(*) FILTER (WHERE lower(file_ext) IN ('.exe', '.dll', '.so')) AS execs, count(DISTINCT file_hash) AS hashes, min(us) FILTER (WHERE event_type = 'created') AS f0, max(us) FILTER (WHERE event_type = 'created') AS f1 FROM filesystem_data GROUP BY 1, 2),
    a AS (SELECT client_id, w FROM n UNION SELECT client_id, w FROM p UNION SELECT client_id, w FROM f),
    raw AS (SELECT a.client_id, a.w AS window_us, coalesce(conns, 0) AS conns, coalesce(dsts, 0) AS dsts, coalesce(sent, 0.0) AS sent, coalesce(received, 0.0) AS received, coalesce(tcp, 0) AS tcp, coalesce(udp, 0) AS udp, coalesce(busiest, 0) AS busiest, coalesce(entropy, 0.0) AS entropy,
        coalesce(spawns, 0) AS spawns, coalesce(cpu, 0.0) AS cpu, coalesce(memory, 0.0) AS memory, coalesce(procs, 0) AS procs, coalesce(credential, false) AS credential, coalesce(creates, 0) AS creates, coalesce(execs, 0) AS execs, coalesce(hashes, 0) AS hashes, f0, f1
        FROM a LEFT JOIN n USING (client_id, w) LEFT JOIN b USING (client_id, w) LEFT JOIN h USING (client_id, w) LEFT JOIN p USING (client_id, w) LEFT JOIN f USING (client_id, w)),
    dt AS (SELECT *, {delta("conns", -10, 10)} AS d_conns, {delta("creates", -50, 50)} AS d_creates, {delta("spawns", -10, 10)} AS d_spawns, {delta("hashes", -20, 20)} AS d_hashes FROM raw WINDOW o AS (PARTITION BY client_id ORDER BY window_us)),
    ft AS (SELECT client_id, window_us, {log("conns", 10)} AS conn_count, {clip("dsts", 0, 50)} AS unique_dst_count, {log("sent", 20)} AS bytes_sent, {log("received", 20)} AS bytes_recv, {clip("entropy", 0, 8)} AS port_entropy,
        CAST(tcp AS DOUBLE) / greatest(conns, 1) AS tcp_ratio, CAST(udp AS DOUBLE) / greatest(conns, 1) AS udp_ratio, {clip(f"conns / {seconds}", 0, 10)} AS conn_rate, {clip(f"dsts / {seconds}", 0, 5)} AS dst_churn_rate, d_conns AS delta_conn_count,
        {clip("coalesce(conns - lag(conns) OVER o - lag(d_conns) OVER o, 0.0)", -5, 5)} AS conn_acceleration, {log("spawns", 8)} AS proc_spawn_count, d_spawns AS delta_proc_spawn,
        {clip("CASE WHEN spawns > 0 THEN cpu / spawns ELSE 0.0 END / 100", 0, 1)} AS avg_proc_cpu, {clip("ln(1 + CASE WHEN spawns > 0 THEN memory / spawns ELSE 0.0 END) / 10", 0, 1)} AS avg_proc_memory, {clip("procs", 0, 100)} AS unique_proc_names,
        {clip("creates", 0, 100)} AS file_create_count, d_creates AS delta_file_create, {clip("execs", 0, 20)} AS file_exec_count, {clip("hashes", 0, 50)} AS file_hash_novelty, d_hashes AS delta_unique_hashes,
        CASE WHEN creates > 50 AND hashes > 20 AND f1 - f0 < 30000000 THEN 1.0 ELSE 0.0 END AS ransomware_burst, CASE WHEN conns > 10 AND busiest > 5 AND dsts < 3 THEN 1.0 ELSE 0.0 END AS c2_pattern, CASE WHEN credential AND spawns > 2 THEN 1.0 ELSE 0.0 END AS cred_dump_pattern,
        conns AS conn_count_raw, creates AS file_create_raw, spawns AS proc_spawn_raw, hashes AS unique_hashes_raw FROM dt WINDOW o AS (PARTITION BY client_id ORDER BY window_us))"""


RAW = ("conn_count_raw", "file_create_raw", "proc_spawn_raw", "unique_hashes_raw")


def rounded(columns: tuple[str, ...] = FEATURES, of: str = "{}") -> str:
    """Each column to 6 digits; what ends in a 5 there is rounded up by any engine."""
    return ", ".join(f"round({of.format(c)} + 1e-9, 6) AS {c}" for c in columns)


def feature_rows(span: int) -> str:
    return f"WITH {features(span)} SELECT client_id, window_us, {rounded()}, {', '.join(RAW)} FROM ft"


def pattern_rows(span: int) -> str:
    return f"""WITH {features(span)} SELECT client_id, window_us, 'critical' AS severity, concat_ws(',', CASE WHEN ransomware_burst > 0 THEN 'ransomware_burst' END, CASE WHEN c2_pattern > 0 THEN 'c2_beaconing' END, CASE WHEN cred_dump_pattern > 0 THEN 'credential_dump' END) AS patterns,
        'conns=' || conn_count_raw || ' creates=' || file_create_raw || ' spawns=' || proc_spawn_raw AS evidence, CASE WHEN cred_dump_pattern > 0 THEN 'RESET_CREDENTIALS' WHEN c2_pattern > 0 THEN 'BLOCK_DESTINATION' ELSE 'ISOLATE_HOST' END AS action
        FROM ft WHERE ransomware_burst > 0 OR c2_pattern > 0 OR cred_dump_pattern > 0"""


def robust_rows(span: int, last: int = 100, least: int = 20) -> str:
    """Each feature against the client's last windows, by median and absolute deviation, or range."""
    score = (
        "CASE WHEN n < " + str(least) + " THEN greatest(-3.0, least(3.0, {0})) WHEN {0}_mad > 1e-6 THEN ({0} - {0}_med) / (1.4826 * {0}_mad) WHEN {0}_high - {0}_low > 1e-6 THEN ({0} - {0}_low) / ({0}_high - {0}_low) ELSE 0.0 END"
    )
    seen = ", ".join(f"median({c}) OVER o AS {c}_med, list({c}) OVER o AS {c}_all, min({c}) OVER o AS {c}_low, max({c}) OVER o AS {c}_high" for c in FEATURES)
    spread = ", ".join(f"list_aggregate(list_transform({c}_all, lambda v: abs(v - {c}_med)), 'median') AS {c}_mad" for c in FEATURES)
    return f"""WITH {features(span)}, past AS (SELECT *, count(*) OVER o AS n, {seen} FROM ft WINDOW o AS (PARTITION BY client_id ORDER BY window_us ROWS BETWEEN {last - 1} PRECEDING AND CURRENT ROW)),
    spread AS (SELECT *, {spread} FROM past) SELECT client_id, window_us, {rounded(of=score)}, {', '.join(RAW)} FROM spread"""
