"""Telemetry operators on hand-made rows, worked examples, and every registered query against SQL."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hostlight.functions import scalars
from hostlight.functions.fixed import FEATURES, WEIGHT_KEYS
from hostlight.models import autoencoder, ensemble, forest
from hostlight.operators import alerts, baselines, crawl, dedup, detectors, evaluate, features, federated, fleet, reporting, risk
from hostlight.plans.queries import QUERIES, SQL
from hostlight.sources import telemetry

SF = "/root/testdata/sf0.001"
MINUTE = 60_000_000


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


def plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda x: None if x is None or x != x else str(x))
        else:
            df[c] = pd.to_numeric(df[c], errors="coerce").astype(float)
    return df.sort_values(list(df.columns), ignore_index=True)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    got, want = plain(QUERIES[name](spark, SF).toPandas()), plain(con.sql(SQL[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9, atol=1e-6)  # columns are rounded to 6 digits, whose last one may differ


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def risk_of(df, **key):
    return {r[0]: (r[1], r[2]) for r in df.select("id", "risk", "indicators").collect()}


def test_network_risk(spark):
    data = [
        (1, "8.8.8.8", 4444, "TCP", None, 1, 1), (2, "192.168.1.5", 4444, "TCP", None, 1, 1), (3, "8.8.8.8", 443, "TCP/HTTPS", "x.googleapis.com", 5, 1), (4, "8.8.8.8", 443, "TCP/HTTPS", "evilcdn.example", 5, 1),
        (5, "8.8.8.8", 9, "TCP:9", "a.example", 501, 31), (6, "8.8.8.8", 3389, "TCP/RDP", None, 2, 1), (7, "127.0.0.1", 1, "TCP", None, 1, 1),
    ]
    got = risk_of(risk.network_risk_full(rows(spark, data, "id long, dst_ip string, dst_port int, protocol string, dns string, conn_n long, ports_n long")))
    assert got[1] == (10.0, ["known_malicious_port:4444", "suspicious_port_range:4444", "no_reverse_dns_external", "first_connection_malicious_port"])
    assert got[2] == (0.5, ["local_network_connection"]) and got[3] == (0.5, ["known_safe_domain"]) and got[4] == (1.0, ["https_cloud_service"]) and got[7][0] == 0.0
    assert got[5][0] == 0.5 + 0.5 + 2.0 + 3.0 and got[6][0] == 0.5 + 1.5 + 4.0


def test_process_risk(spark):
    schema = "id long, name string, path string, cmdline string, memory_mb double, cpu_percent double, parent_name string"
    data = [
        (1, "a.exe", "C:\\Program Files\\a", "x -enc y", 1.0, 1.0, None), (2, "a.exe", "c:/program files/a", "x", 1.0, 1.0, None), (3, "Mimikatz.exe", "d:/x", None, 1.0, 1.0, None), (4, "hydra.exe", "d:/x", None, 1.0, 1.0, None),
        (5, "powershell.exe", "d:/x", "powershell -enc AAA", 1.0, 1.0, None), (6, "a.exe", "C:\\Users\\b\\Downloads\\a.exe", "", 5001.0, 96.0, "winword.exe"), (7, None, None, None, None, None, None),
    ]
    got = risk_of(risk.process_risk_full(rows(spark, data, schema)))
    assert got[1][0] == 6.0 and got[2] == (0.5, ["safe_location"]) and got[3] == (9.0, ["critical_malware:mimikatz"]) and got[4] == (8.0, ["known_suspicious_process:hydra"])
    assert got[5][0] == 10.0 and got[6] == (10.0, ["user_directory_execution", "very_high_memory", "very_high_cpu", "office_macro_spawned_process"]) and got[7] == (0.0, [])


def test_file_and_user_risk(spark):
    schema = "id long, file_name string, file_path string, file_ext string, file_size long, is_new boolean, age_s long, windows boolean"
    data = [
        (1, "a.locked", "c:/program files/a.locked", ".locked", 1, False, 9999, True), (2, "x.enc", "c:/docs/documents/x.enc", ".enc", 1, False, 9999, True), (3, "operation.txt", "c:/d", ".txt", 1, False, 9999, True),
        (4, "inv.pdf.exe", "c:/d", ".exe", 20_000, False, 9999, True), (5, "b.txt", "c:/d", ".txt", 1, False, 9999, True), (6, "x.enc", "c:/other/x.enc", ".enc", 1, True, 59, True),
    ]
    got = risk_of(risk.file_risk_full(rows(spark, data, schema)))
    assert got[1][0] == 9.0 and got[2][0] == 8.5 and got[3] == (9.5, ["critical_malware_keyword:rat"]) and got[4][0] == 10.0 and got[5] == (0.0, []) and got[6][0] == 7.0
    users = rows(spark, [(1, "Admin", "203.0.113.9", 3, 5, True), (2, "bob", "local", 2, 6, True), (3, "bob", "1.2.3.4", 1, 23, False), (4, "bob", None, 1, 22, True)], "id long, username string, source_ip string, sessions int, login_hour int, new_ip boolean")
    got = risk_of(risk.user_risk_full(users))
    assert [got[k][0] for k in (1, 2, 3, 4)] == [10.0, 0.0, 3.5, 0.0]


def test_live_scorers(spark):
    net = rows(spark, [(1, "8.8.8.8", 80, None, 1, 1, None), (2, "10.0.0.1", 4444, None, 9, 1, None), (3, "8.8.8.8", 4444, "a.b", 9, 1, None), (4, "8.8.8.8", 4444, "a.b", 9, 1, 6.5), (5, "8.8.8.8", 80, "a.b", 9, 1, None)], "id long, dst_ip string, dst_port int, dns string, conn_n long, ports_n long, ml double")
    got = {r["id"]: (r["risk"], r["method"]) for r in risk.network_risk_live(net, "ml").collect()}
    assert got == {1: (2.0, "baseline"), 2: (3.0, "baseline"), 3: (7.0, "rule"), 4: (6.5, "ml"), 5: (None, None)}
    proc = rows(spark, [(1, "a", "d:/x", "", None, None, True, 90.0, 1.0, 1), (2, "a", "d:/x", "", None, None, False, 90.0, 1.0, 1), (3, "psexec", "d:/x", "", None, None, False, 1.0, 1.0, 1), (4, "a", "d:/x", "", None, "p>q", False, 1.0, 1.0, 30)], "id long, name string, path string, cmdline string, parent_name string, lineage string, trusted boolean, cpu_percent double, memory_mb double, pid long")
    got = {r["id"]: (r["risk"], r["method"]) for r in risk.process_risk_live(proc).collect()}
    assert got == {1: (None, None), 2: (3.0, "resource"), 3: (9.5, "rule"), 4: (7.5, "rule")}
    files = rows(spark, [(1, "a.locked", "d:/a", ".locked", False, 9999, False), (2, "a.txt", "d:/a", ".txt", False, 599, False), (3, "a.txt", "d:/a", ".txt", False, 600, True), (4, "a.txt", "d:/google/a", ".txt", True, 1, True)], "id long, file_name string, file_path string, file_ext string, is_new boolean, age_s long, sampled boolean")
    assert {r["id"]: r["risk"] for r in risk.file_risk_live(files).collect()} == {1: 8.0, 2: 2.0, 3: 1.0, 4: None}
    users = rows(spark, [(1, "admin", "9.9.9.9", 1, 23, False, False, 0), (2, "bob", "local", 5, 12, False, False, 0), (3, "bob", "local", 1, 12, False, False, 5), (4, "bob", "9.9.9.9", 1, 12, True, True, 0)], "id long, username string, source_ip string, sessions int, login_hour int, new_ip boolean, recent_login boolean, failed_logins long")
    assert {r["id"]: r["risk"] for r in risk.user_risk_live(users).collect()} == {1: 6.0, 2: 1.0, 3: 7.0, 4: 7.0}


LOGIN = "id long, client_id string, us long, username string, source_ip string, privilege_escalation boolean"


def test_login_detectors_at_their_bounds(spark):
    five = [(k, "c", k * 150_000_000, "u", "9.9.9.9", False) for k in range(5)]  # the fifth comes exactly 10 minutes after the first
    assert [r["id"] for r in detectors.detect_brute_force(rows(spark, five, LOGIN)).collect()] == [4]
    late = [*five[:4], (4, "c", 600_000_001, "u", "9.9.9.9", False)]
    assert detectors.detect_brute_force(rows(spark, late, LOGIN)).count() == 0
    up = [(1, "c", 0, "u", "local", True), (2, "c", 3_600_000_000, "u", "local", True), (3, "c", 7_200_000_001, "u", "local", True)]
    assert [r["id"] for r in detectors.detect_priv_escalation(rows(spark, up, LOGIN)).collect()] == [2]
    trip = [(1, "c", 0, "u", "1.1.1.1", False), (2, "c", 10, "u", "2.2.2.2", False), (3, "c", 20, "u", "2.2.2.2", False), (4, "c", 30, "u", "local", False), (5, "c", 40, "u", "2.2.2.2", False)]
    assert [(r["id"], r["other_ip"]) for r in detectors.detect_impossible_travel(rows(spark, trip, LOGIN)).orderBy("id").collect()] == [(2, "1.1.1.1"), (3, "1.1.1.1")]


def test_lineage_and_sessions(spark):
    p = rows(spark, [(1, "c", 1, 10, None, "winword.exe"), (2, "c", 1, 11, 10, "cmd.exe"), (3, "c", 2, 12, 10, "cmd.exe")], "id long, client_id string, snapshot long, pid long, ppid long, name string")
    got = {r["id"]: r["parent_name"] for r in detectors.with_parent(p).collect()}
    assert got == {1: None, 2: "winword.exe", 3: None}
    assert [r["lineage"] for r in detectors.suspicious_lineage(detectors.with_parent(p)).collect()] == ["winword.exe>cmd.exe"]
    s = rows(spark, [("c", 1, 0, "a"), ("c", 2, 1_000_000, "a"), ("c", 3, 2_000_000, "b"), ("c", 4, 3_000_000, "a")], "client_id string, snapshot long, us long, session string")
    got = sorted((r["us"], r["session"], r["event"], r["duration_s"]) for r in detectors.session_events(s).collect())
    assert got == [(0, "a", "login", None), (2_000_000, "a", "logout", 2.0), (2_000_000, "b", "login", None), (3_000_000, "a", "login", None), (3_000_000, "b", "logout", 1.0)]


def test_ttl_expiry_equal_to_now_still_suppresses():
    s = 1_000_000
    assert dedup.ttl_kept([0, 300 * s, 300 * s + 1, 600 * s], [300 * s] * 4) == [True, False, True, False]


def test_no_two_kept_alerts_within_a_ttl(spark):
    rng = np.random.default_rng(0)
    data = [(int(k), f"s{k % 7}", int(t), ["critical", "high", "low", "odd"][k % 4]) for k, t in enumerate(np.sort(rng.integers(0, 3_000_000_000, 400)))]
    got = dedup.ttl_dedup(rows(spark, data, "id long, signature string, us long, severity string")).filter("kept").toPandas().sort_values("us")
    for _, g in got.groupby("signature"):
        spans = [1_000_000 * dedup.SERVER_TTL.get(s, dedup.OTHER_TTL) for s in g.severity]
        assert all(b > a + w for a, b, w in zip(g.us, g.us[1:], spans, strict=False))
    kept = dedup.rate_limit(rows(spark, [(k, "c", k * 1_000_000) for k in range(130)], "id long, client_id string, us long"), 50).filter("kept").count()
    assert kept == 50 + 50 + 10


def test_worked_examples(spark):
    assert round((95 - 49.2) / 2.8, 2) == 16.36
    w = [("a", 2.0, 2.5, 2.0, 1000, 2.0), ("b", 3.5, 2.0, 1.8, 100, 5.0), ("c", 2.2, 4.0, 2.3, 10, 8.0)]
    df = rows(spark, w, "client_id string, x double, y double, z double, n long, v double").withColumn("round", F.lit(1))
    long = df.select("round", "client_id", "n", F.explode(F.create_map(*[a for c in "xyzv" for a in (F.lit(c), F.col(c))])).alias("key", "value"))
    mean = {r["key"]: round(r["value"], 3) for r in federated.fed_avg(long).collect()}
    assert (mean["x"], mean["y"], mean["z"]) == (2.567, 2.833, 2.033)
    assert {r["key"]: round(r["value"], 2) for r in federated.fed_avg(long, "n").collect()}["v"] == 2.32
    odd = spark.range(100).select(F.lit(1).alias("round"), F.col("id").cast("string").alias("client_id"), F.lit("k").alias("key"), F.when(F.col("id") == 0, 10.0).otherwise(2.0).alias("value"))
    assert round(federated.fed_avg(odd).first()["value"], 2) == 2.08 and federated.trimmed_mean(odd).first()["value"] == 2.0


def test_zscore_needs_history_and_spread(spark):
    data = [("c", "m", k, k, float(k % 2)) for k in range(11)] + [("c", "m", 11, 11, 9.0)] + [("d", "m", k, k, 5.0) for k in range(12)]
    got = {(r["client_id"], r["id"]): (r["z"], r["anomaly"]) for r in baselines.zscore_detect(rows(spark, data, "client_id string, metric string, us long, id long, value double")).collect()}
    assert got[("c", 9)][0] is None and got[("c", 10)][0] is not None and got[("c", 11)][1] and got[("d", 11)] == (None, False)
    ema = baselines.ema(rows(spark, data[:3], "client_id string, metric string, us long, id long, value double")).toPandas().ema.tolist()
    assert np.allclose(ema, [0, 0.05, 0.0475])


def test_robust_normalisation():
    x = np.r_[np.full(25, 2.0), 9.0]
    assert (features.normalized(x)[:19] == 2).all() and (features.normalized(x)[19:25] == 0).all() and features.normalized(x)[25] == 1.0
    rng = np.random.default_rng(0)
    v = rng.normal(size=300)
    out = features.normalized(v)
    for k in (19, 98, 99, 250):
        h = v[max(0, k - 99) : k + 1]
        mad = np.median(np.abs(h - np.median(h)))
        assert math.isclose(out[k], (v[k] - np.median(h)) / (1.4826 * mad))


def test_normalisation_in_chunks_is_the_same(spark):
    rng = np.random.default_rng(1)
    data = [("c", k, float(x)) for k, x in enumerate(rng.normal(size=350))]
    df = rows(spark, data, "client_id string, window_us long, conn_count double")
    a, b = (features.robust_normalize(df, ("conn_count",), chunk=c).toPandas().sort_values("window_us").conn_count.to_numpy() for c in (None, 120))
    assert np.allclose(a, b)


def test_windows_and_flags(spark):
    net = rows(spark, [("c", k * 1000, "9.9.9.9", 80, 10.0, 1.0, "TCP") for k in range(11)], "client_id string, us long, dst_ip string, dst_port int, bytes_sent double, bytes_recv double, protocol string")
    proc = rows(spark, [("c", k, "lsass.exe", 50.0, 100.0) for k in range(3)], "client_id string, us long, name string, cpu_percent double, memory_mb double")
    files = rows(spark, [("c", k * 100_000, ".exe", f"h{k % 30}", "created") for k in range(51)], "client_id string, us long, file_ext string, file_hash string, event_type string")
    raw = features.windows(features.tagged_events(net, proc, files))
    f = features.features(raw).collect()
    assert len(f) == 1 and (f[0]["ransomware_burst"], f[0]["c2_pattern"], f[0]["cred_dump_pattern"]) == (1, 1, 1) and f[0]["port_entropy"] == 0 and f[0]["file_exec_count"] == 20 and math.isclose(f[0]["conn_count"], math.log1p(11))
    a = features.pattern_alerts(features.features(raw)).first()
    assert a["patterns"] == ["ransomware_burst", "c2_beaconing", "credential_dump"] and a["action"] == "RESET_CREDENTIALS"


def test_severity_bounds(spark):
    df = rows(spark, [(s, [0.0] * len(FEATURES)) for s in (5.49, 5.5, 7.0, 8.5, 9.5)], "ensemble_score double, vector array<double>")
    assert [r["severity"] for r in ensemble.severity(df).orderBy("ensemble_score").collect()] == ["normal", "low", "medium", "high", "critical"]


def test_models_find_the_odd_row(spark):
    rng = np.random.default_rng(0)
    data = [(k, [float(x) for x in rng.normal(size=6)]) for k in range(300)] + [(300, [9.0] * 6)]
    m = rows(spark, data, "id long, vector array<double>")
    trees = forest.train(m, trees=30, sample=64)
    low = forest.score(m, trees, 64).orderBy("iso_score").first()
    assert len(trees) == 30 and low["id"] == 300 and -1 <= low["iso_score"] < -0.5
    model = autoencoder.train(m, epochs=3)
    assert autoencoder.score(m, model).orderBy(F.desc("ae_error")).first()["id"] == 300 and model.threshold > 0
    assert forest.train(m.limit(0)) == [] and autoencoder.train(m.limit(0)) is None


def test_curves(spark):
    s = [("a", 0.9, True), ("a", 0.8, False), ("a", 0.7, True), ("a", 0.1, False), ("tie", 1.0, True), ("tie", 1.0, False), ("one", 1.0, True)]
    got = {r["model"]: r["auc"] for r in evaluate.auc(rows(spark, s, "model string, score double, label boolean")).collect()}
    assert got == {"a": 0.75, "tie": 0.5, "one": None}


def test_federated_rules(spark):
    assert federated.reputation_steps([10.0, 10.1], [False, False], [False, True]) == [1.0, 0.9 * 0.95]
    long = [0.1 <= r <= 2 for r in federated.reputation_steps([1.0] * 200, [False] * 200, [False] * 200)]
    assert all(long)
    for n, kept in ((2, 2), (3, 1)):
        df = spark.range(n).select(F.lit(1).alias("round"), F.col("id").cast("string").alias("client_id"), F.lit("k").alias("key"), F.col("id").cast("double").alias("value"))
        assert federated.trimmed_mean(df).first()["kept"] == kept
    u = rows(spark, [("c", {k: 5.0 for k in WEIGHT_KEYS}), ("d", {k: 1.0 for k in WEIGHT_KEYS})], "client_id string, weights map<string,double>")
    got = {r["client_id"]: r for r in federated.delta_clip(u, F.create_map(*[x for k in WEIGHT_KEYS for x in (F.lit(k), F.lit(1.0))]), 2.0).collect()}
    assert got["c"]["was_clipped"] and math.isclose(math.sqrt(sum(v * v for v in got["c"]["delta"].values())), 2.0) and not got["d"]["was_clipped"]
    w = rows(spark, [(1, "a", 1.0, 2.0), (1, "b", 3.0, 0.0)], "round int, client_id string, reputation double, quality double")
    assert math.isclose(federated.client_weights(w).agg(F.sum("share")).first()[0], 1.0)
    back = federated.rollback(rows(spark, [(1, 0.9), (2, 0.87), (3, 0.885)], "round int, auc double")).orderBy("round").collect()
    assert [(r["rolled_back"], r["kept_round"]) for r in back] == [(False, 1), (True, 1), (False, 3)]


def test_validation_and_members(spark):
    model = [(1, k, 2.0 if "threshold" in k else 1.0) for k in WEIGHT_KEYS] + [(2, k, 5.0 if "threshold" in k else 1.0) for k in WEIGHT_KEYS]
    models = rows(spark, model, "round int, key string, model double")
    seen = [(k, k >= 20, float(k % 7) if k < 20 else 3.0, None, 4.0 if k == 29 else None) for k in range(30)]
    labelled = rows(spark, seen, "id long, label boolean, z_network double, z_process double, z_file double")
    got = {r["round"]: r for r in federated.validation(models, labelled).collect()}
    up, down = [max(r[2], r[4] or 0.0) for r in seen if r[1]], [r[2] for r in seen if not r[1]]
    area = sum((a > b) + (a == b) / 2 for a in up for b in down) / 200
    assert math.isclose(got[1]["auc"], area) and got[1]["tpr"] == 1.0 and math.isclose(got[1]["fpr"], sum(z > 2 for z in down) / 20)
    assert got[2]["tpr"] == 0.0 and math.isclose(got[2]["fpr"], sum(z > 5 for z in down) / 20)
    few = {r["round"]: r["auc"] for r in federated.validation(models, labelled.limit(19)).collect()}
    assert math.isclose(few[1], 0.875) and math.isclose(few[2], 0.725)
    u = rows(spark, [("a", 1, 0), ("b", 1, 400), ("a", 2, 500), ("c", 2, 900), ("b", 3, 1500)], "client_id string, round int, us long")
    assert sorted((r["round"], r["client_id"], r["us"]) for r in federated.members(u, 600).collect()) == [(1, "a", 0), (1, "b", 400), (2, "a", 500), (2, "b", 400), (2, "c", 900), (3, "b", 1500)]


def test_reports(spark):
    p = [(k, "c", k, "Chrome.exe" if k in (30, 31) else "a.exe", 10, "d:/x", "", None, None, 90.0 if k == 30 else 1.0, 1.0) for k in range(1, 62)] + [(62, "c", 62, "psexec.exe", 10, "d:/x", "", None, None, 1.0, 1.0)]
    df = rows(spark, p, "id long, client_id string, us long, name string, pid long, path string, cmdline string, parent_name string, lineage string, cpu_percent double, memory_mb double")
    got = {r["id"]: (r["risk"], r["method"]) for r in reporting.report_processes(df, F.lit(0)).collect()}
    assert got == {60: (1.0, "baseline"), 62: (9.5, "rule")}  # the busy 30th is trusted
    f = [(k, "c", k, "a.txt", "d:/a", ".txt", 10, f"h{k}", False, 9999) for k in range(25)] + [(90, "c", 90, "x.locked", "d:/a", ".locked", 10, "same", False, 9999), (91, "c", 91, "y.locked", "d:/a", ".locked", 10, "same", False, 9999), (92, "c", 92, "b.txt", "d:/a", ".txt", 10, "h", False, 10)]
    df = rows(spark, f, "id long, client_id string, us long, file_name string, file_path string, file_ext string, file_size long, file_hash string, is_new boolean, age_s long")
    got = {r["id"]: r["risk"] for r in reporting.report_files(df, F.lit(0)).collect()}
    assert got == {**{k: 1.0 for k in range(20)}, 90: 8.0, 91: 7.0, 92: 2.0}


def test_last_model_finding(spark):
    e = rows(spark, [(1, "a", 5), (2, "a", 100), (3, "a", 161), (4, "b", 100), (5, None, 7)], "id long, client_id string, us long")
    found = rows(spark, [("a", 5), ("a", 100), ("b", 101), (None, 1)], "client_id string, us long")
    assert {r["id"]: r["ml"] for r in alerts.with_last_model(e, found, 60).collect()} == {1: True, 2: True, 3: False, 4: False, 5: True}


def test_messages_split(spark):
    text = {"client_id": "c", "timestamp": "2024-01-01T00:00:00Z", "network": {"details": [{"dst_ip": "1.2.3.4", "dst_port": 80}]}, "processes": {"details": [{"pid": 1}], "high_risk": [{"pid": 2, "risk_score": 9}]}, "filesystem": [{"file_name": "a", "file_size": 0}], "user_activity": [{"username": "u"}]}
    got = telemetry.split_telemetry(rows(spark, [(json.dumps(text),), ("junk",)], "message string"))
    n, f, u = got["network"].first(), got["filesystem"].first(), got["user_activity"].first()
    assert (n["connection_count"], n["risk_score"], n["is_anomaly"], n["threat_indicators"]) == (1, 0.0, False, []) and f["file_size"] is None and (u["source_ip"], u["login_success"], u["concurrent_sessions"]) == ("local", True, 1)
    assert sorted((r["pid"], r["high_risk"]) for r in got["processes"].collect()) == [(1, False), (2, True)] and got["network"].count() == 1


def test_registry(spark):
    schema = "client_id string, hostname string, ip_address string, status string, last_heartbeat long, first_seen long, federated_learning boolean"
    reg = rows(spark, [("a", "old", "1", "offline", 1, 1, False), ("b", "b", "2", "offline", 1, 1, False)], schema)
    new = rows(spark, [("a", "new", None, "x", 5, 5, True), ("c", "c", "3", "x", 6, 6, False)], schema)
    up = {r["client_id"]: r for r in telemetry.upsert_clients(reg, new).collect()}
    assert (up["a"]["hostname"], up["a"]["status"], up["a"]["first_seen"]) == ("new", "online", 1) and up["b"]["status"] == "offline" and up["c"]["first_seen"] == 6
    merged = {r["client_id"]: r for r in telemetry.merge_registry(reg, new).collect()}
    assert merged["a"]["hostname"] == "new" and merged["a"]["ip_address"] == "1"
    auto = {r["client_id"]: r["hostname"] for r in telemetry.auto_register(reg, rows(spark, [("zzzzzzzzzzzz",)], "client_id string")).collect()}
    assert auto["zzzzzzzzzzzz"] == "auto-registered-zzzzzzzz"


def test_inventory_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"client_id": "c", "timestamp": "t1", "data": {"users": [{"username": "u", "uid": "7"}]}}))
    (tmp_path / "b.json").write_text(json.dumps({"timestamp": "t2", "data": {}}))
    snaps = telemetry.read_snapshots(spark, str(tmp_path))
    assert snaps.count() == 1 and telemetry.flatten_inventory(snaps, "users").first()["uid"] == 7 and telemetry.latest_snapshot(snaps).first()["timestamp"] == "t1"


CRAWL = "\x1b[1m2.\n --- [+] Website: \x1b[35mA site\x1b[0m\n| Onion Link: \x1b[32mhttp://{0}.onion\x1b[0m\n| Keywords: \x1b[32msafe, tool\x1b[0m\n- Sentiment: Polarity = 0.22, Subjectivity = 0.43\n| Links Found: 118\n| Emails Found: a.b@c.org\n".format("a" * 56)


def test_crawl_sites(spark):
    kind = "task_id string, raw_output string, darkdump_results struct<urls: array<string>, domains: array<string>, emails: array<string>, ips: array<string>, keywords: array<string>>"
    df = rows(spark, [("t", "intro\n" + CRAWL + CRAWL.replace("2.", "3.", 1), (["\x1b[0mhttps://x.y"], ["github.", "A" * 20 + ".onion."], [], [], ["\x1b[0msafe"])), ("n", None, None)], kind)
    s = crawl.sites(df).collect()
    assert len(s) == 2 and s[0]["title"] == "A site" and s[0]["keywords"] == ["safe", "tool"] and s[0]["links_found"] == 118 and s[0]["sentiment"]["polarity"] == 0.22 and s[0]["emails_found"] == ["a.b@c.org"]
    assert crawl.sites(df, strict=True).count() == 0 and crawl.first_sites(crawl.sites(df)).count() == 1
    e = {r["task_id"]: r for r in crawl.entities(df).collect()}
    assert len(e["t"]["urls"]) == 2 and e["t"]["onion_domains"] == ["a" * 20 + ".onion", "a" * 56 + ".onion"] and e["t"]["clearnet_domains"] == [] and e["t"]["keywords"] == ["safe"] and e["n"]["urls"] == []
    c = {r["task_id"]: r for r in crawl.statistics(crawl.entities(df), crawl.sites(df)).collect()}
    assert (c["t"]["total_websites"], c["t"]["onion_urls"], c["t"]["clearnet_urls"], c["n"]["total_websites"]) == (2, 1, 1, 0)


def test_alert_texts(spark):
    names = F.array(F.lit("file_create_count"), F.lit("conn_count"), F.lit("dst_churn_rate"))
    r = spark.range(1).select(alerts.dominant_category(names).alias("d"), alerts.source_category(F.lit("ml_file_anomaly")).alias("s"), scalars.feature_label(F.lit("some_thing")).alias("l")).first()
    assert tuple(r) == ("network", "filesystem", "Some Thing")
    data = [
        (1, "network", "high", ["c2_pattern", "conn_count"], 8.25, "why"), (2, "process", "critical", ["cred_dump_pattern", "proc_spawn_count"], None, "why"), (3, "filesystem", "medium", ["file_create_count"], 9.0, ""),
        (4, "user_activity", "low", ["conn_rate"], None, None), (5, "network", "critical", ["conn_rate", "tcp_ratio"], 0.0, "x" * 300),
    ]
    df = rows(spark, data, "id long, category string, severity string, f array<string>, score double, why string")
    c, f = F.col("category"), F.col("f")
    said, shown = alerts.explain(c, lambda n: F.when(F.array_contains(f, n), F.lit(60.0 if n.endswith("count") else 1.0)), F.coalesce("score", F.lit(0.0)), f)
    out = df.select("id", alerts.alert_title(c, f, F.col("severity")).alias("t"), alerts.alert_description(c, f, F.col("why"), F.col("score")).alias("d"), said.alias("e"), shown.alias("v"), alerts.recommended_action(F.col("severity"), c, f).alias("a"))
    got = {r["id"]: r for r in out.collect()}
    assert [got[k]["t"] for k in (1, 2, 3, 4, 5)] == ["⚠️ Possible C2 Communication Detected", "⚠️ CRITICAL: Credential Theft Attempt", "⚠️ Mass File Modification Detected", "ML Anomaly: LOW - USER_ACTIVITY", "Suspicious Network Activity - CRITICAL"]
    assert got[1]["d"] == "Repeated connections to same destination suggest Command & Control (C2) communication | Unusually high number of network connections detected | AI Analysis: Anomaly Detection: 8.3/10"
    assert got[4]["d"] == "Multiple anomalous behaviors detected" and got[5]["d"] == "AI Analysis: Anomaly Detection: 0.0/10"
    assert got[1]["e"] == ["Threat Level: 8.3/10", "⚠️ Possible Command & Control (C2) communication detected", "High network activity: 6000 connections"] and got[1]["v"] == ["Repeated connections to same destination with regular timing"]
    assert got[2]["e"][1] == "Rapid process creation: 600 processes spawned" and got[4]["e"] == ["Multiple statistical anomalies detected"] and got[4]["v"] == ["Top features: conn_rate"]
    assert got[3]["e"] == ["Threat Level: 9.0/10", "Mass file activity: 60 files created/modified"] and got[3]["a"].startswith("MONITOR: Track filesystem activity")
    assert got[2]["a"].startswith("🚨 IMMEDIATE: CREDENTIAL THEFT") and got[5]["a"].startswith("IMMEDIATE: Isolate host from network") and got[4]["a"].startswith("LOG")


def test_event_vectors(spark):
    minute = 60_000_000
    net = rows(spark, [("c", 1, 10, "8.8.8.8", 80, "TCP", 1.0, 2.0, 1, 1), ("c", 2, 20, "8.8.4.4", 53, "UDP", 1.0, 2.0, 11, 2)], "client_id string, id long, us long, dst_ip string, dst_port int, protocol string, bytes_sent double, bytes_recv double, conn_n long, ports_n long")
    proc = rows(spark, [("c", 3, 30, "Mimikatz.exe", 50.0, 2500.0, "c:/windows/temp/", "cmd.exe")], "client_id string, id long, us long, name string, cpu_percent double, memory_mb double, path string, parent_name string")
    file = rows(spark, [("c", 4, 40, ".exe", "h", "created"), ("c", 5, minute + 1, ".locked", "h", "created")], "client_id string, id long, us long, file_ext string, file_hash string, event_type string")
    raw = features.windows(features.tagged_events(net, proc, file))
    got = {}
    for df in (features.network_vectors(net, raw), features.process_vectors(proc, raw), features.file_vectors(file, raw)):
        got |= {r["id"]: dict(zip(features.FEATURES, r["vector"], strict=True)) for r in df.collect()}
    set_ = lambda k: {n: round(v, 6) for n, v in got[k].items() if v}
    assert set_(2) == {"conn_count": 0.02, "unique_dst_count": 1.0, "port_entropy": 1.0, "tcp_ratio": 0.5, "udp_ratio": 0.5, "conn_rate": 0.033333, "dst_churn_rate": 0.033333, "proc_spawn_count": 0.1, "file_create_count": 0.02, "delta_conn_count": 0.2, "c2_pattern": 1.0}
    assert set_(3) == {"conn_count": 0.02, "proc_spawn_count": 0.1, "avg_proc_cpu": 0.5, "avg_proc_memory": 0.5, "unique_proc_names": 1.0, "file_create_count": 0.02, "file_exec_count": 1.0, "delta_proc_spawn": 0.1, "cred_dump_pattern": 1.0}
    assert set_(4) == {"conn_count": 0.02, "proc_spawn_count": 0.1, "file_create_count": 0.02, "file_exec_count": 1.0, "file_hash_novelty": 1.0, "delta_file_create": 0.02, "delta_unique_hashes": 1.0}
    assert set_(5) == {"file_create_count": 0.02, "delta_file_create": 0.02, "ransomware_burst": 1.0}


def test_fleet_offline_and_ack(spark):
    c = rows(spark, [("a", "online", 0), ("b", "online", 1)], "client_id string, status string, heartbeat long")
    assert {r["client_id"]: r["status"] for r in fleet.mark_offline(c, 2 * MINUTE + 1, 2 * MINUTE).collect()} == {"a": "offline", "b": "online"}


def test_stream_equals_batch(spark, tmp_path):
    from hostlight.streaming import jobs

    data = [(f"c{k % 3}", k * 7, ["n", "p", "f"][k % 3], f"x{k % 5}", 1.0, True) for k in range(200)]
    df = rows(spark, data, "client_id string, s long, kind string, name string, bytes_sent double, flag boolean").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    df.write.parquet(str(tmp_path / "in"))
    stream = jobs.window_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.table("w").collect()))
    assert got == sorted(map(tuple, jobs.window_counts(df).collect())) and len(got) > 20
