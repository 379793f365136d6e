"""More registered queries: reports, model gates, validation and the older server's rounds, and operators used elsewhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed, scalars
from ..functions.fixed import FEATURES, WEIGHT_KEYS
from ..models import ensemble
from ..operators import alerts, baselines, detectors, federated, fleet, reporting, risk
from ..sources.tables import telemetry
from .queries import (
    _FILE, _FL, _LINEAGE, _LONG, _METRICS, _NET, _PARENTS, _SNAP, CYCLE, DAY, _files, _fl, _group_sql, _ml_alerts, _rounds, _with_snapshot, contributions, global_models, metrics, most_updates, query, rounded, updates,
)

# -- reports --------------------------------------------------------------------------------------------------

_RULES = {name: scorer.duckdb()[0] for name, scorer in (("network", risk.NETWORK_LIVE), ("process", risk.PROCESS_LIVE), ("file", risk.FILE_LIVE))}
_TRUSTED = "lower(name) IN (" + ", ".join(f"'{n}'" for n in fixed.TRUSTED_PROCESSES) + ")"


@query(f"""SELECT id, round(risk, 6) AS risk, method FROM (SELECT id, CASE WHEN rr > 6 THEN rr WHEN conn_n = 1 AND NOT local THEN 2.0 WHEN {risk._BAD_PORT} AND local THEN 3.0 END AS risk, CASE WHEN rr > 6 THEN 'rule' ELSE 'baseline' END AS method
    FROM (SELECT *, {_RULES["network"]} AS rr FROM ({_NET}) n) x) y WHERE risk IS NOT NULL""", "network_data")
def f8_report_network(spark, sf_dir):
    return rounded(reporting.report_network(fleet.running_history(telemetry(spark, sf_dir)["network_data"])).select("id", "risk", "method"), "risk")


@query(f"""SELECT id, round(risk, 6) AS risk, method FROM (SELECT id, trusted, CASE WHEN rr > 6 THEN rr WHEN cpu_percent > 80 OR memory_mb > 2000 THEN 3.0 WHEN n % 30 = 0 AND NOT trusted THEN 1.0 END AS risk, CASE WHEN rr > 6 THEN 'rule' WHEN cpu_percent > 80 OR memory_mb > 2000 THEN 'resource' ELSE 'baseline' END AS method
    FROM (SELECT *, {_RULES["process"]} AS rr FROM (SELECT *, {_LINEAGE} AS lineage, {_TRUSTED} AS trusted, row_number() OVER (PARTITION BY client_id, {_SNAP} ORDER BY us, id) AS n FROM ({_PARENTS}) p) q) x) y WHERE risk IS NOT NULL AND NOT (trusted AND risk < 5)""", "process_data")
def f8_report_processes(spark, sf_dir):
    rows = detectors.with_parent(_with_snapshot(telemetry(spark, sf_dir)["process_data"]))
    rows = rows.withColumn("lineage", detectors.lineage(F.col("parent_name"), F.col("name")))
    return rounded(reporting.report_processes(rows, F.floor(F.col("us") / CYCLE)).select("id", "risk", "method"), "risk")


@query(f"""WITH s AS (SELECT *, rr <= 7 AND NOT (is_new OR age_s < 600) AS plain FROM (SELECT *, {_RULES["file"]} AS rr, {risk._SAFE_FILE} AS safe FROM ({_FILE}) f) x),
    t AS (SELECT *, sum(CAST(plain AS INT)) OVER (PARTITION BY client_id, {_SNAP} ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM s),
    u AS (SELECT *, CASE WHEN rr > 7 THEN rr WHEN is_new OR age_s < 600 THEN 2.0 WHEN n <= 20 THEN 1.0 END AS r, CASE WHEN rr > 7 THEN 'rule' ELSE 'baseline' END AS method FROM t WHERE NOT (safe AND rr < 6)),
    v AS (SELECT *, r > 5 AND file_size < 52428800 AND row_number() OVER (PARTITION BY client_id, r > 5 AND file_size < 52428800, file_hash ORDER BY us, id) > 1 AS known FROM u WHERE r IS NOT NULL)
    SELECT id, round(CASE WHEN known THEN greatest(0.0, r - 1) ELSE r END, 6) AS risk, method FROM v""", "filesystem_data")
def f8_report_files(spark, sf_dir):
    return rounded(reporting.report_files(_files(spark, sf_dir).drop("sampled"), F.floor(F.col("us") / CYCLE)).select("id", "risk", "method"), "risk")


# -- model gates ----------------------------------------------------------------------------------------------

HOUR = 3_600_000_000
_FOUND = "SELECT client_id, us FROM alerts WHERE severity <> 'medium'"
_GATED = f"(SELECT n.*, n.us - f.us <= {HOUR} AND f.us IS NOT NULL AS ml FROM network_data n ASOF LEFT JOIN (SELECT DISTINCT client_id, us FROM ({_FOUND}) y) f ON f.client_id = n.client_id AND f.us <= n.us)"


def gated_network(spark, sf_dir):
    """Connections with the findings of a model (the severe alerts) within an hour before them."""
    t = telemetry(spark, sf_dir)
    return alerts.with_last_model(t["network_data"], t["alerts"].filter("severity <> 'medium'"), HOUR)


@query(f"SELECT id, coalesce(ml, false) AS ml FROM {_GATED} g", "network_data", "alerts")
def al16_last_model(spark, sf_dir):
    return gated_network(spark, sf_dir).select("id", "ml")


@query(f"SELECT id, CASE WHEN risk_score > 8 THEN 'high' ELSE 'medium' END AS severity, 'ML-detected anomalous network connection to ' || dst_ip || ':' || dst_port AS description FROM {_GATED} g WHERE ml AND is_anomaly", "network_data", "alerts")
def al15_network_model_alerts(spark, sf_dir):
    return alerts.network_model_alerts(gated_network(spark, sf_dir)).select("id", "severity", "description")


@query(f"""SELECT id, 'network' AS source_category, CASE WHEN risk_score > 8 THEN 'high' ELSE 'medium' END AS severity, 'Connection: ' || dst_ip || ':' || dst_port || ' (' || protocol || ') | Detection: ' || CASE WHEN ml THEN 'ML' ELSE 'RULE' END AS description FROM {_GATED} g WHERE (risk_score > 7 AND ml) OR risk_score > 8.5
    UNION ALL SELECT id, 'process', CASE WHEN risk_score > 8.5 THEN 'critical' ELSE 'high' END, 'Process: ' || name || ' (PID: ' || pid || ') | Path: ' || path FROM process_data WHERE risk_score > 7
    UNION ALL SELECT id, 'filesystem', CASE WHEN risk_score > 8.5 THEN 'critical' ELSE 'high' END, 'File: ' || file_name || ' (' || file_ext || ') | Hash: ' || substr(file_hash, 1, 16) FROM filesystem_data WHERE risk_score > 7""", "network_data", "process_data", "filesystem_data", "alerts")
def al16_gated_by_model(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    return alerts.gated_alerts(gated_network(spark, sf_dir), t["process_data"], t["filesystem_data"], "ml").select("id", "source_category", "severity", "description")


_FEATURE_NAMES = "[" + ", ".join(f"'{n}'" for n in FEATURES) + "]"


@query(f"""SELECT id, round(r, 6) AS alert_risk, 'ML Anomaly: ' || upper(severity) || ' - ' || f[1] AS title, description || ' | Contributing Features: ' || array_to_string(f[1:5], ', ') || ' | ' || CASE WHEN iso IS NOT NULL THEN printf('Isolation Forest Score: %.4f', CAST(round(CAST(CAST(iso AS VARCHAR) AS DECIMAL(38, 20)), 4) AS DOUBLE)) ELSE printf('Autoencoder Error: %.4f', CAST(round(CAST(CAST(ae AS VARCHAR) AS DECIMAL(38, 20)), 4) AS DOUBLE)) END AS description
    FROM (SELECT *, coalesce(greatest(abs(iso) * 15, 5.0), least(ae * 100, 10.0), 5.0) AS r FROM (SELECT id, severity, description, CASE WHEN id % 2 = 0 THEN -risk_score / 12 END AS iso, CASE WHEN id % 2 = 1 THEN risk_score / 12 / 10 END AS ae,
        list_transform([0, 5, 11], lambda k: ({_FEATURE_NAMES})[CAST((id + k) % {len(FEATURES)} AS INT) + 1]) AS f FROM alerts) x) y WHERE r > 5 OR severity = 'high'""", "alerts")
def al16_model_alerts(spark, sf_dir):
    ml = _ml_alerts(spark, sf_dir).withColumn("severity", F.lower("severity"))
    ml = ml.withColumns({"ae_score": F.when(F.col("id") % 2 == 1, -F.col("iso_score") / 10), "iso_score": F.when(F.col("id") % 2 == 0, F.col("iso_score"))})
    return rounded(alerts.model_alerts(ml).select("id", "alert_risk", "title", "description"), "alert_risk")


# -- validation, rollback, metadata -----------------------------------------------------------------------------

_Z = f"""SELECT id, value > 150 AS label, metric, CASE WHEN n >= 10 AND s > 0 THEN (value - m) / s END AS z FROM (SELECT id, metric, value, count(value) OVER p AS n, avg(value) OVER p AS m, stddev_pop(value) OVER p AS s
    FROM ({_METRICS}) y WINDOW p AS (PARTITION BY client_id, metric ORDER BY us, id ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING)) x"""
_LIMITS = "SELECT round, " + ", ".join(f"max(CASE WHEN key = '{n}_threshold' THEN model END) / max(CASE WHEN key = '{n}_sensitivity' THEN model END) AS {n}" for n in ("network", "process", "file")) + " FROM g GROUP BY 1"
_VALID = f"""l AS ({_LIMITS}), z AS ({_Z}),
    sc AS (SELECT l.round, z.label, coalesce(abs(z.z) / CASE WHEN metric IN ('click', 'view') THEN l.network WHEN metric = 'purchase' THEN l.process ELSE l.file END, 0.0) AS s FROM z, l),
    rk AS (SELECT round, label, s, rank() OVER (PARTITION BY round ORDER BY s) + (count(*) OVER (PARTITION BY round, s) - 1) / 2.0 AS r FROM sc),
    va AS (SELECT round, count(*) AS windows, (sum(CASE WHEN label THEN r END) - count(*) FILTER (WHERE label) * (count(*) FILTER (WHERE label) + 1) / 2.0) / (count(*) FILTER (WHERE label) * count(*) FILTER (WHERE NOT label)) AS auc,
        count(*) FILTER (WHERE label AND s > 1) / CAST(count(*) FILTER (WHERE label) AS DOUBLE) AS tpr, count(*) FILTER (WHERE NOT label AND s > 1) / CAST(count(*) FILTER (WHERE NOT label) AS DOUBLE) AS fpr FROM rk GROUP BY 1)"""
_BACK = """vn AS (SELECT round, auc, row_number() OVER (ORDER BY round) AS i FROM va),
    rb AS (SELECT round, i, auc, false AS rolled_back, auc AS best, round AS kept_round FROM vn WHERE i = 1
        UNION ALL SELECT v.round, v.i, v.auc, v.auc < b.best - 0.02, CASE WHEN v.auc < b.best - 0.02 THEN b.best ELSE v.auc END, CASE WHEN v.auc < b.best - 0.02 THEN b.kept_round ELSE v.round END FROM rb b JOIN vn v ON v.i = b.i + 1)"""


def labelled_windows(spark, sf_dir):
    """Each event as a window with the z-score of its category; values above 150 are anomalies."""
    z = baselines.zscore_detect(metrics(spark, sf_dir))
    kind = F.when(F.col("metric").isin("click", "view"), "network").when(F.col("metric") == "purchase", "process").otherwise("file")
    return z.select("id", (F.col("value") > 150).alias("label"), *[F.when(kind == n, F.col("z")).alias(f"z_{n}") for n in ("network", "process", "file")])


@query(_rounds(f", {_VALID} SELECT round, windows, round(auc, 6) AS auc, round(tpr, 6) AS tpr, round(fpr, 6) AS fpr FROM va"))
def fl12_validation(spark, sf_dir):
    return rounded(federated.validation(global_models(spark, sf_dir), labelled_windows(spark, sf_dir)), "auc", "tpr", "fpr")


@query(_rounds(f", {_VALID}, {_BACK} SELECT rb.round, rb.rolled_back, CAST(rb.kept_round AS BIGINT) AS kept_round, g.key, round(g.model, 6) AS model FROM rb JOIN g ON g.round = rb.kept_round"))
def fl13_rollback(spark, sf_dir):
    models = global_models(spark, sf_dir)
    rolled = federated.rollback(federated.validation(models, labelled_windows(spark, sf_dir)))
    return rounded(federated.in_force(models, rolled).select("round", "rolled_back", "kept_round", "key", "model"), "model")


@query(_rounds(f""", {_VALID}, {_BACK}, q AS (SELECT round, client_id, row_number() OVER (PARTITION BY round ORDER BY client_id) AS i FROM rep WHERE n > 3),
    ids AS (SELECT round, count(*) AS quarantined, string_agg(client_id, ',' ORDER BY client_id) FILTER (WHERE i <= 5) AS quarantined_ids FROM q GROUP BY 1)
    SELECT r.round, count(*) AS participated, coalesce(max(ids.quarantined), 0) AS quarantined, coalesce(max(ids.quarantined_ids), '') AS quarantined_ids, round(avg(least(r.n, 2.0)), 6) AS avg_delta_norm, 0.5 AS dp_noise, round(max(rb.auc), 6) AS auc, bool_or(rb.rolled_back) AS rolled_back
    FROM rep r LEFT JOIN ids ON ids.round = r.round LEFT JOIN rb ON rb.round = r.round GROUP BY 1"""))
def fl15_round_metadata(spark, sf_dir):
    newest = federated.latest_per_round(contributions(spark, sf_dir), most_updates(spark, sf_dir)).select("round", "client_id", "us", "pre_norm", "post_norm", "was_clipped", "quality")
    judged = federated.rollback(federated.validation(global_models(spark, sf_dir), labelled_windows(spark, sf_dir)))
    out = federated.round_metadata(federated.reputation(newest, "pre_norm", 3.0), judged)
    return rounded(out.withColumn("quarantined_ids", F.array_join("quarantined_ids", ",")), "avg_delta_norm", "auc")


# -- the older servers' rounds ------------------------------------------------------------------------------------

_QUALITY = "least(2.0, greatest(0.1, least(1.0, samples / 100.0)) * CASE WHEN variance > 0 THEN least(variance / 50, 1.2) ELSE 1.0 END * least(1 + anomaly_rate / 2, 1.3))"


@query(f"""WITH RECURSIVE fl AS ({_FL.replace("{orders}", "orders")}), lo AS ({_LONG}), base AS (SELECT *, {_QUALITY} AS quality FROM fl), ends AS (SELECT round, round * {DAY} AS t FROM base GROUP BY 1, 2),
    m AS (SELECT e.round, b.client_id, arg_max(b.round, b.round) AS src FROM base b JOIN ends e ON b.round * {DAY} <= e.t AND b.round * {DAY} > e.t - 3 * {DAY} GROUP BY 1, 2),
    w AS (SELECT m.round, m.client_id, m.src, b.quality, b.samples FROM m JOIN base b ON b.client_id = m.client_id AND b.round = m.src),
    sh AS (SELECT round, client_id, src, 0.7 * quality / sum(quality) OVER (PARTITION BY round) + 0.3 * samples / sum(samples) OVER (PARTITION BY round) AS share FROM w),
    mean AS (SELECT sh.round, lo.key, sum(lo.value * sh.share) / sum(sh.share) AS value, count(*) AS clients FROM sh JOIN lo ON lo.client_id = sh.client_id AND lo.round = sh.src GROUP BY 1, 2),
    mi AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY round) AS i FROM mean),
    x AS (SELECT key, round, i, clients, value, CAST(value - 0.01 * (value - 1) AS DOUBLE) AS model, CAST(value - 0.01 * (value - 1) - 1 AS DOUBLE) AS mom FROM mi WHERE i = 1
        UNION ALL SELECT m.key, m.round, m.i, m.clients, m.value, m.value - 0.01 * (m.value - x.model) + 0.9 * x.mom, m.value - 0.01 * (m.value - x.model) + 0.9 * x.mom - x.model FROM x JOIN mi m ON m.key = x.key AND m.i = x.i + 1)
    SELECT round, key, clients, round(value, 6) AS value, round(model, 6) AS model FROM x""")
def fl10_prox_rounds(spark, sf_dir):
    """Members of the last three rounds, shares by quality and data."""
    rows = federated.members(contributions(spark, sf_dir), 3 * DAY, most_updates(spark, sf_dir))
    shares = federated.client_weights(rows.select("round", "client_id", "weights", "quality", "samples"), older=True)
    means = federated.shared_mean(federated.long_form(shares.select("round", "share", "weights")))
    return rounded(federated.prox_rounds(means, {k: 1.0 for k in WEIGHT_KEYS}).select("round", "key", "clients", "value", "model"), "value", "model")


@query(_fl(f"WITH fl, lo AS ({_LONG}) SELECT round, key, round(median(value), 6) AS value, count(*) AS clients FROM lo GROUP BY 1, 2"))
def fl17_median_baselines(spark, sf_dir):
    return rounded(federated.group_medians(federated.long_form(updates(spark, sf_dir))), "value")


@query(_fl(f"""WITH fl, lo AS ({_LONG}), r AS (SELECT *, count(*) OVER (PARTITION BY round, key) AS n, row_number() OVER (PARTITION BY round, key ORDER BY value, client_id) AS i FROM lo)
    SELECT round, key, round(sum(value * samples) / sum(samples), 6) AS value, count(*) AS kept FROM r WHERE n <= 2 * greatest(1, floor(n * 0.1)) OR (i > greatest(1, floor(n * 0.1)) AND i <= n - greatest(1, floor(n * 0.1))) GROUP BY 1, 2"""))
def fl8_weighted_trimmed_mean(spark, sf_dir):
    return rounded(federated.trimmed_mean(federated.long_form(updates(spark, sf_dir)), weight="samples"), "value")


# -- baselines of all clients, agents' updates ----------------------------------------------------------------------

_LAST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY client_id, metric ORDER BY us DESC, id DESC) AS r FROM ({_METRICS}) m) x WHERE r <= 200"


@query(f"SELECT metric, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, count(*) AS samples FROM ({_LAST}) l GROUP BY 1")
def w3_global_moments(spark, sf_dir):
    return rounded(baselines.merged_moments(baselines.baseline_stats(metrics(spark, sf_dir)), "metric").select("metric", "mean", "std", "samples"), "mean", "std")


@query(f"""WITH everyone AS (SELECT metric, avg(value) AS gm, stddev_pop(value) AS gs FROM ({_LAST}) l GROUP BY 1),
    y AS (SELECT id, metric, value, count(value) OVER p AS n, 0.6 * avg(value) OVER p + 0.4 * gm AS m, 0.6 * stddev_pop(value) OVER p + 0.4 * gs AS s FROM ({_METRICS}) x JOIN everyone USING (metric) WINDOW p AS (PARTITION BY client_id, metric ORDER BY us, id ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING))
    SELECT id, coalesce(round(CASE WHEN n >= 10 AND s > 0 THEN (value - m) / s END, 5), -999) AS z, coalesce(CASE WHEN n >= 10 AND s > 0 THEN abs((value - m) / s) > 2.5 END, false) AS anomaly FROM y""")
def w3_blended_detect(spark, sf_dir):
    out = baselines.blended_detect(metrics(spark, sf_dir)).select("id", "z", "anomaly")
    return out.withColumn("z", F.coalesce(F.round("z", 5), F.lit(-999.0)))


@query(f"""WITH RECURSIVE m AS (SELECT *, row_number() OVER (PARTITION BY client_id, metric ORDER BY us, id) AS k, row_number() OVER (PARTITION BY client_id, metric ORDER BY us DESC, id DESC) AS back FROM ({_METRICS}) y),
    r AS (SELECT client_id, metric, k, value AS ema FROM m WHERE k = 1 UNION ALL SELECT m.client_id, m.metric, m.k, CAST(0.95 AS DOUBLE) * r.ema + CAST(0.05 AS DOUBLE) * m.value FROM r JOIN m ON m.client_id = r.client_id AND m.metric = r.metric AND m.k = r.k + 1),
    newest AS (SELECT r.client_id, r.metric, r.ema FROM r JOIN m ON m.client_id = r.client_id AND m.metric = r.metric AND m.k = r.k WHERE m.back = 1),
    st AS (SELECT client_id, metric, avg(value) AS mean, stddev_pop(value) AS std, var_pop(value) AS variance, count(*) AS samples, quantile_cont(value, 0.5) FILTER (WHERE back <= 50) AS q50 FROM m WHERE back <= 200 GROUP BY 1, 2),
    z AS (SELECT client_id, coalesce(CASE WHEN n >= 10 AND s > 0 THEN abs((value - a) / s) > 2.5 END, false) AS anomaly FROM (SELECT client_id, value, count(value) OVER p AS n, avg(value) OVER p AS a, stddev_pop(value) OVER p AS s FROM ({_METRICS}) y WINDOW p AS (PARTITION BY client_id, metric ORDER BY us, id ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING)) x),
    d AS (SELECT client_id, avg(CAST(anomaly AS INT)) AS rate, count(*) FILTER (WHERE anomaly) AS n FROM z GROUP BY 1)
    SELECT st.client_id, st.metric, round(mean + 1e-9, 5) AS mean, round(std, 5) AS std, round(variance, 3) AS variance, round(ema + 1e-9, 6) AS ema, round(q50, 5) AS q50, samples, round(d.rate, 6) AS anomaly_rate, d.n AS total_anomalies FROM st JOIN newest USING (client_id, metric) JOIN d USING (client_id)""")
def fl16_agent_updates(spark, sf_dir):
    m = metrics(spark, sf_dir)
    rows = federated.agent_update(baselines.baseline_stats(m), baselines.zscore_detect(m), baselines.ema(m), baselines.score_distribution(m))
    out = rows.select("client_id", F.explode("statistics").alias("metric", "s"), "anomaly_rate", "total_anomalies")
    r = lambda c, n: F.round(F.col(f"s.{c}"), n).alias(c)
    return out.select("client_id", "metric", F.round(F.col("s.mean") + 1e-9, 5).alias("mean"), r("std", 5), r("variance", 3), F.round(F.col("s.ema") + 1e-9, 6).alias("ema"), r("q50", 5), "s.samples", F.round("anomaly_rate", 6).alias("anomaly_rate"), "total_anomalies")


# -- operators that others use --------------------------------------------------------------------------------------


@query("""WITH a AS (SELECT 'client_' || CAST(user_id AS STRING) AS client_id, CASE event_id % 3 WHEN 0 THEN 'rejected' ELSE 'malformed' END AS kind FROM e WHERE event_id % 5 = 0), c AS (SELECT client_id, kind, count(*) AS n FROM a GROUP BY 1, 2)
    SELECT client_id, kind, n FROM c UNION ALL SELECT '(all)', kind, sum(n) FROM c GROUP BY kind""")
def a12_rejection_stats(spark, sf_dir):
    audit = telemetry(spark, sf_dir)["events"].filter("event_id % 5 = 0").select("client_id", F.when(F.col("event_id") % 3 == 0, "rejected").otherwise("malformed").alias("kind"))
    return federated.rejection_stats(audit).withColumn("client_id", F.coalesce("client_id", F.lit("(all)")))


@query(f"SELECT id, list_transform([0, 5, 11], lambda k: {_group_sql(f'({_FEATURE_NAMES})[CAST((id + k) % {len(FEATURES)} AS INT) + 1]')})[1] AS first_group, round(least(10.0, (abs(risk_score) + abs(risk_score - 7)) / 2), 6) AS mean_risk, printf('%.2f', CAST(round(CAST(CAST(CASE WHEN id % 3 = 0 THEN risk_score ELSE risk_score / 12 * 12 / 2 END AS VARCHAR) AS DECIMAL(38, 20)), 2) AS DOUBLE)) AS shown FROM alerts", "alerts")
def x13_x14_scores(spark, sf_dir):
    a = _ml_alerts(spark, sf_dir)
    r = -F.col("iso_score") * 12
    shown = scalars.shown_score(F.col("ensemble_score"), r / 2)
    return a.select("id", scalars.feature_group(F.try_element_at("contributing_features", F.lit(1))).alias("first_group"), F.round(scalars.group_risk(F.array(r, r - 7)), 6).alias("mean_risk"), shown.alias("shown"))


@query("SELECT id, CASE WHEN last IS NULL THEN n >= 20 ELSE (n >= 150 AND us - last >= 900000000) OR us - last >= 3600000000 END AS due FROM (SELECT id, us, lag(us) OVER w AS last, row_number() OVER w AS n FROM alerts WINDOW w AS (PARTITION BY client_id ORDER BY us, id)) x", "alerts")
def m10_retrain_due(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("client_id").orderBy("us", "id")
    a = telemetry(spark, sf_dir)["alerts"].withColumns({"last": F.lag("us").over(w), "n": F.row_number().over(w)})
    return a.select("id", ensemble.retrain_due(F.col("last"), F.col("n"), F.col("us")).alias("due"))


@query(_rounds("SELECT round, round(2.5 * avg(model), 6) AS threshold FROM g WHERE key LIKE '%threshold' GROUP BY 1"))
def m11_federated_threshold(spark, sf_dir):
    weights = global_models(spark, sf_dir).groupBy("round").agg(F.map_from_entries(F.collect_list(F.struct("key", "model"))).alias("w"))
    return weights.select("round", F.round(ensemble.federated_threshold(F.col("w")), 6).alias("threshold"))
