"""Streams against batch results on the given events, with a restart between, lost commits and micro-batches run again."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from hostlight.functions.fixed import WEIGHT_KEYS
from hostlight.operators import baselines, detectors, federated, fleet
from hostlight.plans.queries import _FACTS, _TOP, contributions
from hostlight.sources.tables import derived, read, telemetry
from hostlight.streaming import jobs, rounds, state, views

SF = "/root/testdata/sf0.001"
DAY = 86_400_000_000


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    state.use_rocksdb(spark, to_the_end=True)
    spark.conf.set("spark.sql.shuffle.partitions", 2)
    yield
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")


def in_files(df, path, n, order=("us", "id")):
    """Parquet files of consecutive rows, whose times of change are in their order."""
    rows = df.toPandas().sort_values(list(order), ignore_index=True)
    os.makedirs(path, exist_ok=True)
    for k, part in enumerate(np.array_split(np.arange(len(rows)), n)):
        name = f"{path}/part-{k}.parquet"
        rows.iloc[part].to_parquet(name, index=False, coerce_timestamps="us")
        os.utime(name, (1_700_000_000 + 10 * k,) * 2)


def source(spark, df, path):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def run_twice(spark, df, stream, path, n=4, order=("us", "id")):
    """The output of a stream over `df` in n files, stopped and started again after half of them."""
    for begin, end in ((0, n // 2), (n // 2, n)):
        in_files(df, f"{path}/all", n, order)
        os.makedirs(f"{path}/in", exist_ok=True)
        for k in range(begin, end):
            os.rename(f"{path}/all/part-{k}.parquet", f"{path}/in/part-{k}.parquet")
        out = stream(source(spark, df, f"{path}/in"))
        q = out.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start()
        assert q.awaitTermination(240) and q.exception() is None
    return spark.read.parquet(f"{path}/out").toPandas()


def same(got, want, columns, key=("id",)):
    got, want = (d.sort_values(list(key), ignore_index=True)[columns] for d in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=1e-9)


def metrics(spark):
    return telemetry(spark, SF)["events"].select("client_id", F.col("event_type").alias("metric"), "us", F.col("event_id").alias("id"), "value")


def test_baselines_and_averages(spark, tmp_path):
    m = metrics(spark)
    got = run_twice(spark, m, lambda s: state.baseline_stream(s, least=5), str(tmp_path))
    z = baselines.zscore_detect(m, least=5).toPandas().assign(z=lambda d: d.z.astype(float))
    same(got.assign(z=got.z.astype(float)), z, ["id", "z", "anomaly"])
    same(got, baselines.ema(m).toPandas(), ["id", "ema"])
    assert got.z.notna().sum() > 50


def test_known_files(spark, tmp_path):
    files = telemetry(spark, SF)["filesystem_data"].select("id", "us", F.when(F.col("id") % 11 > 0, F.col("file_hash")).alias("file_hash"), "risk_score")
    got = run_twice(spark, files, state.known_file_stream, str(tmp_path))
    same(got, detectors.hash_novelty(files).toPandas(), ["id", "novel", "risk_after"])


def test_reputations(spark, tmp_path):
    c = contributions(spark, SF).select("client_id", "us", "round", "post_norm", "was_clipped").filter("client_id < 'client_12'")
    got = run_twice(spark, c, state.reputation_stream, str(tmp_path), order=("us", "client_id"))
    same(got, federated.reputation(c).toPandas(), ["client_id", "us", "reputation", "mean_norm", "clips"], ("client_id", "us"))


def test_histories(spark, tmp_path):
    net = telemetry(spark, SF)["network_data"].filter("client_id < 'client_12'")
    got = run_twice(spark, net.select("client_id", "dst_ip", "dst_port", "id", "us", "src_port"), state.history_stream, str(tmp_path))
    same(got, fleet.running_history(net).toPandas(), ["id", "conn_n", "ports_n"])


def test_suppression_and_sessions(spark, tmp_path):
    from hostlight.operators import dedup

    a = spark.createDataFrame([(f"s{k % 3}", k, ["critical", "low"][k % 2], 1_000_000_000 + k * 20) for k in range(60)], "signature string, id long, severity string, s long").withColumn("ts", F.timestamp_seconds("s")).withColumn("us", F.col("s") * 1_000_000)
    got = run_twice(spark, a.drop("s"), lambda s: jobs.dedup_stream(s, "30 minutes"), f"{tmp_path}/a")
    assert sorted(got.id) == sorted(r["id"] for r in dedup.ttl_dedup(a).filter("kept").collect())
    snaps = [("c", 0, ["a"]), ("c", 1, ["a"]), ("d", 1, ["x"]), ("c", 2, ["b"]), ("d", 2, []), ("c", 3, ["a", "b"])]
    s = spark.createDataFrame(snaps, "client_id string, s long, sessions array<string>").withColumn("ts", F.timestamp_seconds("s")).select("client_id", "ts", "sessions")
    got = run_twice(spark, s, jobs.session_stream, f"{tmp_path}/s", 2, ("ts", "client_id"))
    # a snapshot without sessions shows in the stream only; the batch operator has rows of open sessions
    assert sorted((r.client_id, r.ms, r.session, r.event) for r in got.itertuples()) == [("c", 0, "a", "login"), ("c", 2000, "a", "logout"), ("c", 2000, "b", "login"), ("c", 3000, "a", "login"), ("d", 1000, "x", "login"), ("d", 2000, "x", "logout")]


def test_heartbeats_and_sliding_logins(spark, tmp_path):
    beats = spark.createDataFrame([("a", 0), ("b", 10), ("b", 60), ("b", 120), ("b", 300), ("c", 301), ("c", 500)], "client_id string, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000_000)).select("client_id", "ts")
    got = run_twice(spark, beats, jobs.heartbeat_stream, f"{tmp_path}/b", order=("ts", "client_id"))
    events = sorted((r.client_id, r.status) for r in got.itertuples())
    assert events.count(("a", "online")) == 1 and ("a", "offline") in events and ("c", "online") in events and events.count(("b", "online")) == 1
    logins = spark.createDataFrame([("c", "9.9.9.9", k * 100) for k in range(5)] + [("c", "1.1.1.1", 0), ("c", "8.8.8.8", 9000), ("c", "8.8.8.8", 9001)], "client_id string, source_ip string, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000_000)).drop("s")
    got = run_twice(spark, logins, jobs.sliding_counts, f"{tmp_path}/l", 8, ("ts", "source_ip"))
    assert set(got.source_ip) == {"9.9.9.9"} and got.n.max() == 5 and len(got) == len(jobs.sliding_counts(logins).collect())


# -- rounds ----------------------------------------------------------------------------------------------------


def updates(spark, rows):
    data = [(c, us, {k: v for k in WEIGHT_KEYS}) for c, us, v in rows]
    return spark.createDataFrame(data, "client_id string, us long, weights map<string,double>")


def mean(df):
    return federated.fed_avg(federated.long_form(df))


def in_rounds(spark, path):
    return {r["round"]: (r["value"], r["clients"]) for r in rounds.rounds(spark, path).filter(F.col("key") == WEIGHT_KEYS[0]).collect()}


def test_one_client_per_batch_waits_for_another(spark, tmp_path):
    path = str(tmp_path / "fl")
    step = rounds.Rounds(path, mean, longest=None)
    batches = [("a", 1, 2.0), ("b", 2, 4.0), ("b", 3, 9.0), ("b", 4, 1.0), ("c", 5, 3.0)]
    for epoch, row in enumerate(batches):
        step(updates(spark, [row]), epoch)
    want = {1: (3.0, 2), 4: (2.0, 2)}  # of b's two pending updates the newer one counts
    assert in_rounds(spark, path) == want
    for epoch in (1, 4, 2):
        step(updates(spark, [batches[epoch]]), epoch)  # run again: they are in the log
    assert in_rounds(spark, path) == want and spark.read.parquet(f"{path}/log/*").count() == 5


def test_a_lone_client_after_its_time(spark, tmp_path):
    path = str(tmp_path / "fl")
    step = rounds.Rounds(path, mean)
    for epoch, us in enumerate((0, 60_000_000, 120_000_000, 130_000_000)):
        step(updates(spark, [("a", us, float(epoch))]), epoch)
    assert in_rounds(spark, path) == {2: (2.0, 1)}


def test_a_batch_that_stopped_before_its_log_is_run_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "fl")
    step = rounds.Rounds(path, mean, longest=None)
    step(updates(spark, [("a", 1, 2.0)]), 0)

    def stop(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:  # after the round's table, before the log
        m.setattr(type(spark), "createDataFrame", stop)
        rows = updates
        with pytest.raises(RuntimeError):
            m.undo()
            df = rows(spark, [("b", 2, 4.0)])
            m.setattr(type(spark), "createDataFrame", stop)
            step(df, 1)
    assert in_rounds(spark, path) == {1: (3.0, 2)} and rounds.logged(spark, path, 1, rounds.LOG) is None
    step(updates(spark, [("b", 2, 4.0)]), 1)
    step(updates(spark, [("c", 3, 8.0)]), 2)
    assert in_rounds(spark, path) == {1: (3.0, 2)} and rounds.logged(spark, path, 2, rounds.LOG)["upto"] == 1


def test_rounds_of_a_stream_with_lost_commits(spark, tmp_path):
    path = str(tmp_path)
    df = updates(spark, [(f"c{k % 4}", k, float(k)) for k in range(8)])
    rows = df.select("client_id", "us", F.to_json("weights").alias("w"))
    in_files(rows, f"{path}/in", 8, ("us",))
    parsed = lambda s: s.select("client_id", "us", F.from_json("w", "map<string,double>").alias("weights"))

    def run():
        q = rounds.federated_rounds(parsed(source(spark, rows, f"{path}/in")), mean, f"{path}/fl", None, longest=None).option("checkpointLocation", f"{path}/cp").start()
        assert q.awaitTermination(240) and q.exception() is None

    run()
    want = {k: (k - 0.5, 2) for k in (1, 3, 5, 7)}
    assert in_rounds(spark, f"{path}/fl") == want
    for name in ("7", ".7.crc"):  # the last micro-batch ended, but its commit is lost
        os.remove(f"{path}/cp/commits/{name}")
    run()
    assert in_rounds(spark, f"{path}/fl") == want


# -- standing views --------------------------------------------------------------------------------------------


def test_standing_views_equal_the_union(spark, tmp_path):
    path = str(tmp_path)
    events, customer = telemetry(spark, SF)["events"], read(spark, SF, "customer")
    last = events.agg(F.max("us")).first()[0]
    events = events.filter(F.col("us") > last - 3 * DAY).select("event_id", "user_id", "event_type", "value", "client_id", "us")
    registry = telemetry(spark, SF)["clients"].select("client_id", "federated_learning")
    details = {n: (v, d) for n, (v, d) in _TOP.items()}
    named = {
        "a1": views.client_stats(registry), "a2": views.event_counts(_FACTS), "a3": views.alert_stats(), "a4": views.user_stats(), "a5": views.hourly_timeline(),
        "t1": views.active_alerts(20), "t2": views.recent_alerts(DAY // 3, 2), "t3": views.top_risks(details, 2, 5),
    }
    standing = views.Standing(f"{path}/views", named, derived)
    for begin, end in ((0, 2), (2, 4)):
        in_files(events, f"{path}/all", 4, ("us", "event_id"))
        os.makedirs(f"{path}/in", exist_ok=True)
        for k in range(begin, end):
            os.rename(f"{path}/all/part-{k}.parquet", f"{path}/in/part-{k}.parquet")
        q = views.standing_views(source(spark, events, f"{path}/in"), standing, None).option("checkpointLocation", f"{path}/cp").start()
        assert q.awaitTermination(300) and q.exception() is None
        union = spark.read.parquet(f"{path}/in")
        t, as_of = derived(union, customer), union.agg(F.max("us")).first()[0]
        want = {
            "a1": fleet.client_stats(t["clients"]), "a2": fleet.event_counts({n: t[v] for n, v in _FACTS.items()}, as_of), "a3": fleet.alert_stats(t["alerts"], as_of), "a4": fleet.user_stats(t["user_activity"], as_of),
            "a5": fleet.hourly_timeline(t["network_data"], as_of), "t1": fleet.active_alerts(t["alerts"], 20).select("id", "client_id", "us", "risk_score"),
            "t2": fleet.recent_alerts_per_client(t["alerts"], as_of, DAY // 3, 2), "t3": fleet.top_risks({n: (t[v], d) for n, (v, d) in _TOP.items()}, as_of, 2, 5),
        }
        for name, df in want.items():
            w, g = df.toPandas(), standing.current(spark, name).toPandas()[df.columns]
            by = list(df.columns)
            pd.testing.assert_frame_equal(g.sort_values(by, ignore_index=True), w.sort_values(by, ignore_index=True), check_dtype=False, atol=1e-9, obj=name)
    before = {n: standing.current(spark, n).toPandas() for n in named}
    standing(union.limit(50), 3)  # run again: it is in the log
    standing.forget(spark, 3, keep=1)
    for n, w in before.items():
        pd.testing.assert_frame_equal(standing.current(spark, n).toPandas(), w)
    kept = spark.read.option("basePath", f"{path}/views/rows").parquet(f"{path}/views/rows/*")
    assert kept.agg(F.min("hour")).first()[0] >= (last - DAY) // views.HOUR and not os.path.exists(f"{path}/views/state/a2/epoch=2")
