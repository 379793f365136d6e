"""Steps whose tasks hold the same at any size of the table."""

from hostlight.operators import federated
from hostlight.sources.store import dealt


def test_dealt_grows_with_rows(spark):
    df = spark.range(1_000)
    assert dealt(df, 1_000, "id", each=10).rdd.getNumPartitions() == 100
    assert dealt(df, 1_000, "id").rdd.getNumPartitions() == 4


def test_members_sort_each_update_once(spark):
    """Against a look at every pair of round and update; rows aren't multiplied before the sort."""
    rows = [(c, r, 100 * r + 7 * (c % 5)) for c in range(12) for r in range(1, 30) if (c + r) % (c % 4 + 1) == 0]
    u = spark.createDataFrame(rows, "client_id long, round long, us long")
    ends = {r: max(us for _, k, us in rows if k == r) for _, r, _ in rows}
    want = {(r, c, max(us for k, _, us in rows if k == c and end - 450 < us <= end)) for r, end in ends.items() for c in range(12) if any(k == c and end - 450 < us <= end for k, _, us in rows)}
    got = federated.members(u, 450, len(rows))
    assert {(r["round"], r["client_id"], r["us"]) for r in got.collect()} == want and got.count() == len(want)
    plan = u.sparkSession._jvm.PythonSQLUtils.explainString(federated.members(u, 450)._jdf.queryExecution(), "simple")
    assert plan.index("Generate") < plan.index("Window")  # top down: the rounds of an update come after the sort


def test_shares_need_no_join_of_long_rows(spark):
    u = spark.createDataFrame([(1, "a", 1.0, 30.0, {"x": 2.0}), (1, "b", 3.0, 10.0, {"x": 6.0})], "round int, client_id string, quality double, samples double, weights map<string,double>")
    shared = federated.client_weights(u, older=True)
    long = federated.long_form(shared.select("round", "share", "weights"))
    [row] = federated.shared_mean(long).collect()
    assert abs(row["value"] - (2 * (0.7 / 4 + 0.3 * 3 / 4) + 6 * (0.7 * 3 / 4 + 0.3 / 4))) < 1e-12 and row["clients"] == 2


def test_flow_counts_are_dealt_out_by_their_number(spark, tmp_path, monkeypatch):
    """Many small partitions hold the flows and their counts."""
    from hostlight.plans import queries

    spark.range(600).selectExpr("id % 7 AS l_suppkey", "id % 11 AS l_partkey", "DATE'2024-01-01' + CAST(id % 3 AS INT) AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(queries, "dealt", lambda df, rows, *keys: dealt(df, rows, *keys, each=10))
    got = queries.scale_flow_counts(spark, str(tmp_path))
    rows = {(r["client"], r["day"]): (r["flows"], r["destinations"]) for r in got.collect()}
    ids = [i for i in range(600) if i % 7 == 2 and i % 3 == 1]
    assert len(rows) == 21 and rows["2", "2024-01-02"] == (len(ids), len({i % 11 for i in ids})) and got.rdd.getNumPartitions() == 60


def test_models_score_in_one_worker(spark):
    import numpy as np

    from hostlight.models import autoencoder, forest

    x = np.random.default_rng(0).normal(size=(50, 3))
    m = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)], "id long, vector array<double>")
    trees, model = [forest.grow(x, np.random.default_rng(k), 6) for k in range(5)], autoencoder.Autoencoder.fresh(np.zeros(3), np.ones(3), 0)
    both = autoencoder.score(forest.score(m, trees, 50), model)
    plan = spark._jvm.PythonSQLUtils.explainString(both._jdf.queryExecution(), "simple")
    assert plan.count("ArrowEvalPython") == 1
    want = -np.exp2(-np.mean([forest.depths(t, x) for t in trees], axis=0) / float(forest.expected_depth(50)))
    got = both.orderBy("id").toPandas()
    assert np.allclose(got["iso_score"], want) and np.allclose(got["ae_error"], model.errors(x).mean(1))


def test_global_models_are_computed_once_from_one_table(spark):
    """No join of long rows, and the models, which several steps read, are kept."""
    from hostlight.functions.fixed import WEIGHT_KEYS
    from hostlight.plans import queries

    rows = [(1 + k % 3, f"c{k}", 0.5 + k % 4, *[float(k * i % 7) for i in range(len(WEIGHT_KEYS))]) for k in range(20)]
    u = spark.createDataFrame(rows, "round int, client_id string, share double, " + ", ".join(f"{k} double" for k in WEIGHT_KEYS))
    long = u.unpivot(["round", "client_id", "share"], list(WEIGHT_KEYS), "key", "value")
    want = {(r["round"], r["key"]): (round(r["value"], 9), r["clients"]) for r in federated.shared_mean(long).collect()}
    assert {(r["round"], r["key"]): (round(r["value"], 9), r["clients"]) for r in federated.column_means(u, WEIGHT_KEYS).collect()} == want
    plan = spark._jvm.PythonSQLUtils.explainString(queries.global_models(spark, "/root/testdata/sf0.001")._jdf.queryExecution(), "simple")
    assert "Exchange" not in plan and "Join" not in plan


def test_fold_passes_other_columns_as_they_are(spark):
    from hostlight.operators.carry import fold

    rows = [("a", 1, float("nan"), 2**60 + 1), ("a", 2, None, None), (None, 3, 1.5, 7)]
    df = spark.createDataFrame(rows, "client_id string, us long, x double, big long")
    step = lambda state, x: (state.append(x) or len(state), state[-1] is None)
    got = fold(df, ["client_id"], ["x"], list, step, {"n": "long", "none": "boolean"}, ("us",)).orderBy("us").collect()
    assert [(r["n"], r["none"], r["big"]) for r in got] == [(1, True, 2**60 + 1), (2, True, None), (1, False, 7)]
    assert got[0]["x"] != got[0]["x"] and got[1]["x"] is None


def test_windows_are_counted_once_for_all_rounds(spark, monkeypatch):
    """What is kept has a row for each kind of window, not one for each window and round."""
    from hostlight.functions.fixed import WEIGHT_KEYS
    from hostlight.sources import store

    sizes = []
    monkeypatch.setattr(federated, "kept", lambda df: (lambda k: sizes.append(k.count()) or k)(store.kept(df)))
    models = spark.createDataFrame([(r, k, 1.0 + r % 3 if "threshold" in k else 0.5 + r / 9) for r in range(1, 10) for k in WEIGHT_KEYS], "round int, key string, model double")
    seen = [(k, k % 5 == 0, float(k % 7 - 3) if k % 2 else None, None, float(k % 4) if k % 3 else None) for k in range(400)]
    seen += [(400, True, float("nan"), None, None), (401, None, 2.0, 1.0, None), (402, True, float("inf"), None, None)]
    labelled = spark.createDataFrame(seen, "id long, label boolean, z_network double, z_process double, z_file double")
    got = {r["round"]: r for r in federated.validation(models, labelled).collect()}
    assert sum(sizes) <= 40 and len(got) == 9
    for r in range(1, 10):
        limit = (1.0 + r % 3) / (0.5 + r / 9)
        score = lambda w: float("inf") if any(z != z for z in w[2:] if z is not None) else max(abs(z) / limit if z is not None else 0.0 for z in w[2:])  # noqa: B023, E731
        odd = {w[0] for w in seen if w[2] is not None and w[2] != w[2]}  # NaN is the largest of all
        up, down = [(w[0] in odd, score(w)) for w in seen if w[1]], [(w[0] in odd, score(w)) for w in seen if w[1] is False]
        area = sum((a > b) + (a == b) / 2 for a in up for b in down) / len(up) / len(down)
        assert got[r]["windows"] == 403 and abs(got[r]["auc"] - area) < 1e-12
        assert abs(got[r]["tpr"] - sum(s > 1 for _, s in up) / len(up)) < 1e-12 and abs(got[r]["fpr"] - sum(s > 1 for _, s in down) / len(down)) < 1e-12


def test_areas_over_many_ranges_and_batches(spark):
    """Scores that repeat, within and across batches; models of one row, without a class, without a name."""
    import numpy as np

    from hostlight.operators import evaluate

    rng = np.random.default_rng(4)
    rows = [(None if k % 11 == 0 else f"m{k % 3}", None if k % 50 == 0 else float("nan") if k % 37 == 0 else float(rng.integers(0, 12)), int(rng.integers(0, 4)), int(rng.integers(0, 3))) for k in range(900)]
    rows += [("one", 1.0, 3, 0), ("none", 1.0, 0, 0)]
    df = spark.createDataFrame(rows, "model string, score double, p long, n long").repartition(5)
    place = lambda s: -1.0 if s is None else 99.0 if s != s else s
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for much in (0, 900):
            got = {r["model"]: r for r in evaluate.areas(df, much, each=30).collect()}
            assert set(got) == {None, "m0", "m1", "m2", "one", "none"} and got["one"]["auc"] is None and got["none"]["auc"] is None
            for m in (None, "m0", "m1", "m2"):
                mine = [(place(s), p, n) for model, s, p, n in rows if model == m]
                p, n = sum(r[1] for r in mine), sum(r[2] for r in mine)
                pairs = sum(a[1] * b[2] * ((a[0] > b[0]) + (a[0] == b[0]) / 2) for a in mine for b in mine)
                assert (got[m]["p"], got[m]["n"]) == (p, n) and abs(got[m]["auc"] - pairs / p / n) < 1e-12
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
