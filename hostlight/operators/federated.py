"""Federated rounds on update tables: validation, screening, clipping, reputation, aggregation, noise, rollback.

An update is (round, client_id, us, weights map<string,double>, samples, anomaly_rate, ...). Long form: (round, client_id,
key, value).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import WEIGHT_KEYS
from ..sources.store import dealt, kept
from .carry import fold
from .evaluate import areas
from .scan import numbered


def validate(updates: DataFrame) -> DataFrame:
    """Adds status: accepted, or malformed if a map or a weight is missing or a weight isn't finite."""
    w = F.col("weights")
    finite = [w[k].isNotNull() & ~F.isnan(w[k]) & (F.abs(w[k]) < float("inf")) for k in WEIGHT_KEYS]
    good = w.isNotNull() & F.col("statistics").isNotNull() & F.col("data_quality").isNotNull()
    for f in finite:
        good = good & F.coalesce(f, F.lit(False))
    return updates.withColumn("status", F.when(good, "accepted").otherwise("malformed"))


def screen(updates: DataFrame, least: int = 10, rate: float = 0.5, size: float = 1000, norm: float = 30) -> DataFrame:
    """Adds accepted, reason, warning: too few samples, weights too large, norm before clipping too large."""
    largest = F.array_max(F.transform(F.map_values("weights"), F.abs))
    reason = F.when(F.col("samples") < least, "insufficient_samples").when(largest > size, "weight_out_of_range").when(F.col("pre_norm") > norm, "norm_too_large")
    return updates.withColumns({"accepted": reason.isNull(), "reason": reason, "warning": F.when(F.col("anomaly_rate") > rate, "high_anomaly_rate")})


def rejection_stats(audit: DataFrame) -> DataFrame:
    """Rejections by client and kind, and in total (client_id null)."""
    each = audit.groupBy("client_id", "kind").agg(F.count("*").alias("n"))
    return each.unionByName(each.groupBy("kind").agg(F.sum("n").alias("n")).withColumn("client_id", F.lit(None).cast("string")))


def latest_per_round(updates: DataFrame, rows: int | None = None) -> DataFrame:
    """A client's newest update of each round. With `rows` (how many there are at most) tasks hold the same at any size."""
    updates = updates if rows is None else dealt(updates, rows, "round", "client_id")
    order = Window.partitionBy("round", "client_id").orderBy(F.desc("us"))
    return updates.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def delta_clip(updates: DataFrame, current: Column, bound: float = 10.0) -> DataFrame:
    """Adds delta (over shared keys), pre_norm, post_norm, was_clipped: deltas longer than the bound are shortened to it."""
    shared = F.map_filter("weights", lambda k, v: current[k].isNotNull())
    out = updates.withColumn("delta", F.transform_values(shared, lambda k, v: v - current[k]))
    length = F.sqrt(F.aggregate(F.map_values("delta"), F.lit(0.0), lambda a, x: a + x * x))
    out = out.withColumn("pre_norm", length)
    scale = F.when(F.col("pre_norm") > bound, bound / F.col("pre_norm")).otherwise(1.0)
    return out.withColumns({"was_clipped": F.col("pre_norm") > bound, "delta": F.transform_values("delta", lambda k, v: v * scale), "post_norm": F.least(F.col("pre_norm"), F.lit(bound))})


def quality(samples: Column, variance: Column, rate: Column) -> Column:
    """At most 2: samples, variety and anomalies, each within its bounds."""
    volume = F.greatest(F.lit(0.1), F.least(F.lit(1.0), samples / 100))
    variety = F.when(variance > 0, F.least(variance / 50, F.lit(1.2))).otherwise(1.0)
    return F.least(F.lit(2.0), volume * variety * F.least(1 + rate / 2, F.lit(1.3)))


def reputation_step(state: dict, norm: float, clipped: bool, quarantined: bool) -> tuple[float, float, int]:
    """Reputation, mean norm and clips after a client's next update; the state starts with reputation 1."""
    r = state.get("r", 1.0)
    state["n"] = state.get("n", 0) + 1
    if not clipped and norm < 5:
        r = min(2.0, r * 1.02)
    if state["n"] > 10:
        r = min(2.0, r * 1.01)
    if clipped:
        r = max(0.1, r * 0.98)
    if quarantined:
        r = max(0.1, r * 0.90)
    if norm > 10:
        r = max(0.1, r * 0.95)
    state.update(r=r, sum=state.get("sum", 0.0) + norm, clips=state.get("clips", 0) + bool(clipped))
    return r, state["sum"] / state["n"], state["clips"]


def reputation_steps(norms: Sequence[float], clipped: Sequence[bool], quarantined: Sequence[bool]) -> list[float]:
    """Reputation after each update of a client, in order, from 1."""
    state: dict = {}
    return [reputation_step(state, n, c, q)[0] for n, c, q in zip(norms, clipped, quarantined, strict=True)]


def reputation(contributions: DataFrame, quarantine_on: str = "post_norm", above: float = 15.0) -> DataFrame:
    """Adds was_quarantined, reputation, mean_norm and clips per client in time order (us); computed once and kept."""
    rows = contributions.withColumn("was_quarantined", F.coalesce(F.col(quarantine_on) > above, F.lit(False)))
    out = {"reputation": "double", "mean_norm": "double", "clips": "long"}
    return kept(fold(rows, ["client_id"], ["post_norm", "was_clipped", "was_quarantined"], dict, reputation_step, out, ("us",)))


def client_weights(updates: DataFrame, older: bool = False) -> DataFrame:
    """Adds share, summing to 1 in each round: 0.6 of reputation and 0.4 of quality (older: 0.7 of quality, 0.3 of data)."""
    used = {"quality": 0.7, "samples": 0.3} if older else {"reputation": 0.6, "quality": 0.4}
    # sums by round are a small table that joins back, so that no task holds all clients of a round
    sums = F.broadcast(updates.groupBy("round").agg(*[F.sum(c).alias(f"_{c}") for c in used], F.count("*").alias("_clients")))  # a row per round
    part = lambda c: F.when(F.col(f"_{c}") > 0, F.col(c) / F.col(f"_{c}")).otherwise(1 / F.col("_clients"))
    mixed = sum((w * part(c) for c, w in used.items()), F.lit(0.0))
    # each part sums to 1 over a round, and so do the weights: the shares do as well
    return updates.join(sums, "round").withColumn("share", mixed).drop("_clients", *[f"_{c}" for c in used])


def long_form(updates: DataFrame, column: str = "weights") -> DataFrame:
    keep = [c for c in updates.columns if c not in (column, "statistics", "data_quality")]
    return updates.select(*keep, F.explode(column).alias("key", "value"))


def fed_avg(long: DataFrame, samples: str | None = None) -> DataFrame:
    """Mean of each key and round, plain or weighted by samples."""
    mean = F.avg("value") if samples is None else F.sum(F.col("value") * F.col(samples)) / F.sum(samples)
    return long.groupBy("round", "key").agg(mean.alias("value"), F.count("*").alias("clients"))


def trimmed_mean(long: DataFrame, share: float = 0.1, weight: str | None = None) -> DataFrame:
    """Mean of each round and key without the k = max(1, floor(share n)) largest and smallest, if n > 2k; ties by client.

    Ranks come from one range partitioning of all values, so no task holds the clients of a round and key.
    """
    sizes = long.groupBy("round", "key").agg(F.count("*").alias("_n"))
    ranked = numbered(long, ["round", "key"], [F.col("value"), F.col("client_id")], "_r").join(sizes, ["round", "key"])
    k = F.greatest(F.lit(1), F.floor(F.col("_n") * share))
    inner = ranked.filter((F.col("_n") <= 2 * k) | ((F.col("_r") > k) & (F.col("_r") <= F.col("_n") - k)))
    mean = F.avg("value") if weight is None else F.sum(F.col("value") * F.col(weight)) / F.sum(weight)
    return inner.groupBy("round", "key").agg(mean.alias("value"), F.count("*").alias("kept"))


def clamp(key: Column, value: Column) -> Column:
    """Thresholds within 1..5, sensitivities within 0.3..2, alpha and beta within 0..1."""
    between = lambda a, b: F.greatest(F.lit(a), F.least(F.lit(b), value))
    return F.when(key.contains("threshold"), between(1.0, 5.0)).when(key.contains("sensitivity"), between(0.3, 2.0)).when(key.contains("alpha") | key.contains("beta"), between(0.0, 1.0)).otherwise(value)


def clamped(key: str, value: float) -> float:
    low, high = (1.0, 5.0) if "threshold" in key else (0.3, 2.0) if "sensitivity" in key else (0.0, 1.0) if "alpha" in key or "beta" in key else (-np.inf, np.inf)
    return min(high, max(low, value))


def global_rounds(means: DataFrame, start: dict[str, float], rate: float = 0.5, momentum: float = 0.9, simple: bool = False) -> DataFrame:
    """The global model after each round, from (round, key, value): a momentum step towards the round's mean, clamped.

    Sums come from Spark; the fold over rounds runs per key. simple: rate 0.3, no momentum, no clamp.
    """
    if simple:
        rate, momentum = 0.3, 0.0

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("round", ignore_index=True)
        key = pdf["key"].iloc[0]
        value, speed, out = start.get(key, 1.0), 0.0, []
        for target in pdf["value"]:
            speed = momentum * speed + (1 - momentum) * (target - value)
            value = value + rate * speed
            value = value if simple else clamped(key, value)
            out.append(value)
        return pdf.assign(model=out)

    return means.groupBy("key").applyInPandas(run, means.withColumn("model", F.lit(0.0)).schema)


def shared_mean(long: DataFrame, shares: DataFrame | None = None) -> DataFrame:
    """Mean of each key and round, weighted by the clients' shares of the round: a column of `long`, or (round, client_id, share)."""
    both = long if shares is None else long.join(shares.select("round", "client_id", "share"), ["round", "client_id"])
    return both.groupBy("round", "key").agg((F.sum(F.col("value") * F.col("share")) / F.sum("share")).alias("value"), F.count("*").alias("clients"))


def column_means(shared: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`shared_mean` of updates with a column for each key, which all of them have: a row of sums per round instead of long rows."""
    sums = shared.groupBy("round").agg(*[F.sum(F.col(k) * F.col("share")).alias(k) for k in keys], F.sum("share").alias("_share"), F.count("*").alias("clients"))
    each = F.array(*[F.struct(F.lit(k).alias("key"), (F.col(k) / F.col("_share")).alias("value")) for k in keys])
    return sums.select("round", "clients", F.inline(each)).select("round", "key", "value", "clients")


def fed_prox(long: DataFrame, current: Column, mu: float = 0.01) -> DataFrame:
    """Values pulled towards the current model: v - mu (v - g)."""
    return long.withColumn("value", F.col("value") - mu * (F.col("value") - current))


def gaussian_noise(means: DataFrame, clip: float = 10.0, scale: float = 0.5, seed: int = 7) -> DataFrame:
    """Adds Gaussian noise of scale * 2 * clip / clients, and its scale."""
    out = means.withColumn("noise_scale", scale * 2 * clip / F.col("clients"))
    return out.withColumn("value", F.col("value") + F.randn(seed) * F.col("noise_scale"))


def laplace_noise(means: DataFrame, epsilon: float = 1.0, seed: int = 7) -> DataFrame:
    out = means.withColumn("_u", F.rand(seed) - 0.5)
    return out.withColumn("value", F.col("value") - (1 / epsilon) * F.signum("_u") * F.log1p(-2 * F.abs("_u"))).drop("_u")


def heuristic_auc(mean_threshold: Column) -> Column:
    """Area to assume when fewer than 20 labelled windows are there."""
    return F.greatest(F.lit(0.7), F.least(F.lit(0.95), 0.85 + (2.5 - mean_threshold) * 0.05))


def validation(models: DataFrame, labelled: DataFrame, least: int = 20) -> DataFrame:
    """Per round of a global model (round, key, model): auc, tpr and fpr over labelled windows, and how many there are.

    labelled: id, label, and z_network, z_process, z_file (null: not seen). A window's score under a round is its largest z
    over that round's threshold by sensitivity, and it is detected above 1. Windows are counted by their values once, and the
    counts go through all rounds. With fewer than `least` windows, or without both labels, the area is the heuristic one.
    """
    names = ("network", "process", "file")
    wide = models.groupBy("round").pivot("key", WEIGHT_KEYS).agg(F.first("model"))
    limits = wide.select("round", *[(F.col(f"{n}_threshold") / F.col(f"{n}_sensitivity")).alias(n) for n in names], (sum(F.col(f"{n}_threshold") for n in names) / 3).alias("mean_threshold"))
    # windows with the same values count together in every round
    alike = labelled.groupBy(*[F.abs(f"z_{n}").alias(f"z_{n}") for n in names]).agg(F.count("*").alias("windows"), F.count_if("label").alias("p"), F.count_if(~F.col("label")).alias("n"))
    alike = kept(alike)
    score = F.greatest(*[F.coalesce(F.abs(F.col(f"z_{n}") / F.col(n)), F.lit(0.0)) for n in names])
    scored = alike.crossJoin(F.broadcast(limits)).select("round", "windows", "p", "n", score.alias("score"))  # a row per round is broadcast
    hit = lambda c: F.coalesce(F.try_divide(F.sum(F.when(F.col("score") > 1, F.col(c)).otherwise(0)), F.sum(c)), F.lit(0.0))
    rates = scored.groupBy("round").agg(F.sum("windows").alias("windows"), hit("p").alias("tpr"), hit("n").alias("fpr"))
    curve = areas(scored.select(F.col("round").alias("model"), "score", "p", "n"), alike.count() * limits.count())
    found = curve.select(F.col("model").alias("round"), F.col("auc").alias("_auc"))
    out = limits.select("round", "mean_threshold").join(rates, "round", "left").join(found, "round", "left")
    seen = F.coalesce(F.col("windows"), F.lit(0))
    area = F.when(seen >= least, F.col("_auc"))
    return out.select("round", seen.alias("windows"), F.coalesce(area, heuristic_auc(F.col("mean_threshold"))).alias("auc"), F.coalesce("tpr", F.lit(0.0)).alias("tpr"), F.coalesce("fpr", F.lit(0.0)).alias("fpr"))


def rollback(rounds: DataFrame, drop: float = 0.02) -> DataFrame:
    """Adds rolled_back and kept_round to (round, auc): rounds whose area is more than `drop` below that of the last kept
    one are rolled back, and the model of that one, kept_round, stays in force."""

    def step(state: dict, number: int, area: float) -> tuple[bool, int]:
        back = "auc" in state and area < state["auc"] - drop
        if not back:
            state.update(auc=area, round=number)
        return back, state["round"]

    one = rounds.withColumn("_all", F.lit(0))  # a row per round
    return fold(one, ["_all"], ["round", "auc"], dict, step, {"rolled_back": "boolean", "kept_round": "long"}, ("round",)).drop("_all")


def in_force(models: DataFrame, rolled: DataFrame) -> DataFrame:
    """The model in force after each round (round, key, model), rolled back ones replaced by the last kept."""
    kept_models = models.select(F.col("round").alias("kept_round"), "key", "model")
    return rolled.select("round", "kept_round", "rolled_back").join(kept_models, "kept_round")


def members(updates: DataFrame, span: int = 600_000_000, rows: int | None = None) -> DataFrame:
    """Updates by round as the older server takes them: each client's newest one of the last `span` before the round's end.

    A round ends with its last update. An update counts in the rounds that end from it on, before the client's next one and within
    the span, so that each is sorted once, whatever the number of rounds; of updates at one time, one counts. With `rows` (how
    many updates there are at most) tasks hold the same at any size.
    """
    ends = F.broadcast(updates.groupBy("round").agg(F.max("us").alias("_end")).withColumn("_slot", F.floor(F.col("_end") / span)))  # a row per round
    sent = updates.drop("round") if rows is None else dealt(updates.drop("round"), rows, "client_id")
    sent = sent.withColumn("_next", F.lead("us").over(Window.partitionBy("client_id").orderBy("us")))
    by = F.floor(F.col("us") / span)
    sent = sent.withColumn("_slot", F.explode(F.array(by, by + 1)))
    here = (F.col("_end") >= F.col("us")) & (F.col("_end") - F.col("us") < span) & (F.col("_next").isNull() | (F.col("_end") < F.col("_next")))
    return sent.join(ends, "_slot").filter(here).drop("_slot", "_end", "_next")


def prox_rounds(means: DataFrame, start: dict[str, float], mu: float = 0.01, momentum: float = 0.9) -> DataFrame:
    """The older server's model after each round, from share-weighted means (round, key, value): values are pulled to the
    model by mu, and a part of the last change is added."""

    def step(state: dict, key: str, value: float) -> tuple[float]:
        g = state.get("g", start.get(key, value))
        new = value - mu * (value - g) + momentum * state.get("m", 0.0)
        state.update(g=new, m=new - g)
        return (new,)

    return fold(means, ["key"], ["key", "value"], dict, step, {"model": "double"}, ("round",))


def group_medians(long: DataFrame) -> DataFrame:
    """Median of each key and round, by ranks from one range partitioning."""
    sizes = long.groupBy("round", "key").agg(F.count("value").alias("clients"))
    ranked = numbered(long.filter(F.col("value").isNotNull()), ["round", "key"], [F.col("value"), F.col("client_id")], "_r").join(sizes, ["round", "key"])
    middle = ranked.filter(F.abs(2 * F.col("_r") - 1 - F.col("clients")) <= 1)
    return middle.groupBy("round", "key", "clients").agg(F.avg("value").alias("value")).select("round", "key", "value", "clients")


def convergence(models: DataFrame, stable: float = 0.01, last: int = 20) -> DataFrame:
    """Root mean square change of the six weights to the round before, and whether it is stable; newest rounds only."""
    order = Window.partitionBy("key").orderBy("round")
    moved = models.filter(F.col("key").isin(*WEIGHT_KEYS)).withColumn("d", F.col("model") - F.lag("model").over(order))
    out = moved.groupBy("round").agg(F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("delta")).filter(F.col("delta").isNotNull())
    return out.orderBy(F.desc("round")).limit(last).withColumn("status", F.when(F.col("delta") < stable, "Stable").otherwise("Converging"))


def round_metadata(contributions: DataFrame, judged: DataFrame | None = None, noise: float = 0.5, first: int = 5) -> DataFrame:
    """Per round: participants, quarantined clients (and the first of their ids), mean norm, noise; with `judged` (round, auc,
    rolled_back) its area and whether it was rolled back."""
    bad = contributions.filter("was_quarantined").select("round", "client_id")
    ids = bad.withColumn("_r", F.row_number().over(Window.partitionBy("round").orderBy("client_id"))).filter(F.col("_r") <= first)
    ids = ids.groupBy("round").agg(F.array_sort(F.collect_list("client_id")).alias("quarantined_ids"))
    out = contributions.groupBy("round").agg(F.count("*").alias("participated"), F.count_if("was_quarantined").alias("quarantined"), F.avg("post_norm").alias("avg_delta_norm"))
    out = out.join(ids, "round", "left").withColumns({"quarantined_ids": F.coalesce("quarantined_ids", F.array().cast("array<string>")), "dp_noise": F.lit(noise)})
    return out if judged is None else out.join(judged.select("round", "auc", "rolled_back"), "round", "left")


def leaderboard(contributions: DataFrame, as_of: int) -> DataFrame:
    """Per client: updates, newest quality and reputation, norms, clips, quarantines, activity; best reputation first."""
    age = (F.lit(as_of) - F.col("last_us")) / 1e6
    out = contributions.groupBy("client_id").agg(
        F.count("*").alias("updates"), F.max_by("quality", "us").alias("quality"), F.max_by("reputation", "us").alias("reputation"), F.avg("post_norm").alias("avg_norm"),
        F.avg(F.col("was_clipped").cast("double")).alias("clip_ratio"), F.count_if("was_quarantined").alias("quarantines"), F.max("us").alias("last_us"),
    )
    status = F.when(age < 600, "Active").when(age < 3600, "Idle").otherwise("Inactive")
    return out.withColumn("status", status).orderBy(F.desc("reputation"), "client_id")


def agent_update(stats: DataFrame, detections: DataFrame, averages: DataFrame | None = None, distribution: DataFrame | None = None) -> DataFrame:
    """One update row per client: statistics by metric (mean, std, variance, ema, samples), quartiles of scores, and the share of anomalies.

    averages: client_id, metric, us, id, ema, of which the newest count; distribution: client_id, metric, q25, q50, q75.
    """
    if averages is not None:
        stats = stats.join(averages.groupBy("client_id", "metric").agg(F.max_by("ema", F.struct("us", "id")).alias("ema")), ["client_id", "metric"], "left")
    if distribution is not None:
        stats = stats.join(distribution.select("client_id", "metric", "q25", "q50", "q75"), ["client_id", "metric"], "left")
    parts = [c for c in stats.columns if c not in ("client_id", "metric")]
    packed = stats.groupBy("client_id").agg(F.map_from_entries(F.collect_list(F.struct("metric", F.struct(*parts)))).alias("statistics"), F.sum("samples").alias("samples"))
    rates = detections.groupBy("client_id").agg(F.avg(F.col("anomaly").cast("double")).alias("anomaly_rate"), F.count_if("anomaly").alias("total_anomalies"))
    return packed.join(rates, "client_id", "left").na.fill(0)
