"""Baselines per client and metric: statistics of the last values, adaptive z-scores, moving averages, sensitivity.

Metrics are long rows (client_id, metric, us, id, value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles
from .scan import Bounded, Forgetting, scan

KEY = ("client_id", "metric")


def _order():
    return Window.partitionBy(*KEY).orderBy("us", "id")


def baseline_stats(metrics: DataFrame, last: int = 200) -> DataFrame:
    """Mean, population deviation and variance, and number, of the last values of each client and metric."""
    newest = Window.partitionBy(*KEY).orderBy(F.desc("us"), F.desc("id"))
    kept = metrics.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= last)
    return kept.groupBy(*KEY).agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.var_pop("value").alias("variance"), F.count("*").alias("samples"))


def merged_moments(stats: DataFrame, *keys: str) -> DataFrame:
    """Mean, population deviation and variance of all values, from those of parts (mean, variance, samples) by key.

    Squares are taken around the common mean, so that large means don't cancel.
    """
    sums = stats.groupBy(*keys).agg(F.sum("samples").alias("_n"), (F.sum(F.col("mean") * F.col("samples")) / F.sum("samples")).alias("_mean"))
    spread = F.col("samples") * (F.col("variance") + (F.col("mean") - F.col("_mean")) * (F.col("mean") - F.col("_mean")))
    out = stats.join(sums, list(keys)).groupBy(*keys, "_n", "_mean").agg(F.sum(spread).alias("_m2"))
    variance = F.col("_m2") / F.col("_n")
    return out.select(*keys, F.col("_mean").alias("mean"), F.sqrt(variance).alias("std"), variance.alias("variance"), F.col("_n").alias("samples"))


def blended_detect(metrics: DataFrame, **how) -> DataFrame:
    """`zscore_detect` against 60 % of the client's own and 40 % of all clients' mean and deviation of the metric."""
    everyone = merged_moments(baseline_stats(metrics), "metric").select("metric", F.col("mean").alias("global_mean"), F.col("std").alias("global_std"))
    return zscore_detect(metrics.join(everyone, "metric"), **how)


def score_distribution(scores: DataFrame, last: int = 50) -> DataFrame:
    """Quartiles and mean of the last scores of each client and metric, linearly interpolated."""
    newest = Window.partitionBy(*KEY).orderBy(F.desc("us"), F.desc("id"))
    kept = scores.withColumn("rank", F.row_number().over(newest)).filter(F.col("rank") <= last)
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return kept.groupBy(*KEY).agg(q.alias("q"), F.avg("value").alias("mean")).select(*KEY, F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "mean")


def zscore_detect(metrics: DataFrame, threshold: float = 2.5, sensitivity: float = 1.0, last: int = 200, least: int = 10, local_share: float = 0.6) -> DataFrame:
    """Adds z and anomaly: the value against the last values before it.

    Columns global_mean and global_std, if there are, are blended in (1 - local_share); without them the local ones count
    alone. Fewer than `least` values before, or no spread: no anomaly, null z.
    """
    past = _order().rowsBetween(-last, -1)
    n, mean, std = F.count("value").over(past), F.avg("value").over(past), F.stddev_pop("value").over(past)
    if "global_mean" in metrics.columns:
        blend = lambda own, other: F.when(F.col(other).isNull(), own).otherwise(local_share * own + (1 - local_share) * F.col(other))
        mean, std = blend(mean, "global_mean"), blend(std, "global_std")
    out = metrics.withColumns({"_n": n, "_mean": mean, "_std": std})
    z = F.when((F.col("_n") >= least) & (F.col("_std") > 0), (F.col("value") - F.col("_mean")) / F.col("_std"))
    out = out.withColumn("z", z)
    return out.withColumn("anomaly", F.coalesce(F.abs("z") > threshold / sensitivity, F.lit(False))).drop("_n", "_mean", "_std")


def ema(metrics: DataFrame, alpha: float = 0.95) -> DataFrame:
    """Adds ema: alpha times the average before plus the rest of the value, seeded by the first value."""

    return scan(metrics, KEY, [F.col("us"), F.col("id")], Forgetting(alpha))


#: Variance above which sensitivity grows and below which it falls, by metric.
SENSITIVITY = {"network": (15.0, 3.0), "process": (8.0, 2.0)}


def adapt_sensitivity(metrics: DataFrame, last: int = 20) -> DataFrame:
    """Adds factor: 1.05 for a restless metric, 0.95 for a calm one, 1 otherwise and with no more than `last` values."""
    frame = _order().rowsBetween(-(last - 1), 0)
    upto = _order().rowsBetween(Window.unboundedPreceding, 0)
    out = metrics.withColumns({"variance": F.var_pop("value").over(frame), "_n": F.count("*").over(upto)})
    high = F.lit(None).cast("double")
    low = F.lit(None).cast("double")
    for name, (h, l_) in SENSITIVITY.items():
        high, low = F.when(F.col("metric") == name, h).otherwise(high), F.when(F.col("metric") == name, l_).otherwise(low)
    factor = F.when(F.col("_n") <= last, 1.0).when(F.col("variance") > high, 1.05).when(F.col("variance") < low, 0.95).otherwise(1.0)
    return out.withColumn("factor", factor).drop("_n")


def running_sensitivity(metrics: DataFrame, start: float = 1.0, low: float = 0.5, high: float = 2.0, last: int = 20) -> DataFrame:
    """Adds factor and sensitivity: the start times the factors of a client's metric up to the row, within bounds after each."""
    return scan(adapt_sensitivity(metrics, last).withColumn("factor", F.col("factor").cast("double")), KEY, [F.col("us"), F.col("id")], Bounded(start, low, high))


def iqr_clean(matrix: DataFrame, columns: list[str], times: float = 3.0, least: int = 20, remain: int = 15) -> DataFrame:
    """Rows within `times` interquartile ranges of the quartiles in every column; all rows if there are fewer than
    `least`, or if fewer than `remain` would stay. Quartiles are counted in passes over all columns at once."""
    if matrix.limit(least).count() < least:
        return matrix
    test = F.lit(True)
    for c, (a, b) in quantiles(matrix, columns, [0.25, 0.75]).items():
        if a is not None:
            test = test & F.col(c).between(a - times * (b - a), b + times * (b - a))
    kept = matrix.filter(test)
    return kept if kept.limit(remain).count() >= remain else matrix
