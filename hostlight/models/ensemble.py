"""The anomaly ensemble: weighted scores of z, forest, autoencoder and an optional flag; severity; explanation.

Rows have `vector` (normalised features in the order of FEATURES), iso_score, ae_error, ae_parts (null where a model
is missing). Everything is built-in columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import FEATURES

#: Weights of the components.
WEIGHTS = {"z": 0.20, "iso": 0.40, "ae": 0.35, "flag": 0.05}


def _feature(name: str) -> Column:
    return F.col("vector")[FEATURES.index(name)]


def scores(df: DataFrame, z_threshold: float = 3.0, ae_threshold: float | None = None, iso_cut: float = -0.7, flag: str | None = None) -> DataFrame:
    """Adds z_part, iso_part, ae_part, flag_part and ensemble_score (at most 10).

    z counts only if more than 7 features exceed its threshold; the sum is damped by 0.8 and grows by a tenth for each
    model beyond the first that scores above 6, if two or more do.
    """
    over = F.filter("vector", lambda x: F.abs(x) > z_threshold)
    capped = F.transform(over, lambda x: F.least(F.abs(x) / z_threshold, F.lit(2.0)))
    z = F.when(F.size(over) > 7, F.least(F.lit(10.0), F.aggregate(capped, F.lit(0.0), lambda a, x: a + x) / F.size(over) * 5)).otherwise(0.0)
    iso = F.when(F.col("iso_score") < iso_cut, F.least(F.abs("iso_score") * 12, F.lit(10.0))).otherwise(0.0)
    ae = F.lit(0.0) if ae_threshold is None else F.when(F.col("ae_error") > 1.5 * ae_threshold, F.least(F.col("ae_error") / ae_threshold * 6, F.lit(10.0))).otherwise(0.0)
    flagged = F.when(F.col(flag), 7.0).otherwise(0.0) if flag else F.lit(0.0)
    out = df.withColumns({"z_part": z, "iso_part": F.coalesce(iso, F.lit(0.0)), "ae_part": F.coalesce(ae, F.lit(0.0)), "flag_part": flagged})
    parts = [F.col(f"{n}_part") for n in WEIGHTS]
    total = sum((F.col(f"{n}_part") * w for n, w in WEIGHTS.items()), F.lit(0.0)) * 0.8
    strong = sum(((p > 6).cast("int") for p in parts), F.lit(0))
    return out.withColumn("ensemble_score", F.least(F.lit(10.0), F.when(strong >= 2, total * (1 + 0.1 * (strong - 1))).otherwise(total)))


def severity(df: DataFrame) -> DataFrame:
    """Adds severity, and raises it and the score for the pattern flags; critical is never lowered."""
    s = F.col("ensemble_score")
    level = F.when(s >= 9.5, "critical").when(s >= 8.5, "high").when(s >= 7.0, "medium").when(s >= 5.5, "low").otherwise("normal")
    ransom, c2, cred = (_feature(n) > 0 for n in ("ransomware_burst", "c2_pattern", "cred_dump_pattern"))
    raised = F.when(ransom, F.greatest(s, F.lit(9.5))).when(c2, F.greatest(s, F.lit(8.0))).when(cred, F.greatest(s, F.lit(7.5))).otherwise(s)
    named = F.when(ransom | (level == "critical"), "critical").when(c2 | cred, "high").otherwise(level)
    return df.withColumns({"severity": named, "ensemble_score": raised})


def top_features(values: Column, n: int = 5) -> Column:
    """Names of the features with the largest sizes, largest first."""
    names = F.array(*[F.lit(x) for x in FEATURES])
    pairs = F.transform(F.arrays_zip(values.alias("v"), names.alias("n")), lambda x: F.struct(-F.abs(x["v"]), x["n"].alias("n")))
    return F.transform(F.slice(F.array_sort(pairs), 1, n), lambda x: x["n"])


def contributing(df: DataFrame) -> DataFrame:
    """Adds contributing_features: the first 3 of each model that found something, in order, each once, at most 5."""
    none = F.array().cast("array<string>")
    iso = F.when(F.col("iso_part") > 0, F.slice(top_features(F.col("vector")), 1, 3)).otherwise(none)
    ae = F.when(F.col("ae_part") > 0, F.slice(top_features(F.col("ae_parts")), 1, 3)).otherwise(none)
    return df.withColumn("contributing_features", F.slice(F.array_distinct(F.concat(iso, ae)), 1, 5))


def heuristic(df: DataFrame) -> DataFrame:
    """Fallback without models: ransomware is critical 9.5, command and control high 8.5."""
    ransom, c2 = _feature("ransomware_burst") > 0, _feature("c2_pattern") > 0
    return df.withColumns({"ensemble_score": F.when(ransom, 9.5).when(c2, 8.5).otherwise(0.0), "severity": F.when(ransom, "critical").when(c2, "high").otherwise("normal")})


def tiered(df: DataFrame, iso_threshold: float | None, ae_threshold: float | None, flag: str | None = None) -> DataFrame:
    """First hit wins: over 8 features above 5 (high), forest below its threshold (medium), autoencoder error above its
    threshold (medium), flag (low). Adds tier, severity and features."""
    names = F.array(*[F.lit(x) for x in FEATURES])
    flagged = F.transform(F.filter(F.arrays_zip(F.col("vector").alias("v"), names.alias("n")), lambda x: F.abs(x["v"]) > 5), lambda x: x["n"])
    iso = F.lit(False) if iso_threshold is None else F.coalesce(F.col("iso_score") < iso_threshold, F.lit(False))
    ae = F.lit(False) if ae_threshold is None else F.coalesce(F.col("ae_error") > ae_threshold, F.lit(False))
    low = F.col(flag) if flag else F.lit(False)
    z = F.size(flagged) > 8
    tier = F.when(z, "z").when(iso, "iso").when(ae, "ae").when(low, "flag").otherwise("none")
    level = F.when(z, "high").when(iso | ae, "medium").when(low, "low").otherwise("normal")
    found = F.when(z, flagged).when(iso, F.slice(top_features(F.col("vector")), 1, 3)).when(ae, F.slice(top_features(F.col("ae_parts")), 1, 3)).otherwise(F.array().cast("array<string>"))
    return df.withColumns({"tier": tier, "severity": level, "features": found})


def any_of_three(z: Column, iso: Column, ae: Column) -> Column:
    """The short form of the detector."""
    return F.coalesce(z, F.lit(False)) | F.coalesce(iso, F.lit(False)) | F.coalesce(ae, F.lit(False))


def retrain_due(last_us: Column, rows: Column, now_us: Column) -> Column:
    """Never trained: from 20 rows; else after 15 minutes with 150 rows, or after an hour."""
    age = (now_us - last_us) / 1e6
    return F.when(last_us.isNull(), rows >= 20).otherwise(((age >= 900) & (rows >= 150)) | (age >= 3600))


def federated_threshold(weights: Column) -> Column:
    """The z threshold from a map of federated weights: 2.5 times the mean of the thresholds."""
    values = F.array(*[weights[f"{k}_threshold"] for k in ("network", "process", "file")])
    there = F.filter(values, lambda x: x.isNotNull())
    return F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, x: a + x) / F.size(there) * 2.5)
