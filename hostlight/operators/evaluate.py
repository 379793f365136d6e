"""Model evaluation: curves, area, confusion, summaries. Rows are (model, score, label) with label true or false.

Points are per distinct score; cumulative counts run over distinct scores of a model, not over rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scan import Sums, numbered, scan


def scaled_scores(df: DataFrame, score: str = "iso_score", epsilon: float = 1e-9) -> DataFrame:
    """Inverts scores (lower was odder) and scales them to 0..1."""
    ends = df.agg(F.min(-F.col(score)).alias("_low"), F.max(-F.col(score)).alias("_high"))
    return df.crossJoin(F.broadcast(ends)).withColumn("scaled", (-F.col(score) - F.col("_low")) / (F.col("_high") - F.col("_low") + epsilon)).drop("_low", "_high")


def roc_points(df: DataFrame) -> DataFrame:
    """Per model and distinct score, descending: cumulative true and false positives and their rates (0 without a class).

    Sums run in two phases over range-partitioned scores, so that a model of all rows isn't one task.
    """
    counts = F.count_if("label").cast("double").alias("p"), F.count_if(~F.col("label")).cast("double").alias("n")
    grouped = df.groupBy("model", "score").agg(*counts)
    totals = df.groupBy("model").agg(F.count_if("label").alias("all_p"), F.count_if(~F.col("label")).alias("all_n"))
    running = scan(grouped, ["model"], [F.desc("score")], Sums(tp="p", fp="n"))
    out = running.join(totals, "model").withColumns({c: F.col(c).cast("long") for c in ("p", "n", "tp", "fp")})
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.withColumns({"tpr": rate("tp", "all_p"), "fpr": rate("fp", "all_n")})


def auc(df: DataFrame) -> DataFrame:
    """Area under the curve by trapezoids, scores that tie together; null if a class is missing."""
    return areas(df.groupBy("model", "score").agg(F.count_if("label").alias("p"), F.count_if(~F.col("label")).alias("n"))).select("model", "auc")


def areas(counts: DataFrame, rows: int = 0, each: int = 4_000_000) -> DataFrame:
    """Per model: p, n and auc (null if a class is missing), from rows (model, score, p, n) that count true and false labels at
    a score; scores may repeat.

    Rows are sorted in ranges of model and score, no score in two of them. A range adds up the area over its own counts, and
    the false ones below the true ones of the ranges before it follow from the sums of ranges, so that each row is read
    once. With `rows` (how many there are at most) a range holds about `each`.
    """
    by = F.col("model").asc_nulls_first(), F.col("score").desc()
    least = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = (-(-rows // each),) if rows > least * each else ()
    odd = F.when(F.col("score").isNull(), 2).when(F.isnan(F.col("score").cast("double")), 1).otherwise(0)
    placed = counts.repartitionByRange(*ranges, *by).sortWithinPartitions(*by).withColumns({"_odd": odd, "_range": F.spark_partition_id()})
    plain = placed.withColumn("score", F.when(F.col("_odd") == 0, F.col("score")).otherwise(F.lit(0).cast(counts.schema["score"].dataType))).select("_range", "model", "score", "_odd", "p", "n")
    schema = plain.select("_range", F.lit(0).alias("_at"), "model", "p", "n", F.lit(0.0).alias("_area")).schema
    parts = plain.mapInPandas(part_areas, schema)
    before = Window.partitionBy("model").orderBy("_range", "_at").rowsBetween(Window.unboundedPreceding, -1)
    whole = F.col("_area") + F.col("n") * F.coalesce(F.sum("p").over(before), F.lit(0)).cast("double")
    sums = parts.withColumn("_area", whole).groupBy("model").agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum("_area").alias("_area"))
    return sums.select("model", "p", "n", (F.col("_area") / F.nullif(F.col("p").cast("double") * F.col("n"), F.lit(0.0))).alias("auc"))


def changes(column: pd.Series) -> np.ndarray:
    """Whether a value differs from the one before it, nulls being equal; true for the first."""
    values, null = column.to_numpy(), column.isna().to_numpy()
    return np.concatenate([[True], (values[1:] != values[:-1]).astype(bool) & ~(null[1:] & null[:-1])])


def part_areas(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts and area of each model in each batch of sorted rows. The last score of a batch waits for the next one."""
    waiting: list[pd.DataFrame] = []
    for at, pdf in enumerate(chain(batches, [None])):
        rows = pd.concat([*waiting, *([] if pdf is None else [pdf])], ignore_index=True) if waiting or pdf is not None else pd.DataFrame()
        if not len(rows):
            continue
        begin = np.flatnonzero(changes(rows["model"]) | changes(rows["score"]) | changes(rows["_odd"]))
        slices = rows.iloc[begin].assign(**{c: np.add.reduceat(rows[c].to_numpy(), begin) for c in ("p", "n")})
        if pdf is not None:
            slices, waiting = slices.iloc[:-1], [slices.iloc[-1:]]
        if not len(slices):
            continue
        first = np.flatnonzero(changes(slices["model"]))
        p, n = slices["p"].to_numpy(float), slices["n"].to_numpy(float)
        tp = np.cumsum(p)
        tp -= np.repeat(tp[first] - p[first], np.diff(np.append(first, len(p))))
        out = slices.iloc[first][["_range", "model"]]
        sums = {c: np.add.reduceat(slices[c].to_numpy(), first) for c in ("p", "n")}
        yield out.assign(_at=at, **sums, _area=np.add.reduceat(n * (tp - p / 2), first))[["_range", "_at", "model", "p", "n", "_area"]]


def pr_points(df: DataFrame) -> DataFrame:
    return roc_points(df).select("model", "score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.col("tpr").alias("recall"))


def confusion(df: DataFrame, above: float = 5.0) -> DataFrame:
    return df.groupBy("model", "label", (F.col("score") > above).alias("predicted")).agg(F.count("*").alias("n"))


def placeholder_labels(df: DataFrame, share: float = 0.9) -> DataFrame:
    """Rows after the first share of each model, in order of id, are anomalies."""
    sizes = df.groupBy("model").agg(F.count("*").alias("_n"))
    ranked = numbered(df, ["model"], [F.col("id")], "_r").join(sizes, "model")
    return ranked.withColumn("label", F.col("_r") > F.floor(F.col("_n") * share)).drop("_r", "_n")


def summary(df: DataFrame, features: int, version: int = 0) -> DataFrame:
    """Per client: samples, features and the area of each model there is (ensemble, iso, ae)."""
    areas = auc(df.withColumn("model", F.struct("client_id", "model"))).select("model.client_id", "model.model", "auc")
    wide = areas.groupBy("client_id").pivot("model", ["ensemble", "iso", "ae"]).agg(F.first("auc"))
    counts = df.filter("model = 'ensemble'").groupBy("client_id").agg(F.count("*").alias("samples"))
    return counts.join(wide, "client_id", "left").select("client_id", "samples", F.lit(features).alias("features"), F.col("ensemble").alias("ensemble_auc"), F.col("iso").alias("iso_auc"), F.col("ae").alias("ae_auc"), F.lit(version).alias("server_model_version"))
