"""Federated rounds of a stream of updates: pending updates wait until enough clients have sent one.

Tables below one path, which belongs to one streaming query and its checkpoint:

* `pending/epoch=N`: the updates of micro-batch N;
* `rounds/round=N`: the result of the round that micro-batch N completed;
* `log/epoch=N`: written last; up to which micro-batch updates have been used (`upto`), and what happened.

Whatever is written before the log is overwritten when a micro-batch is run again, and a micro-batch that is in the log isn't
run again, so each update goes into one round, whenever the job stops.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

LOG = "upto long, first_us long, clients long, aggregated boolean"


def logged(spark: SparkSession, path: str, epoch: int, schema: str):
    """The log's row of a micro-batch, None if it hasn't come to its end."""
    try:
        return spark.read.schema(schema).parquet(f"{path}/log/epoch={epoch}").first()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


class Rounds:
    """Runs `aggregate` over the newest pending update of each client, once `least` clients wait, or one for `longest` (us)."""

    def __init__(self, path: str, aggregate: Callable[[DataFrame], DataFrame], least: int = 2, longest: int | None = 120_000_000):
        self.path, self.aggregate, self.least, self.longest = path, aggregate, least, longest

    def __call__(self, df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        if logged(spark, self.path, epoch, LOG) is not None:
            return
        before = logged(spark, self.path, epoch - 1, LOG)
        upto, first = (before["upto"], before["first_us"]) if before is not None else (epoch - 1, None)
        df.write.mode("overwrite").parquet(f"{self.path}/pending/epoch={epoch}")
        waiting = spark.read.schema(df.schema).parquet(*[f"{self.path}/pending/epoch={e}" for e in range(upto + 1, epoch + 1)])
        newest = Window.partitionBy("client_id").orderBy(F.desc("us"))
        waiting = waiting.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")
        seen = waiting.agg(F.count("*").alias("clients"), F.min("us").alias("first"), F.max("us").alias("last")).first()
        clients, first = seen["clients"], seen["first"] if first is None else first
        full = clients >= self.least or (self.longest is not None and clients > 0 and seen["last"] - first >= self.longest)
        if full:
            self.aggregate(waiting.withColumn("round", F.lit(epoch))).write.mode("overwrite").parquet(f"{self.path}/rounds/round={epoch}")
        row = (epoch if full else upto, None if full else first, clients, full)
        spark.createDataFrame([row], LOG).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/epoch={epoch}")


def federated_rounds(updates: DataFrame, aggregate: Callable[[DataFrame], DataFrame], path: str, interval: str | None = "2 minutes", **how) -> DataStreamWriter:
    """Updates (client_id, us, ...) to rounds below `path`; the caller adds the checkpoint and starts it."""
    out = updates.writeStream.foreachBatch(Rounds(path, aggregate, **how))
    return out.trigger(processingTime=interval) if interval else out.trigger(availableNow=True)


def rounds(spark: SparkSession, path: str) -> DataFrame:
    """All rounds so far, with their number."""
    return spark.read.option("basePath", f"{path}/rounds").parquet(f"{path}/rounds/*")
