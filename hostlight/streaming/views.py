"""Standing views of a stream: hourly partial results, merged into an accumulated table with each micro-batch.

A view over the last hours is the merge of the partial results of its whole hours, and of the rows of the one hour that its
span cuts, which are kept by hour for that. Tables below one path, which belongs to one streaming query:

* `rows/epoch=N/hour=H`: rows of micro-batch N;
* `state/<view>/epoch=N`: partial results by hour after micro-batch N, without hours that no span reaches any more;
* `shown/<view>/epoch=N`: the view after micro-batch N;
* `log/epoch=N`: written last, with the newest time (`as_of`).

A micro-batch that is run again overwrites what it wrote; one that is in the log isn't run again. `forget` deletes what is
older than the last micro-batches and hours.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.fixed import LOCAL_SOURCES
from ..operators import fleet
from .rounds import logged

HOUR, DAY = fleet.HOUR, fleet.DAY
LOG = "as_of long"
Tables = Mapping[str, DataFrame]


@dataclass
class View:
    """`part` makes partial results (with `hour`, null for all times) of tables, `merge` joins them, `show` makes the view.

    `span` is how far back the view goes, None for all times.
    """

    part: Callable[[Tables], DataFrame]
    merge: Callable[[DataFrame], DataFrame]
    show: Callable[[DataFrame, int], DataFrame]
    span: int | None = DAY


def _hour() -> Column:
    return F.floor(F.col("us") / HOUR).cast("long").alias("hour")


def _summed(*keys: str) -> Callable[[DataFrame], DataFrame]:
    return lambda p: p.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in p.columns if c not in keys])


def _top(n: int, keys: tuple[str, ...], *order: Column) -> Callable[[DataFrame], DataFrame]:
    """The first rows of each key; without keys, of all."""
    if not keys:
        return lambda p: p.orderBy(*order).limit(n)
    return lambda p: p.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def event_counts(facts: Mapping[str, str]) -> View:
    def part(t: Tables) -> DataFrame:
        out = None
        for name, table in facts.items():
            rows = t[table].groupBy(_hour()).agg(F.count("*").alias("events")).withColumn("category", F.lit(name))
            out = rows if out is None else out.unionByName(rows)
        return out

    def show(p: DataFrame, as_of: int) -> DataFrame:
        every = p.sparkSession.createDataFrame([(n,) for n in facts], "category string")
        return every.join(p.groupBy("category").agg(F.sum("events").alias("events")), "category", "left").na.fill(0)

    return View(part, _summed("hour", "category"), show)


def alert_stats() -> View:
    critical, high = F.count_if(F.col("severity") == "critical"), F.count_if(F.col("severity") == "high")
    part = lambda t: t["alerts"].filter("status = 'active'").groupBy(_hour()).agg(F.count("*").alias("total"), critical.alias("critical"), high.alias("high"))
    none = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    show = lambda p, as_of: p.agg(none("total"), none("critical"), none("high")).withColumn("other", F.col("total") - F.col("critical") - F.col("high"))
    return View(part, _summed("hour"), show)


def user_stats() -> View:
    remote, high = F.count_if(~F.col("source_ip").isin(*LOCAL_SOURCES)), F.count_if(F.col("risk_score") > 5)
    part = lambda t: t["user_activity"].groupBy(_hour(), "username").agg(F.count("*").alias("logins"), remote.alias("remote"), high.alias("high_risk"))
    none = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    show = lambda p, as_of: p.agg(none("logins"), F.countDistinct("username").alias("users"), none("remote"), none("high_risk"))
    return View(part, _summed("hour", "username"), show)


def hourly_timeline(table: str = "network_data") -> View:
    part = lambda t: t[table].groupBy(_hour()).agg(F.count("*").alias("events"), F.sum("risk_score").alias("risk"))

    def show(p: DataFrame, as_of: int) -> DataFrame:
        hours = p.sparkSession.range(as_of // HOUR - 24, as_of // HOUR + 1).select(F.col("id").alias("hour"))
        sums = p.groupBy("hour").agg(F.sum("events").alias("events"), F.sum("risk").alias("risk"))
        return hours.join(sums, "hour", "left").select("hour", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce(F.col("risk") / F.col("events"), F.lit(0.0)).alias("avg_risk"))

    return View(part, _summed("hour"), show)


def client_stats(registry: DataFrame, online: int = DAY) -> View:
    """Of a registry (client_id, federated_learning): clients whose last event is recent are online."""
    none = F.lit(None).cast("long").alias("hour")
    part = lambda t: t["events"].groupBy("client_id").agg(F.max("us").alias("heartbeat")).withColumn("hour", none)
    merge = lambda p: p.groupBy("client_id").agg(F.max("heartbeat").alias("heartbeat"), F.max("hour").alias("hour"))

    def show(p: DataFrame, as_of: int) -> DataFrame:
        seen = F.when(F.col("heartbeat") >= as_of - online, "online").otherwise("offline")
        return fleet.client_stats(registry.join(p, "client_id", "left").withColumn("status", seen))

    return View(part, merge, show, None)


def active_alerts(limit: int = 100) -> View:
    first = _top(limit, (), F.desc("us"), F.desc("risk_score"), F.col("id"))
    part = lambda t: first(t["alerts"].filter("status = 'active'").select(F.lit(None).cast("long").alias("hour"), "id", "client_id", "us", "risk_score"))
    return View(part, first, lambda p, as_of: first(p).drop("hour"), None)


def recent_alerts(span: int = 300_000_000, top: int = 5) -> View:
    order = F.desc("risk_score"), F.col("id")
    text = F.concat_ws(": ", "title", "description").alias("text")
    first = _top(top, ("hour", "client_id"), *order)
    part = lambda t: first(t["alerts"].filter("status = 'active'").select(_hour(), "client_id", "id", "risk_score", text))

    def show(p: DataFrame, as_of: int) -> DataFrame:
        ranked = p.withColumn("rank", F.row_number().over(Window.partitionBy("client_id").orderBy(*order)))
        return ranked.filter(F.col("rank") <= top).select("client_id", "rank", "risk_score", "text")

    return View(part, first, show, span)


def top_risks(details: Mapping[str, tuple[str, str]], each: int = 5, limit: int = 15) -> View:
    order = F.desc("risk"), F.col("id")
    first = _top(each, ("hour", "category"), *order)

    def part(t: Tables) -> DataFrame:
        out = None
        for name, (table, detail) in details.items():
            rows = t[table].filter(F.col("risk_score") > 5).select(_hour(), F.lit(name).alias("category"), "client_id", F.col(detail).alias("detail"), F.col("risk_score").alias("risk"), "id")
            out = rows if out is None else out.unionByName(rows)
        return first(out)

    show = lambda p, as_of: _top(each, ("category",), *order)(p.drop("hour")).orderBy(F.desc("risk"), "category", "id").limit(limit)
    return View(part, first, show)


class Standing:
    """Keeps views of an event stream; `tables` makes the views' tables from events (with `us`)."""

    def __init__(self, path: str, views: Mapping[str, View], tables: Callable[[DataFrame], Tables]):
        self.path, self.views, self.tables = path, dict(views), tables

    def __call__(self, events: DataFrame, epoch: int) -> None:
        spark = events.sparkSession
        if logged(spark, self.path, epoch, LOG) is not None:
            return
        before = logged(spark, self.path, epoch - 1, LOG)
        events.withColumn("hour", F.floor(F.col("us") / HOUR).cast("long")).write.mode("overwrite").partitionBy("hour").parquet(f"{self.path}/rows/epoch={epoch}")
        events = spark.read.schema(events.schema).parquet(f"{self.path}/rows/epoch={epoch}")
        newest = [v for v in (events.agg(F.max("us")).first()[0], before["as_of"] if before else None) if v is not None]
        if newest:
            self._merge(spark, events, epoch, before is not None, max(newest))
        spark.createDataFrame([(max(newest, default=None),)], LOG).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/log/epoch={epoch}")

    def _merge(self, spark: SparkSession, events: DataFrame, epoch: int, more: bool, as_of: int) -> None:
        new = self.tables(events)
        every = spark.read.option("basePath", f"{self.path}/rows").schema(events.withColumn("hour", F.lit(0).cast("long")).schema).parquet(f"{self.path}/rows/*")
        for name, view in self.views.items():
            part = view.part(new)
            if more:
                part = part.unionByName(spark.read.schema(part.schema).parquet(f"{self.path}/state/{name}/epoch={epoch - 1}"))
            state = view.merge(part)
            edge = None if view.span is None else (as_of - view.span) // HOUR
            if edge is not None:
                state = state.filter(F.col("hour") >= edge)
            at = f"{self.path}/state/{name}/epoch={epoch}"
            state.write.mode("overwrite").parquet(at)
            state = spark.read.schema(state.schema).parquet(at)
            if edge is not None:  # the hour that the span cuts comes from its rows
                cut = view.part(self.tables(every.filter((F.col("hour") == edge) & (F.col("us") >= as_of - view.span)).drop("hour")))
                state = state.filter(F.col("hour") > edge).unionByName(cut)
            view.show(state, as_of).write.mode("overwrite").parquet(f"{self.path}/shown/{name}/epoch={epoch}")

    def current(self, spark: SparkSession, name: str) -> DataFrame:
        """A view after the last micro-batch that came to its end."""
        last = spark.read.option("basePath", f"{self.path}/log").parquet(f"{self.path}/log/*").agg(F.max("epoch")).first()[0]
        return spark.read.parquet(f"{self.path}/shown/{name}/epoch={last}")

    def forget(self, spark: SparkSession, epoch: int, keep: int = 10) -> None:
        """Deletes states and views older than the last `keep` micro-batches before `epoch`, and hours of rows that no span reaches."""
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        row = logged(spark, self.path, epoch, LOG)
        oldest = (row["as_of"] - max(v.span or 0 for v in self.views.values())) // HOUR
        fs = hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        number = lambda status: int(status.getPath().getName().split("=")[1])
        for kind in ("state", "shown"):
            for name in self.views:
                for found in fs.globStatus(hadoop.Path(f"{self.path}/{kind}/{name}/epoch=*")) or ():
                    if number(found) <= epoch - keep:
                        fs.delete(found.getPath(), True)
        for found in fs.globStatus(hadoop.Path(f"{self.path}/rows/epoch=*/hour=*")) or ():
            if number(found) < oldest:
                fs.delete(found.getPath(), True)


def standing_views(events: DataFrame, standing: Standing, interval: str | None = "5 seconds") -> DataStreamWriter:
    """Events (with client_id and us) to standing views; the caller adds the checkpoint and starts it."""
    out = events.writeStream.foreachBatch(standing)
    return out.trigger(processingTime=interval) if interval else out.trigger(availableNow=True)
