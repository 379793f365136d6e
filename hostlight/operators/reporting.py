"""What the agent reports of its findings: rules and models first, then rows worth watching, by category.

Rows are of one collection cycle (a column) where a number per cycle matters: every 30th process, the first 20 files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed import TRUSTED_PROCESSES
from . import risk

EVERY_PROCESS, FIRST_FILES, DISCOUNTED_ABOVE, LARGEST_HASHED = 30, 20, 5.0, 50 << 20


def report_network(history: DataFrame, ml: str | None = None) -> DataFrame:
    """Connections (with conn_n, ports_n) of a model finding, of rules above 6, new external ones, and bad ports within."""
    return risk.network_risk_live(history, ml).filter(F.col("risk").isNotNull())


def report_processes(processes: DataFrame, cycle: Column, ml: str | None = None) -> DataFrame:
    """Processes (with parent_name, lineage) of a model finding, of rules above 6, busy ones, and every 30th of a cycle;
    trusted ones below 5 aren't reported."""
    number = F.row_number().over(Window.partitionBy("client_id", cycle).orderBy("us", "id"))
    trusted = F.coalesce(F.lower("name").isin(*TRUSTED_PROCESSES), F.lit(False))
    rows = processes.withColumns({"trusted": trusted, "sampled": (number % EVERY_PROCESS == 0) & ~trusted})
    return risk.process_risk_live(rows, ml).filter(F.col("risk").isNotNull())


def report_files(files: DataFrame, cycle: Column, ml: str | None = None) -> DataFrame:
    """Files of a model finding, of rules above 7, recent ones, and the first 20 others of a cycle; safe places below 6 aren't
    reported. Known content of reported files above 5 takes 1 off."""
    other = risk.FILE_LIVE.apply(files, "_risk", "_says")
    plain = (F.col("_risk") <= 7) & ~(F.col("is_new") | (F.col("age_s") < 600)) & (F.col(ml).isNull() if ml else F.lit(True))
    upto = Window.partitionBy("client_id", cycle).orderBy("us", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = other.withColumn("_plain", plain).withColumn("sampled", F.col("_plain") & (F.sum(F.col("_plain").cast("int")).over(upto) <= FIRST_FILES))
    rows = risk.file_risk_live(rows.drop("_risk", "_says", "_plain"), ml).drop("sampled").filter(F.col("risk").isNotNull())
    hashed = F.col("file_hash").isNotNull() & (F.col("risk") > DISCOUNTED_ABOVE) & (F.col("file_size") < LARGEST_HASHED)
    known = hashed & (F.row_number().over(Window.partitionBy("client_id", F.when(hashed, F.col("file_hash")).otherwise(F.col("id").cast("string"))).orderBy("us", "id")) > 1)
    return rows.withColumn("risk", F.when(known, F.greatest(F.lit(0.0), F.col("risk") - 1)).otherwise(F.col("risk")))
