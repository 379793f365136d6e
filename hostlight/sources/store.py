"""Cutting lineage: tables that are used more than once are written to the cluster's checkpoint folder and read from there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where none is set and all tasks run in this process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def kept(df: DataFrame) -> DataFrame:
    """`df` computed once; its partitions and their order stay as they are."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame, rows: int, *keys: str, each: int = 1_000_000) -> DataFrame:
    """`df` of `rows` rows (or fewer) dealt out by keys, about `each` to a partition: so a task holds the same at any size of the table."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // each)), *keys)
