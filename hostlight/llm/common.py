"""Helpers that several corpus operators share."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Whitespace-delimited words: everything but space, tab, newlines, vertical tab and form feed.
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes A-Z to a-z, everything else as is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Bytes that end a word.
SPACES = np.isin(np.arange(256), [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(text) -> bytes:
    """UTF-8 bytes of a text; null counts as empty."""
    return text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""


def chunks(texts: pd.Series, limit: int = 2 << 20):
    """Consecutive slices of a batch that hold about `limit` characters each (a longer text is a slice of its own)."""
    sizes = texts.map(lambda t: len(t) if isinstance(t, str) else 0).to_numpy()
    begin, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield slice(begin, i)
            begin, total = i, 0
        total += int(n)
    if len(sizes) > begin:
        yield slice(begin, len(sizes))


def release() -> None:
    """Gives freed memory back to the machine, so that a worker that waits for its next task holds little."""
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (in place where it can)."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def words_of(data: bytes, breaks: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word of a buffer, without a Python loop over words. `breaks`: bytes that end a word."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64)
    inside = np.zeros(len(b) + 2, np.int8)
    inside[1:-1] = ~breaks[b]
    edges = np.diff(inside)
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = _powers(len(b) + 1)
    sums = np.empty(len(b) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[b] * up[: len(b)], out=sums[1:])
    return start, end, mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def with_fresh(df: DataFrame, wanted: str) -> str:
    """A column name that `df` doesn't have."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted = f"_{wanted}"
    return wanted


def crc_mod(column: Column | str, by: int) -> Column:
    return F.crc32(F.col(column).cast("string") if isinstance(column, str) else column.cast("string")) % by


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one of our own only where none is set and all tasks run in this process (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        import tempfile

        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", folder)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """`df` written as Parquet in the cluster's shared folder and read again: cuts the lineage, survives lost executors."""
    import uuid

    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
