"""Chroma audio fingerprints: which recordings hold the same music, and at which offset.

1. Short-time spectra are folded into 12 pitch classes per frame; frames are smoothed and normalised.
2. With the integral image of these frames (time by pitch class), 16 filters compare sums of rectangles in a window
   of `WIDTH` frames. Each answer is quantised to two bits (neighbouring levels differ in one bit), which gives one
   packed 32-bit integer per frame.
3. Recordings with equal fingerprints are one class; only its least key is matched further. The index holds one key per
   place: the signs of 12 filters (noise rarely turns them) in a few frames, `SPACED` apart. Every place of a key is met,
   however many there are; of a run of places with equal signs in `RUN` such frames (a long note, silence) the first counts.
4. Queries (keys divisible by `every`) look up all recordings; a hit stands if the signs in the frames around it also
   agree in the main. Hits are counted by offset, and of each pair the offset with most hits (ties: the smallest) is
   aligned over its whole overlap: the pair matches if the share of different bits is at most `max_error`.

The index finds nearly all pairs, not all: tests measure its recall against alignment of every pair at every offset.

Defined results: null, empty or undecodable audio, and audio shorter than a window, has no fingerprint: no class
mates and no matches. Silence has one. Repeated rows are a class; rows that share a key are taken together. A row
without key is found by no query and asks none. Keys that aren't whole numbers are drawn as queries by their CRC32. An
empty table gives an empty table, and every recording is read whole. Only key and audio are read, so other columns may
have any name.

The given tables hold no audio. `melodies` renders the vectors of `embeddings` as tones (one note per number), so that
the query has recordings that grow with the input; each tenth recording holds most of the one before it, and then its own
beginning (`recordings`), so that there are matches to find.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

RATE, FRAME, HOP = 4_000, 1_024, 256
WIDTH = 16
#: Frames of a key and of a run, in steps of SPACED; places of a frequent key that are met at once where keys are dealt out.
KEY, RUN, SPACED, BUCKET = 3, 9, 4, 4_096
#: Frames around a hit whose signs are compared, and the share of them that may differ.
AROUND, AROUND_ERROR = (-12, -8, -4, 12, 16, 20), 0.25
#: Asking places that are sent to all executors at most (about 80 bytes each); more are dealt out by key.
ASKED = 300_000
MAX_ERROR, EVERY = 0.15, 20
LEVEL = 0.06


def decode_wav(data) -> np.ndarray | None:
    """Mono samples at RATE of 16-bit PCM in a WAV container; None if it isn't that."""
    try:
        with wave.open(io.BytesIO(bytes(data))) as f:
            if f.getsampwidth() != 2:
                return None
            x = np.frombuffer(f.readframes(f.getnframes()), "<i2").astype(np.float64) / 32768
            x, rate = x.reshape(-1, f.getnchannels()).mean(1), f.getframerate()
    except (wave.Error, EOFError, TypeError, ValueError):
        return None
    if rate != RATE and len(x):
        x = np.interp(np.arange(int(len(x) * RATE / rate)) * rate / RATE, np.arange(len(x)), x)
    return x


def notes(vector) -> np.ndarray | None:
    """A note for each number, by its size."""
    if vector is None or not len(vector):
        return None
    v = np.nan_to_num(np.asarray(vector, np.float64))
    spread = 2.5 * np.sqrt((v * v).mean()) + 1e-12
    return np.clip(np.floor((v / spread + 1) * 18), 0, 35)


def tones(note: np.ndarray | None) -> np.ndarray | None:
    """Samples of notes, a tenth of a second each."""
    if note is None:
        return None
    phase = 2 * np.pi * np.cumsum(np.repeat(110 * 2 ** (note / 12), RATE // 10)) / RATE
    return np.sin(phase) + 0.4 * np.sin(2 * phase)


def melodies(vector) -> np.ndarray | None:
    """Samples of a melody: the k-th number's size is the k-th note's pitch."""
    return tones(notes(vector))


def passages(pair) -> np.ndarray | None:
    """Samples of two vectors: the second's melody from its 17th note on, and 16 notes of the first's; without a second, the first's."""
    own, other = (None, None) if pair is None else (notes(pair[0]), notes(pair[1]))
    return tones(own if own is None or other is None else np.concatenate([other[16:], own[:16]]))


def recordings(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 10) -> DataFrame:
    """(key, audio): pairs of vectors for `passages`. Keys one above a multiple of `every` hold the vector of the key before too."""
    own = vectors.select(F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").alias("own"))
    other = own.filter(F.col("key") % every == 0).groupBy((F.col("key") + 1).alias("key")).agg(F.min("own").alias("other"))
    return own.join(other, "key", "left").select("key", F.array("own", "other").alias("audio"))


def _classes() -> np.ndarray:
    """Shares of each spectral line in each pitch class, between 100 and 1,800 Hz."""
    hz = np.arange(FRAME // 2 + 1) * RATE / FRAME
    out = np.zeros((len(hz), 12))
    use = (hz >= 100) & (hz <= 1_800)
    out[use, np.round(12 * np.log2(hz[use] / 440)).astype(int) % 12] = 1
    return out


_LINES, _HANN = _classes(), np.hanning(FRAME)


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames by 12 pitch classes, each frame of length 1 (or 0 in silence)."""
    if len(samples) < FRAME:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    out = np.empty((len(frames), 12))
    for k in range(0, len(frames), 512):
        out[k : k + 512] = np.abs(np.fft.rfft(frames[k : k + 512] * _HANN, axis=1)) @ _LINES
    padded = np.pad(out, ((2, 2), (0, 0)), mode="edge")
    smooth = sum(w * padded[k : k + len(out)] for k, w in enumerate((0.25, 0.75, 1.0, 0.75, 0.25)))
    size = np.sqrt((smooth * smooth).sum(1, keepdims=True))
    return np.where(size > 1e-6, smooth / np.maximum(size, 1e-6), 0.0)


#: Filters by rule: each kind of comparison at four heights of the pitch-class axis.
FILTERS = [(kind, 3 * step, 3 + 3 * (step % 2), width) for step in range(4) for kind, width in (("time", 16), ("pitch", 8), ("checks", 12), ("middle", 15))]


#: The bits of a code that hold signs, but for the filters of the middle (which rarely change).
SIGNS = sum(2 << 30 - 2 * k for k, (kind, *_) in enumerate(FILTERS) if kind != "middle")
SIGNS -= SIGNS >> 31 << 32  # as a signed integer


def fingerprint(samples: np.ndarray | None) -> np.ndarray:
    """One unsigned 32-bit integer per frame that a whole window follows."""
    if samples is None:
        return np.empty(0, np.uint32)
    image = chroma(samples)
    n = len(image) - WIDTH + 1
    if n < 1:
        return np.empty(0, np.uint32)
    wrapped = np.concatenate([image, image[:, :6]], 1)  # pitch classes are a circle
    sums = np.zeros((wrapped.shape[0] + 1, wrapped.shape[1] + 1))
    sums[1:, 1:] = wrapped.cumsum(0).cumsum(1)
    at = np.arange(n)

    def area(t0: int, t1: int, y0: int, y1: int) -> np.ndarray:
        return sums[at + t1, y1] - sums[at + t0, y1] - sums[at + t1, y0] + sums[at + t0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w in FILTERS:
        all_ = area(0, w, y, y + h)
        if kind == "time":
            first = area(0, w // 2, y, y + h)
        elif kind == "pitch":
            first = area(0, w, y, y + (h + 1) // 2)
        elif kind == "checks":
            first = area(0, w // 2, y, y + (h + 1) // 2) + area(w // 2, w, y + (h + 1) // 2, y + h)
        else:
            first = area(w // 3, 2 * w // 3, y, y + h)
        answer = np.log1p(first / w) - np.log1p((all_ - first) / w)
        level = (answer > -LEVEL).astype(np.uint32) + (answer > 0) + (answer > LEVEL)
        out = out << np.uint32(2) | (level ^ level >> np.uint32(1)).astype(np.uint32)
    return out


def fingerprints(media: DataFrame, key: str, audio: str, decode: Callable = decode_wav) -> DataFrame:
    """(key, codes): the packed integers of each recording, as array of int."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "codes": [fingerprint(decode(x)).view(np.int32) for x in pdf["audio"]]})

    kind = media.schema[key].dataType.simpleString()
    return media.select(F.col(f"`{key}`").alias("key"), F.col(f"`{audio}`").alias("audio")).mapInPandas(run, f"key {kind}, codes array<int>")


def bit_error(a: np.ndarray, b: np.ndarray, offset: int) -> float:
    """Share of different bits where b, shifted by `offset` frames, lies over a; 1 if less than half of the shorter does."""
    begin, end = max(0, offset), min(len(a), len(b) + offset)
    if 2 * (end - begin) < min(len(a), len(b)) or end <= begin:
        return 1.0
    x = a[begin:end].view(np.uint32) ^ b[begin - offset : end - offset].view(np.uint32)
    return float(np.bitwise_count(x).sum()) / (32 * (end - begin))


def _asks(prints: DataFrame, every: int) -> Column:
    whole = prints.schema["key"].dataType.typeName() in ("byte", "short", "integer", "long")
    return F.coalesce((F.col("key") if whole else F.crc32(F.col("key").cast("string"))) % every == 0, F.lit(False))


def _packed(values: list[Column]) -> list[Column]:
    """Signs of frames (longs of 32 bits, every other one set) as longs of four frames each."""
    four = lambda v: reduce(Column.bitwiseOR, [F.shiftleft(F.shiftright(x, j % 2), 32 * (j // 2)) for j, x in enumerate(v)])
    return [four(values[k : k + 4]) for k in range(0, len(values), 4)]


def places(reps: DataFrame) -> DataFrame:
    """(key, asks, place, k, x, seen): the places of each recording with their keys, the signs of the frames around, and
    which of these there are; of a run of places with equal signs in all of `RUN` frames, the first."""
    signs = reps.select("key", "asks", F.transform("codes", lambda c: c.bitwiseAND(F.lit(SIGNS))).alias("s"))

    def row(i: Column) -> Column:
        at = [F.get("s", i + SPACED * f) for f in range(RUN)]
        around = F.array(*[F.when(i + f >= 0, F.get("s", F.greatest(i + f, F.lit(0)))) for f in AROUND])
        return F.struct(i.alias("place"), around.alias("around"), F.xxhash64(F.lit(KEY), *at[:KEY]).alias("k"), F.xxhash64(F.lit(RUN), *at).alias("run"))

    rows = signs.select("key", "asks", F.transform(F.sequence(F.lit(0), F.size("s") - 1), row).alias("rows"))
    fresh = F.filter("rows", lambda r, i: (i == 0) | (r["run"] != F.get(F.col("rows"), F.greatest(i - 1, F.lit(0)))["run"]))
    out = rows.select("key", "asks", F.explode(fresh).alias("r")).select("key", "asks", "r.place", "r.k", "r.around")
    whole = F.lit(SIGNS & 0xFFFFFFFF)
    frames = [F.col("around")[j].cast("long").bitwiseAND(whole) for j in range(len(AROUND))]
    x, seen = _packed([F.coalesce(f, F.lit(0)) for f in frames]), _packed([F.when(f.isNull(), F.lit(0)).otherwise(whole).cast("long") for f in frames])
    return out.select("key", "asks", "place", "k", *[c.alias(f"x{j}") for j, c in enumerate(x)], *[c.alias(f"seen{j}") for j, c in enumerate(seen)])


def hits(reps: DataFrame) -> DataFrame:
    """(q, key, offset): each asking place with each place that shares its key, where the frames around agree.

    No place of a key is left out. Asking places go to all executors if a count shows that they are few. Otherwise keys are
    dealt out; the places of a key of more than `BUCKET` are cut into blocks, its asking places too, and each block of the
    one meets each of the other in a task, so that neither memory nor a task grows with a key.
    """
    asking = stored(places(reps.filter("asks")).drop("asks"))
    longs = range(-(-len(AROUND) // 4))
    mine = asking.select("k", F.col("key").alias("q"), F.col("place").alias("q_place"), *[F.col(f"{c}{j}").alias(f"q_{c}{j}") for j in longs for c in ("x", "seen")])
    rows, by = places(reps), ["k"]
    if asking.count() <= ASKED:
        mine = F.broadcast(mine)
    else:
        rows = stored(rows.join(asking.select("k").distinct(), "k", "left_semi"))
        blocks = lambda n: F.ceil(n / BUCKET).cast("int")
        full = rows.groupBy("k").agg(blocks(F.count("*")).alias("theirs"), blocks(F.count_if("asks")).alias("ours")).filter("theirs > 1")
        full = stored(full)
        full = F.broadcast(full) if full.count() <= ASKED else full
        each, one = lambda n: F.explode(F.sequence(F.lit(0), F.coalesce(F.col(n), F.lit(1)) - 1)), lambda n, *c: F.pmod(F.xxhash64(*c), F.coalesce(F.col(n), F.lit(1)))
        rows = rows.join(full, "k", "left").withColumns({"_b": one("theirs", "key", "place").cast("int"), "_a": each("ours")}).drop("theirs", "ours")
        mine = mine.join(full, "k", "left").withColumns({"_a": one("ours", "q", "q_place").cast("int"), "_b": each("theirs")}).drop("theirs", "ours")
        by = ["k", "_a", "_b"]
    both = [F.col(f"seen{j}").bitwiseAND(F.col(f"q_seen{j}")) for j in longs]
    differ = sum((F.bit_count(F.col(f"x{j}").bitwiseXOR(F.col(f"q_x{j}")).bitwiseAND(b)) for j, b in enumerate(both)), F.lit(0))
    agree = differ <= AROUND_ERROR * sum((F.bit_count(b) for b in both), F.lit(0))
    return rows.join(mine, by).filter((F.col("q") != F.col("key")) & agree).select("q", "key", (F.col("q_place") - F.col("place")).alias("offset"))


def matches(prints: DataFrame, every: int = EVERY, max_error: float = MAX_ERROR) -> DataFrame:
    """One row per row of `prints`: key, class_id, n_frames, and `found` (queries): class_id, offset and error of each match."""
    prints = stored(prints)
    kind = prints.schema["key"].dataType.simpleString()
    marked = prints.select("key", F.size("codes").alias("n_frames"), _asks(prints, every).alias("asks"), F.when(F.size("codes") > 0, F.sha2(F.array_join("codes", ","), 256)).alias("h"), "codes")
    classes = marked.filter("h IS NOT NULL").groupBy("h").agg(F.min("key").alias("class_id"), F.max("asks").alias("any_asks"))
    classes = stored(classes)
    some = marked.filter("h IS NOT NULL AND key IS NOT NULL")
    reps = stored(some.join(classes, "h").filter("key = class_id").select("key", F.col("any_asks").alias("asks"), "codes").distinct())
    by_offset = hits(reps).groupBy("q", "key", "offset").agg(F.count("*").alias("n"))
    best = by_offset.groupBy("q", "key").agg(F.max(F.struct("n", -F.col("offset"))).alias("best")).select("q", "key", (-F.col("best.col2")).alias("offset"))
    codes = reps.select("key", "codes")
    pairs = best.join(codes, "key").withColumnRenamed("codes", "theirs").join(codes.select(F.col("key").alias("q"), F.col("codes").alias("mine")), "q")

    def errors(mine: pd.Series, theirs: pd.Series, offset: pd.Series) -> pd.Series:
        return pd.Series([bit_error(np.asarray(a, np.int32), np.asarray(b, np.int32), int(o)) for a, b, o in zip(mine, theirs, offset, strict=True)], dtype=float)

    aligned = pairs.withColumn("error", F.pandas_udf(errors, "double")("mine", "theirs", "offset")).filter(F.col("error") <= max_error)
    found = aligned.groupBy("q").agg(F.sort_array(F.collect_list(F.struct(F.col("key").alias("class_id"), "offset", "error"))).alias("found"))
    out = marked.drop("codes").join(classes.select("h", "class_id"), "h", "left").join(found.withColumnRenamed("q", "class_id"), "class_id", "left")
    none = F.array().cast(f"array<struct<class_id:{kind},offset:int,error:double>>")
    return out.select("key", F.coalesce("class_id", "key").alias("class_id"), "n_frames", F.when(F.col("asks"), F.coalesce("found", none)).alias("found"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = fingerprints(recordings(table(spark, sf_dir, "embeddings")), "key", "audio", passages)
    return matches(prints).withColumnRenamed("key", "vec_id").withColumn("n_matches", F.size("found"))
