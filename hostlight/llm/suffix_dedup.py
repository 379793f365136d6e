"""Removal of long repeated byte strings, by suffix arrays that are built from Lyndon groups.

A byte goes if a string of `length` bytes that covers it also starts earlier (smaller key, or the same document
and an earlier start). Strings never cross documents and are judged on the input.

1. Anchors. A k-byte hash is taken at every place; where the least hash of a run of length - k + 1 places stands
   is an anchor. Equal strings of `length` bytes have the same anchors at the same offsets, so a string can only
   repeat if its anchor does. With each anchor goes a hash of everything that a string around it can hold.
2. Of equal surroundings only the earliest stands for all (every later one is a repeat through and through): first
   among the texts that a task reads together, then among all, where anchors are dealt out and sorted by hash and
   streamed with constant memory. Anchors whose hash occurs once end here; anchors whose surroundings differ go on,
   one row per kind of surroundings. Hashes that hold a good part of a sample's anchors are dealt out by hash and
   surroundings, so that no anchor fills one task. Surroundings are equal if both hashes (128 bits) are.
3. The surroundings of those are fetched from the texts and compared exactly: a generalised suffix array over
   8-byte symbols groups equal strings, the earliest start of each group stays.
   Suffix order is constructed in linear grouping steps: groups of suffixes that share a Lyndon prefix are
   handled in descending order; pointers to the previous smaller suffix extend the groups before them; in the
   end each group's order is emitted from left to right. Ranks are never recomputed.
   Anchors that are very frequent in the sample, or have more than LIMIT kinds of surroundings, aren't gathered: Spark groups
   their strings by 128-bit digests. That bounds memory and changes no result.
4. Removed intervals are merged per document and cut out.

Defined results: a null or empty text counts as empty, with nothing removed. Texts shorter than `length` are
never touched. Repeated rows with different keys: the one with the smallest key stays. Rows with the same key
and text are one document given twice: they get the same result and remove nothing from each other. An
empty table gives an empty table; other columns of the input don't matter. Rows without key neither lose nor cause
anything.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, mix, raw, release, stored, table, with_fresh

LENGTH = 100
K = 36
RIGHT = LENGTH
LEFT = LENGTH - K  # bytes before an anchor that a string around it can hold
SYMBOL = 8
SYMBOLS = (LEFT + RIGHT + SYMBOL - 1) // SYMBOL
#: Kinds of surroundings of one anchor that are compared in one task, and those of one suffix array.
LIMIT = 20_000
BLOCK = 3_000
#: Strings of a frequent anchor that are compared together at first.
TOGETHER = 16
#: Rows of digests in one piece.
AT_ONCE = 8_192
#: Documents of the sample; the anchors a hash must have there to be dealt out by its surroundings; and to have its kinds
#: of surroundings dealt out too (they are compared by digests then, which takes longer than a suffix array).
SAMPLE, OFTEN, SPLIT = 2_000, 40, 200

_BYTE = np.random.default_rng(77).integers(1, 1 << 63, 257, dtype=np.uint64)
_STEP = {n: np.uint64(0x9E3779B97F4A7C15 * (2 * n + 1) & 0xFFFFFFFFFFFFFFFF | 1) for n in (1, 2, 4, 8, 16, 32, 64)}


# -- anchors --------------------------------------------------------------------------------------------------


def _doubled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of runs of 2n from hashes of runs of n; the last n places have none and keep what they have."""
    out = h * _STEP[n]
    out[:-n] += h[n:]
    out ^= out >> np.uint64(29)
    return out


def _slide(x: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over x[i : i + width], for i up to len(x) - width."""
    span = 1
    while span * 2 <= width:
        x = pick(x[:-span], x[span:])
        span *= 2
    return pick(x[: len(x) - (width - span)], x[width - span :]) if width > span else x


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text, place, hash, and hash of the surroundings of each anchor of texts of LENGTH bytes or more."""
    none = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.uint64)
    sizes = np.array([len(t) for t in texts], np.int64)
    if not len(sizes) or sizes.max() < LENGTH:
        return none
    gap = LEFT + RIGHT  # between texts, so that surroundings never reach into another one
    starts = gap + np.concatenate([[0], np.cumsum(sizes[:-1] + gap)])
    data = np.full(int(starts[-1] + sizes[-1] + gap), 256, np.uint16)
    for t, s in zip(texts, starts.tolist(), strict=True):
        data[s : s + len(t)] = np.frombuffer(t, np.uint8)
    level = {1: _BYTE[data]}
    for n in (1, 2, 4, 8, 16):
        level[2 * n] = _doubled(level[n], n)
        if n not in (4, 8):
            del level[n]
    gram = level[32] * _STEP[64]
    gram[:-32] += level[4][32:]
    gram = mix(gram)
    width = LENGTH - K + 1
    low = _slide(gram, width, np.minimum)  # least hash of the run that begins here
    # places that hold the least hash of a run that lies in one text
    inside = np.zeros(len(data) + 1, np.int32)
    long = sizes >= LENGTH
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, starts[long] + sizes[long] - LENGTH + 1, -1)
    inside = np.cumsum(inside)[: len(low)].astype(bool)
    # no run that covers a place has a least hash above the place's own, so it is least in one if it equals their largest
    high = np.where(inside, low, np.uint64(0))
    best = _slide(np.concatenate([np.zeros(width - 1, np.uint64), high]), width, np.maximum)[: len(gram)]
    at = np.flatnonzero(gram[: len(best)] == best)
    at = at[(at >= gap) & (best[at] != 0)]
    owner = np.searchsorted(starts, at, "right") - 1
    around = np.zeros(len(at), np.uint64)
    for begin, size in ((-64, 32), (-32, 32), (0, 32), (32, 32), (64, 32), (92, 8)):
        around = (around ^ level[size][at + begin]) * np.uint64(0xD6E8FEB86659FD93)
        around ^= around >> np.uint64(32)
    return owner, at - starts[owner], gram[at], around


def _anchor_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for part in chunks(pdf["text"], 1 << 18):
            key = pdf["key"].to_numpy()[part]
            owner, place, h, around = anchors([raw(t) for t in pdf["text"].iloc[part]])
            frame = pd.DataFrame({"h": h.view(np.int64), "c": around.view(np.int64), "key": key[owner], "place": place.astype(np.int32)})
            yield _known_repeats(frame)
    release()


def _known_repeats(frame: pd.DataFrame) -> pd.DataFrame:
    """`frame` with place -1 - place where equal surroundings stand earlier in it."""
    _, kind = np.unique(mix(frame["h"].to_numpy().view(np.uint64)) ^ frame["c"].to_numpy().view(np.uint64), return_inverse=True)
    often = np.bincount(kind)[kind] > 1 if len(kind) else np.zeros(0, bool)
    if not often.any():
        return frame
    some = frame[often].sort_values(["h", "c", "key", "place"])
    first = some.groupby(["h", "c"], sort=False)[["key", "place"]].transform("first")
    later = some.index[((some["key"] != first["key"]) | (some["place"] != first["place"])).to_numpy()]
    frame.loc[later, "place"] = -1 - frame.loc[later, "place"]
    return frame


def _sorted_out(batches: Iterator[pd.DataFrame], hot: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
    """Rows sorted by (h, c, key, place): `whole` for equal (h, c) that don't stand at the place of the first; the first,
    if h has several c or is in `hot`, not `whole`. Rows given twice have the same places and stay with the first. Rows
    with negative places are repeats already."""
    last = None  # the row before: h, c
    origin = None  # key and place of the first row of the current (h, c)
    held = None  # the first row of the current h, while h has one c only
    columns = ["h", "key", "place"]
    for pdf in batches:
        sure = pdf["place"].to_numpy() < 0
        if sure.any():
            yield pdf.loc[sure, columns].assign(place=-1 - pdf["place"][sure], whole=True)
            pdf = pdf[~sure]
        n = len(pdf)
        if not n:
            continue
        h, c = pdf["h"].to_numpy(), pdf["c"].to_numpy()
        new_h, new_c = np.empty(n, bool), np.empty(n, bool)
        new_h[1:] = h[1:] != h[:-1]
        new_c[1:] = new_h[1:] | (c[1:] != c[:-1])
        new_h[0] = last is None or last[0] != h[0]
        new_c[0] = new_h[0] or last[1] != c[0]
        key, place = pdf["key"].to_numpy(), pdf["place"].to_numpy()
        first = np.maximum.accumulate(np.where(new_c, np.arange(n), -1))  # -1: in an earlier batch
        later = (key != key[first]) | (place != place[first])
        before = first < 0
        if before.any():
            later[before] = (key[before] != origin[0]) | (place[before] != origin[1])
        if not before[-1]:
            origin = key[first[-1]], place[first[-1]]
        # an h is mixed as soon as it has a second c
        group = np.cumsum(new_h)
        kinds = np.bincount(group, weights=new_c & ~new_h, minlength=group[-1] + 1) > 0
        if hot is not None and len(hot):
            kinds[group[np.isin(h, hot)]] = True
        mixed_before = last is not None and held is None
        if not new_h[0] and mixed_before:
            kinds[0] = True
        mixed = kinds[group]
        out = [pdf.loc[later, columns].assign(whole=True), pdf.loc[new_c & mixed, columns].assign(whole=False)]
        if not new_h[0] and kinds[0] and held is not None:
            out.append(held[columns].assign(whole=False))
        final = np.flatnonzero(new_h)
        if len(final):
            held = None if kinds[group[-1]] else pdf.iloc[[final[-1]]]
        elif kinds[group[-1]]:
            held = None
        last = h[-1], c[-1]
        yield pd.concat(out)


# -- suffix arrays --------------------------------------------------------------------------------------------


def _numbers(n: int, value: int) -> array:
    return array("i", [value]) * n


def suffix_array(text: Sequence[int]) -> Sequence[int]:
    """Suffixes of a string of numbers in ascending order; its last number must be the only least one."""
    n = len(text)
    sa = array("i", np.argsort(np.asarray(text), kind="stable").astype(np.int32).tobytes())
    place = _numbers(n, 0)
    group = _numbers(n, 0)  # where the suffix's group starts
    size = _numbers(n + 1, 0)
    start = 0
    for k, s in enumerate(sa):
        if text[s] != text[sa[start]]:
            start = k
        place[s], group[s] = k, start
        size[start] += 1
    previous = _numbers(n, -1)
    # 1: groups in descending order; `previous` is the nearest suffix before that is in a lower group
    end = n
    while end > 0:
        begin = group[sa[end - 1]]
        count: dict[int, int] = {}
        for s in sorted(sa[begin:end]) if end - begin > 1 else sa[begin:end]:
            p = s - 1
            while p >= 0 and group[p] >= begin:
                p = previous[p]
            previous[s] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        # a suffix followed by more members extends its Lyndon prefix by more copies of theirs, and is larger
        if len(set(count.values())) > 1:
            times: dict[int, list[int]] = {}
            for p, c in count.items():
                times.setdefault(c, []).append(p)
            parts = [times[c] for c in sorted(times, reverse=True)]
        else:
            parts = [list(count)] if count else []
        for part in parts:
            for p in part:
                g = group[p]
                size[g] -= 1
                a, b = place[p], g + size[g]
                other = sa[b]
                sa[a], sa[b] = other, p
                place[other], place[p] = a, b
            for p in part:
                g = group[p] + size[group[p]]
                group[p] = g
            for p in part:
                size[group[p]] += 1
        end = begin
    # 2: from left to right each suffix puts the ones before it at the front of their groups
    order = _numbers(n, -1)
    order[0] = n - 1
    done = bytearray(n)
    done[n - 1] = 1
    front = array("i", range(n + 1))
    for k in range(n):
        p = order[k] - 1
        while p >= 0 and not done[p]:
            g = group[p]
            order[front[g]] = p
            front[g] += 1
            done[p] = 1
            p = previous[p]
    return order


def repeats(around: np.ndarray, low: np.ndarray, high: np.ndarray, key: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which strings repeat an earlier one: a row per surroundings, a column per offset LEFT..0 before the anchor.

    around: LEFT + RIGHT bytes per row; low, high: how far they lie in the text (before and after the anchor).
    """
    m = len(around)
    padded = np.zeros((m, SYMBOLS * SYMBOL), np.uint8)
    padded[:, : LEFT + RIGHT] = around
    symbols = padded.reshape(m, SYMBOLS, SYMBOL).copy().view(">u8")[:, :, 0]
    _, ranks = np.unique(symbols, return_inverse=True)
    text = np.ones((m, SYMBOLS + 1), np.int64)  # 1 ends each row
    text[:, :SYMBOLS] = ranks.reshape(m, SYMBOLS) + 2
    order = np.array(suffix_array(array("i", np.append(text.ravel(), 0).astype(np.int32).tobytes())))[1:]
    row, column = order // (SYMBOLS + 1), order % (SYMBOLS + 1)
    starts = LEFT // SYMBOL + 1
    use = column < starts
    row, column = row[use], column[use]
    # common bytes of neighbours, up to LENGTH; equal strings are neighbours
    begin = column * SYMBOL
    view = np.lib.stride_tricks.sliding_window_view(padded, LENGTH, axis=1)
    mine = view[row, begin]
    same = np.zeros(len(row), np.int64)
    if len(row) > 1:
        differ = mine[1:] != mine[:-1]
        same[1:] = np.where(differ.any(1), differ.argmax(1), LENGTH)
    out = np.zeros((m, LEFT + 1), bool)
    rows, keys, offsets, groups, heads = [], [], [], [], []
    for tail in range(SYMBOL):
        part = np.cumsum(same < LENGTH - tail)
        back = begin - tail  # where the string begins in the row
        ok = (back >= 0) & (LEFT - back <= low[row]) & (back + LENGTH - LEFT <= high[row])
        head = np.zeros(len(row), np.uint64)
        for k in range(tail):
            head = head << np.uint64(8) | padded[row, np.maximum(back, 0) + k].astype(np.uint64)
        rows.append(row[ok])
        offsets.append(LEFT - back[ok])
        groups.append(part[ok] * SYMBOL + tail)
        heads.append(head[ok])
    r, t, g, hd = map(np.concatenate, (rows, offsets, groups, heads))
    if not len(r):
        return out
    begins = place[r] - t
    by = np.lexsort((begins, key[r], hd, g))
    r, t, g, hd, begins = r[by], t[by], g[by], hd[by], begins[by]
    keys = key[r]
    new = np.concatenate([[True], (g[1:] != g[:-1]) | (hd[1:] != hd[:-1])])
    first = np.maximum.accumulate(np.where(new, np.arange(len(r)), 0))
    later = (keys != keys[first]) | (begins != begins[first])
    out[r[later], t[later]] = True
    return out


def _spans(repeated: np.ndarray, key: np.ndarray, place: np.ndarray) -> pd.DataFrame:
    """(key, begin, end) of runs of repeated strings per row."""
    m = len(repeated)
    flags = np.zeros((m, LEFT + 3), np.int8)
    flags[:, 1:-1] = repeated[:, ::-1]  # by begin, ascending
    edges = np.diff(flags, axis=1)
    row, a = np.nonzero(edges == 1)
    _, b = np.nonzero(edges == -1)
    return pd.DataFrame({"key": key[row], "begin": place[row] - LEFT + a, "end": place[row] - LEFT + b - 1 + LENGTH})


def _digest(b: bytes) -> tuple[int, int]:
    d = hashlib.blake2b(b, digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _single(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The strings in runs of them, by digest."""
    columns = ["key", "begin", "end", "s1", "s2"]
    for pdf in batches:
        for first in range(0, len(pdf), AT_ONCE // TOGETHER):
            some = pdf.iloc[first : first + AT_ONCE // TOGETHER]
            out = [(key, begin + k, begin + k + LENGTH, *_digest(part[k : k + LENGTH])) for key, begin, part in zip(some["key"], some["begin"], some["part"], strict=True) for k in range(len(part) - LENGTH + 1)]
            yield pd.DataFrame(out, columns=columns)
    release()


def _firsts(strings: DataFrame) -> DataFrame:
    """Per digest that occurs more than once: the first place."""
    first = strings.groupBy("s1", "s2").agg(F.min(F.struct("key", "begin")).alias("first"), F.count("*").alias("n"))
    return first.filter("n > 1").drop("n")


def _compared(batches: Iterator[pd.DataFrame], hot: np.ndarray | None = None) -> Iterator[pd.DataFrame]:
    """Rows (h, key, place, low, high, around) sorted by h: repeated spans, or, of large groups and of `hot`, runs of up to
    TOGETHER strings by digest, with their bytes."""
    open_rows: list[pd.DataFrame] = []
    columns = ["key", "begin", "end", "s1", "s2"]

    def grouped(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        around = np.frombuffer(b"".join(frame["around"]), np.uint8).reshape(len(frame), LEFT + RIGHT)
        key, place = frame["key"].to_numpy(), frame["place"].to_numpy().astype(np.int64)
        found = repeats(around, frame["low"].to_numpy(), frame["high"].to_numpy(), key, place)
        yield _spans(found, key, place).assign(s1=None, s2=None, part=None)[[*columns, "part"]]

    def hashed(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        out = []
        for low, high, around, key, place in zip(frame["low"], frame["high"], frame["around"], frame["key"], frame["place"], strict=True):
            begin, end = max(0, LEFT - low), min(LEFT, LEFT + high - LENGTH)  # where the first and the last string begin in `around`
            a = begin
            while a <= end:  # runs end at the same offsets from the anchor in all texts
                stop = min(a + TOGETHER - 1 - a % TOGETHER, end)
                part = around[a : stop + LENGTH]
                out.append((key, place - LEFT + a, place - LEFT + a + len(part), *_digest(part), part))
                a = stop + 1
            if len(out) >= AT_ONCE:
                yield pd.DataFrame(out, columns=[*columns, "part"])
                out = []
        yield pd.DataFrame(out, columns=[*columns, "part"])

    def ended(rows: list[pd.DataFrame], last: bool) -> Iterator[pd.DataFrame]:
        """Handles complete groups; gives back nothing and leaves the last, perhaps open, group in open_rows."""
        frame = pd.concat(rows, ignore_index=True)
        h = frame["h"].to_numpy()
        edges = [0, *(np.flatnonzero(h[1:] != h[:-1]) + 1).tolist(), len(frame)]
        stop = len(edges) - 1 if last else len(edges) - 2
        begin = 0
        for k in range(stop):
            if edges[k + 1] - edges[k] > LIMIT:
                if edges[k] > edges[begin]:
                    yield from grouped(frame.iloc[edges[begin] : edges[k]])
                yield from hashed(frame.iloc[edges[k] : edges[k + 1]])
                begin = k + 1
            elif edges[k + 1] - edges[begin] >= BLOCK or k == stop - 1:
                yield from grouped(frame.iloc[edges[begin] : edges[k + 1]])
                begin = k + 1
        open_rows[:] = [frame.iloc[edges[stop] :]]

    over = None  # the group that is too large, while its rows come
    for pdf in batches:
        if hot is not None and len(hot):
            often = np.isin(pdf["h"].to_numpy(), hot)
            if often.any():
                yield from hashed(pdf[often])
                pdf = pdf[~often]
                if not len(pdf):
                    continue
        if over is not None:
            rest = pdf["h"].to_numpy() == over
            yield from hashed(pdf[rest])
            pdf = pdf[~rest]
            if not len(pdf):
                continue
            over = None
        open_rows.append(pdf)
        if sum(map(len, open_rows)) >= BLOCK:
            yield from ended(list(open_rows), False)
            if len(open_rows[0]) > LIMIT:
                over = open_rows[0]["h"].iloc[0]
                yield from hashed(open_rows[0])
                open_rows.clear()
    if open_rows and sum(map(len, open_rows)):
        yield from ended(list(open_rows), True)
    release()


# -- Spark ----------------------------------------------------------------------------------------------------


def _surroundings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["h", "key", "place", "low", "high", "around"]
    for pdf in batches:
        out = []
        for key, text, hs, at in zip(pdf["key"], pdf["text"], pdf["hs"], pdf["at"], strict=True):
            b = raw(text)
            for h, p in zip(hs.tolist(), at.tolist(), strict=True):
                low, high = min(LEFT, p), min(RIGHT, len(b) - p)
                out.append((h, key, p, low, high, bytes(LEFT - low) + b[p - low : p + high] + bytes(RIGHT - high)))
            if len(out) >= 20_000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        yield pd.DataFrame(out, columns=columns)
    release()


def merged(row, size: int) -> list[tuple[int, int]]:
    """Disjoint, maximal runs of what a row of `repeated_spans` removes from a text of `size` bytes."""
    if row is None or size < LENGTH:
        return []
    whole, begin, end = (np.asarray(x, np.int64) for x in row)
    begin, end = np.concatenate([whole - LEFT, begin]), np.concatenate([whole + RIGHT, end])
    if not len(begin):
        return []
    by = np.argsort(begin)
    begin, end = np.maximum(begin[by], 0), np.minimum(np.maximum.accumulate(end[by]), size)
    new = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]]))
    return list(zip(begin[new].tolist(), end[np.append(new[1:], len(end)) - 1].tolist(), strict=True))


def frequent_anchors(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes with at least OFTEN anchors in about SAMPLE texts, at most a 40th of the sample's anchors; and with at least SPLIT."""
    share = min(1.0, SAMPLE / max(rows.count(), 1))
    kind = rows.schema["key"].dataType.simpleString()
    seen = rows.sample(share, 3).mapInPandas(_anchor_rows, f"h long, c long, key {kind}, place int")
    often = seen.filter("place >= 0").groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") >= OFTEN).toPandas()
    h = often["h"].to_numpy(np.int64)
    return np.sort(h), np.sort(h[often["n"].to_numpy() >= SPLIT])


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """What to remove, documents with something to remove only.

    key; whole: anchors all of whose surroundings go; begin, end: other spans. Spans may overlap, see `merged`.
    """
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).filter("key IS NOT NULL")
    kind = rows.schema["key"].dataType.simpleString()
    found = rows.mapInPandas(_anchor_rows, f"h long, c long, key {kind}, place int")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot, split = frequent_anchors(rows)
    # repeats that are known already go anywhere, and so do the kinds of surroundings of a frequent anchor
    deal = F.when(F.col("place") < 0, F.xxhash64("key", "place")).when(F.col("h").isin(hot.tolist()), F.xxhash64("h", "c")).otherwise(F.col("h"))
    dealt = found.repartition(parts, deal).sortWithinPartitions("h", "c", "key", "place").mapInPandas(lambda x: _sorted_out(x, hot), f"h long, key {kind}, place int, whole boolean")
    by_doc = dealt.groupBy("key").agg(F.collect_list(F.when(F.col("whole"), F.col("place"))).alias("whole"), F.collect_list(F.when(~F.col("whole"), F.struct("h", "place"))).alias("at"))
    by_doc = stored(by_doc.select("key", "whole", F.col("at.h").alias("hs"), F.col("at.place").alias("at")))  # for the comparison and the result
    fetched = rows.join(by_doc.filter(F.size("at") > 0).select("key", "hs", "at"), "key").mapInPandas(_surroundings, f"h long, key {kind}, place int, low int, high int, around binary")
    spans = f"key {kind}, begin int, end int"
    deal = F.when(F.col("h").isin(split.tolist()), F.xxhash64("key", "place")).otherwise(F.col("h"))
    compared = stored(fetched.repartition(parts, deal).sortWithinPartitions("h").mapInPandas(lambda x: _compared(x, split), f"{spans}, s1 long, s2 long, part binary"))
    # a run of strings that stands earlier goes whole; the strings of the other runs, the first of each kind, are looked up alone
    runs = compared.filter("s1 IS NOT NULL")
    placed = runs.join(_firsts(runs.drop("part")), ["s1", "s2"], "left").withColumn("again", F.coalesce(F.struct("key", "begin") != F.col("first"), F.lit(False)))
    strings = placed.filter("NOT again").select("key", "begin", "part").mapInPandas(_single, f"{spans}, s1 long, s2 long")
    single = strings.join(_firsts(strings), ["s1", "s2"]).filter(F.struct("key", "begin") != F.col("first"))
    more = compared.filter("s1 IS NULL").select("key", "begin", "end")
    for found in (placed.filter("again"), single):
        more = more.unionByName(found.select("key", "begin", "end"))
    more = more.groupBy("key").agg(F.collect_list(F.struct("begin", "end")).alias("s"))
    both = by_doc.filter(F.size("whole") > 0).select("key", "whole").join(more, "key", "full")
    none = F.array().cast("array<int>")
    return both.select("key", F.coalesce("whole", none).alias("whole"), F.coalesce("s.begin", none).alias("begin"), F.coalesce("s.end", none).alias("end"))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for key, text, whole, begin, end in zip(pdf["key"], pdf["text"], pdf["whole"], pdf["begin"], pdf["end"], strict=True):
            b = raw(text)
            gone = merged((whole, begin, end), len(b)) if whole is not None else []
            out.append((key, len(b), sum(y - x for x, y in gone), len(gone), hashlib.sha256(_kept(b, gone)).hexdigest()))
        yield pd.DataFrame(out, columns=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _kept(b: bytes, gone: list[tuple[int, int]]) -> bytes:
    edges = [0, *[x for s in gone for x in s], len(b)]
    return b"".join([b[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)])


def removed_digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: bytes, removed bytes, removed runs, and a digest of what is kept."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    joined = rows.join(repeated_spans(docs, key, text), "key", "left")
    return joined.mapInPandas(_digests, f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("key", key)


def characters(b: bytes, gone: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without the bytes of characters that they cut."""
    out = []
    for x, y in gone:
        while x < y and b[x] & 0xC0 == 0x80:
            x += 1
        while x < y < len(b) and b[y] & 0xC0 == 0x80:
            y -= 1
        out.append((x, y))
    return out


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """`docs` without repeated strings (whole characters only); texts of which nothing is left go.

    `length`, if the table has it, is set to the code points left. A null text stays as it is.
    """

    def cut(text: pd.Series, whole: pd.Series, begin: pd.Series, end: pd.Series) -> pd.Series:
        out = []
        for t, *row in zip(text, whole, begin, end, strict=True):
            b = raw(t)
            gone = characters(b, merged(row, len(b)))
            out.append(_kept(b, gone).decode("utf-8", "surrogatepass") if gone else t)
        return pd.Series(out, dtype=object)

    cut_udf = F.pandas_udf(cut, "string")
    found = repeated_spans(docs, key, text)
    fresh = {c: with_fresh(docs, f"repeat_{c}") for c in found.columns}
    joined = docs.join(found.withColumnsRenamed(fresh), F.col(f"`{key}`") == F.col(fresh["key"]), "left")
    untouched = F.col(fresh["key"]).isNull()
    rest = joined.filter(~untouched)
    rest = rest.withColumn(text, cut_udf(F.col(text), *[F.col(fresh[c]) for c in ("whole", "begin", "end")])).filter(F.length(text) > 0)
    if length is not None and length in docs.columns:
        rest = rest.withColumn(length, F.length(text).cast(docs.schema[length].dataType))
    return joined.filter(untouched).unionByName(rest).select([f"`{c}`" for c in docs.columns])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed_digests(table(spark, sf_dir, "documents"))
