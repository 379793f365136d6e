"""N-gram Jaccard join with Bayesian candidate pruning.

Two documents are linked if the sets of their five-word shingles have a Jaccard similarity of `threshold` or more.

1. Each text becomes its set of shingle hashes, a fingerprint of that set, and a MinHash signature. Documents with
   equal sets are copies, represented by the smallest key; only representatives go on.
2. Signatures are cut into bands; representatives that share a band are candidates. Only (band, key) rows move, and
   a bucket links its members to its least one, so a bucket of m members gives m rows, never m * m.
   Candidates are gathered into components by spreading the least key.
3. The shingle sets of a component are compared in blocks, block against block, so that no task holds more than two
   blocks. Of each pair that shares a band the MinHash values are compared step by step; with a uniform prior the
   similarity given m of n equal values has a Beta(m + 1, n - m + 1) posterior, and the pair is dropped as soon
   as the chance of reaching the threshold falls below `tolerance`. The rest is verified exactly, on the sets.
4. Each task gives its links as counts per representative and as a spanning forest; classes are the components of
   the forests.

Every pair of different texts above the threshold is counted, but pairs are never rows. A pair stays unseen with
the chance that no band of a similar pair agrees (1 - s^4)^32, 5e-8 at s = 0.8, or that pruning is wrong (tolerance).

Words are what stands between white space, A-Z lower-cased. A text of one to four words is one shingle of all
its words. Defined results: a null text, or one without words, has no shingles, no links and a class of its own.
Repeated rows are copies. Ties for a representative don't occur, as keys should be unique. An empty table gives an
empty table; other columns of the input don't matter. Rows without key are alone, with null ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, chunks, mix, raw, release, shared_folder, stored, table, with_fresh, words_of

WORDS = 5
THRESHOLD = 0.8
TOLERANCE = 1e-6
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEP = 16  # MinHash values per look
BLOCK = 2_000  # representatives of a block

_SEEDS = np.random.default_rng(5).integers(1, 1 << 63, (2, HASHES), dtype=np.uint64)
_MULTIPLY, _ADD = _SEEDS[0] | np.uint64(1), _SEEDS[1]


# -- sets and signatures --------------------------------------------------------------------------------------


def shingles(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = b" ".join(t.translate(LOWER) for t in texts)
    ends = np.cumsum(sizes + 1) - 1
    start, _, h = words_of(data)
    owner = np.searchsorted(ends, start, "right")
    count = np.bincount(owner, minlength=len(texts))
    grams = np.zeros(max(len(h) - WORDS + 1, 0), np.uint64)
    for k in range(WORDS):
        grams = (grams ^ h[k : len(h) - WORDS + 1 + k]) * np.uint64(0x9FB21C651E98DF25)
        grams ^= grams >> np.uint64(35)
    first = np.concatenate([[0], np.cumsum(count)])
    out = []
    for k, n in enumerate(count.tolist()):
        a = first[k]
        if n >= WORDS:
            out.append(np.unique(grams[a : a + n - WORDS + 1]))
        elif n:
            g = np.uint64(n)
            for x in h[a : a + n]:
                g = mix(np.array([g ^ x]))[0]
            out.append(np.array([g], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (32 bits) of each set, a row per set; sets must not be empty."""
    flat = np.concatenate(sets)
    begin = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), HASHES), np.uint32)
    for k in range(HASHES):
        value = flat * _MULTIPLY[k]
        value += _ADD[k]
        value ^= value >> np.uint64(31)
        value *= _MULTIPLY[k]
        out[:, k] = np.minimum.reduceat(value, begin) >> np.uint64(32)
    return out


def bands_of(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key per band."""
    out = np.zeros((len(signature), BANDS), np.uint64)
    values = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    for k in range(ROWS):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + values[:, :, k] + np.uint64(1))
    return mix(out + np.arange(BANDS, dtype=np.uint64))


def _prepared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for part in chunks(pdf["text"], 1 << 18):
            sets = shingles([raw(t) for t in pdf["text"].iloc[part]])
            full = [k for k, s in enumerate(sets) if len(s)]
            bands: list = [np.empty(0, np.int64)] * len(sets)
            if full:
                for k, row in zip(full, bands_of(signatures([sets[k] for k in full])), strict=True):
                    bands[k] = row.view(np.int64)
            prints = [(int(s.sum(dtype=np.uint64)), int(np.bitwise_xor.reduce(mix(s.copy()))) if len(s) else 0) for s in sets]
            yield pd.DataFrame({
                "key": pdf["key"].to_numpy()[part], "n": [len(s) for s in sets], "bands": bands,
                "f1": np.array([p[0] for p in prints], np.uint64).view(np.int64), "f2": np.array([p[1] for p in prints], np.uint64).view(np.int64),
            })
    release()


# -- Bayesian pruning -----------------------------------------------------------------------------------------


@lru_cache
def least_matches(threshold: float, tolerance: float) -> np.ndarray:
    """How many of the first STEP, 2 * STEP, ... values must agree for a pair to stay.

    The posterior's chance of a similarity of `threshold` or more is a sum over the grid of the density.
    """
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            logs = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(logs - logs.max())
            if density[grid >= threshold].sum() / density.sum() >= tolerance:
                out.append(m)
                break
    return np.array(out)


def candidates(mine: np.ndarray, others: np.ndarray, my_bands: np.ndarray, bands: np.ndarray, threshold: float, tolerance: float) -> np.ndarray:
    """Which rows of `others` share a band with the signature `mine` and survive the incremental comparison: STEP values
    at a time are compared, of the rows that are still in."""
    alive = np.flatnonzero((bands == my_bands).any(1))
    matches = np.zeros(len(alive), np.int64)
    for k, need in enumerate(least_matches(threshold, tolerance)):
        if not len(alive):
            break
        look = slice(k * STEP, (k + 1) * STEP)
        matches += (others[alive, look] == mine[look]).sum(1)
        stay = matches >= need
        alive, matches = alive[stay], matches[stay]
    return alive


def linked(left: list[np.ndarray], right: list[np.ndarray], threshold: float, tolerance: float, same: bool) -> Iterator[tuple[int, np.ndarray]]:
    """(i, places in `right` linked to left[i]); within one block only later places."""
    sig_l, sig_r = signatures(left), signatures(right)
    bands_l, bands_r = bands_of(sig_l), bands_of(sig_r)
    # sets as rows of a table of the hashes that at least two sets hold; a hash of one set is in no intersection
    held, counts = np.unique(np.concatenate(left if same else left + right), return_counts=True)
    held = held[counts > 1]
    sizes_r = np.array([len(s) for s in right])
    place_r = [np.searchsorted(held, s[np.isin(s, held, assume_unique=True)]) for s in right]
    order = np.concatenate(place_r) if place_r else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(right)), [len(p) for p in place_r])
    by = np.argsort(order, kind="stable")
    first = np.searchsorted(order[by], np.arange(len(held) + 1))
    owner = owner[by]
    for i, s in enumerate(left):
        begin = i + 1 if same else 0
        found = candidates(sig_l[i], sig_r[begin:], bands_l[i], bands_r[begin:], threshold, tolerance) + begin
        if not len(found):
            continue
        if len(found) < 8:
            shared = np.array([np.isin(s, right[j], assume_unique=True).sum() for j in found])
        else:  # all at once: how often each set appears in the lists of this set's hashes
            at = np.searchsorted(held, s)
            at = at[(at < len(held)) & (held[np.minimum(at, len(held) - 1)] == s)] if len(held) else at[:0]
            lists = [owner[first[a] : first[a + 1]] for a in at]
            shared = np.bincount(np.concatenate(lists), minlength=len(right))[found] if lists else np.zeros(len(found), np.int64)
        union = len(s) + sizes_r[found] - shared
        ok = shared >= threshold * union - 1e-9
        if ok.any():
            yield i, found[ok]


class Forest:
    """Union by least number."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _verified(threshold: float, tolerance: float):
    """Takes the rows of one pair of blocks x, y; gives (key, links, root)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("key", ignore_index=True)
        keys, copies = pdf["key"].to_numpy(), pdf["copies"].to_numpy()
        sets: list[np.ndarray] = []
        for part in chunks(pdf["text"], 1 << 18):
            sets += shingles([raw(t) for t in pdf["text"].iloc[part]])
        sides = [np.flatnonzero(pdf["block"].to_numpy() == b) for b in np.unique(pdf["block"])]
        a, b = sides[0], sides[-1]
        forest, links = Forest(len(pdf)), np.zeros(len(pdf), np.int64)
        if len(sides) == 1 and pdf["x"].iloc[0] != pdf["y"].iloc[0]:  # the other block is empty
            return pd.DataFrame({"key": keys[:0], "links": links[:0], "root": keys[:0]})
        for i, found in linked([sets[k] for k in a], [sets[k] for k in b], threshold, tolerance, len(sides) == 1):
            links[a[i]] += copies[b[found]].sum()
            links[b[found]] += copies[a[i]]
            for j in b[found].tolist():
                forest.join(int(a[i]), j)
        roots = np.array([forest.root(k) for k in range(len(pdf))])
        some = links > 0
        return pd.DataFrame({"key": keys[some], "links": links[some], "root": keys[roots[some]]})

    return run


# -- Spark ----------------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(a, root) for the nodes of edges (a, b): the least node that is connected to a.

    Each round, every node takes the least root of its neighbours, and then its root's root. Rounds grow with the
    logarithm of a component's width; each is written to the shared folder.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")))
    while True:
        near = both.join(roots.select(F.col("a").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
        lower = roots.join(near, "a").select("a", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        jump = lower.select(F.col("a").alias("root"), F.col("root").alias("up"))
        stepped = stored(lower.join(jump, "root", "left").select("a", F.least("root", F.coalesce("up", "root")).alias("root"), "was"))
        changed = stepped.filter("root < was").limit(1).count()
        roots = stepped.select("a", "root")
        if not changed:
            return roots


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row per row of `docs`: key, class_id (least key of those connected by links), copy_id (least key with an equal
    set), n_links (other documents at or above the threshold, copies included) and n_shingles."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    nameless, rows = rows.filter("key IS NULL"), rows.filter("key IS NOT NULL")
    made = stored(rows.mapInPandas(_prepared, f"key {kind}, n long, bands array<long>, f1 long, f2 long"))
    prints = made.filter("n > 0").groupBy("f1", "f2", "n").agg(F.min("key").alias("copy_id"), F.count("*").alias("copies"))
    classes = stored(prints)
    members = made.select("key", "f1", "f2", "n").join(classes, ["f1", "f2", "n"], "left").select("key", "n", F.coalesce("copy_id", "key").alias("copy_id"), F.coalesce("copies", F.lit(1)).alias("copies"))

    firsts = made.join(classes.select(F.col("copy_id").alias("key"), "copies"), "key").select("key", F.explode("bands").alias("band"))
    buckets = firsts.groupBy("band").agg(F.min("key").alias("least"), F.count("*").alias("m")).filter("m > 1")
    edges = firsts.join(buckets, "band").filter(F.col("key") != F.col("least")).select(F.col("key").alias("a"), F.col("least").alias("b")).distinct()
    grouped = components(edges)

    # blocks of a component: numbered, so that block pairs cover every pair once
    sized = grouped.join(grouped.groupBy("root").agg(F.count("*").alias("m")), "root")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    # the place in a block comes from a hash: blocks are about even, and no component is sorted in one task
    sized = sized.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("a"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(F.col("block"), o).alias("x"), F.greatest(F.col("block"), o).alias("y")))
    needed = sized.select(F.col("a").alias("key"), "root", "block", F.explode(pairs).alias("pair"))
    copies = classes.select(F.col("copy_id").alias("key"), "copies")
    fetched = rows.join(grouped.select(F.col("a").alias("key")), "key").join(copies, "key")
    found = (
        needed.join(fetched, "key")
        .select("key", "copies", "block", "text", "root", F.col("pair.x").alias("x"), F.col("pair.y").alias("y"))
        .groupBy("root", "x", "y")
        .applyInPandas(_verified(threshold, tolerance), f"key {kind}, links long, root {kind}")
    )
    found = stored(found)
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    forest = found.filter(F.col("key") != F.col("root")).select(F.col("key").alias("a"), F.col("root").alias("b"))
    groups = components(forest).select(F.col("a").alias("copy_id"), F.col("root").alias("group_id"))
    out = members.join(groups, "copy_id", "left").join(links.withColumnRenamed("key", "copy_id"), "copy_id", "left")
    out = out.select("key", F.coalesce("group_id", "copy_id").alias("class_id"), "copy_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.col("n").alias("n_shingles"))
    alone = nameless.select("key", F.col("key").alias("class_id"), F.col("key").alias("copy_id"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_shingles"))
    return out.unionByName(alone).withColumnRenamed("key", key)


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` whose key is the least of its class, with the columns of `docs`; of rows with the same key and
    text, one (the least by its other columns)."""
    again, group = with_fresh(docs, "near_key"), with_fresh(docs, "near_group")
    found = near_duplicates(docs, key, text).select(F.col(key).alias(again), F.col("class_id").alias(group))
    gone = found.filter(F.col(again) != F.col(group)).select(again)
    kept = docs.join(gone, F.col(f"`{key}`") == F.col(again), "left_anti")
    twice = docs.select(F.col(f"`{key}`").alias(again)).filter(F.col(again).isNotNull()).groupBy(again).agg(F.count("*").alias("n")).filter("n > 1").select(again)
    if twice.isEmpty():
        return kept
    place = with_fresh(docs, "near_place")
    same = F.col(f"`{key}`") == F.col(again)
    order = Window.partitionBy(f"`{key}`", f"`{text}`").orderBy(F.to_json(F.struct(*[f"`{c}`" for c in docs.columns])))
    once = kept.join(twice, same, "left_semi").withColumn(place, F.row_number().over(order)).filter(F.col(place) == 1).drop(place)
    return kept.join(twice, same, "left_anti").unionByName(once)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared_folder(spark)
    return near_duplicates(table(spark, sf_dir, "documents"))
