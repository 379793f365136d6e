"""Language-model scores from a hashed maximum-entropy model with class-factored softmax.

Tokens are the words of a text, A-Z lower-cased, and one end. The model predicts each token from the two before it. Every
word stands at a leaf of a class tree of three levels of `WAYS` branches: the `OWN` most frequent words have leaves of
their own, all others share the rest by their hash. With c1, c2, c3 the branches that lead to the leaf of w,

    P(w | p1, p2) = P(c1 | p1, p2) * P(c2 | c1, p1, p2) * P(c3 | c1, c2, p1, p2) * P(w | leaf)

Each of the first three factors is a softmax over a bias (the logarithm of the branch's count in training) and the
weights of three features: p1, the pair (p2, p1), and p2 alone (a skip over p1). Features are made of the hashes of
whatever words stand there, frequent or not; node and feature are hashed to a row of a table of fixed size. In a
shared leaf a word has its smoothed share of the exact corpus counts, (c + 0.5) / (N' + 0.5 * (V' + 1)) over the leaf.
So scores are proper and comparable with the unigram base score.

Training passes once over the tokens of all training documents: they are dealt into `STEPS` batches by hash, and each batch
is one distributed gradient update. Each task sums observed and expected counts per weight over its documents, Spark adds
the sums up, and a step scaled by the counts follows; tasks are as many as the batch has partitions.

All words are counted, in Spark. Counts of the `HEAD` most frequent words go to the tasks; the other words of a document
are joined with the counts, and their logarithms summed per document. Scoring works on batches in numpy: each distinct
(p2, p1, leaf) of a batch is scored once.

Words are compared by 64-bit hashes. Defined results: a null or empty text is one end token. Without training
documents N is 0, base and model give every token the same share. Repeated rows get equal scores, an empty table
gives an empty table. Ties in frequency are broken by the hash. Rows without key have null results and teach nothing.
Only key, text and the training condition are read, so other columns may have any name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, chunks, crc_mod, mix, raw, shared_folder, stored, table, words_of
from .language_id import Table

#: Branches of a node of the class tree (three levels); words with a leaf of their own; words counted in the tasks.
WAYS, OWN, HEAD = 32, 1 << 14, 200_000
LEAVES = WAYS**3
#: Rows of the table of weights (WAYS weights each), updates, their size, and counts that a weight must outweigh.
ROW_BITS, STEPS, RATE, SMOOTH = 14, 10, 0.4, 2.0
#: Rows of a slice of the gradient; tokens whose branches are worked out at once, so that they stay in the processor's cache.
SLICE, AT_ONCE = 1 << 10, 1 << 11

_LOG10 = np.log(10.0)


@dataclass
class Words:
    """Hashes of frequent words, most frequent first: number 0 is the end; and their counts."""

    hashes: np.ndarray
    counts: np.ndarray
    own: int = OWN  # leaves that hold one word
    index: Table | None = field(default=None, repr=False)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Place in the list, -1 for other words."""
        if self.index is None:
            self.index = Table(self.hashes[1:].view(np.int64) & np.int64((1 << 62) - 1))
        found = self.index.find(h.view(np.int64) & np.int64((1 << 62) - 1))
        return np.where(found < 0, -1, found + 1)

    def __getstate__(self) -> dict:
        return {**self.__dict__, "index": None}


def tokens(texts: list[bytes], words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, number in the list and hash of each token; the end of each text has number 0."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes + 1) - 1
    start, _, h = words_of(b" ".join(t.translate(LOWER) for t in texts))
    owner = np.searchsorted(ends, start, "right")
    last = np.cumsum(np.bincount(owner, minlength=len(texts)))
    return np.insert(owner, last, np.arange(len(texts))), np.insert(words.numbers(h), last, 0), np.insert(h, last, np.uint64(0))


def leaves(number: np.ndarray, h: np.ndarray, own: int) -> np.ndarray:
    """The leaf of each word."""
    return np.where((number >= 0) & (number < own), number, own + (h % np.uint64(LEAVES - own)).astype(np.int64))


def contexts(owner: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the one and the two tokens before each token; 1 and 2 before a text."""
    p1, p2 = np.full(len(h), 1, np.uint64), np.full(len(h), 2, np.uint64)
    p2[1:][owner[1:] == owner[:-1]] = 1
    same1, same2 = owner[1:] == owner[:-1], owner[2:] == owner[:-2]
    p1[1:][same1] = h[:-1][same1]
    p2[2:][same2] = h[:-2][same2]
    return p1, p2


def distinct(p1: np.ndarray, p2: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal (p1, p2, leaf): the place of one, to which each belongs, and how many there are."""
    mark = mix(mix(p1 + np.uint64(7)) ^ (p2 * np.uint64(0xA0761D6478BD642F)) ^ leaf.astype(np.uint64))
    _, first, at, n = np.unique(mark, return_index=True, return_inverse=True, return_counts=True)
    return first, at, n


class Maxent:
    """The class tree, its biases and the weights."""

    def __init__(self, leaf_counts: np.ndarray):
        mass = leaf_counts.astype(float) + 0.5
        #: logarithms of the shares of each node's branches: the root's, those of its children, and of theirs
        self.bias = [_normal(np.log(mass.reshape(-1, WAYS, WAYS ** (2 - k)).sum(2))).astype(np.float32) for k in range(3)]
        self.weights = np.zeros((1 << ROW_BITS, WAYS), np.float32)

    def features(self, p1: np.ndarray, p2: np.ndarray) -> np.ndarray:
        """Hashes of the features of each context, a column each."""
        a, b = np.uint64(0x632BE59BD9B4E019), np.uint64(0xE7037ED1A0B428DB)
        return np.stack([mix(p1 ^ a), mix((p1 * a) ^ mix(p2 + b)), mix(p2 ^ b)], 1)

    def rows(self, f: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Rows of the weights of each feature at a node."""
        h = (f ^ (node.astype(np.uint64)[:, None] * np.uint64(0xA0761D6478BD642F))) * np.uint64(0xE7037ED1A0B428DB)
        return (h >> np.uint64(64 - ROW_BITS)).astype(np.int64)

    def sums(self, f: np.ndarray, leaf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per level: rows of the weights, bias and weights of all branches of the node added up, and the branch that is taken.

        The sums are at most the features' number times RATE times the updates, so that their exponentials don't overflow.
        """
        for k in range(3):
            above = leaf // WAYS ** (3 - k)
            rows = self.rows(f, above + (0, 1, 1 + WAYS)[k])
            x = self.bias[k].take(above, 0)
            for j in range(rows.shape[1]):
                x += self.weights.take(rows[:, j], 0)
            yield rows, x, leaf // WAYS ** (2 - k) % WAYS

    def levels(self, f: np.ndarray, leaf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per level: rows of the weights, logarithms of all branches of the node, and the branch that is taken."""
        for rows, x, branch in self.sums(f, leaf):
            yield rows, _normal(x), branch

    def logs(self, p1: np.ndarray, p2: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        """Natural logarithm of P(leaf | p1, p2)."""
        out = np.zeros(len(leaf))
        for begin in range(0, len(leaf), AT_ONCE):
            part = slice(begin, begin + AT_ONCE)
            for _, x, branch in self.sums(self.features(p1[part], p2[part]), leaf[part]):
                taken = x[np.arange(len(branch)), branch]
                out[part] += taken - np.log(np.exp(x, out=x).sum(1))
        return out

    def add(self, p1: np.ndarray, p2: np.ndarray, leaf: np.ndarray, n: np.ndarray, observed: np.ndarray, expected: np.ndarray) -> None:
        """Adds observed and expected counts per weight, of n tokens at each (p1, p2, leaf)."""
        flat, total, many = observed.reshape(-1), np.zeros(expected.shape[::-1]), 50_000
        for begin in range(0, len(leaf), many):
            size = min(many, len(leaf) - begin)
            should, at = np.empty((3, WAYS, size)), np.empty((3, 3, size), np.int64)  # by level: a row per branch, a row per feature
            for first in range(0, size, AT_ONCE):
                here = slice(first, min(first + AT_ONCE, size))
                part = slice(begin + here.start, begin + here.stop)
                m = n[part].astype(np.float32)
                for k, (rows, x, branch) in enumerate(self.sums(self.features(p1[part], p2[part]), leaf[part])):
                    np.exp(x, out=x)
                    x *= (m / x.sum(1))[:, None]
                    should[k, :, here], at[k, :, here] = x.T, rows.T
                    for j in range(rows.shape[1]):
                        np.add.at(flat, rows[:, j] * WAYS + branch, m)
            for k in range(3):
                for rows in at[k]:
                    for c in range(WAYS):
                        total[c] += np.bincount(rows, should[k, c], len(expected))
        expected += total.T

    def step(self, observed: np.ndarray, expected: np.ndarray) -> None:
        self.weights += (RATE * (observed - expected) / (np.maximum(observed, expected) + SMOOTH)).astype(np.float32)


def _normal(x: np.ndarray) -> np.ndarray:
    x = x - x.max(1, keepdims=True)
    return x - np.log(np.exp(x).sum(1, keepdims=True))


# -- Spark ----------------------------------------------------------------------------------------------------


def word_counts(train: DataFrame) -> DataFrame:
    """(h, n): hash and count of each word of all training documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in chunks(pdf["text"]):
                h, n = np.unique(words_of(b" ".join(raw(t).translate(LOWER) for t in pdf["text"].iloc[part]))[2], return_counts=True)
                yield pd.DataFrame({"h": h.view(np.int64), "n": n.astype(np.int64)})

    return stored(train.select("text").mapInPandas(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")))


def frequent_words(counts: DataFrame, ends: int = 0, own: int = OWN) -> Words:
    """The HEAD most frequent words, most frequent first, after the end token."""
    top = counts.orderBy(F.desc("n"), "h").limit(HEAD).toPandas()
    return Words(np.concatenate([np.zeros(1, np.uint64), top["h"].to_numpy(np.int64).view(np.uint64)]), np.concatenate([[ends], top["n"].to_numpy(np.int64)]), own)


def leaf_counts(counts: DataFrame, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and different words at each leaf."""
    share = LEAVES - words.own
    place = F.expr(f"pmod(pmod(h, {share}) + IF(h < 0, {2**64 % share}, 0), {share})")  # the hash is unsigned
    sums = counts.groupBy(place.cast("int").alias("leaf")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).toPandas()  # `share` rows at most
    own = min(words.own, len(words.hashes))
    n, kinds = np.zeros(LEAVES, np.int64), np.zeros(LEAVES, np.int64)
    n[words.own + sums["leaf"]], kinds[words.own + sums["leaf"]] = sums["n"], sums["kinds"]
    shared = words.own + (words.hashes[1:own] % np.uint64(share)).astype(np.int64)
    np.subtract.at(n, shared, words.counts[1:own])
    np.subtract.at(kinds, shared, 1)
    n[:own], kinds[:own] = words.counts[:own], 1
    return n, kinds


def rare_words(rows: DataFrame, words: Words, counts: DataFrame) -> DataFrame:
    """Of the words not in the list: (key, twin, more, more_known) per (key, twin), the sum of log10(c + 0.5) and the tokens with c > 0."""
    frozen = rows.sparkSession.sparkContext.broadcast(words)
    kind = rows.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = frozen.value
        for pdf in batches:
            keys, twins = pdf["key"].to_numpy(), pdf["twin"].to_numpy()
            for part in chunks(pdf["text"], 1 << 20):
                owner, number, h = tokens([raw(t) for t in pdf["text"].iloc[part]], w)
                rare = number < 0
                who = owner[rare] + part.start
                yield pd.DataFrame({"h": h[rare].view(np.int64), "key": keys[who], "twin": twins[who]})

    found = rows.mapInPandas(run, f"h long, key {kind}, twin long").join(counts, "h", "left")
    c = F.coalesce("n", F.lit(0))
    return stored(found.groupBy("key", "twin").agg(F.sum(F.log10(c + F.lit(0.5))).alias("more"), F.sum((c > 0).cast("long")).alias("more_known")))


def fit(train: DataFrame, words: Words, leaf_n: np.ndarray, steps: int = STEPS) -> Maxent:
    """Weights from the tokens of all training documents, in `steps` batches of one update each."""
    spark = train.sparkSession
    model, path = Maxent(leaf_n), f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    train.select("text", F.pmod(F.xxhash64("key", "text"), F.lit(steps)).cast("int").alias("batch")).write.partitionBy("batch").parquet(path)
    batches_of = spark.read.schema("text string, batch int").parquet(path)
    known = spark.sparkContext.broadcast(words)
    for step in range(steps):
        frozen = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pd.DataFrame], frozen=frozen) -> Iterator[pd.DataFrame]:
            m, sums = frozen.value, None
            for pdf in batches:
                for part in chunks(pdf["text"]):
                    owner, number, h = tokens([raw(t) for t in pdf["text"].iloc[part]], known.value)
                    (p1, p2), leaf = contexts(owner, h), leaves(number, h, known.value.own)
                    use, _, n = distinct(p1, p2, leaf)
                    sums = np.zeros((2, *m.weights.shape), np.float32) if sums is None else sums
                    m.add(p1[use], p2[use], leaf[use], n, *sums)
            for begin in range(0, 0 if sums is None else len(m.weights), SLICE):
                yield pd.DataFrame({"slice": [begin], "x": [sums[:, begin : begin + SLICE].tobytes()]})

        def added(pdf: pd.DataFrame) -> pd.DataFrame:
            x = np.sum([np.frombuffer(x, np.float32) for x in pdf["x"]], axis=0, dtype=np.float64)
            return pd.DataFrame({"slice": pdf["slice"].iloc[:1], "x": [x.astype(np.float32).tobytes()]})

        some = batches_of.filter(F.col("batch") == step).select("text")
        slices = some.mapInPandas(run, "slice int, x binary").groupBy("slice").applyInPandas(added, "slice int, x binary").collect()  # as many bytes as weights
        frozen.unpersist()
        if slices:
            total = np.concatenate([np.frombuffer(r["x"], np.float32).reshape(2, -1, WAYS) for r in sorted(slices, key=lambda r: r["slice"])], 1)
            model.step(*total)
    return model


def score(docs: DataFrame, training: Column, key: str = "doc_id", text: str = "text", steps: int = STEPS, own: int = OWN) -> DataFrame:
    """One row per row of `docs`: key, n_tokens, n_known, train_tokens, base_score, score (log10), and `train`."""
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), F.coalesce(training, F.lit(False)).alias("train"))
    nameless, rows = rows.filter("key IS NULL"), rows.filter("key IS NOT NULL")
    # rows that share a key are told apart by their text; where no key is shared, nothing more needs to move
    shared = not rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()
    rows = rows.withColumn("twin", F.xxhash64("text") if shared else F.lit(0).cast("long"))
    train = rows.filter("train")
    counts = word_counts(train)
    ends = train.count()
    words = frequent_words(counts, ends, own)
    leaf_n, leaf_kinds = leaf_counts(counts, words)
    total, kinds = int(leaf_n.sum()), int(leaf_kinds[1:].sum()) + int(ends > 0)
    model = fit(train, words, leaf_n, steps)
    rare = rare_words(rows, words, counts)
    base_log = np.log10(total + 0.5 * (kinds + 1))
    leaf_log = np.log10(leaf_n + 0.5 * (leaf_kinds + 1))
    frozen = docs.sparkSession.sparkContext.broadcast((words, model, leaf_log))  # all of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w, m, leaf_logs = frozen.value
        logs10 = np.log10(w.counts + 0.5)
        for pdf in batches:
            for part in chunks(pdf["text"]):
                owner, number, h = tokens([raw(t) for t in pdf["text"].iloc[part]], w)
                size = part.stop - part.start
                per = lambda x, owner=owner, size=size: np.bincount(owner, x, size)
                listed, leaf = number >= 0, leaves(number, h, w.own)
                own = np.where(listed, logs10[np.maximum(number, 0)], 0.0)
                known = listed & (w.counts[np.maximum(number, 0)] > 0)
                p1, p2 = contexts(owner, h)
                use, at, _ = distinct(p1, p2, leaf)
                p = (m.logs(p1[use], p2[use], leaf[use]) / _LOG10)[at]
                n = per(None)
                yield pd.DataFrame({
                    "key": pdf["key"].iloc[part], "twin": pdf["twin"].iloc[part], "train": pdf["train"].iloc[part], "n_tokens": n.astype(np.int64), "known": per(known).astype(np.int64),
                    "own": per(own) - n * base_log, "model": per(p) + per(np.where(leaf < w.own, 0.0, own - leaf_logs[leaf])),
                })

    kind = rows.schema["key"].dataType.simpleString()
    made = rows.mapInPandas(run, f"key {kind}, twin long, train boolean, n_tokens long, known long, own double, model double")
    out = made.join(rare, ["key", "twin"], "left")
    rows_of = F.count("*").over(Window.partitionBy("key", "twin")) if shared else F.lit(1)  # the sums are over all equal rows
    more, more_known = F.coalesce("more", F.lit(0.0)) / rows_of, (F.coalesce("more_known", F.lit(0)) / rows_of).cast("long")
    out = out.select(
        F.col("key").alias(key), "train", "n_tokens", (F.col("known") + more_known).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("own") + more).alias("base_score"), (F.col("model") + more).alias("score"),
    )
    return out.unionByName(nameless.select(F.col("key").alias(key), "train"), allowMissingColumns=True)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod("doc_id", 5) == 1
    out = score(table(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
