"""Language identification by prediction by partial matching.

For each language a context tree of order `ORDER` counts which byte follows each context of 0 to ORDER bytes. The
counts are frozen after training. A byte costs, in its longest context that was seen, the code length of its share
there, or that of an escape and then its cost in the next shorter context; an escape's share is d / (n + d) for n
bytes and d different ones seen after the context, a byte's is its count / (n + d); below order 0 every byte costs
8 bits. A text's cost under a language is the exact sum over its bytes, and the language with the least cost wins.

Scoring looks each byte with its ORDER bytes before it up in one table of the strings seen in training (all
languages side by side); a string that wasn't seen falls back, context by context, to shorter ones. Tables have the
size of what was seen in a bounded number of training documents.

Contexts start at the beginning of a text with zero bytes. Texts are scored whole.

Defined results: `und` and score 0 for a null text or one without a letter, or if nothing could be learned. Ties go
to the language first in order. Repeated rows give equal results, an empty table an empty table; rows without lang
teach nothing. The score is the winner's share of the posterior, with code lengths divided by the square root of the
text's length (bytes aren't independent).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, crc_mod, raw, table

ORDER = 3
#: At most about this many documents are learned from, drawn by a hash of the text; a bound on the model's size.
TRAINING_DOCS = 20_000

_LETTER = regex.compile(r"\p{L}")


def codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of the texts, it and the ORDER bytes before it as a number; and where each text ends."""
    data = np.frombuffer(b"".join(bytes(ORDER) + t for t in texts), np.uint8).astype(np.uint32)
    code = data.copy()
    for k in range(1, ORDER + 1):
        code[k:] |= data[:-k] << np.uint32(8 * k)
    sizes = np.array([len(t) for t in texts], np.int64)
    keep = np.ones(len(data), bool)
    begin = np.concatenate([[0], np.cumsum(sizes + ORDER)[:-1]])
    for k in range(ORDER):
        keep[begin + k] = False
    return code[keep], np.cumsum(sizes)


def counted(docs: DataFrame) -> pd.DataFrame:
    """(lang, code, n) of rows (lang, text); partial sums in the tasks, as many rows as there are strings seen."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                for piece in chunks(part["text"]):
                    code, n = np.unique(codes([raw(t) for t in part["text"].iloc[piece]])[0], return_counts=True)
                    yield pd.DataFrame({"lang": lang, "code": code.astype(np.int64), "n": n.astype(np.int64)})

    return docs.mapInPandas(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()


class Table:
    """Numbers to rows of floats, by open addressing; unseen numbers give -1."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1)))) + 2)
        size = 1 << self.bits
        self.key = np.full(size, -1, np.int64)
        self.row = np.full(size, -1, np.int32)
        left, at, self.probes = np.arange(len(keys)), self.place(keys), 0
        while len(left):
            self.probes += 1
            free = self.key[at] < 0
            _, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.key[at[won]], self.row[at[won]] = keys[left[won]], left[won]
            stay = np.ones(len(left), bool)
            stay[won] = False
            left, at = left[stay], (at[stay] + 1) & (size - 1)

    def place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        at = self.place(keys)
        out = np.where(self.key[at] == keys, self.row[at], -1)
        open_ = np.flatnonzero((out < 0) & (self.key[at] >= 0))
        for step in range(1, self.probes):
            if not len(open_):
                break
            spot = (at[open_] + step) & (len(self.key) - 1)
            hit = self.key[spot] == keys[open_]
            out[open_[hit]] = self.row[spot[hit]]
            open_ = open_[~hit & (self.key[spot] >= 0)]
        return out


class Model:
    """Code lengths in bits: per order, the strings seen (context and byte) and the contexts' escapes."""

    def __init__(self, counts: pd.DataFrame):
        self.langs = sorted(counts["lang"].unique())
        number = {lang: k for k, lang in enumerate(self.langs)}
        lang = counts["lang"].map(number).to_numpy(np.int64)
        code, n = counts["code"].to_numpy(np.int64), counts["n"].to_numpy(np.float64)
        self.strings: list[tuple[Table, np.ndarray]] = []
        self.escapes: list[tuple[Table, np.ndarray]] = []
        lower: np.ndarray | None = None  # costs of the next lower order, by the strings of that order
        for order in range(ORDER + 1):
            strings, at = np.unique(code & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
            seen = np.zeros((len(strings), len(self.langs)))
            np.add.at(seen, (at, lang), n)
            contexts, up = np.unique(strings >> 8, return_inverse=True)
            total, different = np.zeros((2, len(contexts), len(self.langs)))
            np.add.at(total, up, seen)
            np.add.at(different, up, (seen > 0).astype(float))
            with np.errstate(divide="ignore", invalid="ignore"):
                # a context that a language never saw costs it nothing to leave
                escape = np.where(total > 0, np.log2((total + different) / different), 0.0)
                cost = np.where(seen > 0, np.log2((total + different)[up] / seen), 0.0)
            below = np.full((len(strings), len(self.langs)), 8.0) if lower is None else lower[self.strings[-1][0].find(strings & ((1 << 8 * order) - 1))]
            cost = np.where(seen > 0, cost, escape[up] + below)
            self.strings.append((Table(strings), cost.astype(np.float32)))
            self.escapes.append((Table(contexts), escape.astype(np.float32)))
            lower = cost

    def costs(self, code: np.ndarray) -> np.ndarray:
        """Bits per language of each byte with its context."""
        code = code.astype(np.int64)
        index, cost = self.strings[ORDER]
        row = index.find(code)
        out = cost[row] if len(cost) else np.zeros((len(code), len(self.langs)), np.float32)
        left = np.flatnonzero(row < 0)
        if len(left):
            out[left] = 0
            for order in range(ORDER, -1, -1):
                if order < ORDER:
                    index, cost = self.strings[order]
                    row = index.find(code[left] & ((1 << 8 * (order + 1)) - 1))
                    hit = row >= 0
                    out[left[hit]] += cost[row[hit]]
                    left = left[~hit]
                context, escape = self.escapes[order]
                row = context.find((code[left] >> 8) & ((1 << 8 * order) - 1))
                hit = row >= 0
                out[left[hit]] += escape[row[hit]]
            out[left] += 8.0
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Bits per language of each text, in pieces that fit a core's memory."""
        out = np.zeros((len(texts), len(self.langs)))
        code, ends = codes(texts)
        begins = np.concatenate([[0], ends[:-1]])
        for a in range(0, len(code), 1 << 17):
            b = min(a + (1 << 17), len(code))
            sums = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(self.costs(code[a:b]), axis=0, dtype=np.float64)])
            first, last = np.searchsorted(ends, a, "right"), np.searchsorted(begins, b, "left")
            k = np.arange(first, last)
            out[k] += sums[np.clip(ends[k], a, b) - a] - sums[np.clip(begins[k], a, b) - a]
        return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang", training_docs: int = TRAINING_DOCS) -> Model | None:
    """A model of the rows with a lang and a text; None if there are none."""
    rows = docs.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    n = rows.select("lang").count()
    if n > training_docs:
        rows = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int((1 << 20) * training_docs / n) + 1)
    counts = counted(rows)
    return Model(counts) if len(counts) else None


def identify(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: key, lang_pred, score, and `bits` per language in the order of `model.langs`."""
    frozen = docs.sparkSession.sparkContext.broadcast(model)  # a few MB, bounded by the training documents

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = frozen.value
        for pdf in batches:
            lettered = np.array([isinstance(t, str) and _LETTER.search(t) is not None for t in pdf["text"]], bool)
            pred, score, bits = np.full(len(pdf), "und", object), np.zeros(len(pdf)), [None] * len(pdf)
            some = np.flatnonzero(lettered)
            if m is not None and len(some):
                for part in chunks(pdf["text"].iloc[some], 1 << 20):
                    at = some[part]
                    texts = [raw(t) for t in pdf["text"].iloc[at]]
                    cost = m.score(texts)
                    gap = (cost - cost.min(1, keepdims=True)) / np.sqrt([[len(t)] for t in texts])
                    pred[at] = np.array(m.langs, object)[cost.argmin(1)]
                    score[at] = 1 / np.exp2(-gap).sum(1)
                    for k, row in zip(at, cost, strict=True):
                        bits[k] = row
            yield pd.DataFrame({"key": pdf["key"], "lang_pred": pred, "score": score, "bits": bits})

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    return rows.mapInPandas(run, f"key {kind}, lang_pred string, score double, bits array<double>").withColumnRenamed("key", key)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.filter(crc_mod("doc_id", 4) != 2))
    found = identify(docs, model)
    return found.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
