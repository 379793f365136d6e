"""Benchmark decontamination: an FM-index per training shard, searched for all windows of the benchmark's items.

1. A benchmark item's windows are its runs of `WINDOW` consecutive words; an item of fewer is one window. Spark makes and
   counts the different ones and deals them to blocks of about `BLOCK` windows, each sent to all executors in turn: a stated
   query set against all rows. (One block in the registered query's tables.)
2. A shard is a slice of a task's documents. Its words become symbols: the block's words are numbered, and a run of other
   words, which no window crosses, is one separator, as is the end of a document. The shard's FM-index (`fm_index`) has
   a suffix order, a wavelet matrix of the symbols before the suffixes, and sampled suffix positions.
3. All windows are searched backward at once through the wavelet ranks. The rows found are located by steps back to a
   sampled position, a bounded number of them at a time.
4. Occurrences are merged to spans of hit words per document, for the count and for removal.

Words are compared by 64-bit hashes (a false match in 10^9 different words against 10^5 has a chance of 5e-6).

Defined results: null and empty texts, and texts of separators only, have no words and are clean. An item without words has
no windows. Items with one id count once; an item whose id is null is named ''. Repeated documents each have their row; a
null key stays. Without items nothing is hit; without documents the result is empty. Only key and text (item and text of the
benchmark) are read, whatever other columns are named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, chunks, raw, release, stored, table, with_fresh, words_of
from .fm_index import FmIndex

WINDOW = 10
#: Windows that are sent to all executors at once.
BLOCK = 100_000
#: Characters of a shard, and occurrences located at a time.
SHARD, AT_ONCE = 6 << 20, 1 << 20
LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes that no word holds, after lower-casing.
BREAKS = np.array([not (48 <= b <= 57 or 97 <= b <= 122 or b >= 128) for b in range(256)])
SPAN = "array<struct<first:long,last:long,begin:long,end:long>>"


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", length: int = WINDOW) -> DataFrame:
    """Different windows of words (`words`) with the ids of the items that hold them (`items`)."""
    lower = F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = benchmark.select(F.coalesce(F.col(f"`{item}`").cast("string"), F.lit("")).alias("item"), F.regexp_extract_all(lower, F.lit(LETTERS), F.lit(0)).alias("all")).filter(F.size("all") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - length + 1, F.lit(1)))
    each = rows.select("item", "all", F.explode(starts).alias("start")).select("item", F.slice("all", F.col("start"), length).alias("words"))
    return each.groupBy("words").agg(F.collect_set("item").alias("items"))


class Phrases:
    """A block of windows: their words' hashes in order, the windows as word numbers, and their items."""

    def __init__(self, rows: list[tuple[list[str], list[str]]], length: int):
        words = sorted({w for window, _ in rows for w in window})
        hashes = words_of("\n".join(words).encode(), BREAKS)[2] if words else np.empty(0, np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        number = {words[k]: n + 1 for n, k in enumerate(order.tolist())}
        self.sequences = np.full((len(rows), length), -1, np.int64)
        self.lengths = np.array([len(w) for w, _ in rows], np.int64)
        for k, (window, _) in enumerate(rows):
            self.sequences[k, length - len(window) :] = [number[w] for w in window]
        self.items = sorted({i for _, items in rows for i in items})
        at = {i: n for n, i in enumerate(self.items)}
        self.owners = [np.array([at[i] for i in items], np.int64) for _, items in rows]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word, 0 for words of no window."""
        out = np.zeros(len(hashes), np.int64)
        likely = np.flatnonzero(self.maybe[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        if len(likely):
            wanted = hashes[likely]
            at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
            same = self.hashes[at] == wanted
            out[likely[same]] = at[same] + 1
        return out


def search(texts: list[bytes], phrases: Phrases) -> tuple[np.ndarray, dict[int, list[tuple[int, int, int, int]]], dict[int, list[str]]]:
    """Words per text; for texts with occurrences, their spans (first and last word, first byte and end) and items."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)])
    start, end, hashes = words_of(b"\n".join(texts).translate(LOWER), BREAKS)
    counts = np.diff(np.searchsorted(start, begin))
    first_word = np.concatenate([[0], np.cumsum(counts)])
    n = len(start)
    if not n or not len(phrases.hashes):
        return counts, {}, {}
    number = phrases.numbers(hashes)
    ends = np.zeros(n, bool)
    ends[first_word[1:][counts > 0] - 1] = True
    # a separator for each run of other words, and one at the end of each text
    known = number > 0
    shown = known.copy()
    shown[1:] |= known[:-1]
    shown[0] = True
    shown |= ends
    breaks = known & ends
    place = np.cumsum(shown.astype(np.int64) + breaks) - breaks - 1
    symbols = np.zeros(int(shown.sum() + breaks.sum()) + 1, np.int64)
    word_at = np.zeros(len(symbols), np.int64)
    symbols[place[known]] = number[known]
    word_at[place[known]] = np.flatnonzero(known)
    index = FmIndex(symbols, len(phrases.hashes))
    low, high = index.ranges(phrases.sequences)
    edges = np.zeros(n + 1, np.int64)
    owners: set[tuple[int, int]] = set()
    text_of = np.repeat(np.arange(len(texts)), counts)
    found = np.flatnonzero(low < high)
    many = (high - low)[found]
    upto = np.cumsum(many)
    total = int(upto[-1]) if len(upto) else 0
    for a in range(0, total, AT_ONCE):
        k = np.arange(a, min(total, a + AT_ONCE))
        which = np.searchsorted(upto, k, side="right")
        phrase = found[which]
        at = word_at[index.locate(low[phrase] + k - (upto[which] - many[which]))]
        np.add.at(edges, at, 1)
        np.add.at(edges, at + phrases.lengths[phrase], -1)
        pairs = np.unique(text_of[at] * len(low) + phrase)
        owners.update((t, int(i)) for t, p in zip(*divmod(pairs, len(low)), strict=True) for i in phrases.owners[p])
    hit = np.cumsum(edges[:-1]) > 0
    opens = hit & np.concatenate([[True], ~hit[:-1] | ends[:-1]])
    closes = hit & np.concatenate([~hit[1:], [True]]) | hit & ends
    spans: dict[int, list[tuple[int, int, int, int]]] = {}
    for a, b in zip(np.flatnonzero(opens).tolist(), np.flatnonzero(closes).tolist(), strict=True):
        t = int(text_of[a])
        spans.setdefault(t, []).append((a - int(first_word[t]), b - int(first_word[t]), int(start[a] - begin[t]), int(end[b] - begin[t])))
    items: dict[int, list[str]] = {}
    for t, i in sorted(owners):
        items.setdefault(int(t), []).append(phrases.items[i])
    return counts, spans, items


def _merged(spans):
    """Spans that overlap or touch as one."""
    out = []
    for s in sorted(spans, key=lambda s: s["first"]):
        if out and s["first"] <= out[-1]["last"] + 1:
            if s["last"] > out[-1]["last"]:
                out[-1] |= {"last": s["last"], "end": s["end"]}
        else:
            out.append({k: s[k] for k in ("first", "last", "begin", "end")})
    return out


def located(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", length: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """One row per row of `docs`: the key, n_words, `spans` of hit words (with bytes of the text), and `items` in order."""
    spark = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    found = stored(windows(benchmark, item, item_text, length))
    n_blocks = max(1, -(-found.count() // block))

    def searched(number: int) -> DataFrame:
        rows = found.filter(F.pmod(F.xxhash64("words"), F.lit(n_blocks)) == number).collect()
        sent = spark.sparkContext.broadcast(Phrases([(r["words"], r["items"]) for r in rows], length))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for part in chunks(pdf["text"], SHARD):
                    rows = pdf.iloc[part]
                    counts, spans, items = search([raw(t) for t in rows["text"]], sent.value)
                    named = [[dict(zip(("first", "last", "begin", "end"), s, strict=True)) for s in spans.get(k, ())] for k in range(len(rows))]
                    yield pd.DataFrame({"key": rows["key"], "same": rows["same"], "n_words": counts, "spans": named, "items": [items.get(k, []) for k in range(len(rows))]})
            release()

        same = F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))) if n_blocks > 1 else F.lit("")
        rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"), same.alias("same"))
        return rows.mapInPandas(run, f"key {kind}, same string, n_words long, spans {SPAN}, items array<string>")

    if n_blocks == 1:
        return searched(0).drop("same").withColumnRenamed("key", key)
    # rows of one key and one text have the same occurrences, so these need no number of their own
    parts = [stored(searched(k)) for k in range(n_blocks)]
    hits = parts[0].filter(F.size("items") > 0)
    for p in parts[1:]:
        hits = hits.unionByName(p.filter(F.size("items") > 0))
    merge = F.udf(_merged, SPAN)
    hits = hits.dropDuplicates().groupBy(F.col("key").alias("k"), F.col("same").alias("s")).agg(merge(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    rows = parts[0].select("key", "same", "n_words").join(hits, F.col("key").eqNullSafe(F.col("k")) & (F.col("same") == F.col("s")), "left")
    none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).alias(c)
    return rows.select(F.col("key").alias(key), "n_words", none("spans", SPAN), none("items", "array<string>"))


def cleaned(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of `docs`, with what lies in spans of hit words cut out of their texts; keys are assumed to name one text each."""
    again, spans = with_fresh(docs, "hit_key"), with_fresh(docs, "hit_spans")
    hits = located(docs, benchmark, key, text, **how).filter(F.size("spans") > 0).select(F.col(f"`{key}`").alias(again), F.col("spans").alias(spans)).dropDuplicates([again])

    @F.pandas_udf("string")
    def cut(texts: pd.Series, found: pd.Series) -> pd.Series:
        def one(t, at):
            if at is None or not isinstance(t, str):
                return t
            b, out, upto = raw(t), [], 0
            for s in at:
                out.append(b[upto : s["begin"]])
                upto = s["end"]
            return b"".join([*out, b[upto:]]).decode("utf-8", "surrogatepass")

        return pd.Series([one(t, at) for t, at in zip(texts, found, strict=True)])

    joined = docs.join(hits, F.col(f"`{key}`").eqNullSafe(F.col(again)), "left")
    return joined.select([cut(F.col(f"`{c}`"), F.col(spans)).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns])


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = located(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{LETTERS}')"
SQL = f"""
WITH b AS (SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS ws FROM benchmark),
k AS (SELECT item, ws, unnest(range(1, greatest(len(ws) - {WINDOW - 1}, 1) + 1)) AS i FROM b WHERE len(ws) > 0),
q AS (SELECT DISTINCT item, least(len(ws), {WINDOW}) AS n, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS phrase FROM k),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
p AS (SELECT r, l.n, ws, unnest(range(1, len(ws) - l.n + 2)) AS i FROM d JOIN (SELECT DISTINCT n FROM q) l ON len(ws) >= l.n),
o AS (SELECT p.r, p.i, p.n, q.item FROM p JOIN q ON q.n = p.n AND q.phrase = array_to_string(p.ws[p.i:p.i + p.n - 1], ' ')),
h AS (SELECT r, count(DISTINCT w) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS w FROM o) x GROUP BY r),
t AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest FROM (SELECT DISTINCT r, item FROM o) x GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.r = d.r LEFT JOIN t ON t.r = d.r
"""
