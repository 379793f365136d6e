"""License scan: an exact set-similarity join of text blocks with license templates.

A block is a line of a text, or a window across lines (see below). Blocks and templates are word sets; a block meets a template if it holds at least
`threshold` of the template's words (containment). The join is exact:

* global order: template words are ordered by the number of blocks of the whole corpus that hold them, rarest first;
* prefix filter: a template of n words that a block covers to k = ceil(threshold * n) shares at least one of
  the n - k + 1 rarest template words with it, so only those words look up candidates;
* length filter: the block has at least k different words;
* positional filter: after the first shared word, at place p of the ordered template, at most n - p words can match;
* whatever is left is counted exactly.

A notice may be wrapped over lines, so windows across lines are blocks too: as many consecutive words as the template
has. A text's words pass the same filters before its windows are counted. The SQL knows lines only, so it has fewer labels
and lower scores where a notice is wrapped.

Templates are a fixed small list (a parameter). Texts are words `[0-9a-z]` and non-ASCII after lower-casing A-Z.
Phrases (base labels) are consecutive words of the whole text, across lines.

Defined results: a null or empty text has no words, no labels, null places and score 0. Repeated rows give
equal results, an empty table an empty table. Ties in word order are broken by the word.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter, defaultdict, deque
from collections.abc import Iterator, Mapping
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import raw, table

#: The phrases and their labels.
PHRASES: dict[str, str] = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: License notices in common use, as templates. Labels of their own; base labels stay.
TEMPLATES: dict[str, str] = {
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-release": "released under the mit license",
    "apache-2-notice": "licensed under the apache license version 2 0",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl-notice": "this work is licensed under the gnu general public license version",
    "gpl-program": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
    "cc-by-notice": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "rights-reserved": "all rights reserved",
    "as-is": "the software is provided as is without warranty of any kind express or implied",
}

#: Separators to spaces, A-Z to a-z, new lines kept; a byte above 127 belongs to a word.
_CLEAN = bytes(10 if b == 10 else b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Matcher:
    """Templates in global order with their prefix index."""

    def __init__(self, templates: Mapping[str, str], threshold: float, counts: Mapping[str, int]):
        self.sets = {k: frozenset(v.encode().translate(_CLEAN).split()) for k, v in templates.items()}
        rank = lambda w: (counts.get(w.decode(), 0), w)
        self.order = {k: sorted(v, key=rank) for k, v in self.sets.items()}
        self.lengths = {k: len(v.encode().translate(_CLEAN).split()) for k, v in templates.items()}
        self.needed = {k: math.ceil(threshold * len(v) - 1e-9) for k, v in self.sets.items()}
        self.index: dict[bytes, list[tuple[str, int]]] = defaultdict(list)
        for k, ordered in self.order.items():
            for place, w in enumerate(ordered[: len(ordered) - self.needed[k] + 1]):
                self.index[w].append((k, place))
        self.prefix = frozenset(self.index)

    def matches(self, block: list[bytes]) -> Iterator[tuple[str, float]]:
        """Templates that a block meets, with the share of the template's words it holds."""
        if self.prefix.isdisjoint(block):
            return
        have = set(block)
        first: dict[str, int] = {}
        for w in self.prefix & have:
            for k, place in self.index[w]:
                first[k] = min(place, first.get(k, place))
        for k, place in first.items():
            n = len(self.order[k])
            if len(have) >= self.needed[k] and n - place >= self.needed[k] and (shared := len(self.sets[k] & have)) >= self.needed[k]:
                yield k, shared / n

    def windows(self, words: list[bytes]) -> Iterator[tuple[int, str, float]]:
        """Templates that windows of their length meet, with the first word of the best window and its share."""
        for k, _ in self.matches(words):
            wanted, held, have = self.sets[k], deque(), Counter()
            best, start = 0, 0
            for i, w in enumerate(words):
                if w not in wanted:
                    continue
                held.append((i, w))
                have[w] += 1
                while held[0][0] <= i - self.lengths[k]:
                    gone = held.popleft()[1]
                    have[gone] -= 1
                    if not have[gone]:
                        del have[gone]
                if len(have) > best:
                    best, start = len(have), held[0][0]
            if best >= self.needed[k]:
                yield start, k, best / len(wanted)


def word_counts(docs: DataFrame, text: str, templates: Mapping[str, str]) -> dict[str, int]:
    """How many blocks of the whole table hold each template word; as many rows as templates have words."""
    known = frozenset(w for v in templates.values() for w in v.encode().translate(_CLEAN).split())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[bytes] = Counter()
        for pdf in batches:
            for t in pdf["text"]:
                for line in raw(t).translate(_CLEAN).split(b"\n"):
                    found.update(known.intersection(line.split()))
        yield pd.DataFrame({"word": [w.decode() for w in found], "n": [*found.values()]}).astype({"word": str, "n": "int64"})

    rows = docs.selectExpr(f"`{text}` AS text").mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {r["word"]: r["n"] for r in rows}


def places(words: list[bytes], phrases: Mapping[bytes, str]) -> Iterator[tuple[int, str]]:
    """(start, label) of each place where a phrase's words stand one after the other."""
    joined = b" " + b" ".join(words) + b" "
    for phrase, label in phrases.items():
        at = joined.find(b" " + phrase + b" ")
        while at >= 0:
            yield joined.count(b" ", 0, at), label
            at = joined.find(b" " + phrase + b" ", at + 1)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: Mapping[str, str] = TEMPLATES, phrases: Mapping[str, str] = PHRASES, threshold: float = 0.8) -> DataFrame:
    """One row per row of `docs`: the key, n_words, phrase places, labels, best containment and the matched blocks."""
    counts = word_counts(docs, text, templates)
    wanted = {p.encode(): label for p, label in phrases.items()}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(templates, threshold, counts)
        for pdf in batches:
            out = []
            for k, t in zip(pdf["key"], pdf["text"], strict=True):
                blocks = [line.split() for line in raw(t).translate(_CLEAN).split(b"\n")]
                words = [w for b in blocks for w in b] if len(blocks) > 1 else blocks[0]
                at = sorted(places(words, wanted))
                base = {label for _, label in at}
                met = [(n, label, share) for n, b in enumerate(blocks) for label, share in matcher.matches(b)]
                if len(blocks) > 1:
                    best: dict[str, float] = {}
                    for _, label, share in met:
                        best[label] = max(share, best.get(label, 0.0))
                    ends = list(accumulate(map(len, blocks)))
                    met += [(bisect_right(ends, i), label, share) for i, label, share in matcher.windows(words) if share > best.get(label, 0.0)]
                score = 1.0 if base else max([share for _, _, share in met], default=0.0)
                out.append((
                    k, len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None,
                    ",".join(sorted(base)), ",".join(sorted(base | {label for _, label, _ in met})), score,
                    [{"line": n, "template": label, "share": share} for n, label, share in sorted(met)],
                ))
            yield pd.DataFrame(out, columns=["key", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]).astype({"first_word": "Int64", "last_word": "Int64"})

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.selectExpr(f"`{key}` AS key", f"`{text}` AS text")
    schema = f"key {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<line:long,template:string,share:double>>"
    return rows.mapInPandas(run, schema).withColumnRenamed("key", key)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("blocks")


def _sql() -> str:
    """The scan for another engine, without the candidate filters: every block against every template."""
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    sets = {k: sorted(set(v.split())) for k, v in TEMPLATES.items()}
    rows = ", ".join(f"('{k}', [{', '.join(repr(w) for w in v)}], {math.ceil(0.8 * len(v) - 1e-9)})" for k, v in sets.items())
    hits = " UNION ALL ".join(f"SELECT doc_id, i, '{label}' AS label FROM q WHERE t{len(p.split())} = '{p}'" for p, label in PHRASES.items())
    return f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, '{word}') AS ws FROM d),
p AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) - 1 AS i FROM w),
q AS (SELECT doc_id, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS t3, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o AS t4 FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS ({hits}),
b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h GROUP BY doc_id),
l AS (SELECT doc_id, list_distinct(regexp_extract_all(line, '{word}')) AS have FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
tpl AS (SELECT * FROM (VALUES {rows}) v(name, words, need)),
m AS (SELECT l.doc_id, tpl.name AS label, len(list_intersect(l.have, tpl.words)) / CAST(len(tpl.words) AS DOUBLE) AS share FROM l, tpl WHERE len(list_intersect(l.have, tpl.words)) >= tpl.need),
a AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM h UNION ALL SELECT doc_id, label FROM m) u GROUP BY doc_id),
s AS (SELECT doc_id, max(share) AS share FROM m GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score
FROM w LEFT JOIN b ON b.doc_id = w.doc_id LEFT JOIN a ON a.doc_id = w.doc_id LEFT JOIN s ON s.doc_id = w.doc_id
"""


SQL = _sql()
