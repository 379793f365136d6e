"""Quality rules as a short-circuit cascade, with built-in Spark functions only.

Each rule has a failing condition over measures of the text. On a bounded sample the planner estimates what
share of rows each rule rejects and what its measures cost, and orders rules by rejection per cost; the
cascade then is one CASE whose later branches run only for rows that every earlier rule let through.
The order never changes which rows are kept, only the work and the name of the first failed rule.

Defined results: a null or empty text has no words, fails `min_words` and isn't kept. Repeated rows are
judged alike. An empty table gives an empty result. Columns of the input stay; a column that has the name of
an output is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, table, with_fresh

_SYMBOLS = r"[^#*$%&|<>]+"
_UPPER, _LETTER = r"[^\p{Lu}]+", r"[^\p{L}]+"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(_text(text), F.lit(WORD), F.lit(0))


def word_chars(w: Column) -> Column:
    return F.length(F.array_join(w, "")).cast("long")


def symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(_text(text), _SYMBOLS, "")).cast("long")


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(_text(text), _LETTER, "")).cast("long")


def upper_letters(text: Column) -> Column:
    return F.length(F.regexp_replace(_text(text), _UPPER, "")).cast("long")


def lines(text: Column) -> Column:
    return F.filter(F.split(_text(text), "\n"), lambda x: x.rlike(WORD))


def duplicate_lines(text_lines: Column) -> Column:
    return (F.size(text_lines) - F.size(F.array_distinct(text_lines))).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once per row, however often the body, or a lambda in it, uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def windows3(w: Column) -> Column:
    """A hash of every run of three words; null below three words."""
    n = F.size(w)
    window = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    return F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), window))


def repeated_words(w: Column) -> Column:
    """Words in windows that occur twice or more.

    (hash, place) pairs are sorted, so that equal windows are neighbours; a neighbour of equal hash counts
    once its three words are equal too. Texts without a repeated hash skip the sort.
    """

    def equal(x: Column, y: Column) -> Column:
        out = x["h"] == y["h"]
        for k in range(3):
            out = out & (F.get(w, x["i"] + k) == F.get(w, y["i"] + k))
        return F.coalesce(out, F.lit(False))

    def places(s: Column) -> Column:
        return F.transform(F.filter(s, lambda x, k: equal(x, F.get(s, k - 1)) | equal(x, F.get(s, k + 1))), lambda x: x["i"])

    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last"))

    def count(tri: Column) -> Column:
        pairs = F.sort_array(F.transform(tri, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = F.aggregate(F.sort_array(let(pairs, places)), start, step, lambda a: a["n"])
        return F.when(tri.isNull() | (F.size(F.array_distinct(tri)) == F.size(tri)), F.lit(0)).otherwise(found)

    return let(windows3(w), count).cast("long")


@dataclass(frozen=True)
class Rule:
    """`fails` and `cost` take a lookup of measures; cost is in characters touched."""

    name: str
    fails: Callable[[Callable[[str], Column]], Column]
    cost: Callable[[Callable[[str], Column]], Column]


#: Production rules. The first two are the base rules.
RULES: tuple[Rule, ...] = (
    Rule("min_words", lambda m: m("n_words") < 50, lambda m: F.lit(1.0)),
    Rule("repeated_words", lambda m: 100 * m("n_repeat_words") > 50 * m("n_words"), lambda m: 8.0 * m("n_words") * F.log2(m("n_words") + 2)),
    Rule("symbols", lambda m: 100 * m("n_symbols") > 20 * m("n_words"), lambda m: m("n_chars") * 1.0),
    Rule("capitals", lambda m: 100 * m("n_upper") > 60 * m("n_letters"), lambda m: m("n_chars") * 2.0),
    Rule("duplicate_lines", lambda m: 100 * m("n_dup_lines") > 50 * m("n_lines"), lambda m: m("n_chars") * 1.5),
    Rule("word_length", lambda m: (m("word_chars") > 25 * m("n_words")) | (m("word_chars") < 2 * m("n_words")), lambda m: m("n_chars") * 0.5),
)


#: Measures that op8 reports for every row.
BASE_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measures(text: Column, w: Column) -> dict[str, Callable[[], Column]]:
    """Measures by name, over a text and its words."""
    return {
        "n_words": lambda: F.size(w).cast("long"),
        "word_chars": lambda: word_chars(w),
        "n_symbols": lambda: symbols(text),
        "n_lines": lambda: F.size(lines(text)),
        "n_dup_lines": lambda: let(lines(text), duplicate_lines),
        "n_repeat_words": lambda: repeated_words(w),
        "n_letters": lambda: letters(text),
        "n_upper": lambda: upper_letters(text),
        "n_chars": lambda: F.length(_text(text)),
    }


def order_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = 2000, seed: int = 7) -> list[tuple[Rule, float, float]]:
    """(rule, share rejected, mean cost), best rejection per cost first, estimated on about `sample_rows` rows
    drawn from the whole table.

    An empty table keeps the given order. Ties keep the given order too.
    """
    rows = docs.count()
    share = min(1.0, sample_rows / max(rows, 1))
    t = F.col(f"`{text}`")
    sample = docs.select(t).sample(share, seed)

    def judged(w: Column) -> Column:
        m = _measures(t, w)
        at = lambda name: m[name]()
        return F.struct(*[x for k, r in enumerate(rules) for x in (F.coalesce(r.fails(at), F.lit(True)).cast("double").alias(f"r{k}"), r.cost(at).cast("double").alias(f"c{k}"))])

    judgements = sample.select(let(words(t), judged).alias("j"))
    found = judgements.agg(*[F.avg(f"j.{x}{k}").alias(f"{x}{k}") for k in range(len(rules)) for x in "rc"]).first()
    measured = [(r, found[f"r{k}"] or 0.0, max(found[f"c{k}"] or 1.0, 1e-9)) for k, r in enumerate(rules)]
    return sorted(measured, key=lambda x: -x[1] / x[2])


def _first_failed(order: Sequence[Rule], at: Callable[[str], Column]) -> Column:
    out = F.lit(None).cast("string")
    for rule in reversed(order):
        out = F.when(F.coalesce(rule.fails(at), F.lit(True)), F.lit(rule.name)).otherwise(out)
    return out


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = 2000, measures: bool | Sequence[str] = False) -> DataFrame:
    """`docs` with `failed_rule` (null if kept) and `kept`, and the measures named in `measures` (True: all but n_chars).

    A row's other measures are computed only if it passed the earlier rules.
    """
    order = [r for r, _, _ in order_rules(docs, rules, text, sample_rows)]
    t = F.col(f"`{text}`")
    if measures:
        names = [n for n in _measures(t, t) if n != "n_chars"] if measures is True else list(measures)
        all_of = with_fresh(docs, "measures_")
        made = let(words(t), lambda w: F.struct(*[_measures(t, w)[n]().alias(n) for n in names]))
        out = docs.withColumn(all_of, made)
        out = out.withColumns({n: F.col(all_of)[n] for n in names}).drop(all_of)
        failed = _first_failed(order, lambda n: F.col(n) if n in names else _measures(t, words(t))[n]())
    else:
        out = docs
        failed = let(words(t), lambda w: _first_failed(order, lambda n: _measures(t, w)[n]()))
    return out.withColumn("failed_rule", failed).withColumn("kept", F.col("failed_rule").isNull())


def kept_documents(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The rows of `docs` that pass every rule, with the columns of `docs`."""
    renamed = docs.withColumnsRenamed({c: f"in_{k}" for k, c in enumerate(docs.columns)})  # names may clash with ours
    out = cascade(renamed, rules, f"in_{docs.columns.index(text)}").filter("kept")
    return out.select([F.col(f"in_{k}").alias(c) for k, c in enumerate(docs.columns)])


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cascade(table(spark, sf_dir, "documents").select("doc_id", "text"), measures=BASE_MEASURES)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & F.col("kept")).alias("kept"))


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
p AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
t AS (SELECT doc_id, i, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o AS tri FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, tri) AS n FROM t WHERE tri IS NOT NULL),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM c, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(r.n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
        length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS n_letters,
        length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) AS n_upper
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (100 * n_symbols > 20 * n_words) AND NOT (100 * n_upper > 60 * n_letters)
  AND NOT (100 * n_dup_lines > 50 * n_lines) AND NOT (word_chars > 25 * n_words OR word_chars < 2 * n_words) AS kept
FROM b
"""
