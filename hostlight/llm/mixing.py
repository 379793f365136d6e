"""Mixing sources to target weights: hierarchical budgeting over a domain-language-source tree.

1. Tokens are summed per leaf (domain, lang, source); a leaf's capacity is its tokens times `max_epochs`.
2. The token budget goes down the tree. Among siblings it is shared in proportion to their weights; a node can
   take no more than the capacity below it, and what it can't take is shared among its siblings (water filling).
   A node's budget never exceeds its capacity, so a shortage reaches an ancestor's siblings only once all
   siblings are full.
3. Each leaf takes whole epochs of its documents and then the prefix of one more epoch, in the order of a seeded
   hash of epoch, leaf and document, until its budget is used: a document is taken if the tokens before it are
   below the budget.

Prefix sums don't gather a leaf in one task: documents are dealt to `buckets` ranges of the hash, sums per
(leaf, bucket) are accumulated, and documents are sorted within their (leaf, bucket) only.

Defined results: null lang, source or domain are nodes of their own, named ''. A null or empty text has no tokens
and is taken with the prefix it falls into. Weights that aren't given count 1; a weight of 0 or less takes nothing.
Ties in the hash are broken by the key; equal keys are taken together. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, shared_folder, table, with_fresh

#: Production weights by level and node; anything else weighs 1.
WEIGHTS: dict[str, dict[str, float]] = {
    "domain": {"web": 3.0, "curated": 2.0, "forum": 1.0},
    "lang": {"en": 4.0, "de": 2.0, "fr": 2.0, "es": 2.0},
    "source": {"src0": 2.0},
}
BUCKETS = 256
#: Leaves whose budgets are sent to all executors at most; more are joined by a shuffle.
FEW_LEAVES = 100_000
LEVELS = ("domain", "lang", "source")


def tokens(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))).cast("long")


def domain_of(source: Column) -> Column:
    """The domain that a source belongs to: by the number at its end; sources without one are 'web'."""
    n = F.coalesce(F.regexp_extract(F.coalesce(source, F.lit("")), r"(\d{1,9})$", 1).try_cast("int"), F.lit(0)) % 3
    return F.when(n == 0, "web").when(n == 1, "curated").otherwise("forum")


def _weight(node: Column, weights: Mapping[str, float]) -> Column:
    out = F.lit(1.0)
    for name, w in weights.items():
        out = F.when(node == name, F.lit(float(w))).otherwise(out)
    return F.greatest(out, F.lit(0.0))


def _fill(nodes: DataFrame, parent: list[str], name: str, weights: Mapping[str, float]) -> DataFrame:
    """`nodes` (parent keys, name, capacity, budget of the parent) with each node's own budget.

    Siblings are ordered by capacity per weight. With the first k of them full, the others share what is left
    by weight; a node is full if its capacity is at most its share at the moment its turn comes.
    """
    w = _weight(F.col(name), weights)
    ratio = F.when(w > 0, F.col("capacity") / w).otherwise(F.lit(float("inf")))
    order = Window.partitionBy(*parent).orderBy("ratio", name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumn("w", w).withColumn("ratio", ratio)
    nodes = nodes.withColumn("used", F.coalesce(F.sum(F.when(F.col("w") > 0, F.col("capacity"))).over(before), F.lit(0.0)))
    nodes = nodes.withColumn("rest_w", F.sum("w").over(Window.partitionBy(*parent)) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    nodes = nodes.withColumn("level", F.when(F.col("w") > 0, (F.col("budget") - F.col("used")) / F.col("rest_w")))
    first_open = F.first(F.when(F.col("ratio") > F.col("level"), F.col("level")), True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    got = F.when(F.col("w") <= 0, 0.0).when(first_open.isNull(), F.col("capacity")).otherwise(F.least(F.col("capacity"), first_open * F.col("w")))
    return nodes.withColumn("got", got).drop("budget").withColumnRenamed("got", "budget").drop("w", "ratio", "used", "rest_w", "level")


def leaf_budgets(leaves: DataFrame, budget_share: float, max_epochs: int, weights: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """`leaves` (domain, lang, source, leaf_tokens) with `budget` in tokens."""
    caps = leaves.withColumn("capacity", F.col("leaf_tokens").cast("double") * max_epochs)
    total = leaves.agg(F.coalesce(F.sum("leaf_tokens"), F.lit(0)).cast("double").alias("all"))
    level = total.select((F.col("all") * budget_share).alias("budget"), F.lit(0).alias("root"))
    parent = ["root"]
    for depth, name in enumerate(LEVELS):
        keys = list(LEVELS[: depth + 1])
        nodes = caps.groupBy(*keys).agg(F.sum("capacity").alias("capacity")).withColumn("root", F.lit(0))
        nodes = nodes.join(F.broadcast(level), parent) if depth == 0 else nodes.join(level.select(*parent, "budget"), parent)
        level = _fill(nodes, parent, name, weights.get(name, {}))
        parent = keys
    return leaves.join(level.select(*LEVELS, "budget"), list(LEVELS))


def mix(
    docs: DataFrame, key: str = "doc_id", text: str = "text", domain: Column | None = None, weights: Mapping[str, Mapping[str, float]] = WEIGHTS,
    budget_share: float = 0.6, max_epochs: int = 2, seed: int = 11, buckets: int = BUCKETS,
) -> DataFrame:
    """One row per row of `docs`: key, domain, lang, source, n_tokens, leaf_budget and `n_epochs`, how often it is taken.

    `budget_share` is the token budget as a share of all tokens. The number of leaves is bounded by the tree.
    """
    named = [F.coalesce(c, F.lit("")).alias(n) for n, c in zip(LEVELS, (domain if domain is not None else domain_of(F.col("source")), F.col("lang"), F.col("source")), strict=True)]
    rows = docs.select(F.col(f"`{key}`").alias("key"), *named, tokens(F.col(f"`{text}`")).alias("n_tokens"))
    return _taken(rows, weights, budget_share, max_epochs, seed, buckets).withColumnRenamed("key", key)


def _taken(rows: DataFrame, weights: Mapping[str, Mapping[str, float]], budget_share: float, max_epochs: int, seed: int, buckets: int) -> DataFrame:
    leaf = list(LEVELS)
    shared_folder(rows.sparkSession)
    rows = rows.checkpoint()  # a few numbers per document, so that texts are read and counted once
    leaves = leaf_budgets(rows.groupBy(*leaf).agg(F.sum("n_tokens").alias("leaf_tokens")), budget_share, max_epochs, weights)
    whole = F.when(F.col("leaf_tokens") > 0, F.floor(F.col("budget") / F.col("leaf_tokens") + 1e-12)).otherwise(F.lit(0)).cast("int")
    leaves = leaves.withColumn("whole", whole).withColumn("rest", F.col("budget") - F.col("whole") * F.col("leaf_tokens")).select(*leaf, "budget", "whole", "rest")
    few = rows.select(*leaf).distinct().count() <= FEW_LEAVES  # a row per leaf goes to all executors, so that no leaf is one task
    leaves = F.broadcast(leaves) if few else leaves
    # whole epochs take every document; the order of the one after them, of which a prefix is taken, is its own
    place = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("whole").cast("string"), *leaf, F.col("key").cast("string"))), 1, 12), 16, 10).cast("long")
    rows = rows.join(leaves, leaf).withColumn("place", place).withColumn("bucket", (F.col("place") / ((1 << 48) // buckets)).cast("int"))
    # one row per leaf and bucket: both are bounded, by the tree and the parameter
    sums = rows.groupBy(*leaf, "bucket").agg(F.sum("n_tokens").alias("bucket_tokens"))
    sums = sums.withColumn("before", F.sum("bucket_tokens").over(Window.partitionBy(*leaf).orderBy("bucket")) - F.col("bucket_tokens")).drop("bucket_tokens")
    here = Window.partitionBy(*leaf, "bucket")
    upto = here.orderBy("place", "key").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = F.sum("n_tokens").over(upto) - F.sum("n_tokens").over(here.partitionBy(*leaf, "bucket", "place", "key"))
    rows = rows.withColumn("ahead", ahead).join(sums, [*leaf, "bucket"])
    taken = F.col("whole") + (F.col("before") + F.col("ahead") < F.col("rest")).cast("int")
    return rows.select("key", *leaf, "n_tokens", F.col("budget").alias("leaf_budget"), taken.alias("n_epochs"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """The rows of `docs` that the mix takes, as often as it takes them, with the columns of `docs`."""
    again, taken = with_fresh(docs, "mix_key"), with_fresh(docs, "mix_epochs")
    picked = mix(docs, key, **how).filter("n_epochs > 0").select(F.col(key).alias(again), F.col("n_epochs").alias(taken)).distinct()
    joined = docs.join(picked, F.col(f"`{key}`").eqNullSafe(F.col(again)))
    repeated = joined.withColumn(taken, F.explode(F.sequence(F.lit(1), F.col(taken))))
    return repeated.select([f"`{c}`" for c in docs.columns])


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).withColumn("leaf_budget", F.round("leaf_budget", 3))


def _sql_level(name: str, parent: tuple[str, ...], source: str) -> str:
    keys = ", ".join((*parent, name))
    part = "PARTITION BY " + ", ".join(parent) if parent else ""
    weights = "CASE " + " ".join(f"WHEN {name} = '{k}' THEN {float(v)}" for k, v in WEIGHTS[name].items()) + " ELSE 1.0 END"
    using = f"JOIN {source} b USING ({', '.join(parent)})" if parent else f"CROSS JOIN {source} b"
    return f"""
{name}_a AS (SELECT {keys}, sum(leaf_tokens * 2.0::DOUBLE) AS capacity, CAST({weights} AS DOUBLE) AS w FROM leaves GROUP BY {keys}),
{name}_b AS (SELECT n.*, n.capacity / n.w AS ratio, b.budget AS up FROM {name}_a n {using}),
{name}_c AS (SELECT *, coalesce(sum(capacity) OVER o, 0) AS used, sum(w) OVER ({part}) - coalesce(sum(w) OVER o, 0) AS rest_w FROM {name}_b
  WINDOW o AS ({part} ORDER BY ratio, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name}_d AS (SELECT *, (up - used) / rest_w AS lvl FROM {name}_c),
{name}_e AS (SELECT *, first_value(CASE WHEN ratio > lvl THEN lvl END IGNORE NULLS) OVER ({part} ORDER BY ratio, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open FROM {name}_d),
{name}_f AS (SELECT {keys}, CASE WHEN open IS NULL THEN capacity ELSE least(capacity, open * w) END AS budget FROM {name}_e)"""


SQL = (
    r"""
WITH r AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens,
    CASE coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '(\d{1,9})$', 1) AS INTEGER), 0) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'curated' ELSE 'forum' END AS domain FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS leaf_tokens FROM r GROUP BY ALL),
root AS (SELECT sum(leaf_tokens)::DOUBLE * 0.6 AS budget FROM leaves),"""
    + ",".join(_sql_level(n, LEVELS[:k], LEVELS[k - 1] + "_f" if k else "root") for k, n in enumerate(LEVELS))
    + """,
e AS (SELECT l.*, f.budget, CAST(floor(CASE WHEN leaf_tokens > 0 THEN f.budget / leaf_tokens + 1e-12 ELSE 0 END) AS INTEGER) AS whole FROM leaves l JOIN source_f f USING (domain, lang, source)),
p AS (SELECT r.*, budget, whole, leaf_tokens, CAST('0x' || substr(md5('11:' || whole || ':' || domain || ':' || lang || ':' || source || ':' || doc_id), 1, 12) AS BIGINT) AS place FROM r JOIN e USING (domain, lang, source)),
q AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, doc_id) - n_tokens AS ahead FROM p)
SELECT doc_id, domain, lang, source, n_tokens, round(budget, 3) AS leaf_budget, CAST(whole + CASE WHEN ahead < budget - whole * leaf_tokens THEN 1 ELSE 0 END AS INTEGER) AS n_epochs
FROM q
"""
)
