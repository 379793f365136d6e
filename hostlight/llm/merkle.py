"""Merkle dataset manifest: a tree of digests per group, a tree over the groups' roots, and a proof for each row.

* A leaf is the sha256 of a row's fields, each with its length in bytes. The leaves of a group are numbered in the order
  of the key without gathering a group: a range partitioning, a running number within its partitions, and the sums
  of the partitions before.
* Slot pivot: conditional aggregates over a parent's children spread them into `fanout` columns. The columns one after the
  other, hashed, are the parent; without a child's own column they are its siblings. fanout^height consecutive nodes
  are a block, and blocks are dealt out whole, so that `height` levels need one shuffle. The blocks' roots go up in the
  same way, until each group has one node.
* A proof is the list of a row's siblings from its leaf to the root, left and right of its place.

Defined results: null is `-` in a leaf, the empty text `0:`. Null keys come first in their group, rows with equal keys in
the order of their leaves, equal rows in any (their leaves are the same, their proofs those of their places). A
null group is a group of its own, before all others; groups are in the order of their UTF-8 bytes. A group of one row
has its leaf as root; a tree of one group has that group's root. The proof of the only row of all is the digest of nothing.
An empty table gives an empty table. Other columns than the fields aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import crc_mod, stored, table

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 2
#: Levels that one shuffle serves.
HEIGHT = 10
#: Offsets of partitions that are sent to all executors at most; more are joined by a shuffle.
FEW = 100_000
SIBLINGS = "array<struct<left:string,right:string>>"


def leaf(fields: Sequence[Column]) -> Column:
    """Digest of fields in order, each as its length in bytes, `:` and its value, or `-`."""
    part = lambda c: F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.sha2(F.concat(*[part(c) for c in fields]), 256)


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """`rows` with `idx`, each row's number from 0 in its group, and `cnt`, the group's rows, in the given order."""
    placed = stored(rows.repartitionByRange(*[F.col(c).asc_nulls_first() for c in (group, *order)]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in (group, *order)]).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)  # a partition's running numbers begin at its number times 2^33
    runs = placed.groupBy(group, part.alias("part")).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    all_of = Window.partitionBy(group)
    runs = runs.withColumn("before", F.sum("n").over(all_of.orderBy("part")) - F.col("n")).withColumn("cnt", F.sum("n").over(all_of)).drop("n")
    few = runs.count() <= FEW
    runs = F.broadcast(runs) if few else runs
    return placed.withColumn("part", part).join(runs, [group, "part"]).withColumn("idx", F.col("place") - F.col("first") + F.col("before")).drop("part", "place", "first", "before")


def _slots(fanout: int, over: Window, slot: Column, node: Column) -> list[Column]:
    return [F.coalesce(F.max(F.when(slot == j, node)).over(over), F.lit("")) for j in range(fanout)]


def _climbed(nodes: DataFrame, fanout: int, height: int) -> DataFrame:
    """`nodes` (group, idx, cnt, node and others) dealt to blocks, with `top`, the block's root, and `path`, the siblings up to it."""
    size = fanout**height
    rows = nodes.withColumn("block", F.floor(F.col("idx") / size)).repartition("grp", "block").withColumn("top", F.col("node"))
    for k in range(height):
        parent = F.floor(F.col("idx") / fanout ** (k + 1))
        slot = F.floor(F.col("idx") / fanout**k) % fanout
        children = Window.partitionBy("grp", "block", "parent")
        # a group's last node, alone on its level, is its root
        rows = rows.withColumn("parent", parent).withColumn("slot", slot)
        rows = rows.withColumns({f"slot_{j}": c for j, c in enumerate(_slots(fanout, children, F.col("slot"), F.col("top")))})
        cols = [F.col(f"slot_{j}") for j in range(fanout)]
        side = lambda keep: F.concat(*[F.when(keep(j), c).otherwise("") for j, c in enumerate(cols)])  # noqa: E731, B023
        step = F.struct(side(lambda j: j < F.col("slot")).alias("left"), side(lambda j: j > F.col("slot")).alias("right"))
        more = F.col("cnt") > fanout**k
        rows = rows.withColumn(f"step_{k}", F.when(more, step)).withColumn("top", F.when(more, F.sha2(F.concat(*cols), 256)).otherwise(F.col("top"))).drop(*[f"slot_{j}" for j in range(fanout)])
    path = F.filter(F.array(*[F.col(f"step_{k}") for k in range(height)]), lambda s: s.isNotNull())
    return rows.withColumn("path", path).drop("parent", "slot", *[f"step_{k}" for k in range(height)])


def proved(nodes: DataFrame, fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """`nodes` (grp, idx, cnt, node and others) with `top`, their group's root, and `path`, all siblings up to it."""
    most = nodes.agg(F.max("cnt").alias("n")).first()["n"] or 0
    rows = _climbed(nodes, fanout, height)
    if most <= fanout**height:
        return rows.drop("block")
    tops = rows.groupBy("grp", "block").agg(F.max("top").alias("node"), F.ceil(F.max("cnt") / fanout**height).alias("cnt"))
    tops = proved(stored(tops.withColumnRenamed("block", "idx")), fanout, height)
    above = tops.select("grp", F.col("idx").alias("block"), F.col("top").alias("above"), F.col("path").alias("way"))
    return rows.join(above, ["grp", "block"]).withColumn("path", F.concat("path", "way")).withColumn("top", F.col("above")).drop("block", "above", "way")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(path, start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def manifest(
    rows: DataFrame, key: str = "doc_id", group: str = "lang", fields: Sequence[str] = FIELDS, tampered: Callable[[str], Column] | None = None,
    fanout: int = FANOUT, height: int = HEIGHT,
) -> DataFrame:
    """One row per row: key, leaf, subroot, root, path (siblings left and right, from the leaf up), folded_root, verified.

    `tampered` gives a field's value, by its name, as it is when the proof is checked; by default it is unchanged.
    """
    named = {c: F.col(f"`{c}`") for c in fields}
    first = leaf([*named.values()])
    now = first if tampered is None else leaf([tampered(c) for c in fields])
    g = F.col(f"`{group}`")
    # '' before all other groups is the null one; `=` sets the others apart from it and keeps their order
    leaves = rows.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.concat(F.lit("="), g.cast("string")), F.lit("")).alias("grp"), first.alias("node"), now.alias("now"))
    leaves = leaves.withColumn("now", F.when(F.col("now") != F.col("node"), F.col("now")))
    trees = proved(numbered(leaves, "grp", ["key", "node"]), fanout, height)
    roots = stored(trees.groupBy("grp").agg(F.max("top").alias("node")))
    roots = numbered(roots.select(F.lit(0).alias("all"), F.col("grp").alias("name"), "node"), "all", ["name"]).withColumn("grp", F.col("all").cast("string"))
    roots = proved(roots, fanout, height).select(F.col("name").alias("grp"), F.col("top").alias("root"), F.col("path").alias("way"))
    few = roots.count() <= FEW
    out = trees.join(F.broadcast(roots) if few else roots, "grp").withColumn("path", F.concat("path", "way"))
    out = out.withColumn("folded_root", folded(F.coalesce(F.col("now"), F.col("node")), F.col("path")))
    return out.select(F.col("key").alias(key), F.col("node").alias("leaf"), F.col("top").alias("subroot"), "root", "path", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def one_more(field: str) -> Column:
    """The tampering of the registered query: n_chars is one more where 7 divides the key's crc32."""
    value = F.col(f"`{field}`")
    return F.when(crc_mod("doc_id", 7) == 0, F.try_add(value, F.lit(1))).otherwise(value) if field == "n_chars" else value


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(table(spark, sf_dir, "documents"), tampered=one_more)
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings, 256).alias("proof_sha256"), "folded_root", "verified")


_PART = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
_CRC = (
    "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)),"
    " lambda c, b: list_reduce(list_prepend(xor(c, b), range(1, 9)), lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)), 4294967295)"
)


def _sql() -> str:
    parts = lambda n: " || ".join(_PART.format(c if c != "n_chars" else n) for c in FIELDS)
    return f"""
WITH RECURSIVE
d AS (SELECT doc_id, lang AS g, sha256({parts('n_chars')}) AS leaf, CASE WHEN {_CRC} % 7 = 0 THEN sha256({parts('(n_chars + 1)')}) END AS changed FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d),
t(lv, g, i, h) AS (
  SELECT 0, g, i, leaf FROM r
  UNION ALL
  SELECT lv + 1, g, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY lv, g) AS c FROM t) x WHERE c > 1 GROUP BY lv, g, i // 2),
s AS (SELECT g, h, lv AS top, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i FROM (SELECT *, max(lv) OVER (PARTITION BY g) AS m FROM t) x WHERE lv = m),
u(lv, i, h) AS (
  SELECT 0, i, h FROM s
  UNION ALL
  SELECT lv + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)) FROM (SELECT *, count(*) OVER (PARTITION BY lv) AS c FROM u) x WHERE c > 1 GROUP BY lv, i // 2),
steps AS (
  SELECT r.doc_id, r.leaf, t.lv AS step, t.h, t.i % 2 = 0 AS first FROM r JOIN s ON s.g IS NOT DISTINCT FROM r.g JOIN t ON t.g IS NOT DISTINCT FROM r.g AND t.lv < s.top AND t.i = xor(r.i >> t.lv, 1)
  UNION ALL
  SELECT r.doc_id, r.leaf, s.top + u.lv, u.h, u.i % 2 = 0 FROM r JOIN s ON s.g IS NOT DISTINCT FROM r.g JOIN u ON u.lv < (SELECT max(lv) FROM u) AND u.i = xor(s.i >> u.lv, 1)),
-- levels without a sibling hash the node alone
ways AS (SELECT r.doc_id, r.leaf, s.h AS subroot, coalesce(r.changed, r.leaf) AS start, s.top + (SELECT max(lv) FROM u) AS steps FROM r JOIN s ON s.g IS NOT DISTINCT FROM r.g),
f(doc_id, leaf, step, h) AS (
  SELECT doc_id, leaf, 0, start FROM ways
  UNION ALL
  SELECT f.doc_id, f.leaf, f.step + 1, sha256(CASE WHEN x.h IS NULL THEN f.h WHEN x.first THEN x.h || f.h ELSE f.h || x.h END)
  FROM f JOIN ways w ON w.doc_id = f.doc_id AND w.leaf = f.leaf AND f.step < w.steps LEFT JOIN steps x ON x.doc_id = f.doc_id AND x.leaf = f.leaf AND x.step = f.step),
p AS (SELECT doc_id, sha256(string_agg(h, '' ORDER BY step)) AS proof FROM steps GROUP BY doc_id)
SELECT w.doc_id, w.leaf, w.subroot, z.root, coalesce(p.proof, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = z.root AS verified
FROM ways w JOIN f ON f.doc_id = w.doc_id AND f.step = w.steps CROSS JOIN (SELECT h AS root FROM u WHERE lv = (SELECT max(lv) FROM u)) z LEFT JOIN p ON p.doc_id = w.doc_id
"""


SQL = _sql()
