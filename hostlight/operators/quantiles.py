"""Exact quantiles by counting passes: no task and no buffer holds a column's values.

A pass counts the values of a column that lie in each of `BINS` equal parts of a range, with their least and largest; the
part that holds the wanted rank is the next pass's range. A range of equal values is done, and one of at most
`FEW` values is read as it is. Many columns and ranks go through each pass together.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS, FEW = 1024, 1000


def quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> dict[str, list[float | None]]:
    """Quantiles of each column, interpolated between the two nearest ranks; None where a column has no values.

    Null and NaN aren't values. Infinite values count as the ends of their column; a quantile between them and others is infinite.
    """
    spark = df.sparkSession
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns])
    long = df.select(F.inline(pairs)).filter(F.col("v").isNotNull() & ~F.isnan("v"))
    ends = {r["c"]: r for r in long.groupBy("c").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()}
    wanted = {(c, r) for c, e in ends.items() for q in shares for r in (math.floor(q * (e["n"] - 1)), math.ceil(q * (e["n"] - 1)))}
    found: dict[tuple[str, int], float] = {}
    # (column, low, high, values in it) to the ranks in it, counted from its first value
    ranges: dict[tuple, list[tuple[int, int]]] = {}
    for c, r in sorted(wanted):
        ranges.setdefault((c, ends[c]["a"], ends[c]["b"], ends[c]["n"]), []).append((r, r))
    while ranges:
        for key in [k for k in ranges if k[1] == k[2]]:
            found |= {(key[0], rank): key[1] for rank, _ in ranges.pop(key)}
        if not ranges:
            break
        few = {k: v for k, v in ranges.items() if k[3] <= FEW}
        many = [k for k in ranges if k[3] > FEW]
        if few:
            bounds = spark.createDataFrame([(k[0], k[1], k[2]) for k in few], "c string, a double, b double")
            rows = long.join(F.broadcast(bounds), "c").filter("v BETWEEN a AND b").select("c", "a", "b", "v").collect()  # at most FEW for each
            for key, ranks in few.items():
                values = sorted(r["v"] for r in rows if (r["c"], r["a"], r["b"]) == key[:3])
                found |= {(key[0], rank): values[at] for rank, at in ranks}
        ranges, before = {}, ranges
        if many:
            bounds = spark.createDataFrame([(i, k[0], k[1], k[2]) for i, k in enumerate(many)], "i int, c string, a double, b double")
            # infinite and very long ranges are halved before they are subtracted
            share = F.when(F.col("v") == F.col("b"), F.lit(1.0)).when(F.col("v") == F.col("a"), 0.0).otherwise(F.try_divide(F.col("v") / 2 - F.col("a") / 2, F.col("b") / 2 - F.col("a") / 2))
            part = F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(F.coalesce(F.nanvl(share, F.lit(0.5)), F.lit(0.5)) * BINS))).cast("int")
            counted = long.join(F.broadcast(bounds), "c").filter("v BETWEEN a AND b").groupBy("i", part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()
            parts: dict[int, list] = {}
            for r in sorted(counted, key=lambda r: (r["i"], r["part"])):
                parts.setdefault(r["i"], []).append(r)
            for i, key in enumerate(many):
                for rank, at in before[key]:
                    for r in parts[i]:
                        if at < r["n"]:
                            ranges.setdefault((key[0], r["a"], r["b"], r["n"]), []).append((rank, at))
                            break
                        at -= r["n"]

    def one(c: str, q: float) -> float | None:
        if c not in ends:
            return None
        place = q * (ends[c]["n"] - 1)
        low, high = found[c, math.floor(place)], found[c, math.ceil(place)]
        return low if low == high else low + (high - low) * (place - math.floor(place))

    return {c: [one(c, q) for q in shares] for c in columns}
