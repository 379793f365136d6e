"""Sequential rules over the rows of a key, in one pass over sorted partitions.

Rows are dealt out by the hash of their key and sorted within partitions; each task streams through its partition in Arrow
batches and carries the state of the open key from one batch to the next. A task holds one batch and one state, whether
a key has one row or a third of all. Only the columns that a rule reads become Python values, the others pass as they are.
Rules whose steps can be composed run in parallel within a key too (`scan`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = ("us", "id")
ARROW = {"boolean": pa.bool_(), "long": pa.int64(), "double": pa.float64(), "string": pa.string()}


def listed(column: pd.Series) -> list:
    """Plain values, None for null."""
    return column.astype(object).where(column.notna(), None).tolist()


def plain(column: pa.Array) -> list:
    """Plain values, None for null and NaN."""
    values = column.to_pylist()
    return [None if v != v else v for v in values] if pa.types.is_floating(column.type) else values


def key_rows(pdf: pd.DataFrame, keys: Sequence[str]) -> list[tuple]:
    return list(zip(*(listed(pdf[k]) for k in keys), strict=True))


def runs(keys: list[tuple]) -> Iterator[tuple[tuple, int, int]]:
    """(key, begin, end) of each run of equal keys."""
    begin = 0
    for i in range(1, len(keys) + 1):
        if i == len(keys) or keys[i] != keys[begin]:
            yield keys[begin], begin, i
            begin = i


def fold(df: DataFrame, keys: Sequence[str], columns: Sequence[str], start: Callable[[], Any], step: Callable[..., tuple], out: dict[str, str], order: Sequence[str] = ORDER) -> DataFrame:
    """Adds the columns `out` (name to type): `step(state, *columns)` gives a row's values, and changes the state in place.

    `start` makes a key's state. Rows of a key are taken in `order`; null keys are one key.
    """

    df = df.drop(*out)
    schema = df.withColumns({name: F.lit(None).cast(kind) for name, kind in out.items()}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, state = None, None
        for batch in batches:
            read = [[plain(batch.column(n)) for n in names] for names in (keys, columns)]
            got = []
            for key, row in zip(zip(*read[0], strict=True), zip(*read[1], strict=True), strict=True):
                if key != open_key:
                    open_key, state = key, start()
                got.append(step(state, *row))
            added = [pa.array([g[k] for g in got], ARROW[kind]) for k, kind in enumerate(out.values())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, *out])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)
