"""Running values over the sorted rows of a key, in two passes: sums, averages that forget, bounded products.

Rows are range-partitioned by key and order, so that a hot key lies in many partitions, and kept. The first pass composes
the steps of each partition's first and last key: a few numbers per partition, which the driver folds to the state that
each partition begins with. The second pass runs through the partitions, all at once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.store import kept
from .carry import key_rows, runs


class Running:
    """A step that can be composed: a step is a tuple of numbers, a state is None before the first row of a key."""

    columns: tuple[str, ...] = ()
    out: dict[str, str] = {}

    def step(self, values: list[np.ndarray]) -> tuple:
        """All rows of an array as one step."""
        raise NotImplementedError

    def then(self, first: tuple, second: tuple) -> tuple:
        """Two steps, one after the other, as one."""
        raise NotImplementedError

    def after(self, state: Any, step: tuple) -> Any:
        raise NotImplementedError

    def rows(self, state: Any, values: list[np.ndarray]) -> tuple[list[np.ndarray], Any]:
        """Output columns of rows that begin in a state, and the state after them."""
        raise NotImplementedError


class Sums(Running):
    """Running sums, each row's own value included."""

    def __init__(self, **columns: str):
        self.columns, self.out = tuple(columns.values()), {name: "double" for name in columns}

    def step(self, values):
        return tuple(float(v.sum()) for v in values)

    def then(self, first, second):
        return tuple(a + b for a, b in zip(first, second, strict=True))

    def after(self, state, step):
        return step if state is None else self.then(state, step)

    def rows(self, state, values):
        state = state or (0.0,) * len(values)
        return [s + np.cumsum(v) for s, v in zip(state, values, strict=True)], self.after(state, self.step(values))


@dataclass
class Forgetting(Running):
    """e = alpha * e + (1 - alpha) * x, seeded by the first value: a step multiplies and adds."""

    alpha: float
    columns: tuple[str, ...] = ("value",)
    name: str = "ema"

    @property
    def out(self):
        return {self.name: "double"}

    def step(self, values):
        x = values[0]
        powers = self.alpha ** np.arange(len(x) - 1, -1, -1.0)
        return float(x[0]), self.alpha ** len(x), float((1 - self.alpha) * (x * powers).sum())

    def then(self, first, second):
        return first[0], first[1] * second[1], first[2] * second[1] + second[2]

    def after(self, state, step):
        return (step[0] if state is None else state) * step[1] + step[2]

    def rows(self, state, values):
        x = values[0]
        if len(x) < 64:
            e, out = x[0] if state is None else state, []
            for v in x.tolist():
                e = self.alpha * e + (1 - self.alpha) * v
                out.append(e)
            return [np.array(out)], float(e)
        series = pd.Series(np.concatenate([[x[0] if state is None else state], x])).ewm(alpha=1 - self.alpha, adjust=False).mean().to_numpy()[1:]
        return [series], float(series[-1])


@dataclass
class Bounded(Running):
    """A value times a factor each row, kept within bounds after each: a step is (factor, low, high), and so are steps in sequence."""

    start: float
    low: float
    high: float
    columns: tuple[str, ...] = ("factor",)
    name: str = "sensitivity"

    @property
    def out(self):
        return {self.name: "double"}

    def step(self, values):
        return self._through((1.0, -np.inf, np.inf), values[0])

    def _through(self, done, factors):
        for f in factors.tolist():
            done = self.then(done, (f, self.low, self.high))
        return done

    def then(self, first, second):
        within = lambda v: min(second[2], max(second[1], v * second[0]))
        return first[0] * second[0], within(first[1]), within(first[2])

    def after(self, state, step):
        return min(step[2], max(step[1], (self.start if state is None else state) * step[0]))

    def rows(self, state, values):
        state, out = self.start if state is None else state, []
        for f in values[0].tolist():
            state = min(self.high, max(self.low, state * f))
            out.append(state)
        return [np.array(out)], state


def in_order(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows range-partitioned and sorted by key and order, kept; `_chunk` is their partition."""
    by = [*[F.col(k).asc_nulls_first() for k in keys], *order]
    return kept(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_chunk", F.spark_partition_id()))


def begins(rows: DataFrame, keys: Sequence[str], op: Running) -> dict[int, tuple[tuple, Any]]:
    """For partitions that begin within a key: that key and its state there. One row per partition reaches the driver."""

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pickle

        chunk, first, last = None, None, None
        for pdf in batches:
            values = [pdf[c].to_numpy(float) for c in op.columns]
            chunk = int(pdf["_chunk"].iloc[0]) if len(pdf) else chunk
            names = key_rows(pdf, keys)
            spans = list(runs(names))
            for key, a, b in spans[:1]:
                step = op.step([v[a:b] for v in values])
                if first is None or (last is None and first[0] == key):
                    first = (key, step if first is None else op.then(first[1], step))
                else:
                    last = (key, op.then(last[1], step) if last is not None and last[0] == key else step)
            for key, a, b in spans[1:][-1:]:  # what lies between the first and the last key stays in this partition
                last = (key, op.step([v[a:b] for v in values]))
        if first is not None:
            yield pd.DataFrame({"chunk": [chunk], "ends": [pickle.dumps((first, last))]})

    import pickle

    out: dict[int, tuple[tuple, Any]] = {}
    open_key, state = None, None
    for row in sorted(rows.mapInPandas(ends, "chunk int, ends binary").collect()):
        first, last = pickle.loads(bytes(row["ends"]))
        if first[0] == open_key:
            out[row["chunk"]] = (open_key, state)
            state = op.after(state, first[1])
        else:
            open_key, state = first[0], op.after(None, first[1])
        if last is not None:
            open_key, state = last[0], op.after(None, last[1])
    return out


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[Column], op: Running) -> DataFrame:
    """Adds the columns of `op`, run over the rows of each key in the given order (which should have no ties)."""
    rows = in_order(df, keys, order)
    given = begins(rows, keys, op)
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, T._parse_datatype_string(k)) for n, k in op.out.items()]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_key, state, begun = None, None, False
        for pdf in batches:
            if len(pdf) and not begun:
                begun, (open_key, state) = True, given.get(int(pdf["_chunk"].iloc[0]), (None, None))
            values = [pdf[c].to_numpy(float) for c in op.columns]
            parts: list[list[np.ndarray]] = []
            for key, a, b in runs(key_rows(pdf, keys)):
                if key != open_key:
                    open_key, state = key, None
                got, state = op.rows(state, [v[a:b] for v in values])
                parts.append(got)
            columns = {name: np.concatenate([p[k] for p in parts]) if parts else np.empty(0) for k, name in enumerate(op.out)}
            yield pdf.drop(columns="_chunk").assign(**columns)

    return rows.mapInPandas(run, schema)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Adds each row's number in its key, from 1, in the given order."""
    one = scan(df.withColumn("_one", F.lit(1.0)), keys, order, Sums(**{name: "_one"}))
    return one.withColumn(name, F.col(name).cast("long")).drop("_one")
