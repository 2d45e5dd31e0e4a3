"""Recurrences over ordered series, for every row, with no key held by one task.

A step s' = A s + b is an affine map of the state, and so is a whole block of steps. Rows are sorted by key and order into
range partitions, so that a long key lies over several of them; of every block whose key goes on in the next partition the
map is computed, maps are applied one after another, which gives each partition's state to begin with, and then each
partition is folded by itself. What the driver sees is a matrix a partition, whatever the number of rows or keys."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .durable import durable

State = tuple[float, ...]


@dataclass(frozen=True)
class Recurrence:
    """``step`` gives the state after a row from the state before, the row's value, the value before (null at a key's first
    row) and the row's place in its key, from 0. It must be affine in the state, and not depend on it at place 0.
    ``read`` has the columns that a state gives."""

    size: int
    step: Callable[[State, float, float | None, int], State]
    read: dict[str, Callable[[State, int], float | None]]

    def linear(self, place: int, n: int) -> np.ndarray:
        """The matrix A of n steps from a place on: what they make of each unit vector when nothing else comes in."""
        out = []
        for unit in np.eye(self.size).tolist():
            s = tuple(unit)
            for i in range(place, place + n):
                s = self.step(s, 0.0, 0.0, i)
                if not any(s):
                    break
            out.append(s)
        return np.array(out).T


def ema(n: int, column: str = "ema") -> Recurrence:
    """The exponential mean, seeded with the first value."""
    a = 2.0 / (n + 1)
    return Recurrence(1, lambda s, x, p, i: (a * x + (1 - a) * s[0],) if i else (x,), {column: lambda s, i: s[0]})


def rsi(n: int = 14, column: str = "rsi") -> Recurrence:
    """Wilder's relative strength: the mean gain and loss of the first n changes, then smoothed; 100 without losses, null
    with fewer than n + 1 values."""

    def step(s: State, x: float, p: float | None, i: int) -> State:
        if not i:
            return (0.0, 0.0)
        gain, loss = max(x - p, 0.0), max(p - x, 0.0)
        return (s[0] + gain / n, s[1] + loss / n) if i <= n else ((s[0] * (n - 1) + gain) / n, (s[1] * (n - 1) + loss) / n)

    return Recurrence(2, step, {column: lambda s, i: None if i < n else 100.0 if s[1] == 0 else 100 - 100 / (1 + s[0] / s[1])})


def macd(fast: int = 12, slow: int = 26, signal: int = 9, prefix: str = "") -> Recurrence:
    """dif (of two exponential means), dea (its mean, from 0) and hist (twice their difference); null with fewer than slow + signal values."""
    kf, ks, kd = (2.0 / (n + 1) for n in (fast, slow, signal))

    def step(s: State, x: float, p: float | None, i: int) -> State:
        if not i:
            return (x, x, 0.0)
        f, w = kf * x + (1 - kf) * s[0], ks * x + (1 - ks) * s[1]
        return (f, w, kd * (f - w) + (1 - kd) * s[2])

    known = lambda f: lambda s, i: f(s) if i + 1 >= slow + signal else None
    read = {"dif": lambda s: s[0] - s[1], "dea": lambda s: s[2], "hist": lambda s: 2 * (s[0] - s[1] - s[2])}
    return Recurrence(3, step, {prefix + c: known(f) for c, f in read.items()})


def over(rows: DataFrame, keys: list[str], order: list[str], value: str, recurrences: list[Recurrence]) -> DataFrame:
    """keys, order and value of every row that has a value, with the recurrences' columns and bars, the values so far.

    Rows of a key are taken by ``order``, which should tell them apart. Null keys are a key; an empty table gives an empty result."""
    names = [*keys, *order, value]
    kept = rows.where(F.col(value).isNotNull()).select(*names[:-1], F.col(value).cast("double").alias(value))
    placed = durable(kept.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("_part", F.spark_partition_id()))

    # the first and the last key of each partition
    blocks = placed.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"), F.max_by(value, F.struct(*order)).alias("_last"))
    by = Window.partitionBy("_part")
    ends = blocks.withColumns({"_first": F.row_number().over(by.orderBy(*keys)), "_rest": F.row_number().over(by.orderBy(*[F.col(k).desc() for k in keys]))})
    found = sorted(ends.where("_first = 1 OR _rest = 1").collect(), key=lambda r: (r["_part"], r["_first"]))
    #: of a partition, whose first key began earlier: (values before, value before)
    begun: dict[int, tuple[int, float]] = {}
    #: of a partition, whose last key goes on: (key, values before, value before)
    open_: dict[int, tuple[tuple, int, float | None]] = {}
    for a, b in zip(found, found[1:]):
        key = tuple(a[k] for k in keys)
        if a["_part"] != b["_part"] and key == tuple(b[k] for k in keys):
            before = begun.get(a["_part"]) if a["_first"] == 1 else None
            open_[a["_part"]] = (key, *(before or (0, None)))
            begun[b["_part"]] = ((before or (0,))[0] + a["_n"], a["_last"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, states, place, prev = None, [(0.0,) * r.size for r in recurrences], 0, None
        key = None
        for batch in batches:
            if part is None and batch.num_rows:
                part = batch.column("_part")[0].as_py()
                key, place, prev = open_.get(part, (None, 0, None))
                start = place
            if key is None:
                continue
            columns = [batch.column(k).to_pylist() for k in keys]
            for *k, x in zip(*columns, batch.column(value).to_pylist()):
                if tuple(k) == key:
                    states = [r.step(s, x, prev, place) for r, s in zip(recurrences, states)]
                    prev, place = x, place + 1
        if key is not None:
            flat = [x for r, s in zip(recurrences, states) for x in (*r.linear(start, place - start).ravel(), *s)]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([flat], pa.list_(pa.float64()))], ["part", "map"])

    carried: dict[int, tuple[int, float, list[State]]] = {}
    if open_:
        maps = {r["part"]: r["map"] for r in placed.select("_part", *keys, value).mapInArrow(summed, "part int, map array<double>").collect()}
        parts = sorted({r["_part"] for r in found})
        for here, after in zip(parts, parts[1:]):
            if here in open_:
                flat, new, at = maps[here], [], 0
                before = carried[here][2] if here in carried and open_[here][1] else [(0.0,) * r.size for r in recurrences]
                for r, s in zip(recurrences, before):
                    m = r.size
                    matrix, b = np.array(flat[at : at + m * m]).reshape(m, m), np.array(flat[at + m * m : at + m * m + m])
                    new.append(tuple((matrix @ np.array(s) + b).tolist()))
                    at += m * m + m
                carried[after] = (*begun[after], new)

    readers = [(c, k, f) for k, r in enumerate(recurrences) for c, f in r.read.items()]
    out = StructType(placed.drop("_part").schema.fields)
    for c, _, _ in readers:
        out = out.add(c, "double")
    out = out.add("bars", "long")

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, states, place, prev = None, None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_pylist() for k in keys]
            got: list[list] = [[] for _ in readers]
            bars = []
            if key is None:
                key, states = tuple(c[0] for c in columns), [(0.0,) * r.size for r in recurrences]
                place, prev, states = carried.get(batch.column("_part")[0].as_py(), (0, None, states))
            for *k, x in zip(*columns, batch.column(value).to_pylist()):
                if tuple(k) != key:
                    key, place, prev = tuple(k), 0, None
                states = [r.step(s, x, prev, place) for r, s in zip(recurrences, states)]
                for column, (_, i, f) in zip(got, readers):
                    column.append(f(states[i], place))
                prev, place = x, place + 1
                bars.append(place)
            kept = batch.drop_columns("_part")
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(g, pa.float64()) for g in got), pa.array(bars, pa.int64())], [*kept.schema.names, *(c for c, _, _ in readers), "bars"])

    return placed.mapInArrow(folded, out)


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of each key the row that is last by order."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")
