"""Rows in one global order, with the rank of each: the step that prefix doubling repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import durable

#: Groups that a partition's ranks have room for.
ROOM = 1 << 40


def ranked(rows: DataFrame, keys: list[str], place: list[str]) -> DataFrame:
    """rows with rank (equal for equal keys, and in the keys' order), first (whether none of the group comes before by
    place) and many (whether the group has another row).

    One range sort by keys and place: place is part of the sort key, so a group of any size is spread over partitions,
    and no task holds it. Tasks stream through their sorted rows and compare neighbours; a group that goes on over a
    partition's end is settled by the partitions' first and last keys, a row each, which the driver reads. Keys aren't
    null, and are compared as they are, not by hashes."""
    names = rows.columns
    flags = {"_part": "integer", "_group": "long", "_new": "boolean", "_twin": "boolean", "_end": "boolean"}
    out = StructType(rows.schema.fields)
    for name, kind in flags.items():
        out = StructType(out.fields).add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        group, last = -1, None

        def flagged(t: pa.Table, more: bool) -> pa.RecordBatch:
            """All rows but the last (all, if no more come), with what their neighbours say."""
            nonlocal group, last
            t = t.combine_chunks()
            n = t.num_rows
            differs = np.zeros(max(0, n - 1), bool)
            for k in keys:
                c = t.column(k)
                differs |= pc.not_equal(c.slice(1), c.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            head = last is None or any(t.column(k)[0] != v for k, v in zip(keys, last))
            new = np.concatenate(([head], differs))
            numbers = group + np.cumsum(new)
            twin = np.concatenate((~differs, [False]))
            m = n - 1 if more else n
            if m:
                group, last = int(numbers[m - 1]), [t.column(k)[m - 1] for k in keys]
            end = np.zeros(n, bool)
            end[-1] = not more
            for name, x in zip(list(flags)[1:], (numbers, new, twin, end)):
                t = t.append_column(name, pa.array(x))
            return t.slice(0, m).combine_chunks().to_batches()[0]

        for batch in batches:
            if batch.num_rows:
                t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
                if t.num_rows > 1:
                    yield flagged(t, True)
                held = t.slice(t.num_rows - 1)
        if held is not None:
            yield flagged(held, False)

    found = durable(rows.orderBy(*keys, *place).withColumn("_part", F.spark_partition_id()).mapInArrow(run, out))
    key = F.struct(*keys)
    edges = found.groupBy("_part").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.max("_group").alias("groups")).orderBy("_part").collect()
    #: of partitions whose first group began in an earlier one, that group's rank; and whose last group goes on
    begun, goes_on = {}, []
    for before, here in zip(edges, edges[1:]):
        if before["high"] == here["low"]:
            goes_on.append(before["_part"])
            begun[here["_part"]] = begun[before["_part"]] if before["groups"] == 0 and before["_part"] in begun else before["_part"] * ROOM + before["groups"]
    part, rank = F.col("_part"), F.col("_part") * F.lit(ROOM) + F.col("_group")
    first, many = F.col("_new"), ~F.col("_new") | F.col("_twin")
    if begun:
        known = F.element_at(F.create_map(*[F.lit(x) for p in begun.items() for x in p]), part)
        old = (F.col("_group") == 0) & known.isNotNull()
        rank, first, many = F.when(old, known).otherwise(rank), first & ~old, many | old | (F.col("_end") & part.isin(goes_on))
    return found.select(*names, rank.alias("rank"), first.alias("first"), many.alias("many"))
