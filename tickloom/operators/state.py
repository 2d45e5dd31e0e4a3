"""Keyed state as folds: cooldown, burst suppression, streaks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .components import components


def cooldown_fires(hits: DataFrame, keys: list[str], seconds: int) -> DataFrame:
    """keys, epoch, fired for hits (keys, epoch): suppressed hits don't move the anchor.

    The fold's state is two numbers a key. Grouped rows stream through a worker in order, so a key of any length is read
    batch by batch, and no array of its hits is built."""
    kinds = ", ".join(f"{k} {hits.schema[k].dataType.simpleString()}" for k in keys)
    rows = hits.select(*keys, F.col("epoch").cast("bigint")).repartition(*keys).sortWithinPartitions(*keys, "epoch")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, anchor = None, None
        for pdf in batches:
            fired = []
            for row in pdf[[*keys, "epoch"]].itertuples(index=False, name=None):
                if row[:-1] != key:
                    key, anchor = row[:-1], None
                fire = anchor is None or row[-1] - anchor >= seconds
                anchor = row[-1] if fire else anchor
                fired.append(fire)
            yield pdf.assign(fired=fired)

    return rows.mapInPandas(run, f"{kinds}, epoch bigint, fired boolean")


def streaks(rows: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """rows with ``streak``: consecutive failures up to each row, 0 at a success."""
    w = Window.partitionBy(key).orderBy(*order)
    island = F.sum(F.when(failed, 0).otherwise(1)).over(w)
    run = Window.partitionBy(key, "_island").orderBy(*order)
    return rows.withColumn("_island", island).withColumn("streak", F.sum(F.when(failed, 1).otherwise(0)).over(run)).drop("_island")


def components_of(messages: DataFrame) -> DataFrame:
    """messages (id, tickers, ...) with ``component``: the least ticker that shared messages connect theirs to; null without
    tickers."""
    first = messages.select(F.get("tickers", F.lit(0)).alias("a"), F.explode("tickers").alias("b")).distinct()
    linked = components(first).select(F.col("node").alias("_node"), F.col("component").alias("_least"))
    named = messages.withColumn("_first", F.get("tickers", F.lit(0))).join(linked, F.col("_first") == F.col("_node"), "left")
    return named.withColumn("component", F.coalesce("_least", "_first")).drop("_first", "_node", "_least")


#: What a burst's fold gives: decisions (id, sent), or the sent times of a ticker in the end (ticker, times).
FOLDED = "sent boolean, ticker string, times array<double>"


def burst_folded(messages: DataFrame, window: float, threshold: int, before: DataFrame | None = None, now: float | None = None) -> DataFrame:
    """id, sent of each message, as ``burst`` says, and with ``before`` also ticker and times: the sent times within the
    window before ``now``, as they are in the end. before has the same as they were (ticker, times)."""
    kind = messages.schema["id"].dataType
    rows = messages.select("id", F.col("epoch").cast("double").alias("epoch"), F.col("tickers").cast("array<string>").alias("tickers"), F.lit(None).cast("array<double>").alias("times"))
    if before is not None:
        held = before.select(F.lit(None).cast(kind).alias("id"), F.lit(None).cast("double").alias("epoch"), F.array("ticker").alias("tickers"), "times")
        rows = rows.unionByName(held)
    rows = components_of(rows).select("component", "epoch", "id", "tickers", "times").repartition("component").sortWithinPartitions("component", F.col("epoch").asc_nulls_first(), "id")
    keeps, arrow = before is not None, to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: str | None = None
        sent: dict[str, list[float]] = {}

        def states() -> list[tuple]:
            since = -float("inf") if now is None else now - window
            left = ((t, [x for x in xs if x >= since]) for t, xs in sent.items()) if keeps else ()
            return [(None, None, t, xs) for t, xs in left if xs]

        def made(out: list[tuple]) -> pa.RecordBatch:
            kinds = (arrow, pa.bool_(), pa.string(), pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["id", "sent", "ticker", "times"])

        for batch in batches:
            out = []
            for component, epoch, i, tickers, times in zip(*(batch.column(c).to_pylist() for c in ("component", "epoch", "id", "tickers", "times"))):
                names = tickers or []
                if component != at:
                    out += states()
                    at, sent = component, {}
                if times is not None:
                    sent[names[0]] = times
                    continue
                epoch = -float("inf") if epoch is None else epoch
                if len(sent) > 100_000:
                    sent = {t: x for t, x in sent.items() if x[-1] >= epoch - window}
                lately = [[x for x in sent.get(t, ()) if x >= epoch - window] for t in names]
                send = all(len(x) < threshold for x in lately)
                if send:
                    for t in names:
                        sent[t] = [*(x for x in sent.get(t, ()) if x >= epoch - window), epoch]
                out.append((i, send, None, None))
            if out:
                yield made(out)
        if out := states():
            yield made(out)

    return rows.mapInArrow(run, f"id {kind.simpleString()}, {FOLDED}")


def burst(messages: DataFrame, window: float, threshold: int) -> DataFrame:
    """id, sent for messages (id, epoch, tickers): one is held back if any of its tickers was sent ``threshold`` times within
    the window; a sent message counts for all its tickers, one held back for none. Without tickers all are sent.

    Tickers that messages name together depend on each other, so each component of tickers is a fold over its messages
    in order of (epoch, id). Rows stream through a task sorted, and what is kept is the last sent times of tickers within
    the window, ``threshold`` each at most: a component of any length is read batch by batch."""
    return burst_folded(messages, window, threshold).select("id", "sent")
