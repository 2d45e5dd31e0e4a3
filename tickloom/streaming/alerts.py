"""Structured Streaming twins: rules over a stream of ticks, cooldown as keyed state, bursts, counters, micro-batch ingest."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

from ..operators import alerts, state, store, tables
from ..operators.durable import durable

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TICK = "ticker string, epoch long, price double, prev_close double, volume long"


def tick_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Ticks from the JSON files that arrive in a folder."""
    return spark.readStream.schema(TICK).option("maxFilesPerTrigger", files_per_trigger).json(folder)


class Cooldown(StatefulProcessor):
    """A key's last hit that fired, and how many were held back since, for as long as it can hold others back: a timer
    of event time drops both when the watermark has passed the cooldown's end."""

    def __init__(self, keys: list[str], seconds: int):
        self.keys, self.seconds = keys, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("cooldown", "last bigint, held bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, held = self.state.get() if self.state.exists() else (None, 0)
        before = last
        epochs = np.sort(np.concatenate([pdf["epoch"].to_numpy() for pdf in rows])).tolist()
        fired, counts = [], []
        for t in epochs:
            fire = last is None or t - last >= self.seconds
            last, held = (t, 0) if fire else (last, held + 1)
            fired.append(fire)
            counts.append(held)
        if before is not None and before != last:
            self.handle.deleteTimer((before + self.seconds) * 1000)
        if before != last:
            self.handle.registerTimer((last + self.seconds) * 1000)
        self.state.update((last, held))
        yield pd.DataFrame({**{k: [v] * len(epochs) for k, v in zip(self.keys, key)}, "epoch": epochs, "fired": fired, "suppressed": counts})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield from ()

    def close(self) -> None:
        pass


def with_cooldown(hits: DataFrame, keys: list[str], seconds: int, late: str = "1 hour") -> DataFrame:
    """keys, epoch, fired, suppressed (hits held back since the last that fired) for a stream of hits.

    State is two numbers a key, in Spark's state store, so a restart goes on where the checkpoint ends; it goes when the
    watermark, ``late`` behind the newest hit, has passed the cooldown's end, so the store holds what came lately, not all
    keys there ever were. Hits of one micro-batch are taken in order of time, and later ones than the watermark are
    dropped; suppressed hits only count, and don't move the time of the last that fired. Timers need the RocksDB state store, which
    the session is set to."""
    hits.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kinds = ", ".join(f"{k} {hits.schema[k].dataType.simpleString()}" for k in keys)
    timed = hits.select(*keys, F.col("epoch").cast("bigint").alias("epoch"), F.timestamp_seconds("epoch").alias("at")).withWatermark("at", late)
    return timed.groupBy(*keys).transformWithStateInPandas(Cooldown(keys, seconds), f"{kinds}, epoch bigint, fired boolean, suppressed bigint", "Append", "EventTime")


def alert_stream(ticks: DataFrame, rules: list[alerts.Rule], cooldown_seconds: int, late: str = "1 hour") -> DataFrame:
    """Alerts that fire on a stream of ticks."""
    pct = F.when(F.col("prev_close") == 0, 0.0).otherwise((F.col("price") - F.col("prev_close")) / F.col("prev_close") * 100)
    hits = alerts.evaluate(ticks.withColumn("pct_change", pct), rules).select("rule_id", "ticker", "epoch")
    return with_cooldown(hits, ["rule_id", "ticker"], cooldown_seconds, late).where("fired")


def minute_bars(ticks: DataFrame, late: str = "10 minutes") -> DataFrame:
    """One-minute bars of a stream of (ticker, ts, price), with a bound on lateness."""
    order = F.struct("ts", "price")
    bars = ticks.withWatermark("ts", late).groupBy("ticker", F.window("ts", "1 minute"))
    return bars.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count(F.lit(1)).alias("volume"))


def hits_with_reload(ticks: DataFrame, rules: Callable[[], str], folder: str) -> DataStreamWriter:
    """Writes the hits of a stream of ticks to a folder, by the rules as they are when a micro-batch begins.

    ``rules`` gives the text of the rules' file; each batch reads it anew, and a bad file keeps the rules held. A batch
    that is run again overwrites its own hits. hit_stream reads the folder as a stream, for the cooldown."""
    held: list[alerts.Rule] = []

    def run(batch: DataFrame, number: int) -> None:
        nonlocal held
        held = alerts.reloaded(held, rules())
        pct = F.when(F.col("prev_close") == 0, 0.0).otherwise((F.col("price") - F.col("prev_close")) / F.col("prev_close") * 100)
        context = batch.withColumn("pct_change", pct)
        hits = alerts.evaluate(context, held).select("rule_id", "ticker", "epoch") if held else context.select(F.lit("").alias("rule_id"), "ticker", "epoch").limit(0)
        tables.Versions(batch.sparkSession, folder, HIT).write(hits, number)

    return ticks.writeStream.foreachBatch(run)


HIT = "rule_id string, ticker string, epoch long"


def hit_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The hits that hits_with_reload writes."""
    return spark.readStream.schema(HIT).option("recursiveFileLookup", "true").parquet(folder)


def ingest(stream: DataFrame, folder: str, key: str, order: list[str] | None = None, since: Column | None = None, at: str | None = None, within: str = "1 day", folders: int = 256) -> DataStreamWriter:
    """Appends rows whose key isn't in the store yet, the first of each by ``order``: insert-or-get in micro-batches.

    Keys that repeat within a time of each other by ``at`` never come to the store: Spark's own state drops them. Of the
    store, its filters say which keys may be there, and only the folders of those are read (tables.KeyedStore). A batch
    that is run again after a failure overwrites its own rows, so its effect is once."""
    if at is not None:
        stream = stream.withWatermark(at, within).dropDuplicatesWithinWatermark([key])

    def add(batch: DataFrame, number: int) -> None:
        held = tables.KeyedStore(batch.sparkSession, folder, batch.schema, key, folders)
        rows = durable(batch if since is None else batch.where(since))
        held.add(durable(store.insert_new(held.held(rows, number), rows, key, order)), number)

    return stream.writeStream.foreachBatch(add)


def stored(spark: SparkSession, folder: str, schema: str, key: str) -> DataFrame:
    """The rows that ingest has put in a store."""
    return tables.KeyedStore(spark, folder, schema, key).read().drop("batch", "place")


def count_up(stream: DataFrame, folder: str, keys: list[str], delta: str) -> DataStreamWriter:
    """Counters kept in a table (keys, value): what a stream adds up to.

    The sums are Spark's streaming state; each batch gives the counters that changed, as they now are, to a table of last
    values. So a batch that is run again says the same once more and counts nothing twice."""
    sums = stream.groupBy(*keys).agg(F.sum(F.col(delta).cast("double")).alias("value"))

    def put(batch: DataFrame, number: int) -> None:
        tables.Latest(batch.sparkSession, folder, batch.schema, keys).upsert(batch, number)

    return sums.writeStream.outputMode("update").foreachBatch(put)


class Bursts:
    """The burst rule over a stream of messages (id, epoch, tickers): a foreachBatch function.

    A decision depends on all earlier ones of its tickers, so messages wait until none can come before them: until the
    newest is ``delay`` seconds ahead. Then they are decided in order, exactly as in one batch over all of them. Between
    batches there are only the tickers' last sent times, within the window; within one, messages that name tickers
    together form components, which are decided apart. So what a batch costs is the batch and the live tickers, however
    many tickers have been linked before. A batch that is run again overwrites what it wrote. Messages that are later than the delay
    are decided when they come."""

    def __init__(self, spark: SparkSession, folder: str, id_type: str, window: float, threshold: int, delay: float):
        self.window, self.threshold, self.delay = window, threshold, delay
        table = lambda name, schema: tables.Versions(spark, f"{folder}/{name}", schema)
        self.waiting = table("waiting", f"id {id_type}, epoch double, tickers array<string>")
        self.times = table("times", "ticker string, times array<double>")
        self.marks = table("marks", "mark double")
        self.decisions = table("decisions", f"id {id_type}, sent boolean")

    def __call__(self, batch: DataFrame, number: int, end: bool = False) -> None:
        before = number - 1
        new = batch.select("id", F.col("epoch").cast("double").alias("epoch"), "tickers")
        rows = durable(self.waiting.at(before).unionByName(new))
        newest = rows.agg(F.max("epoch")).first()[0]
        marks = [r.mark for r in self.marks.at(before).collect()]
        mark = float("inf") if end else max([*marks, *([newest - self.delay] if newest is not None else [])], default=-float("inf"))
        self.waiting.write(rows.where(F.col("epoch") >= mark), number)
        ready = rows.where(F.col("epoch").isNull() | (F.col("epoch") < mark))
        latest = newest if end and newest is not None else mark
        folded = durable(state.burst_folded(ready, self.window, self.threshold, self.times.at(before), latest))
        self.decisions.write(folded.where("ticker IS NULL"), number)
        self.times.write(folded.where("ticker IS NOT NULL"), number)
        self.marks.write(batch.sparkSession.createDataFrame([(mark,)], "mark double"), number)

    def finish(self, number: int) -> None:
        """Decides what still waits, when no more messages come."""
        self(self.waiting.at(-1), number, end=True)


def dispatch(sinks: dict[str, Callable[[DataFrame], None]], dead: Callable[[DataFrame], None] | None = None, log: Callable[[DataFrame], None] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that gives each channel's rows to its sink; rows of unknown channels are dropped, and one
    channel's failure doesn't keep the others from theirs. Failed rows go to ``dead`` with the batch and the error; without
    it, or if that fails too, the batch fails and is run again, so no row is lost. ``log`` gets a row for each channel
    of the batch, what became of it: batch, channel, ok, rows, error."""
    result = "batch long, channel string, ok boolean, rows long, error string"

    def run(batch: DataFrame, number: int) -> None:
        failed, results = {}, []
        for channel, sink in sinks.items():
            rows = batch.where(F.col("channel") == channel)
            try:
                sink(rows)
            except Exception as e:  # noqa: BLE001
                failed[channel] = f"{type(e).__name__}: {e}"
                if dead is not None:
                    dead(rows.withColumns({"batch": F.lit(number), "error": F.lit(failed[channel])}))
        if log is not None:
            counts = {r.channel: r["count"] for r in batch.where(F.col("channel").isin(*sinks)).groupBy("channel").count().collect()}
            results = [(number, c, c not in failed, counts.get(c, 0), failed.get(c)) for c in sinks]
            log(batch.sparkSession.createDataFrame(results, result))
        if failed and dead is None:
            raise RuntimeError(f"batch {number} failed for {failed}")

    return run
