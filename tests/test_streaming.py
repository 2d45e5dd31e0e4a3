import json
import os

import pytest
from pyspark.sql import functions as F

from tickloom.operators import alerts
from tickloom.streaming import alerts as stream


def test_alerts_and_cooldown_go_on_over_batches(spark, tmp_path):
    source = tmp_path / "ticks"
    source.mkdir()
    rows = [("NVDA", t, 90.0, 100.0, 1) for t in (1000, 1500, 2800)], [("NVDA", t, 90.0, 100.0, 1) for t in (2900, 4700)] + [("AMD", 1, 99.0, 100.0, 1)]
    for i, part in enumerate(rows):
        (source / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("ticker", "epoch", "price", "prev_close", "volume"), r))) for r in part))
        os.utime(source / f"{i}.json", (1000 + i, 1000 + i))
    out = stream.alert_stream(stream.tick_stream(spark, str(source)), [alerts.Rule("drop", "threshold", "pct_change <= -3")], 1800)
    q = out.writeStream.format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.ticker, r.epoch) for r in spark.table("fired").collect()) == [("NVDA", 1000), ("NVDA", 2800), ("NVDA", 4700)]


def test_ingest_keeps_first(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()
    for i in range(2):
        (source / f"{i}.json").write_text("\n".join(json.dumps({"url": f"u{k}", "n": i}) for k in range(i, i + 3)))
    rows = spark.readStream.schema("url string, n int").option("maxFilesPerTrigger", 1).json(str(source))
    q = stream.ingest(rows, store, "url").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = stream.stored(spark, store, "url string, n int", "url").groupBy("url").agg(F.count("*").alias("c")).collect()
    assert {r.url: r.c for r in got} == {f"u{k}": 1 for k in range(4)}


def test_dispatch_is_per_channel(spark):
    taken, dead, log = {}, [], []
    sinks = {"a": lambda df: taken.update(a=df.count()), "b": lambda df: 1 / 0}
    rows = spark.createDataFrame([("a",), ("a",), ("b",), ("c",)], "channel string")
    stream.dispatch(sinks, lambda df: dead.extend(df.collect()), lambda df: log.extend(df.collect()))(rows, 3)
    assert [tuple(r) for r in log] == [(3, "a", True, 2, None), (3, "b", False, 1, "ZeroDivisionError: division by zero")]
    assert taken == {"a": 2} and [(r.channel, r.batch, r.error) for r in dead] == [("b", 3, "ZeroDivisionError: division by zero")]
    # without a place for them, failed rows fail the batch
    with pytest.raises(RuntimeError):
        stream.dispatch(sinks)(rows, 3)
