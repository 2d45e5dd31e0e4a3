import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tickloom.operators import state, tables
from tickloom.operators.durable import durable
from tickloom.streaming import alerts as stream


def put(folder, name, rows, columns, at=1000):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(dict(zip(columns, r))) for r in rows))
    os.utime(folder / name, (at, at))


def run(writer, checkpoint):
    q = writer.option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    q.awaitTermination(300)


def messages(n, seed):
    rnd = random.Random(seed)
    return [(i, 1000.0 + 40 * i + rnd.randrange(30), rnd.sample("abcdefgh", rnd.choice([0, 1, 1, 2])) if i % 5 else [f"t{i % 3}", "a"]) for i in range(n)]


@pytest.mark.parametrize("threshold", [1, 2])
def test_bursts_over_shuffled_batches_equal_one_batch(spark, tmp_path, threshold):
    rows = messages(120, threshold)
    schema = "id long, epoch double, tickers array<string>"
    whole = {r.id: r.sent for r in state.burst(spark.createDataFrame(rows, schema), 600.0, threshold).collect()}
    rnd = random.Random(8)
    # each row up to 400 seconds out of order
    late = sorted(rows, key=lambda r: r[1] + rnd.randrange(400))
    bursts = stream.Bursts(spark, str(tmp_path / "b"), "long", 600.0, threshold, 400.0)
    for k in range(4):
        part = spark.createDataFrame(late[30 * k : 30 * k + 30], schema)
        bursts(part, k)
        if k == 2:
            bursts(part, k)  # run again after a failure
    live = {r.ticker: r.times for r in bursts.times.at(3).collect()}
    mark = bursts.marks.at(3).first().mark
    assert all(t >= mark - 600 for ts in live.values() for t in ts) and max(map(len, live.values())) <= threshold
    bursts.finish(4)
    got = [(r.id, r.sent) for r in bursts.decisions.read().collect()]
    assert len(got) == len(rows) and dict(got) == whole and set(whole.values()) == {True, False}


def test_store_reads_what_may_be_there(spark, tmp_path):
    store = tables.KeyedStore(spark, str(tmp_path / "s"), "url string, n long", "url", folders=64)
    rows = lambda a, b: spark.range(a, b).select(F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), F.col("id").alias("n"))
    store.add(rows(0, 20_000), 0)
    store.add(rows(20_000, 30_000), 1)
    # no key that is there is missed, and hardly one that isn't is asked for
    assert store.perhaps(rows(0, 30_000), 2).count() == 30_000
    assert store.perhaps(rows(50_000, 80_000), 2).count() <= 10
    asked = rows(50_000, 50_500).unionByName(rows(29_990, 29_993))
    held = store.held(asked, 2)
    assert {r.url for r in held.collect()} == {"u29990", "u29991", "u29992"}
    folders = {store.place_of(u) for u in ("u29990", "u29991", "u29992")}
    plan = held._jdf.queryExecution().executedPlan().toString()
    read = re.search(r"PartitionFilters: \[[^\]]*place#\d+ IN \(([\d,]+)\)", plan) or re.search(r"PartitionFilters: \[[^\]]*\(place#\d+ = (\d+)\)", plan)
    assert {int(x) for x in read[1].split(",")} <= folders
    # of the batches before only
    assert store.held(rows(29_990, 29_993), 1).count() == 0 and store.held(rows(0, 5), 0).count() == 0


def test_ingest_over_batches(spark, tmp_path):
    columns = ("url", "n", "at")
    stamp = lambda s: f"2024-01-01T00:{s // 60:02d}:{s % 60:02d}Z"
    for i in range(3):
        put(tmp_path / "in", f"{i}.json", [(f"u{k}", i, stamp(100 * i + k)) for k in range(40 * i, 40 * i + 80)] * 2, columns, 1000 + i)
    read = spark.readStream.schema("url string, n int, at timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    for name, at in (("plain", None), ("state", "at")):
        run(stream.ingest(read, str(tmp_path / name), "url", ["n"], at=at, within="10 minutes", folders=8), tmp_path / f"{name}-c")
        got = stream.stored(spark, str(tmp_path / name), "url string, n int, at timestamp", "url").collect()
        assert sorted((r.url, r.n) for r in got) == sorted((f"u{k}", max(0, k // 40 - 1)) for k in range(160))


def test_counters_count_once(spark, tmp_path):
    for i in range(3):
        put(tmp_path / "in", f"{i}.json", [("2024-01-01", "pushes", f"c{k % 3}", 1.5) for k in range(10 * (i + 1))], ("day", "name", "dims", "delta"), 1000 + i)
    read = spark.readStream.schema("day string, name string, dims string, delta double").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    folder, keys = str(tmp_path / "t"), ["day", "name", "dims"]
    run(stream.count_up(read, folder, keys, "delta"), tmp_path / "c")
    table = tables.Latest(spark, folder, "day string, name string, dims string, value double", keys)
    want = {f"c{c}": 1.5 * sum(1 for n in (10, 20, 30) for k in range(n) if k % 3 == c) for c in range(3)}
    assert {r.dims: r.value for r in table.current().collect()} == want
    # the last batch is run again: the same values once more
    table.upsert(durable(table.at(2)), 2)
    assert {r.dims: r.value for r in table.current().collect()} == want
    assert {r.dims: r.value for r in table.compacted(str(tmp_path / "u"), 1).current().collect()} == want
    assert {r.dims: r.value for r in table.current(before=1).collect()} == {f"c{c}": 1.5 * sum(1 for k in range(10) if k % 3 == c) for c in range(3)}


def test_rules_change_while_the_stream_runs(spark, tmp_path):
    columns = ("ticker", "epoch", "price", "prev_close", "volume")
    for i in range(3):
        put(tmp_path / "ticks", f"{i}.json", [("A", 1000 + i, 90.0, 100.0, 1), ("B", 1000 + i, 99.0, 100.0, 1)], columns, 1000 + i)
    rule = lambda n, e: json.dumps([{"id": n, "kind": "threshold", "expr": e}])
    texts = iter([rule("drop", "pct_change <= -3"), "not a file", rule("any", "pct_change < 0")])
    ticks = stream.tick_stream(spark, str(tmp_path / "ticks"))
    run(stream.hits_with_reload(ticks, lambda: next(texts), str(tmp_path / "hits")), tmp_path / "c")
    rows = []
    run(stream.hit_stream(spark, str(tmp_path / "hits")).writeStream.foreachBatch(lambda df, n: rows.extend(df.collect())), tmp_path / "d")
    assert sorted(map(tuple, rows)) == [("any", "A", 1002), ("any", "B", 1002), ("drop", "A", 1000), ("drop", "A", 1001)]
