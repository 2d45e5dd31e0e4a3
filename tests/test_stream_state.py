import json
import os

from pyspark.sql import functions as F

from tickloom.streaming import alerts as stream


def put(folder, name, rows, columns, at):
    (folder / name).write_text("\n".join(json.dumps(dict(zip(columns, r))) for r in rows))
    os.utime(folder / name, (at, at))


def run(hits, state):
    rows = []
    q = hits.writeStream.foreachBatch(lambda df, n: rows.extend(df.collect())).option("checkpointLocation", str(state)).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return rows, q.recentProgress


def test_cooldown_state_falls_and_a_restart_goes_on(spark, tmp_path):
    source, state = tmp_path / "hits", tmp_path / "state"
    source.mkdir()
    read = lambda: spark.readStream.schema("k string, epoch long").option("maxFilesPerTrigger", 1).json(str(source))
    cooled = lambda: stream.with_cooldown(read(), ["k"], 600, "1 minute")
    put(source, "0.json", [(f"k{i}", 1000 + i) for i in range(50)] + [("a", 1000), ("a", 1300), ("a", 1599)], ("k", "epoch"), 1000)
    put(source, "1.json", [("a", 1600), ("b", 5000)], ("k", "epoch"), 1001)
    put(source, "2.json", [("b", 5599), ("c", 5600)], ("k", "epoch"), 1002)
    rows, first = run(cooled(), state)
    rows = {(r.k, r.epoch): (r.fired, r.suppressed) for r in rows if r.k < "k"}
    assert rows == {("a", 1000): (True, 0), ("a", 1300): (False, 1), ("a", 1599): (False, 2), ("a", 1600): (True, 0), ("b", 5000): (True, 0), ("b", 5599): (False, 1), ("c", 5600): (True, 0)}
    held = [p["stateOperators"][0]["numRowsTotal"] for p in first if p["stateOperators"]]
    # fifty keys of one hit are forgotten once their cooldown is over, and a
    assert max(held) >= 51 and held[-1] < 10
    # a second run goes on with b's time from the first
    put(source, "3.json", [("b", 5599), ("b", 5600), ("k0", 5601)], ("k", "epoch"), 1003)
    rows = {(r.k, r.epoch): r.fired for r in run(cooled(), state)[0]}
    assert rows == {("b", 5599): False, ("b", 5600): True, ("k0", 5601): True}


def test_many_keys_equal_the_batch_fold(spark, tmp_path):
    from tickloom.operators import state as batch

    source = tmp_path / "hits"
    source.mkdir()
    hits = spark.range(3000).select((F.col("id") % 37).cast("string").alias("k"), (10_000 + F.col("id") * 11 + F.col("id") % 37).alias("epoch"))
    rows = [(r.k, r.epoch) for r in hits.orderBy("epoch").collect()]
    for i in range(3):
        put(source, f"{i}.json", rows[1000 * i : 1000 * i + 1000], ("k", "epoch"), 1000 + i)
    read = spark.readStream.schema("k string, epoch long").option("maxFilesPerTrigger", 1).json(str(source))
    got, _ = run(stream.with_cooldown(read, ["k"], 2000), tmp_path / "state")
    want = {(r.k, r.epoch): r.fired for r in batch.cooldown_fires(hits, ["k"], 2000).collect()}
    assert {(r.k, r.epoch): r.fired for r in got} == want
