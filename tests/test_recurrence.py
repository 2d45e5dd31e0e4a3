import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import recurrence


def by_hand(values, what):
    """Every row's columns by one fold."""
    state, prev, out = (0.0,) * what.size, None, []
    for i, x in enumerate(values):
        state = what.step(state, x, prev, i)
        prev = x
        out.append([f(state, i) for f in what.read.values()])
    return out


def close(a, b):
    return (a is None) == (b is None) and (a is None or abs(a - b) <= 1e-9 * max(1.0, abs(b)))


ALL = [recurrence.ema(10, "e"), recurrence.rsi(14), recurrence.macd(5, 10, 4), recurrence.macd(12, 26, 9, "slow_")]


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_every_row_of_long_and_short_keys(spark, partitions):
    rnd = np.random.default_rng(7)
    series = {"a": 700, "b": 1, "c": 14, "d": 15, None: 40, "e": 9, "z": 90}
    values = {k: np.round(rnd.random(n) * 100, 2).tolist() for k, n in series.items()}
    values["e"] = [5.0] * 9
    rows = [(k, i, x, "other") for k, v in values.items() for i, x in enumerate(v)] + [("a", 1000, None, "no bar"), ("q", 1, None, "none")]
    df = spark.createDataFrame(rows, "ticker string, day int, close double, bars string").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = recurrence.over(df, ["ticker"], ["day"], "close", ALL).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == sum(series.values())
    names = [c for r in ALL for c in r.read]
    want = {k: [sum(x, []) for x in zip(*(by_hand(v, r) for r in ALL))] for k, v in values.items()}
    for r in got:
        assert r.bars == r.day + 1
        assert all(close(r[c], w) for c, w in zip(names, want[r.ticker][r.day])), r
    assert recurrence.over(df.where(F.lit(False)), ["ticker"], ["day"], "close", ALL).count() == 0


def test_a_key_of_a_million_bars_is_spread(spark):
    n = 1_000_000
    price = (100 + (F.col("id") * 37 % 1013) / 50 + F.sin(F.col("id") / 9000) * 20).alias("close")
    df = spark.range(n).select(F.lit("hot").alias("ticker"), F.col("id").alias("day"), price)
    got = recurrence.over(df, ["ticker"], ["day"], "close", [recurrence.rsi(14), recurrence.macd()]).withColumn("task", F.spark_partition_id())
    held = got.groupBy("task").count().collect()
    assert len(held) >= 6 and max(r["count"] for r in held) < n / 4
    rows = got.where("day % 9973 = 0 OR day = 999999").select("day", "rsi", "dif", "dea", "hist").collect()
    values = [r.close for r in df.orderBy("day").select("close").collect()]
    for what in (recurrence.rsi(14), recurrence.macd()):
        want = by_hand(values, what)
        assert all(close(r[c], w) for r in rows for c, w in zip(what.read, want[r.day]))


def test_known_values(spark):
    def last(values, what):
        df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "k int, i int, v double")
        row = recurrence.latest(recurrence.over(df, ["k"], ["i"], "v", [what]), ["k"], ["i"]).first()
        return tuple(row[c] for c in what.read)

    assert last(range(20), recurrence.rsi()) == (100.0,)
    assert last(range(20, 0, -1), recurrence.rsi()) == (0.0,)
    assert last([5] * 15, recurrence.rsi()) == (100.0,)
    assert last([5] * 14, recurrence.rsi()) == (None,)
    assert last([2, 4, 8], recurrence.ema(3)) == (5.5,)
    assert last([1] * 34, recurrence.macd()) == (None,) * 3
    assert last([1] * 35, recurrence.macd()) == (0.0,) * 3
