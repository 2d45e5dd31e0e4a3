import random
import time

import pytest
from pyspark.sql import functions as F

from tickloom.operators import asof, dedup
from tickloom.sources import articles as src


def hourly(spark, n, minutes=60):
    at = src.minutes_after("2024-01-01 00:00:00", (F.col("id") * minutes).cast("int"))
    return spark.range(n).select("id", F.lit(7).cast("long").alias("simhash"), F.col("id").cast("string").alias("url_hash"), at.alias("fetched_at"))


def jobs(spark):
    return spark._jsc.sc().dagScheduler().numTotalJobs()


def test_jobs_do_not_grow_with_a_chain(spark):
    used = []
    for days in (20, 365):
        before = jobs(spark)
        got = {r.id: (r.decision, r.duplicate_of) for r in dedup.check_and_register(hourly(spark, 24 * days)).collect()}
        used.append(jobs(spark) - before)
        anchor = 0
        for i in range(24 * days):
            if i - anchor > 24:
                anchor = i
            assert got[i] == (("new", None) if i == anchor else ("simhash", anchor))
    # the days are linked in rounds whose number grows with the logarithm of theirs
    assert used[1] <= used[0] + 60, used


def test_equal_titles_cost_linear_time(spark):
    dedup.near_pairs(hourly(spark, 1000, 0)).count()
    took = []
    for n in (40_000, 160_000):
        began = time.perf_counter()
        assert dedup.near_pairs(hourly(spark, n, 0)).count() == n - 1
        took.append(time.perf_counter() - began)
    # sixteen times with a quadratic cost
    assert took[1] < 5 * took[0] + 2, took


def test_register_with_null_urls_ties_and_no_rows(spark):
    rows = [(3, None, 5, 0), (1, None, 5, 0), (2, "u", 1 << 60, 0), (4, "u", 99, 100_000), (5, None, 7, 10), (6, "v", -1, 0), (7, "v", -1, 1)]
    df = spark.createDataFrame(rows, "id long, url_hash string, simhash long, m int").select("id", "url_hash", "simhash", src.minutes_after("2024-01-01 00:00:00", F.col("m")).alias("fetched_at"))
    got = {r.id: (r.decision, r.duplicate_of) for r in dedup.check_and_register(df).collect()}
    assert got == {1: ("new", None), 3: ("simhash", 1), 2: ("simhash", 1), 4: ("new", None), 5: ("simhash", 1), 6: ("new", None), 7: ("url_hash", 6)}
    assert dedup.check_and_register(df.where(F.lit(False))).count() == 0 and dedup.near_pairs(df.where(F.lit(False))).count() == 0


@pytest.mark.parametrize("inclusive", [True, False])
@pytest.mark.parametrize("span", [1, 7, 1000])
def test_asof_by_brute_force(spark, inclusive, span):
    rnd = random.Random(span)
    left = [(i, rnd.choice(["a", "b", None, "z"]), rnd.randrange(-60, 60) if rnd.random() < 0.95 else None) for i in range(300)]
    right = [(i, rnd.choice(["a", "b", None]), rnd.randrange(-60, 60) if rnd.random() < 0.95 else None) for i in range(80)]
    a, b = spark.createDataFrame(left, "id int, k string, t long"), spark.createDataFrame(right, "id int, k string, t long")
    got = {r._row.id: r._found and r._found.id for r in asof.joined(a, b, ["k"], F.col("t"), F.col("t"), F.struct("id"), F.col("id"), span, inclusive).collect()}
    assert len(got) == 300
    for i, k, t in left:
        fits = [(u, j) for j, m, u in right if m == k and u is not None and t is not None and (u < t or inclusive and u == t)]
        assert got[i] == (max(fits)[1] if fits else None)


def test_a_hot_ticker_is_spread(spark):
    n = 200_000
    ticks = spark.range(n).select(F.lit("hot").alias("k"), F.col("id"), src.minutes_after("2024-01-01 00:00:00", F.col("id").cast("int")).alias("ts"))
    bars = spark.range(140).select(F.lit("hot").alias("k"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("day"), F.col("id").alias("close"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = asof.prior(ticks.withColumn("d", F.to_date("ts")), bars, "k", "d", "day", ["close"]).withColumn("task", F.spark_partition_id()).select("id", "close", "task").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.task for r in got}) >= 6 and len(got) == n
    assert all(r.close == (r.id // 1440 - 1 if r.id >= 1440 else None) for r in got)
