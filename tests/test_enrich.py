from pyspark.sql import functions as F

from tickloom.operators import enrich


def test_extraction_with_a_stub(spark):
    def stub(prompts):
        if any("boom" in p for p in prompts):
            raise RuntimeError("down")
        return [f'sure: {{"summary": "{p}", "event_type": "EARNINGS", "sentiment": "so-so", "related_tickers": ["A"]}}' if "bad" not in p else "no" for p in prompts]

    df = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "boom")], "id long, title string").repartition(3)
    got = {r.id: r for r in enrich.extracted(enrich.asked(df, F.concat(F.lit("p "), "title"), stub, batch=1)).collect()}
    assert (got[1].summary, got[1].event_type, got[1].sentiment, got[1].magnitude, got[1].confidence, got[1].related_tickers, got[1].sectors, got[1].dead) == ("p good", "earnings", "neutral", "low", 0.5, ["A"], [], False)
    assert got[2].dead and got[3].dead and got[3].answer is None and got[3].failure == "RuntimeError: down" and got[1].failure is None


def test_lenient(spark):
    df = spark.createDataFrame([("US",), ("xx",), (None,)], "v string").select(enrich.lenient(F.col("v"), "market").alias("m"), enrich.lenient(F.col("v"), "predicate").alias("p"))
    assert [tuple(r) for r in df.collect()] == [("us", "mentions"), (None, "mentions"), (None, "mentions")]


def test_costs_and_agreement(spark):
    calls = spark.createDataFrame([("m", "2024-01-01 01:00:00", 1000, 500), ("m", "2024-01-01 02:00:00", 1000, 500), ("x", "2024-01-02 02:00:00", 10, 5)], "model string, at string, tokens_in long, tokens_out long")
    prices = spark.createDataFrame([("m", 0.25, 0.5)], "model string, price_in double, price_out double")
    rows = enrich.costs(calls, prices, 1.25).orderBy("day").collect()
    assert [(r.cost, r.remaining, r.reached, r.warned) for r in rows] == [(1.0, 0.25, False, True), (0.0, 1.25, False, False)]
    got = spark.createDataFrame([(1, "a", None), (2, "b", "y")], "id long, e string, s string")
    r = enrich.agreement(got, spark.createDataFrame([(1, "a", None), (2, "c", "y")], "id long, e string, s string"), ["e", "s"]).first()
    assert (r.n, r.e, r.s, r["mean"]) == (2, 0.5, 1.0, 0.75)
