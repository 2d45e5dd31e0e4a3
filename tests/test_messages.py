import json

from pyspark.sql import functions as F

from tickloom.operators import messages
from tickloom.sources import articles as src


def test_cards_and_markdown(spark):
    schema = "id long, title string, summary string, source string, url string, market string, related_tickers array<string>, sectors array<string>, sentiment string, magnitude string"
    df = spark.createDataFrame([(1, "t" * 200, "s", "wire", "http://u", "cn", ["600519", "000001", "A", "B", "C", "D"], ["x", "y", "z"], "bearish", "high")], schema)
    m = messages.card(messages.markdown(messages.from_model(df))).first()
    assert [b.text for b in m.badges] == ["600519", "000001", "A", "B", "C", "#x", "#y", "bearish", "high"] and m.badges[7].color == "red"
    assert [d.url for d in m.deeplinks] == ["http://u", "https://quote.eastmoney.com/sh600519.html", "https://quote.eastmoney.com/sz000001.html", "https://quote.eastmoney.com/szA.html"]
    card = json.loads(m.card)["card"]
    assert card["header"] == {"title": {"tag": "plain_text", "content": "t" * 128}, "template": "blue"} and card["elements"][0]["text"]["content"].startswith("**s**\n\n`600519`")
    assert m.content.startswith("**" + "t" * 200 + "**\n> wire\n\ns\n\n`600519`")


def test_empty_scan(spark):
    ranked = spark.createDataFrame([], "category string, rank int, ticker string, name string, pct_change double, volume_ratio double")
    assert messages.scan_digest(ranked).first().summary == messages.QUIET
    rows = [("losers", 1, "b", "B", -9.0, None), ("gainers", 2, "c", "C", 8.125, 1.0), ("gainers", 1, "a", "A", 9.0, None), ("volume_ratio", 1, "a", "A", 9.0, 8.0)]
    text = messages.scan_digest(spark.createDataFrame(rows, ranked.schema)).first().summary
    assert text == "🚀 涨幅 top 2:\n1. A (a)  +9.00%\n2. C (c)  +8.12%\n\n📉 跌幅 top 1:\n1. B (b)  -9.00%\n\n📈 量比异动 top 1:\n- A (a) 量比 8.00"


def test_relations_name_entities(spark):
    df = spark.createDataFrame([([("NVIDIA", 1), ("TSMC", 2), ("TSMC", 3)], [("NVIDIA", "supplies", "TSMC"), ("NVIDIA", "owns", "Nobody")])], "e array<struct<name: string, n: int>>, r array<struct<subject: string, predicate: string, object: string>>")
    got = df.select(messages.resolved(F.col("r"), F.col("e")).alias("x")).first().x
    assert [(r.subject.n, r.predicate, r.object.n) for r in got] == [(1, "supplies", 3)]


def test_feeds_and_pages(spark):
    atom = '<feed><entry><title>8-K</title><updated>2024-01-02T10:00:00Z</updated><summary>s</summary><id>1</id><link href="http://x/1"/></entry><entry><title>10-Q</title><updated>2024-01-03T10:00:00Z</updated><id>2</id><link href="http://x/2"/></entry></feed>'
    rows = src.atom_entries(spark.createDataFrame([("0001", atom)], "cik string, xml string"), "xml", "cik").orderBy("url").collect()
    assert [(r.cik, r.title, r.url, r.body, str(r.published_at)) for r in rows] == [("0001", "8-K", "http://x/1", "s", "2024-01-02 10:00:00"), ("0001", "10-Q", "http://x/2", None, "2024-01-03 10:00:00")]
    html = '<a class="news-link" data-time="60" href="/n/1"><span class="news-title"> One </span></a><a class="x" href="/n/2">no</a><a data-time="" class="news-link" href="/n/3"><b class="news-title">Three</b></a><a class="news-link" href="http://h/4" data-time="120"><i class="news-title">Four</i></a>'
    got = src.page_links(spark.createDataFrame([(html,)], "h string"), "h", "https://base").collect()
    assert [(r.title, r.url) for r in got] == [("One", "https://base/n/1"), ("Four", "http://h/4")]
    blocked = spark.createDataFrame([(200, "ok"), (403, "ok"), (200, " "), (200, "captcha"), (200, None)], "s int, h string").select(src.page_blocked(F.col("s"), F.col("h")).alias("x")).collect()
    assert [r.x for r in blocked] == [False, True, True, True, True]


def test_violations(spark):
    tickers = spark.createDataFrame([("us", "A", ["x"]), ("us", "A", ["y"]), ("cn", "A", ["x"])], "market string, ticker string, sectors array<string>")
    keywords = spark.createDataFrame([("us", "x"), ("us", "y")], "market string, keyword string")
    holdings = spark.createDataFrame([("A", 1, 1.0), ("A", 2, 1.0), ("B", 0, 1.0)], "ticker string, qty int, cost_per_share double")
    got = {tuple(r) for r in messages.violations(tickers, keywords, holdings).collect()}
    assert got == {("ticker twice", "us:A"), ("holding twice", "A"), ("unknown sector", "cn:x"), ("bad holding", "B")}


def test_signature():
    # printf '' | openssl dgst -sha256 -hmac "$(printf '1599360473\nsecret')" -binary | base64
    assert messages.signature("1599360473", "secret") == "q4jswNiMy51J5JuQV566yJat0/lQ/c+22kINzUgKsGU="
    assert messages.signature("1", "s") != messages.signature("2", "s")
