"""Messages: what articles, alerts and scans look like to a reader, and how channels format them."""

from __future__ import annotations

import base64
import hashlib
import hmac

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.market import arrow

#: Colours and labels; fixed values.
SENTIMENT_COLOURS = {"bullish": "green", "bearish": "red", "neutral": "gray"}
CARD_COLOURS = {"red": "red", "green": "green", "yellow": "yellow", "blue": "blue", "gray": "grey"}
QUIET = "无异动"


def badge(text: Column, colour: Column | str) -> Column:
    return F.struct(text.alias("text"), (F.lit(colour) if isinstance(colour, str) else colour).alias("color"))


def badges(*parts: Column) -> Column:
    """Badge arrays joined, and badges that are null left out."""
    return F.filter(F.concat(*parts), lambda b: b["text"].isNotNull())


def some(items: Column, n: int, colour: str, prefix: str = "") -> Column:
    """The first n of an array as badges."""
    return F.transform(F.slice(items, 1, n), lambda x: badge(F.concat(F.lit(prefix), x), colour))


def links(url: Column, tickers: Column, market: Column) -> Column:
    """The original, then three tickers' pages at most."""
    one = lambda label, to: F.struct(label.alias("label"), to.alias("url"))

    def page(t: Column) -> Column:
        side = F.when(t.startswith("6"), "sh").otherwise("sz")
        return F.when(market == "us", one(F.concat(F.lit("Yahoo "), t), F.concat(F.lit("https://finance.yahoo.com/quote/"), t))).otherwise(one(F.concat(F.lit("东财 "), t), F.concat(F.lit("https://quote.eastmoney.com/"), side, t, F.lit(".html"))))

    return F.concat(F.array(one(F.lit("原文"), url)), F.transform(F.slice(tickers, 1, 3), page))


def from_rules(df: DataFrame) -> DataFrame:
    """Articles with a verdict (no model): the badges come from the verdict, the summary is the start of the body."""
    tickers = F.concat("tickers", "related_tickers")
    first = lambda c, mark, colour: F.array(badge(F.concat(F.lit(mark), F.get(c, F.lit(0))), colour))
    body = F.rtrim(F.substring(F.coalesce("body", F.lit("")), 1, 200))
    return df.select(
        "id", "title", F.coalesce(F.nullif(body, F.lit("")), F.col("title")).alias("summary"), F.col("source").alias("source_label"), "url", "market",
        badges(some(tickers, 5, "blue"), some(F.col("sectors"), 2, "gray", "#"), first("macros", "📊 ", "yellow"), first("generic_hits", "🔖 ", "gray"), F.array(badge(F.lit("rules"), "green"))).alias("badges"),
        links(F.col("url"), tickers, F.col("market")).alias("deeplinks"),
    )


def from_model(df: DataFrame) -> DataFrame:
    """Articles that a model enriched: tickers, sectors, sentiment and magnitude as badges."""
    colour = F.element_at(F.create_map(*[F.lit(x) for p in SENTIMENT_COLOURS.items() for x in p]), F.col("sentiment"))
    return df.select(
        "id", "title", "summary", F.col("source").alias("source_label"), "url", "market",
        badges(some(F.col("related_tickers"), 5, "blue"), some(F.col("sectors"), 2, "gray", "#"), F.array(badge(F.col("sentiment"), colour), badge(F.col("magnitude"), "yellow"))).alias("badges"),
        links(F.col("url"), F.col("related_tickers"), F.col("market")).alias("deeplinks"),
    )


def fixed(x: Column | str, places: int, sign: str = "") -> Column:
    """A number with so many places, ties to even."""
    return F.format_string(f"%{sign}.{places}f", F.bround(x, places))


def signed(x: Column) -> Column:
    return fixed(x, 2, "+")


def alerts(df: DataFrame) -> DataFrame:
    """One message for each hit of (ticker, name, rule_id, expr, price, pct_change, volume, volume_ratio, at)."""
    pct = F.col("pct_change")
    ratio = F.when(F.coalesce("volume_ratio", F.lit(0.0)) != 0, F.concat(F.lit("量比: "), fixed("volume_ratio", 2)))
    lines = [
        F.concat(F.lit("⚡ 触发: "), "rule_id", F.lit("("), "expr", F.lit(")")),
        F.concat(F.lit("当前价: "), fixed("price", 2), F.lit("  ("), signed(pct), F.lit("%)")),
        F.concat(F.lit("今日量: "), fixed(F.col("volume") / 10000, 1), F.lit("万手")),
        ratio,
        F.concat(F.lit("⏱ "), F.date_format("at", "HH:mm:ss")),
    ]
    return df.select("*", F.concat(arrow(pct), F.lit(" "), "name", F.lit(" ("), "ticker", F.lit(") "), "rule_id").alias("title"), F.concat_ws("\n", *lines).alias("summary"), F.array(badge(F.concat(F.lit("#"), "ticker"), "blue"), badge(F.lit("alert"), F.when(pct < 0, "red").otherwise("green"))).alias("badges"))


def bursts(df: DataFrame) -> DataFrame:
    """One message for each snapshot (ticker, name, price, pct_change, at) with several hits (rule_id, kind_order, expr): a
    line for each rule, in order, then the price."""
    keys = ["ticker", "name", "price", "pct_change", "at"]
    rules = F.transform(F.array_sort(F.collect_list(F.struct("kind_order", "rule_id", "expr"))), lambda x: F.concat(F.lit("✓ "), x["rule_id"], F.lit(": "), x["expr"]))
    m = df.groupBy(*keys).agg(rules.alias("rules")).where(F.size("rules") > 1)
    pct, n = F.col("pct_change"), F.size("rules").cast("string")
    tail = [F.concat(F.lit("当前价: "), fixed("price", 2), F.lit("  ("), signed(pct), F.lit("%)")), F.concat(F.lit("⏱ "), F.date_format("at", "HH:mm:ss"))]
    marks = F.array(badge(F.concat(F.lit("#"), "ticker"), "blue"), badge(F.concat(F.lit("多规则x"), n), "yellow"), badge(F.lit("alert"), F.when(pct < 0, "red").otherwise("green")))
    title = F.concat(arrow(pct), F.lit(" "), "name", F.lit(" ("), "ticker", F.lit(") 多规则触发(x"), n, F.lit(")"))
    return m.select(*keys, title.alias("title"), F.concat_ws("\n", F.array_join("rules", "\n"), *tail).alias("summary"), marks.alias("badges"), F.lit("alert_burst").alias("kind"))


def scan_digest(ranked: DataFrame) -> DataFrame:
    """One message of a ranked scan (category, rank, ticker, name, pct_change, volume_ratio): its sections, in order."""
    line = F.when(F.col("category") == "volume_ratio", F.concat(F.lit("- "), "name", F.lit(" ("), "ticker", F.lit(") 量比 "), fixed(F.coalesce("volume_ratio", F.lit(0.0)), 2)))
    line = line.otherwise(F.concat(F.col("rank").cast("string"), F.lit(". "), F.col("name"), F.lit(" ("), F.col("ticker"), F.lit(")  "), signed(F.col("pct_change")), F.lit("%")))
    rows = ranked.withColumn("line", line).groupBy("category").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "line"))), lambda x: x["line"]).alias("lines"))
    head = {"gainers": (1, "🚀 涨幅"), "losers": (2, "📉 跌幅"), "volume_ratio": (3, "📈 量比异动")}
    order = F.element_at(F.create_map(*[F.lit(x) for k, (o, _) in head.items() for x in (k, o)]), F.col("category"))
    label = F.element_at(F.create_map(*[F.lit(x) for k, (_, t) in head.items() for x in (k, t)]), F.col("category"))
    section = F.concat(label, F.lit(" top "), F.size("lines").cast("string"), F.lit(":\n"), F.array_join("lines", "\n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), section.alias("s")))), lambda x: x["s"]), "\n\n")
    return rows.agg(text.alias("t")).select(F.when(F.col("t") == "", QUIET).otherwise(F.col("t")).alias("summary"))


def markdown(messages: DataFrame) -> DataFrame:
    """The text that a markdown channel shows."""
    marks = F.array_join(F.transform("badges", lambda b: F.concat(F.lit("`"), b["text"], F.lit("`"))), " ")
    to = F.array_join(F.transform("deeplinks", lambda d: F.concat(F.lit("["), d["label"], F.lit("]("), d["url"], F.lit(")"))), " | ")
    return messages.withColumn("content", F.concat(F.lit("**"), "title", F.lit("**\n> "), "source_label", F.lit("\n\n"), "summary", F.lit("\n\n"), marks, F.lit("\n\n"), to))


def card(messages: DataFrame) -> DataFrame:
    """The JSON of an interactive card: the first badge gives its colour, the title has 128 characters at most."""
    marks = F.array_join(F.transform("badges", lambda b: F.concat(F.lit("`"), b["text"], F.lit("`"))), " ")
    to = F.array_join(F.transform("deeplinks", lambda d: F.concat(F.lit("["), d["label"], F.lit("]("), d["url"], F.lit(")"))), " | ")
    body = F.concat(F.lit("**"), "summary", F.lit("**\n\n"), marks, F.lit("\n\n"), to)
    colour = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in CARD_COLOURS.items() for x in p]), F.coalesce(F.get("badges", F.lit(0))["color"], F.lit("gray"))), F.lit("grey"))
    text = lambda tag, c: F.struct(F.lit(tag).alias("tag"), c.alias("content"))
    header = F.struct(text("plain_text", F.substring("title", 1, 128)).alias("title"), colour.alias("template"))
    elements = F.array(F.struct(F.lit("div").alias("tag"), text("lark_md", body).alias("text")))
    return messages.withColumn("card", F.to_json(F.struct(F.lit("interactive").alias("msg_type"), F.struct(header.alias("header"), elements.alias("elements")).alias("card"))))


def signature(timestamp: str, secret: str) -> str:
    """What a card's channel checks: HMAC-SHA256 of nothing, keyed by time and secret. One a request, on the sender's side."""
    return base64.b64encode(hmac.new(f"{timestamp}\n{secret}".encode(), digestmod=hashlib.sha256).digest()).decode()


def fan_out(messages: DataFrame, channels: DataFrame, known: list[str]) -> DataFrame:
    """Each message once for each channel of its market that is known; others are dropped."""
    return messages.join(channels.where(F.col("channel").isin(*known)), "market")


def markers(bars: DataFrame, news: DataFrame) -> DataFrame:
    """Bars with the titles of the day's news and where to mark them, just above the high; null on other days."""
    day = news.groupBy("ticker", F.to_date("published_at").alias("trade_date")).agg(F.array_sort(F.collect_list("title")).alias("titles"))
    joined = bars.join(day, ["ticker", "trade_date"], "left")
    return joined.withColumn("mark_at", F.when(F.col("titles").isNotNull(), F.col("high") * 1.02))


def resolved(relations: Column, entities: Column) -> Column:
    """Relations with subject and object replaced by the entities of these names; the last of equal names counts, and
    relations that name an unknown one are dropped."""
    find = lambda name: F.try_element_at(F.filter(entities, lambda e: e["name"] == name), F.lit(-1))
    full = F.transform(relations, lambda r: F.struct(find(r["subject"]).alias("subject"), r["predicate"].alias("predicate"), find(r["object"]).alias("object")))
    return F.filter(full, lambda r: r["subject"].isNotNull() & r["object"].isNotNull())


def violations(tickers: DataFrame, keywords: DataFrame, holdings: DataFrame) -> DataFrame:
    """check, item: what is wrong in a configuration of tickers (market, ticker, sectors), sector keywords (market, keyword)
    and holdings (ticker, qty, cost_per_share)."""
    twice = lambda df, keys, name: df.groupBy(*keys).count().where("count > 1").select(F.lit(name).alias("check"), F.concat_ws(":", *keys).alias("item"))
    used = tickers.select("market", F.explode("sectors").alias("keyword"))
    unknown = used.join(keywords, ["market", "keyword"], "left_anti").select(F.lit("unknown sector").alias("check"), F.concat_ws(":", "market", "keyword").alias("item")).distinct()
    bad = holdings.where(~((F.col("qty") > 0) & (F.col("cost_per_share") > 0))).select(F.lit("bad holding").alias("check"), F.col("ticker").alias("item"))
    return twice(tickers, ["market", "ticker"], "ticker twice").unionByName(twice(holdings, ["ticker"], "holding twice")).unionByName(unknown).unionByName(bad)


def newest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """An upsert's outcome: the last row of each key."""
    w = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
