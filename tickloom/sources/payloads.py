"""What each source sends, as articles: source, market, url, title, body, published_at.

A payload is a column of a table of fetched responses (one row for a request), so any number of responses is normalised
in one pass. Rows older than a scan's mark are dropped by ``articles.since`` on published_at."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .articles import json_items, shanghai_to_utc, wire

#: Where links of sources without full ones begin; fixed values.
FILINGS = "http://static.cninfo.com.cn/"
TIMELINE = "https://xueqiu.com"
TRANSCRIPT = "https://tv.cctv.com/lm/xwlb/day/"
TELEGRAPH = "https://www.cls.cn/telegraph/"
NOTES = "https://tushare.local/"
#: The time of day that all segments of a transcript have, in Shanghai; fixed value.
TRANSCRIPT_TIME = "19:30:00"
COLUMNS = ("source", "market", "url", "title", "body", "published_at")


def text(c: Column | str) -> Column:
    """Trimmed text, null if blank."""
    return F.nullif(F.trim(F.col(c) if isinstance(c, str) else c), F.lit(""))


def articles(df: DataFrame, source: str, market: str, url: Column, title: Column, body: Column, at: Column) -> DataFrame:
    """Rows with a url, a title and a time as articles."""
    out = df.select(F.lit(source).alias("source"), F.lit(market).alias("market"), url.alias("url"), title.alias("title"), body.cast("string").alias("body"), at.alias("published_at"))
    return out.where(F.col("url").isNotNull() & F.col("title").isNotNull() & F.col("published_at").isNotNull())


def seconds(c: str, unit: int = 1) -> Column:
    return F.timestamp_millis(F.col(c) * (1000 // unit))


def finnhub(df: DataFrame, payload: str) -> DataFrame:
    """An array of items with epoch seconds."""
    rows = json_items(df, payload, "struct<datetime: bigint, headline: string, summary: string, url: string, id: bigint>")
    return articles(rows, "finnhub", "us", F.col("url"), F.col("headline"), F.col("summary"), seconds("datetime"))


def wallstreet(df: DataFrame, payload: str, status: str | None = None) -> DataFrame:
    """data.items; responses with an error status have none, and blank titles and links go."""
    rows = df.where(F.col(status) < 400) if status else df
    item = "struct<display_time: bigint, title: string, uri: string, content_short: string>"
    rows = rows.select(F.inline(F.from_json(payload, f"data struct<items: array<{item}>>")["data"]["items"])).where("coalesce(display_time, 0) <> 0")
    return articles(rows, "wallstreetcn", "us", text("uri"), text("title"), text("content_short"), seconds("display_time"))


def yahoo(df: DataFrame, payload: str) -> DataFrame:
    """A ticker's items; they have no body."""
    rows = json_items(df, payload, "struct<providerPublishTime: bigint, title: string, link: string, publisher: string>")
    return articles(rows, "yfinance_news", "us", F.col("link"), F.col("title"), F.lit(None), seconds("providerPublishTime"))


def ticker_wire(df: DataFrame) -> DataFrame:
    """Rows of a ticker's news, whose columns have one of two names each; titles may be empty."""
    has = lambda *names: F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names if n in df.columns], F.lit(None))
    return articles(df, "akshare_news", "cn", has("链接", "文章链接"), F.coalesce(has("标题", "新闻标题"), F.lit("")), has("内容", "新闻内容"), shanghai_to_utc(F.col("发布时间")))


def telegraph(df: DataFrame) -> DataFrame:
    """Date and time in columns of their own; the url is made of the time and the shown title."""
    at = shanghai_to_utc(F.concat_ws(" ", F.date_format("发布日期", "yyyy-MM-dd"), F.col("发布时间")))
    rows = df.where(F.col("发布日期").isNotNull() & F.col("发布时间").isNotNull()).select(at.alias("at"), text("标题").alias("head"), text("内容").alias("body"))
    title = F.coalesce("head", F.substring("body", 1, 80))
    url = F.concat(F.lit(TELEGRAPH), F.date_format("at", "yyyyMMdd'T'HHmmss"), F.lit("/"), F.substring(F.sha1(title.cast("binary")), 1, 12))
    return articles(rows, "caixin_telegram", "cn", url, title, F.col("body"), F.col("at"))


def transcript(df: DataFrame, day: str, index: str) -> DataFrame:
    """Segments (title, content) of a day's broadcast; the url tells the segment by its index. Blank titles go."""
    date = F.date_format(day, "yyyyMMdd")
    url = F.concat(F.lit(TRANSCRIPT), date, F.lit(".shtml#seg"), F.col(index).cast("string"))
    at = shanghai_to_utc(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(" " + TRANSCRIPT_TIME)))
    return articles(df, "cctv_news", "cn", url, text("title"), text("content"), at)


def filings(df: DataFrame, payload: str) -> DataFrame:
    """announcements, which may be null; the title begins with the company's name."""
    item = "struct<announcementTime: bigint, secName: string, announcementTitle: string, adjunctUrl: string>"
    rows = df.select(F.inline(F.from_json(payload, f"announcements array<{item}>")["announcements"]))
    return articles(rows, "juchao", "cn", F.concat(F.lit(FILINGS), "adjunctUrl"), F.concat("secName", F.lit(" "), "announcementTitle"), F.lit(None), seconds("announcementTime", 1000))


def rss(df: DataFrame, payload: str) -> DataFrame:
    """Items of RSS feeds: summaries without tags, 1000 characters at most."""
    item = F.explode(F.from_xml(payload, "channel struct<item: array<struct<title: string, link: string, description: string, pubDate: string>>>")["channel"]["item"]).alias("i")
    rows = df.select(item).select("i.*")
    body = F.nullif(F.substring(F.trim(F.regexp_replace("description", "<[^>]+>", "")), 1, 1000), F.lit(""))
    at = F.try_to_timestamp(F.regexp_replace("pubDate", "^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return articles(rows, "kr36", "cn", text("link"), text("title"), body, at)


def sina(df: DataFrame) -> DataFrame:
    """Time and text only: the title is the text's start, the url the time and the text's hash."""
    rows = df.select(shanghai_to_utc(F.col("时间")).alias("at"), text("内容").alias("body"))
    url = F.concat(F.lit("https://finance.sina.com.cn/7x24/"), F.date_format("at", "yyyyMMdd'T'HHmmss"), F.lit("/"), F.substring(F.sha1(F.col("body").cast("binary")), 1, 12))
    return articles(rows, "sina_global", "cn", url, F.substring("body", 1, 80), F.col("body"), F.col("at"))


def notes(df: DataFrame, channel: str = "sina") -> DataFrame:
    """datetime, title, content; without a title the content's first 60 characters, and the url hashes both."""
    url = F.concat(F.lit(f"{NOTES}{channel}/"), F.substring(F.sha1(F.concat("datetime", "content").cast("binary")), 1, 16))
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.substring("content", 1, 60))
    return articles(df, "tushare_news", "cn", url, title, F.col("content"), shanghai_to_utc(F.col("datetime")))


def blocked(status: Column, kind: Column, payload: Column) -> Column:
    """Whether a timeline's response is a refusal: a status, another content type than JSON, or an error code."""
    code = F.get_json_object(payload, "$.error_code").cast("bigint")
    return status.isin(401, 403) | ~F.coalesce(kind, F.lit("")).contains("application/json") | (F.coalesce(code, F.lit(0)) != 0)


def symbol(ticker: Column) -> Column:
    """A ticker with its exchange before it, as the timeline names it."""
    return F.when(ticker.startswith("6"), F.concat(F.lit("SH"), ticker)).when(ticker.rlike("^[03]"), F.concat(F.lit("SZ"), ticker)).otherwise(ticker)


def timeline(df: DataFrame, payload: str, status: str, kind: str) -> DataFrame:
    """The list of responses that aren't refusals; without a title the description's first 80 characters."""
    fine = df.where(~blocked(F.col(status), F.col(kind), F.col(payload)))
    rows = fine.select(F.inline(F.from_json(payload, "list array<struct<created_at: bigint, target: string, title: string, description: string>>")["list"]))
    title = F.coalesce(F.nullif(F.col("title"), F.lit("")), F.substring("description", 1, 80))
    return articles(rows, "xueqiu", "cn", F.concat(F.lit(TIMELINE), "target"), title, F.col("description"), seconds("created_at", 1000))


#: The wires that share a layout: source, body column, market; fixed values.
WIRES = (("futu_global", "内容", "us"), ("cjzc_em", "摘要", "cn"), ("eastmoney_global", "摘要", "cn"), ("ths_global", "内容", "cn"))


def shared_wire(name: str) -> Callable[[DataFrame], DataFrame]:
    source, body, market = next(w for w in WIRES if w[0] == name)
    return lambda df: wire(df, "标题", body, "发布时间", "链接", source, market)


def union(fetched: dict[str, DataFrame], readers: dict[str, Callable[[DataFrame], DataFrame]], enabled: set[str], needs: dict[str, bool] | None = None) -> DataFrame | None:
    """The articles of all sources that are enabled, fetched, and have what they need (tickers, secrets); null if none is."""
    ready = [n for n in readers if n in enabled and n in fetched and (needs or {}).get(n, True)]
    parts = [readers[n](fetched[n]).select(*COLUMNS) for n in ready]
    return reduce(DataFrame.unionByName, parts) if parts else None
