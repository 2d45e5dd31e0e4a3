"""Articles and market series from the stored tables, and the normalisers that source payloads share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of an article.
ARTICLE = ("id", "source", "market", "url", "title", "body", "fetched_at")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def minutes_after(start: str, n: Column) -> Column:
    """A timestamp without zone, so many minutes after a fixed one."""
    return F.lit(start).cast("timestamp_ntz") + F.make_dt_interval(mins=n)


def articles(docs: DataFrame) -> DataFrame:
    """Documents as articles: the first line, 80 characters at most, is the title."""
    return docs.select(
        F.col("doc_id").alias("id"),
        "source",
        F.when(F.col("lang") == "en", "us").otherwise("cn").alias("market"),
        F.concat(F.lit("https://doc/"), F.col("doc_id")).alias("url"),
        F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"),
        F.col("text").alias("body"),
        minutes_after("2024-01-01 00:00:00", F.col("doc_id").cast("int")).alias("fetched_at"),
    )


def since(df: DataFrame, at: str, column: str = "fetched_at") -> DataFrame:
    """Rows from a time on, that time included; pushed down to the scan where the column is stored."""
    return df.where(F.col(column) >= F.lit(at).cast(df.schema[column].dataType))


def shanghai_to_utc(text: Column) -> Column:
    """A local time of Shanghai, as text, in UTC; null for blank or malformed text."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.nullif(F.trim(text), F.lit(""))), "Asia/Shanghai")


def wire(df: DataFrame, title: str, body: str, published: str, link: str, source: str, market: str) -> DataFrame:
    """A wire's rows as articles: blank times are skipped, a missing title is the body's first 80 characters, and rows
    without a link or title are dropped."""
    text = F.trim(F.coalesce(F.col(body), F.lit("")))
    head = F.coalesce(F.nullif(F.trim(F.col(title)), F.lit("")), F.nullif(F.substring(text, 1, 80), F.lit("")))
    out = df.select(F.lit(source).alias("source"), F.lit(market).alias("market"), F.nullif(F.trim(F.col(link)), F.lit("")).alias("url"), head.alias("title"), F.nullif(text, F.lit("")).alias("body"), shanghai_to_utc(F.col(published)).alias("published_at"))
    return out.where(F.col("published_at").isNotNull() & F.col("url").isNotNull() & F.col("title").isNotNull())


def json_items(df: DataFrame, column: str, schema: str) -> DataFrame:
    """The items of a JSON array of objects, one row each; malformed payloads have none."""
    return df.select(F.inline(F.from_json(column, f"array<{schema}>")))


def synthetic_url(prefix: str, at: Column, text: Column, size: int = 12) -> Column:
    """A url for items that have none: the time, and the first characters of the text's SHA-1."""
    return F.concat(F.lit(prefix), F.date_format(at, "yyyyMMddHHmmss"), F.lit("-"), F.substring(F.sha1(text), 1, size))


def exchange(code: Column) -> Column:
    """The exchange of a six-digit code by its first digits."""
    return F.when(code.rlike("^(60|68)"), "SH").when(code.rlike("^(00|30)"), "SZ").when(code.rlike("^[849]"), "BJ").otherwise("SH")


def quote_lines(text: Column) -> Column:
    """The quotes in a response as an array of payloads: exchange and code, then the comma-separated fields."""
    return F.regexp_extract_all(text, F.lit(r'var hq_str_((?:sh|sz|bj)\d{6}="[^"]*)"'), F.lit(1))


def quotes(df: DataFrame, column: str) -> DataFrame:
    """One row for each well-formed quote of a response; short payloads and bad numbers are dropped."""
    rows = df.select(F.explode(quote_lines(F.col(column))).alias("line"))
    head = F.substring_index("line", '="', 1)
    rows = rows.select(F.upper(F.substring(head, 1, 2)).alias("market"), F.substring(head, 3, 6).alias("ticker"), F.split(F.substring_index("line", '="', -1), ",").alias("f")).where(F.size("f") >= 32)
    number = lambda i, kind="double": F.col("f")[i].try_cast(kind)
    fields = {"open": number(1), "prev_close": number(2), "price": number(3), "high": number(4), "low": number(5), "bid1": number(6), "ask1": number(7), "volume": number(8, "bigint"), "amount": number(9)}
    out = rows.select("ticker", "market", F.col("f")[0].alias("name"), *[c.alias(n) for n, c in fields.items()], F.concat_ws(" ", F.col("f")[30], F.col("f")[31]).alias("at"))
    return out.dropna(subset=list(fields))


def cookies(text: Column) -> Column:
    """``k=v; k2=v2`` as a map; parts without a name or ``=`` are skipped, the last of equal names wins."""
    parts = F.filter(F.split(text, ";"), lambda p: p.contains("=") & (F.trim(F.substring_index(p, "=", 1)) != ""))
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("k"), F.trim(F.substr(p, F.instr(p, "=") + 1)).alias("v")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["k"] == x["k"]))
    return F.map_from_entries(last)


def ticks(events: DataFrame) -> DataFrame:
    """Events as ticks: a user's values are a ticker's prices."""
    return events.select(F.col("user_id").alias("ticker"), "ts", F.col("value").alias("price"), "event_id", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))


def daily_bars(events: DataFrame) -> DataFrame:
    """Open, high, low, close and number of ticks of each ticker and day."""
    order = F.struct("ts", "event_id")
    return ticks(events).groupBy("ticker", F.to_date("ts").alias("trade_date")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count(F.lit(1)).alias("volume"), F.sum("price").alias("amount")
    )


def atom_entries(df: DataFrame, column: str, carry: str) -> DataFrame:
    """The entries of Atom feeds: title, link, summary and time, with the column that names the feed's owner."""
    schema = "entry array<struct<title: string, updated: string, summary: string, id: string, link: struct<_href: string>>>"
    entry = F.explode(F.from_xml(F.col(column), schema)["entry"]).alias("e")
    rows = df.select(carry, entry)
    return rows.select(carry, F.col("e.title").alias("title"), F.col("e.link._href").alias("url"), F.col("e.summary").alias("body"), F.to_timestamp("e.updated").alias("published_at"))


def page_blocked(status: Column, html: Column) -> Column:
    """Whether a page is a refusal rather than news."""
    return status.isin(401, 403) | (F.trim(F.coalesce(html, F.lit(""))) == "") | html.contains("登录") | html.contains("captcha")


def page_links(df: DataFrame, column: str, base: str) -> DataFrame:
    """The news links of a page: title, absolute url and time, from elements of the class news-link."""
    tag = F.explode(F.regexp_extract_all(column, F.lit(r'(?s)(<a[^>]*class="[^"]*news-link[^"]*"[^>]*>.*?</a>)'), F.lit(1)))
    rows = df.select(tag.alias("a"))
    href, seconds = F.regexp_extract("a", r'href="([^"]*)"', 1), F.regexp_extract("a", r'data-time="(\d+)"', 1)
    named = F.regexp_extract("a", r'(?s)class="[^"]*news-title[^"]*"[^>]*>(.*?)<', 1)
    rows = rows.select(F.trim(named).alias("title"), F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(base), href)).alias("url"), F.timestamp_seconds(F.nullif(seconds, F.lit("")).try_cast("bigint")).alias("published_at"))
    return rows.where((F.col("title") != "") & F.col("published_at").isNotNull())
