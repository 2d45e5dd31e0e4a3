"""Queries on sources: payloads made of the tables, read back as each source's articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import articles as src
from ..sources import payloads

QUERIES, ORACLES = {}, {}

#: Events as items: a tenth has no title, and some have no link.
E = "e AS (SELECT event_id AS i, user_id AS u, epoch_ms(ts) // 1000 AS s, date_trunc('second', ts) AS t, CASE WHEN event_id % 10 = 0 THEN '' ELSE 'head ' || event_id END AS head, repeat('body <b>' || user_id || '</b> é ', 10) AS body, CASE WHEN event_id % 11 = 0 THEN '' ELSE '/n/' || event_id END AS link FROM events)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("i"), F.col("user_id").alias("u"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), F.when(F.col("event_id") % 10 == 0, "").otherwise(F.concat(F.lit("head "), F.col("event_id").cast("string"))).alias("head"),
        F.repeat(F.concat(F.lit("body <b>"), F.col("user_id").cast("string"), F.lit("</b> é ")), 10).alias("body"), F.when(F.col("event_id") % 11 == 0, "").otherwise(F.concat(F.lit("/n/"), F.col("event_id").cast("string"))).alias("link"),
    )


def _hour():
    """What a response covers, so that none grows with a table."""
    return F.floor(F.col("s") / 3600).alias("hour")


def _arrays(items: DataFrame, *fields) -> DataFrame:
    """A response for each ticker and hour: its items as JSON."""
    return items.groupBy("u", _hour()).agg(F.collect_list(F.struct(*fields)).alias("items"))


def _shown(df: DataFrame) -> DataFrame:
    return df.select("source", "market", "url", "title", "body", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"))


def _sql(source: str, market: str, url: str, title: str, body: str, where: str = "true", at: str = "t") -> str:
    return f"WITH {E} SELECT '{source}' AS source, '{market}' AS market, {url} AS url, {title} AS title, {body} AS body, strftime({at}, '%Y-%m-%d %H:%M:%S') AS published FROM e WHERE {where}"


def _local(c: str = "s"):
    """Shanghai's local time of an epoch, as text."""
    return F.date_format(F.from_utc_timestamp(F.timestamp_seconds(c), "Asia/Shanghai"), "yyyy-MM-dd HH:mm:ss")


@query(_sql("finnhub", "us", "'https://f' || link", "head", "body"))
def finnhub_items(spark, sf_dir):
    df = _arrays(_items(spark, sf_dir), F.col("s").alias("datetime"), F.col("head").alias("headline"), F.col("body").alias("summary"), F.concat(F.lit("https://f"), "link").alias("url"), F.col("i").alias("id"))
    return _shown(payloads.finnhub(df.select(F.to_json("items").alias("p")), "p"))


@query(_sql("wallstreetcn", "us", "link", "head", "trim(body)", "head <> '' AND link <> '' AND i % 13 <> 0 AND u % 7 <> 0"))
def wallstreet_items(spark, sf_dir):
    """Failed responses, blank titles and links, and items without a time go."""
    df = _arrays(_items(spark, sf_dir), F.when(F.col("i") % 13 != 0, F.col("s")).alias("display_time"), F.col("head").alias("title"), F.col("link").alias("uri"), F.col("body").alias("content_short"))
    df = df.select(F.when(F.col("u") % 7 == 0, 502).otherwise(200).alias("status"), F.to_json(F.struct(F.struct("items").alias("data"))).alias("p"))
    return _shown(payloads.wallstreet(df, "p", "status"))


@query(_sql("yfinance_news", "us", "link", "head", "CAST(NULL AS VARCHAR)"))
def yahoo_items(spark, sf_dir):
    df = _arrays(_items(spark, sf_dir), F.col("s").alias("providerPublishTime"), F.col("head").alias("title"), "link", F.lit("x").alias("publisher"))
    return _shown(payloads.yahoo(df.select(F.to_json("items").alias("p")), "p"))


@query(_sql("akshare_news", "cn", "link", "head", "body", "link <> ''"))
def ticker_wire_items(spark, sf_dir):
    """Half of the titles under their other name."""
    i = _items(spark, sf_dir)
    odd = F.col("i") % 2 == 1
    df = i.select(F.when(odd, F.col("head")).alias("标题"), F.when(~odd, F.col("head")).alias("新闻标题"), F.col("body").alias("新闻内容"), F.col("link").alias("文章链接"), _local().alias("发布时间"))
    return _shown(payloads.ticker_wire(df))


@query(_sql("caixin_telegram", "cn", "'https://www.cls.cn/telegraph/' || strftime(t, '%Y%m%dT%H%M%S') || '/' || substr(sha1(CASE WHEN head = '' THEN substr(trim(body), 1, 80) ELSE head END), 1, 12)", "CASE WHEN head = '' THEN substr(trim(body), 1, 80) ELSE head END", "trim(body)", "i % 13 <> 0"))
def telegraph_items(spark, sf_dir):
    local = F.from_utc_timestamp(F.timestamp_seconds("s"), "Asia/Shanghai")
    df = _items(spark, sf_dir).select(F.to_date(local).alias("发布日期"), F.when(F.col("i") % 13 != 0, F.date_format(local, "HH:mm:ss")).alias("发布时间"), F.col("head").alias("标题"), F.col("body").alias("内容"))
    return _shown(payloads.telegraph(df))


@query(_sql("cctv_news", "cn", "'https://tv.cctv.com/lm/xwlb/day/' || strftime(t, '%Y%m%d') || '.shtml#seg' || i", "head", "trim(body)", "head <> ''", "CAST(t AS DATE) + INTERVAL 11 HOUR + INTERVAL 30 MINUTE"))
def transcript_items(spark, sf_dir):
    df = _items(spark, sf_dir).select(F.to_date(F.timestamp_seconds("s")).alias("day"), "i", F.col("head").alias("title"), F.col("body").alias("content"))
    return _shown(payloads.transcript(df, "day", "i"))


@query(_sql("juchao", "cn", "'http://static.cninfo.com.cn/' || link", "'co' || u || ' ' || head", "CAST(NULL AS VARCHAR)", "u % 5 <> 0"))
def filing_items(spark, sf_dir):
    """Some responses have null for a list."""
    name = F.concat(F.lit("co"), F.col("u").cast("string"))
    df = _arrays(_items(spark, sf_dir), (F.col("s") * 1000).alias("announcementTime"), name.alias("secName"), F.col("head").alias("announcementTitle"), F.col("link").alias("adjunctUrl"))
    df = df.select(F.to_json(F.struct(F.when(F.col("u") % 5 != 0, F.col("items")).alias("announcements"))).alias("p"))
    return _shown(payloads.filings(df, "p"))


@query(_sql("kr36", "cn", "'https://k' || link", "head", "substr(trim(regexp_replace(body, '<[^>]+>', '', 'g')), 1, 1000)", "head <> ''"))
def rss_items(spark, sf_dir):
    """RSS feeds, one for each ticker; summaries lose their tags."""
    i = _items(spark, sf_dir)
    escaped = F.replace(F.replace("body", F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    day = F.concat(F.lit("Mon, "), F.date_format(F.timestamp_seconds("s"), "dd MMM yyyy HH:mm:ss"), F.lit(" +0000"))
    item = F.concat(F.lit("<item><title>"), "head", F.lit("</title><link>https://k"), "link", F.lit("</link><description>"), escaped, F.lit("</description><pubDate>"), day, F.lit("</pubDate></item>"))
    feeds = i.groupBy("u", _hour()).agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>")).alias("p"))
    return _shown(payloads.rss(feeds, "p"))


@query(_sql("sina_global", "cn", "'https://finance.sina.com.cn/7x24/' || strftime(t, '%Y%m%dT%H%M%S') || '/' || substr(sha1(trim(body)), 1, 12)", "substr(trim(body), 1, 80)", "trim(body)"))
def sina_items(spark, sf_dir):
    return _shown(payloads.sina(_items(spark, sf_dir).select(_local().alias("时间"), F.col("body").alias("内容"))))


@query(_sql("tushare_news", "cn", "'https://tushare.local/sina/' || substr(sha1(strftime(t + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') || body), 1, 16)", "CASE WHEN head = '' THEN substr(body, 1, 60) ELSE head END", "body"))
def note_items(spark, sf_dir):
    return _shown(payloads.notes(_items(spark, sf_dir).select(_local().alias("datetime"), F.col("head").alias("title"), F.col("body").alias("content"))))


@query(_sql("xueqiu", "cn", "'https://xueqiu.com' || link", "CASE WHEN head = '' THEN substr(body, 1, 80) ELSE head END", "body", "u % 7 > 2"))
def timeline_items(spark, sf_dir):
    """Refused responses, pages that aren't JSON and error codes bring nothing."""
    df = _arrays(_items(spark, sf_dir), (F.col("s") * 1000).alias("created_at"), F.col("link").alias("target"), F.col("head").alias("title"), F.col("body").alias("description"))
    r = F.col("u") % 7
    df = df.select(F.when(r == 0, 403).otherwise(200).alias("status"), F.when(r == 1, "text/html").otherwise("application/json; charset=utf-8").alias("kind"), F.to_json(F.struct(F.when(r == 2, 400016).otherwise(0).alias("error_code"), F.col("items").alias("list"))).alias("p"))
    return _shown(payloads.timeline(df, "p", "status", "kind"))


@query("SELECT p_partkey AS id, CASE WHEN c[1] = '6' THEN 'SH' || c WHEN c[1] IN ('0', '3') THEN 'SZ' || c ELSE c END AS symbol FROM (SELECT p_partkey, lpad(CAST(p_partkey * 457 % 1000000 AS VARCHAR), 6, '0') AS c FROM part)")
def timeline_symbols(spark, sf_dir):
    code = F.lpad((F.col("p_partkey") * 457 % 1000000).cast("string"), 6, "0")
    return src.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), payloads.symbol(code).alias("symbol"))


_W = "WITH {0} " + " UNION ALL ".join(f"SELECT '{s}' AS source, '{m}' AS market, link AS url, CASE WHEN head = '' THEN substr(trim(body), 1, 80) ELSE head END AS title, trim(body) AS body, strftime(t, '%Y-%m-%d %H:%M:%S') AS published FROM e WHERE link <> '' AND i % 13 <> 0" for s, _, m in payloads.WIRES)


@query(_W.replace("{0}", E))
def wire_union(spark, sf_dir):
    """The wires that share a layout, unioned by the registry; one that isn't enabled and one without its needs are left out."""
    i = _items(spark, sf_dir)
    base = lambda body: i.select(F.col("head").alias("标题"), F.col("body").alias(body), F.when(F.col("i") % 13 != 0, _local()).otherwise("").alias("发布时间"), F.col("link").alias("链接"))
    readers = {s: payloads.shared_wire(s) for s, _, _ in payloads.WIRES} | {"sina_global": payloads.sina, "tushare_news": payloads.notes}
    fetched = {s: base(body) for s, body, _ in payloads.WIRES} | {"sina_global": i, "tushare_news": i}
    return _shown(payloads.union(fetched, readers, set(readers) - {"sina_global"}, {"tushare_news": False}))


@query(_sql("atom", "us", "'https://s/' || i", "head", "trim(body)").replace("'atom' AS source", "CAST(u AS VARCHAR) AS source"))
def atom_items(spark, sf_dir):
    """Atom feeds, one for each owner."""
    escaped = F.replace(F.replace("body", F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    entry = F.concat(F.lit("<entry><title>"), "head", F.lit("</title><updated>"), F.date_format(F.timestamp_seconds("s"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit("</updated><summary>"), escaped, F.lit('</summary><link href="https://s/'), F.col("i").cast("string"), F.lit('"/></entry>'))
    feeds = _items(spark, sf_dir).groupBy("u", _hour()).agg(F.concat(F.lit("<feed>"), F.array_join(F.collect_list(entry), ""), F.lit("</feed>")).alias("p"))
    found = src.atom_entries(feeds.withColumn("u", F.col("u").cast("string")), "p", "u")
    return _shown(found.select(F.col("u").alias("source"), F.lit("us").alias("market"), "url", F.coalesce("title", F.lit("")).alias("title"), "body", "published_at"))


@query(f"WITH {E} SELECT head AS title, CASE WHEN i % 2 = 0 THEN 'https://t' || link ELSE 'https://base' || link END AS url, strftime(t, '%Y-%m-%d %H:%M:%S') AS published FROM e WHERE head <> '' AND u % 6 > 1")
def page_items(spark, sf_dir):
    """News links of HTML pages; refused pages have none."""
    href = F.concat(F.when(F.col("i") % 2 == 0, "https://t").otherwise(""), "link")
    a = F.concat(F.lit('<li><a class="big news-link" href="'), href, F.lit('" data-time="'), F.col("s").cast("string"), F.lit('"><span class="news-title"> '), "head", F.lit(" </span></a></li>"))
    pages = _items(spark, sf_dir).groupBy("u", _hour()).agg(F.array_join(F.collect_list(a), "\n").alias("html"))
    pages = pages.select(F.when(F.col("u") % 6 == 0, 403).otherwise(200).alias("status"), F.when(F.col("u") % 6 == 1, F.concat("html", F.lit("captcha"))).otherwise(F.col("html")).alias("html"))
    fine = pages.where(~src.page_blocked(F.col("status"), F.col("html")))
    return src.page_links(fine, "html", "https://base").select("title", "url", F.date_format("published_at", "yyyy-MM-dd HH:mm:ss").alias("published"))
