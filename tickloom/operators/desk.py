"""What people at the desk ask for: an item's history, replies to commands, pauses, references between settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import asof
from .messages import fixed, newest

#: Texts of the replies; fixed values.
WATCH_USAGE = "用法: /watch TICKER [...]"
UNWATCH_USAGE = "用法: /unwatch TICKER [...]"
UNCHANGED = "无变化"
PAUSE_USAGE = "用法: /pause SOURCE [minutes=30]"
DIGEST_USAGE = "用法: /digest now"
HEALTHY = "OK (详情见 healthcheck endpoint)"
UNKNOWN = "未知命令: /"
NOTHING = "(空)"
SECTIONS = ("美股", "A股", "宏观", "板块")
#: How much of a summary a line shows, and how many lines a reply has; fixed values.
LINE_CHARS, LINES = 120, 10


def history(asked: DataFrame, items: DataFrame, days: int, most: int) -> DataFrame:
    """asked (id, ticker, at, ...) with ``history``: what ``items`` (ticker, at, line) say of the ticker in the days before.

    Newest first, the ``most`` newest at most, as a prompt has room for so many; an empty array where there are none.
    Every item knows the ``most`` up to itself of its period of so many days; a row takes the last item before it, and the
    last before its period, by as-of joins. So a row costs two lists, however many items its ticker has, and a ticker is
    spread over its periods and blocks. Ties of time go by the line. Rows without a ticker or a time have no history."""
    span = days * asof.DAY
    start = lambda at: at - F.pmod(at, F.lit(span))
    timed = items.where("ticker IS NOT NULL AND at IS NOT NULL").select("ticker", asof.micros(F.col("at")).alias("_at"), "line").withColumn("_period", start(F.col("_at")))
    order = Window.partitionBy("ticker", "_period").orderBy("_at", F.col("line").desc())
    upto = F.collect_list(F.struct("_at", "line")).over(order.rowsBetween(-(most - 1), 0))
    known = timed.select("ticker", "_at", F.struct(upto.alias("x")).alias("_list"), F.row_number().over(order).alias("_n"))

    def last(rows: DataFrame, at: Column) -> DataFrame:
        return asof.joined(rows, known, ["ticker"], at, F.col("_at"), F.col("_list"), F.col("_n"), asof.DAY, False)

    at = lambda row: asof.micros(F.col(f"{row}.at"))
    first = last(asked, asof.micros(F.col("at"))).select(F.col("_row.ticker").alias("ticker"), F.col("_row").alias("row"), F.col("_found.x").alias("new"))
    both = last(first, start(at("row"))).select("_row.row", "_row.new", F.col("_found.x").alias("old"))
    none = F.array().cast("array<struct<_at:bigint,line:string>>")
    here = F.filter(F.coalesce("new", none), lambda x: x["_at"] >= start(at("row")))
    lines = F.filter(F.concat(F.reverse(here), F.reverse(F.coalesce("old", none))), lambda x: x["_at"] >= at("row") - span)
    found = F.when(F.col("row.ticker").isNotNull(), F.transform(F.slice(lines, 1, most), lambda x: x["line"]))
    return both.select("row.*", F.coalesce(found, F.array().cast("array<string>")).alias("history"))


def news_replies(items: DataFrame) -> DataFrame:
    """ticker, reply: the newest items (ticker, at, id, summary) of each ticker as lines."""
    w = Window.partitionBy("ticker").orderBy(F.col("at").desc(), "id")
    line = F.concat(F.lit("• "), F.date_format("at", "yyyy-MM-dd HH:mm:ss"), F.lit(" "), F.substring(F.coalesce("summary", F.lit("")), 1, LINE_CHARS))
    top = items.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= LINES).select("ticker", "_n", line.alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_n", "line"))), lambda x: x["line"])
    return top.groupBy("ticker").agg(lines.alias("lines")).select("ticker", F.concat("ticker", F.lit(f" 近 {LINES} 条:\n"), F.array_join("lines", "\n")).alias("reply"))


def cost_reply(cost: Column, remaining: Column) -> Column:
    return F.concat(F.lit("今日 LLM 成本: "), fixed(cost, 2), F.lit(" CNY\n剩余预算: "), fixed(remaining, 2), F.lit(" CNY"))


def paused(states: DataFrame, commands: DataFrame, minutes: int = 30) -> DataFrame:
    """Source states (source, paused_until, error) after pause commands (source, at, minutes); the last command of a source
    counts, one without minutes pauses for half an hour, and a source that wasn't known gets a row."""
    last = newest(commands.where("source is not null"), "source", ["at", "minutes"])
    until = F.col("at") + F.make_dt_interval(mins=F.coalesce("minutes", F.lit(minutes)))
    new = last.select("source", until.alias("_until"))
    out = states.join(new, "source", "full_outer")
    set_ = F.col("_until").isNotNull()
    return out.select("source", F.coalesce("_until", "paused_until").alias("paused_until"), F.when(set_, "manual_pause").otherwise(F.col("error")).alias("error"))


def is_us(ticker: Column) -> Column:
    """Tickers of letters only are American."""
    return ticker.rlike(r"^\p{L}+$")


def watched(us: Column, cn: Column, tickers: Column) -> Column:
    """us, cn, reply after tickers are added, each to the list that its form says; known ones change nothing."""
    new = F.filter(F.array_distinct(tickers), lambda t: ~F.when(is_us(t), F.array_contains(us, t)).otherwise(F.array_contains(cn, t)))
    reply = F.when(F.size(tickers) == 0, WATCH_USAGE).when(F.size(new) == 0, UNCHANGED).otherwise(F.concat(F.lit("已加入: "), F.array_join(new, ", ")))
    return F.struct(F.concat(us, F.filter(new, is_us)).alias("us"), F.concat(cn, F.filter(new, lambda t: ~is_us(t))).alias("cn"), reply.alias("reply"))


def unwatched(us: Column, cn: Column, tickers: Column) -> Column:
    """us, cn, reply after tickers are removed; one that stands in both lists leaves the first only."""
    gone = F.filter(F.array_distinct(tickers), lambda t: F.array_contains(us, t) | F.array_contains(cn, t))
    reply = F.when(F.size(tickers) == 0, UNWATCH_USAGE).when(F.size(gone) == 0, UNCHANGED).otherwise(F.concat(F.lit("已移除: "), F.array_join(gone, ", ")))
    left_us = F.filter(us, lambda t: ~F.array_contains(gone, t))
    left_cn = F.filter(cn, lambda t: ~F.array_contains(gone, t) | F.array_contains(us, t))
    return F.struct(left_us.alias("us"), left_cn.alias("cn"), reply.alias("reply"))


def listed(us: Column, cn: Column, macros: Column, sectors: Column) -> Column:
    """The watchlist as four lines."""
    shown = lambda c: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit(NOTHING))
    return F.concat_ws("\n", *[F.concat(F.lit(f"{label}: "), shown(c)) for label, c in zip(SECTIONS, (us, cn, macros, sectors))])


def by_script(words: Column) -> Column:
    """us, cn: keywords of a flat list by their script; those with a Chinese character (U+4E00 to U+9FFF) are Chinese."""
    chinese = lambda w: w.rlike(r"[\u4E00-\u9FFF]")
    return F.struct(F.filter(words, lambda w: ~chinese(w)).alias("us"), F.filter(words, chinese).alias("cn"))


#: Usage of the chart commands; fixed values.
CHART_USAGE, SENTIMENT_USAGE = "用法: /chart TICKER [window=30d]", "用法: /sentiment TICKER [days=7]"


def chart_requests(commands: DataFrame) -> DataFrame:
    """commands (command, args) with the chart asked for: ticker, kind, window, and usage where no ticker is given. What is
    drawn is the bars with their marks (messages.markers), pixels are the client's."""
    chart = F.col("command") == "chart"
    given = F.size("args") > 0
    window = F.when(chart, F.coalesce(F.get("args", F.lit(1)), F.lit("30d"))).otherwise(F.concat(F.coalesce(F.get("args", F.lit(1)), F.lit("7")), F.lit("d")))
    usage = F.when(~given, F.when(chart, CHART_USAGE).otherwise(SENTIMENT_USAGE))
    return commands.where(F.col("command").isin("chart", "sentiment")).withColumns({"ticker": F.get("args", F.lit(0)), "kind": F.when(given, F.when(chart, "kline").otherwise("sentiment")), "window": F.when(given, window), "usage": usage})


def unresolved(rules: DataFrame, holdings: DataFrame, watchlist: DataFrame, capital: float | None) -> DataFrame:
    """severity, check, rule_id: references of alert rules (rule_id, kind, ticker, holding, portfolio) that lead nowhere.

    A holding that isn't held, and a portfolio rule without capital, stop the load; a ticker that isn't watched is a
    warning only, as its rule is merely never evaluated."""

    def found(rows: DataFrame, severity: str, check: str) -> DataFrame:
        return rows.select(F.lit(severity).alias("severity"), F.lit(check).alias("check"), "rule_id")

    missing = lambda key, of: rules.where(F.col(key).isNotNull()).join(of.select(F.col("ticker").alias(key)), key, "left_anti")
    out = found(missing("holding", holdings), "error", "unknown holding").unionByName(found(missing("ticker", watchlist), "warning", "ticker not watched"))
    return out if capital else out.unionByName(found(rules.where("portfolio"), "error", "no capital"))


def price_move(pct: Column, least: float) -> Column:
    """Whether a move is critical in itself; an unknown one isn't."""
    return F.coalesce(F.abs(pct) >= least, F.lit(False))


def dispatched(text: Column, handlers: dict[str, Callable[[Column], Column]]) -> Column:
    """The reply to a line: that of its command's handler, which gets the array of its arguments. A line that is no
    command has none, and an unknown command says so."""
    words = F.filter(F.split(F.substring(F.trim(text), 2, 1 << 30), r"\s+"), lambda w: w != "")
    name, args = F.get(words, F.lit(0)), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0)))
    out = F.when(~F.trim(text).startswith("/") | (F.size(words) == 0), F.lit(None).cast("string"))
    for command, handler in handlers.items():
        out = out.when(name == command, handler(args))
    return out.otherwise(F.concat(F.lit(UNKNOWN), name))


def pause_reply(args: Column) -> Column:
    """A source, and for how many minutes; what isn't a number of minutes gets the usage."""
    given = F.get(args, F.lit(1))
    minutes = F.when(given.isNull(), F.lit(30)).otherwise(given.try_cast("int"))
    known = (F.size(args) > 0) & minutes.isNotNull()
    return F.when(known, F.concat(F.lit("已暂停 "), F.get(args, F.lit(0)), F.lit(" "), minutes.cast("string"), F.lit(" 分钟"))).otherwise(PAUSE_USAGE)


def digest_reply(args: Column, sent: Column) -> Column:
    """sent: how many items the digest that is sent now has."""
    return F.when(F.get(args, F.lit(0)) == "now", F.concat(F.lit("已发送 digest, 含 "), sent.cast("string"), F.lit(" 条"))).otherwise(DIGEST_USAGE)
