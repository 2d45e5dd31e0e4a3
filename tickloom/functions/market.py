"""Column functions on prices, times and sessions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONES = {"us": "America/New_York", "cn": "Asia/Shanghai"}
#: Minutes of the day in which a market trades; both ends are open hours.
HOURS = {"us": ((570, 960),), "cn": ((570, 690), (780, 900))}


def pct_change(price: Column, prev_close: Column) -> Column:
    return F.when(prev_close == 0, F.lit(0.0)).otherwise((price - prev_close) / prev_close * 100)


def volume_ratio(volume: Column, average: Column) -> Column:
    return F.when(average <= 0, F.lit(0.0)).otherwise(volume / average)


def limit_up(price: Column, prev_close: Column, bid1: Column, ask1: Column) -> Column:
    return (ask1 == 0) & (bid1 > 0) & (price > prev_close * 1.099)


def limit_down(price: Column, prev_close: Column, bid1: Column, ask1: Column) -> Column:
    return (bid1 == 0) & (ask1 > 0) & (price < prev_close * 0.901)


def local(ts: Column, market: str) -> Column:
    return F.from_utc_timestamp(ts, ZONES[market])


def minute_of_day(local_ts: Column) -> Column:
    return F.hour(local_ts) * 60 + F.minute(local_ts)


def is_open(ts: Column, market: str) -> Column:
    """Whether a market trades in the minute of a UTC time, weekends aside."""
    t = local(ts, market)
    inside = F.lit(False)
    for a, b in HOURS[market]:
        inside = inside | minute_of_day(t).between(a, b)
    return (F.weekday(t) < 5) & inside


def session(ts: Column, holiday: Column | None = None) -> Column:
    """The session of the Chinese market at a UTC time; its bounds are half-open."""
    t = local(ts, "cn")
    m = minute_of_day(t)
    closed = (F.weekday(t) >= 5) if holiday is None else (F.weekday(t) >= 5) | F.coalesce(holiday, F.lit(False))
    return F.when(closed, "closed").when(m < 570, "pre").when(m < 690, "morning").when(m < 780, "noon_break").when(m < 900, "afternoon").otherwise("post")


def digest_key(ts: Column, market: Column) -> Column:
    """The half-day digest that an article of a market belongs to."""
    hour = F.hour(F.when(market == "us", local(ts, "us")).otherwise(local(ts, "cn")))
    return F.concat(F.when(hour < 12, "morning").otherwise("evening"), F.lit("_"), market)


def arrow(pct: Column) -> Column:
    # fixed values
    return F.when(pct < 0, "🔻").when(pct > 0, "🚀").otherwise("⚡")
