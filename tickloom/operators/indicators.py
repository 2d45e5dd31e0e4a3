"""Indicators over ordered series: windows where a frame will do; folds over short arrays for previews (whole series: recurrence.py)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by(key: str = "ticker", order: str = "trade_date"):
    return Window.partitionBy(key).orderBy(order)


def last_n(value: Column, n: int, fold, w) -> Column:
    """A frame of the last n rows folded; null with fewer."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(F.lit(1)).over(frame) >= n, fold(value).over(frame)) if n > 0 else F.lit(None).cast("double")


def sma(value: Column, n: int, w) -> Column:
    return last_n(value, n, F.avg, w)


def cross_above(a: Column, b: Column, w) -> Column:
    """Above today, and not above at the row before."""
    return F.coalesce((a > b) & (F.lag(a).over(w) <= F.lag(b).over(w)), F.lit(False))


def cross_below(a: Column, b: Column, w) -> Column:
    return F.coalesce((a < b) & (F.lag(a).over(w) >= F.lag(b).over(w)), F.lit(False))


def crossed(today_a: Column, today_b: Column, before_a: Column | None = None, before_b: Column | None = None, above: bool = True) -> Column:
    """A crossing of four scalars, as rules write it; with two only, plain above (or below)."""
    a, b = (today_a, today_b) if above else (today_b, today_a)
    if before_a is None or before_b is None:
        return a > b
    p, q = (before_a, before_b) if above else (before_b, before_a)
    return (a > b) & (p <= q)


def prev_close(w) -> Column:
    return F.coalesce(F.lag("close").over(w), F.col("close"))


def preview(bars: DataFrame, last: int, key: str = "ticker", order: str = "trade_date", value: str = "close") -> DataFrame:
    """One row for each key with its last values, oldest first. Whole histories are for recurrence.over."""
    newest = Window.partitionBy(key).orderBy(F.col(order).desc())
    rows = bars.select(key, order, value).withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= last)
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("values"))


def ema(values: Column, n: int) -> Column:
    """The last exponential mean, seeded with the first value."""
    alpha = 2.0 / (n + 1)
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), values[0], lambda s, x: alpha * x + (1 - alpha) * s)


def rsi(values: Column, n: int = 14) -> Column:
    """Wilder's relative strength: 100 without losses, null with fewer than n + 1 values."""
    changes = F.zip_with(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.slice(values, 1, F.greatest(F.size(values) - 1, F.lit(0))), lambda a, b: a - b)
    gain = lambda d: F.when(d > 0, d).otherwise(0.0)
    loss = lambda d: F.when(d < 0, -d).otherwise(0.0)
    total = lambda f: F.aggregate(F.slice(changes, 1, n), F.lit(0.0), lambda s, d: s + f(d)) / n
    rest = F.slice(changes, n + 1, F.greatest(F.size(changes) - n, F.lit(0)))
    state = F.aggregate(rest, F.struct(total(gain).alias("g"), total(loss).alias("l")), lambda s, d: F.struct(((s["g"] * (n - 1) + gain(d)) / n).alias("g"), ((s["l"] * (n - 1) + loss(d)) / n).alias("l")))
    value = F.transform(F.array(state), lambda s: F.when(s["l"] == 0, F.lit(100.0)).otherwise(100 - 100 / (1 + s["g"] / s["l"])))[0]
    return F.when(F.size(values) >= n + 1, value)


def macd(values: Column, fast: int = 12, slow: int = 26, signal: int = 9) -> Column:
    """(dif, dea, hist), hist being twice their difference; null with fewer than slow + signal values."""
    k = [2.0 / (n + 1) for n in (fast, slow, signal)]

    def step(s: Column, x: Column) -> Column:
        f, w = k[0] * x + (1 - k[0]) * s["f"], k[1] * x + (1 - k[1]) * s["s"]
        return F.struct(f.alias("f"), w.alias("s"), (k[2] * (f - w) + (1 - k[2]) * s["d"]).alias("d"))

    start = F.struct(values[0].alias("f"), values[0].alias("s"), F.lit(0.0).alias("d"))
    state = F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), start, step)
    out = F.transform(F.array(state), lambda s: F.struct((s["f"] - s["s"]).alias("dif"), s["d"].alias("dea"), (2 * (s["f"] - s["s"] - s["d"])).alias("hist")))[0]
    return F.when(F.size(values) >= slow + signal, out)


def macd_context(values: Column, fast: int = 12, slow: int = 26, signal: int = 9) -> dict[str, Column]:
    """macd_dif, macd_dea and macd_hist for a rule's context: 0 where the series is too short, unlike means, which are null."""
    m = macd(values, fast, slow, signal)
    return {f"macd_{c}": F.coalesce(m[c], F.lit(0.0)) for c in ("dif", "dea", "hist")}
