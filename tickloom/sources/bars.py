"""Daily bars kept as a table, with what is short of days fetched once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.durable import durable
from ..operators.tables import Latest
from .snapshots import short_of

BARS = "ticker string, trade_date date, open double, high double, low double, close double, volume long, amount double"


def fetched_by(client: Callable[[str, int], Iterable[tuple]]) -> Callable[[DataFrame], DataFrame]:
    """A fetch that asks a client for a ticker's last days, (trade_date, open, high, low, close, volume, amount) each, in
    tasks; a ticker whose answer is an error has no bars."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in BARS.split(", ")]
        for pdf in batches:
            for ticker, days in pdf[["ticker", "fetch"]].itertuples(index=False, name=None):
                try:
                    rows = [(ticker, *r) for r in client(ticker, days)]
                except Exception:  # noqa: BLE001, S112
                    continue
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    return lambda short: short.repartition("ticker").mapInPandas(run, BARS)


class DailyBars:
    def __init__(self, spark: SparkSession, folder: str):
        self.table = Latest(spark, folder, BARS, ["ticker", "trade_date"])

    def load(self, tickers: DataFrame, days: int, fetch: Callable[[DataFrame], DataFrame], batch: int) -> DataFrame:
        """The last ``days`` bars of each of the tickers (ticker). Of those that the table has fewer of, twice as many days
        are fetched and put in first, a bar a day; a fetch that gives nothing leaves what there is. A batch that is run
        again fetches what it fetched before."""
        wanted = tickers.select("ticker").distinct()
        short = durable(short_of(self.table.current(batch).join(wanted, "ticker", "left_semi"), wanted, days))
        new = fetch(short).groupBy("ticker", "trade_date").agg(F.max(F.struct("open", "high", "low", "close", "volume", "amount")).alias("bar"))
        self.table.upsert(new.select("ticker", "trade_date", "bar.*"), batch)
        last = Window.partitionBy("ticker").orderBy(F.col("trade_date").desc())
        rows = self.table.current(batch + 1).join(wanted, "ticker", "left_semi")
        return rows.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= days).drop("_n")
