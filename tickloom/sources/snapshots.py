"""Whole-market and sector snapshots, and daily bars kept as a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .articles import exchange

#: The vendor's column names; fixed values.
SPOT = {"code": "代码", "name": "名称", "price": "最新价", "pct": "涨跌幅", "volume": "成交量", "amount": "成交额", "ratio": "量比"}
SECTOR = {"name": "板块名称", "pct": "涨跌幅", "turnover": "换手率"}


def number(c: Column) -> Column:
    """A double; null for what is no number."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def market_rows(spot: DataFrame, names: dict[str, str] = SPOT) -> DataFrame:
    """One row for each tradable code of a spot snapshot: codes of other lengths, and rows without a price or change, go;
    an unknown volume or amount is 0, an unknown ratio null."""
    col = lambda k: F.col(f"`{names[k]}`")
    code = F.trim(col("code").cast("string"))
    df = spot.select(
        code.alias("ticker"), F.coalesce(col("name").cast("string"), F.lit("")).alias("name"), exchange(code).alias("market"), number(col("price")).alias("price"), number(col("pct")).alias("pct_change"),
        F.coalesce(number(col("volume")).try_cast("bigint"), F.lit(0)).alias("volume"), F.coalesce(number(col("amount")), F.lit(0.0)).alias("amount"), number(col("ratio")).alias("volume_ratio"),
    )
    return df.where((F.length("ticker") == 6) & F.col("price").isNotNull() & F.col("pct_change").isNotNull())


def sector_rows(sectors: DataFrame, ordinal: str, names: dict[str, str] = SECTOR) -> DataFrame:
    """One row for each named sector with a change; of equal names the last by ordinal."""
    col = lambda k: F.col(f"`{names[k]}`")
    df = sectors.select(F.col(ordinal).alias("_o"), F.trim(col("name").cast("string")).alias("name"), number(col("pct")).alias("pct_change"), F.lit(None).cast("double").alias("volume_ratio"), number(col("turnover")).alias("turnover_rate"))
    last = Window.partitionBy("name").orderBy(F.col("_o").desc())
    df = df.where((F.col("name") != "") & F.col("pct_change").isNotNull())
    return df.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "_o")


def upserted(held: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """held with new rows put in by key: a new row replaces the held one, and of new ones of a key the last loaded stays
    (``loaded``, a number that grows)."""
    both = held.withColumn("loaded", F.lit(-1).cast("bigint")).unionByName(new)
    last = Window.partitionBy(*keys).orderBy(F.col("loaded").desc())
    return both.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n", "loaded")


def short_of(held: DataFrame, tickers: DataFrame, days: int) -> DataFrame:
    """The tickers that the held bars have fewer than ``days`` of, and how many to fetch: twice the days."""
    counts = held.groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    return tickers.join(counts, "ticker", "left").where(F.coalesce("n", F.lit(0)) < days).select("ticker", F.lit(2 * days).alias("fetch"))


def settings(spark, files: dict[str, str | None], optional: set[str]) -> DataFrame:
    """file, path, value: the leaves of configuration texts (JSON, or YAML where that can be read), as a table that rules and
    checks can join. A missing file is an error unless it is optional; then it has no rows."""
    import json

    rows: list[tuple[str, str, str | None]] = []

    def walk(name: str, path: str, node: object) -> None:
        if isinstance(node, dict):
            for k, v in node.items():
                walk(name, f"{path}.{k}" if path else str(k), v)
        elif isinstance(node, list):
            for i, v in enumerate(node):
                walk(name, f"{path}[{i}]", v)
        else:
            rows.append((name, path, None if node is None else json.dumps(node, ensure_ascii=False).strip('"')))

    for name, text in files.items():
        if text is None:
            if name not in optional:
                raise FileNotFoundError(name)
            continue
        try:
            walk(name, "", json.loads(text))
        except ValueError:
            import yaml

            walk(name, "", yaml.safe_load(text) or {})
    return spark.createDataFrame(rows, "file string, path string, value string")
