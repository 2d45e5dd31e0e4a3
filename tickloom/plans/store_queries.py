"""Queries on snapshots and stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import store
from ..sources import articles as src
from ..sources import snapshots

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("""SELECT lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS ticker, p_name AS name, p_retailprice AS price, CAST(p_size - 25 AS DOUBLE) AS pct_change, CAST(p_size AS BIGINT) AS volume,
    CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size / 10.0::DOUBLE END AS volume_ratio FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 11 <> 0""")
def market_spot_rows(spark, sf_dir):
    """A spot snapshot's rows; every fifth code is too short, every eleventh has no price."""
    key = F.lpad(F.col("p_partkey").cast("string"), 6, "0")
    spot = src.table(spark, sf_dir, "part").select(
        F.when(F.col("p_partkey") % 5 == 0, F.substring(key, 2, 5)).otherwise(key).alias("代码"), F.col("p_name").alias("名称"), F.when(F.col("p_partkey") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("p_retailprice")).alias("最新价"),
        (F.col("p_size") - 25).alias("涨跌幅"), F.col("p_size").alias("成交量"), F.lit(None).cast("string").alias("成交额"), F.when(F.col("p_size") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("p_size") / 10).alias("量比"),
    )
    return snapshots.market_rows(spot).select("ticker", "name", "price", "pct_change", "volume", "volume_ratio")


@query("WITH r AS (SELECT p_brand AS name, CAST(p_size AS DOUBLE) AS pct_change, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS k FROM part) SELECT name, pct_change FROM r WHERE k = 1")
def sector_snapshot(spark, sf_dir):
    """The last row of each sector."""
    s = src.table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit(" "), "p_brand").alias("板块名称"), F.col("p_size").alias("涨跌幅"), F.lit(None).cast("double").alias("换手率"))
    return snapshots.sector_rows(s, "p_partkey").select("name", "pct_change")


@query("""WITH n AS (SELECT l_orderkey AS id, l_quantity AS v, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS k FROM lineitem WHERE l_orderkey % 2 = 0) SELECT o_orderkey AS id, coalesce(n.v, o_totalprice) AS v FROM orders LEFT JOIN n ON n.id = o_orderkey AND k = 1
    UNION ALL SELECT n.id, n.v FROM n WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = n.id)""")
def bars_upsert(spark, sf_dir):
    """A table with rows put in by key, the last loaded of each key."""
    held = src.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    new = src.table(spark, sf_dir, "lineitem").where("l_orderkey % 2 = 0").select(F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("v"), F.col("l_linenumber").cast("bigint").alias("loaded"))
    return snapshots.upserted(held, new, ["id"])


@query("SELECT DISTINCT event_type || ':' || user_id AS key FROM events WHERE user_id % 2 = 1")
def insert_or_get(spark, sf_dir):
    """What an insert of all keys adds to a table that has those of even users."""
    e = src.table(spark, sf_dir, "events")
    rows = e.select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("key"))
    return store.insert_new(e.where("user_id % 2 = 0").select(F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("key")), rows, "key")


@query("SELECT event_id AS id, user_id % 3 = 0 AS resolved FROM events WHERE value < 5")
def dead_letter_resolve(spark, sf_dir):
    letters = src.table(spark, sf_dir, "events").where("value < 5").select(F.col("event_id").alias("id"), "user_id", F.lit(None).cast("timestamp_ntz").alias("resolved_at"))
    done = store.resolve(letters, letters.where("user_id % 3 = 0"), F.lit("2024-03-01 00:00:00").cast("timestamp_ntz"))
    return done.select("id", F.col("resolved_at").isNotNull().alias("resolved"))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY")
def retention(spark, sf_dir):
    """Orders of the last year."""
    o = src.table(spark, sf_dir, "orders")
    return store.retained(o, "o_orderdate", o.agg(F.max("o_orderdate")).scalar(), 365).select(F.col("o_orderkey").alias("id"))


@query("SELECT CASE WHEN n_regionkey = 0 THEN 'South' ELSE n_name END AS name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def canonical_names(spark, sf_dir):
    """Names under their canonical ones."""
    n = src.table(spark, sf_dir, "nation")
    aliases = n.where("n_regionkey = 0").select(F.upper("n_name").alias("alias"), F.lit("South").alias("name"))
    rows = src.table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("name"))
    return store.canonical(rows, "name", aliases).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
