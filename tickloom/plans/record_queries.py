"""Queries over small operators: cookies, alert history, daily triggers, previews, resolved relations, enriched messages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import indicators, messages, store
from ..operators.durable import durable, new_folder
from ..operators.records import Processed, Relations
from ..sources import articles as src
from ..sources.bars import DailyBars
from .market_queries import BARS

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT event_id, CAST(event_id + 1 AS VARCHAR) AS a, user_id || '=' || event_type AS b, CAST(2 + CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS n FROM events")
def cookies_parsed(spark, sf_dir):
    """Cookie texts as maps: equal names, blanks, parts without a name or a sign."""
    text = F.concat(F.lit("a="), "event_id", F.lit("; b = "), "user_id", F.lit("="), "event_type", F.lit(";;junk; =none; a="), F.col("event_id") + 1, F.when(F.col("event_id") % 2 == 0, "; c=").otherwise(""))
    df = src.table(spark, sf_dir, "events").select("event_id", src.cookies(text).alias("m"))
    return df.select("event_id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"), F.size("m").alias("n"))


@query("""SELECT event_id, event_type AS rule_id, '{"ticker":' || user_id || ',"session":"' || event_type || '"' || CASE WHEN event_id % 4 = 0 THEN '' ELSE ',"size":' || CAST(floor(value) AS BIGINT) END || '}' AS snapshot FROM events WHERE value > 150""")
def alert_history(spark, sf_dir):
    """Alerts with their snapshots as JSON."""
    size = F.when(F.col("event_id") % 4 != 0, F.floor("value"))
    df = src.table(spark, sf_dir, "events").where("value > 150").select("event_id", F.col("event_type").alias("rule_id"), F.col("user_id").alias("ticker"), F.col("event_type").alias("session"), size.alias("size"))
    return store.history(df, ["ticker", "session", "size"])


@query("""SELECT event_type AS rule_id, user_id AS ticker, strftime(CAST(ts + INTERVAL 8 HOUR AS DATE), '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE event_type IN ('error', 'purchase') GROUP BY ALL""")
def daily_triggers(spark, sf_dir):
    """How often each rule fired on a local day."""
    fires = src.table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "purchase")).select(F.col("event_type").alias("rule_id"), F.col("user_id").alias("ticker"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("epoch"))
    return store.daily_triggers(fires).select("rule_id", "ticker", F.date_format("day", "yyyy-MM-dd").alias("day"), "n")


@query(f"""WITH {BARS}, l AS (SELECT ticker, list(close ORDER BY trade_date) AS v FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY trade_date DESC) AS k FROM bars) WHERE k <= 5 GROUP BY ticker)
    SELECT ticker, CAST(len(v) AS INTEGER) AS n, v[1] AS oldest, v[len(v)] AS newest, round(list_reduce(v, lambda a, x: (2.0::DOUBLE / 4) * x + (1 - 2.0::DOUBLE / 4) * a), 6) AS ema3 FROM l""")
def latest_bars(spark, sf_dir):
    """Each ticker's last five closes, as a preview shows them, and their exponential mean."""
    p = indicators.preview(src.daily_bars(src.table(spark, sf_dir, "events")), 5)
    return p.select("ticker", F.size("values").alias("n"), F.col("values")[0].alias("oldest"), F.element_at("values", -1).alias("newest"), F.round(indicators.ema(F.col("values"), 3), 6).alias("ema3"))


@query("""WITH e AS (SELECT o_custkey AS k, o_orderpriority AS name, max(o_orderkey) AS id FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY ALL),
    r AS (SELECT o_custkey AS k, o_orderpriority AS subject, '2-HIGH' AS object FROM orders)
    SELECT r.k AS custkey, count(*) AS kept, CAST(sum(s.id) AS BIGINT) AS subjects, CAST(sum(o.id) AS BIGINT) AS objects FROM r JOIN e s ON s.k = r.k AND s.name = r.subject JOIN e o ON o.k = r.k AND o.name = r.object GROUP BY r.k""")
def relations_resolved(spark, sf_dir):
    """Relations of names with the entities that bear them; those that name an unknown one are dropped."""
    entity = F.when(F.col("o_orderkey") % 3 != 0, F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("name")))
    relation = F.struct(F.col("o_orderpriority").alias("subject"), F.col("o_orderstatus").alias("predicate"), F.lit("2-HIGH").alias("object"))
    each = src.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("custkey")).agg(F.array_sort(F.collect_list(entity)).alias("entities"), F.collect_list(relation).alias("relations"))
    full = each.select("custkey", F.explode(messages.resolved(F.col("relations"), F.col("entities"))).alias("r"))
    return full.groupBy("custkey").agg(F.count(F.lit(1)).alias("kept"), F.sum("r.subject.id").alias("subjects"), F.sum("r.object.id").alias("objects"))


@query("""WITH d AS (SELECT doc_id AS id, ['T' || (doc_id % 7), 'T' || (doc_id % 3 + 10)][1:CAST(doc_id % 3 AS INTEGER)] AS t, ['s' || (doc_id % 5), 'tech', 'more'][1:CAST(doc_id % 4 AS INTEGER)] AS s,
      ['bullish', 'bearish', 'neutral'][CAST(doc_id % 3 AS INTEGER) + 1] AS sentiment, ['red', 'green', 'gray'][CASE doc_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 3 END] AS colour, CASE WHEN doc_id % 2 = 0 THEN 'high' ELSE 'low' END AS magnitude FROM documents)
    SELECT id, array_to_string(list_concat(list_transform(t, lambda x: x || ':blue'), list_transform(s[1:2], lambda x: '#' || x || ':gray'), [sentiment || ':' || colour, magnitude || ':yellow']), '|') AS marks FROM d""")
def model_messages(spark, sf_dir):
    """Messages of articles that a model enriched: their marks and colours."""
    d = F.col("doc_id")
    t = F.slice(F.array(F.concat(F.lit("T"), d % 7), F.concat(F.lit("T"), d % 3 + 10)), 1, (d % 3).cast("int"))
    s = F.slice(F.array(F.concat(F.lit("s"), d % 5), F.lit("tech"), F.lit("more")), 1, (d % 4).cast("int"))
    sentiment = F.element_at(F.array(*map(F.lit, ("bullish", "bearish", "neutral"))), (d % 3 + 1).cast("int"))
    df = src.table(spark, sf_dir, "documents").select(d.alias("id"), F.lit("t").alias("title"), F.lit("s").alias("summary"), "source", F.lit("u").alias("url"), F.lit("us").alias("market"), t.alias("related_tickers"), s.alias("sectors"), sentiment.alias("sentiment"), F.when(d % 2 == 0, "high").otherwise("low").alias("magnitude"))
    return messages.from_model(df).select("id", F.array_join(F.transform("badges", lambda b: F.concat(b["text"], F.lit(":"), b["color"])), "|").alias("marks"))


@query("""WITH p AS (SELECT doc_id AS id, source AS summary, CASE WHEN doc_id % 4 = 0 THEN doc_id % 10 / 10.0 ELSE 0.5 END AS score, CASE WHEN doc_id % 5 = 0 THEN 'sent' WHEN doc_id % 7 = 0 THEN 'failed' ELSE 'pending' END AS push_status FROM documents)
    SELECT id, summary, score, score >= 0.5 AS is_critical, ['r' || id % 3] AS rule_hits, push_status FROM p""")
def processed_rows(spark, sf_dir):
    """Processed articles after an insert, a second insert of every fourth, and two rounds of push results."""
    d, table = F.col("doc_id"), Processed(spark, new_folder(spark, "processed"))
    rows = src.table(spark, sf_dir, "documents").select(d.alias("id"), d.alias("raw_id"), F.col("source").alias("summary"), F.lit(0.5).alias("score"), F.lit(True).alias("is_critical"), F.array(F.concat(F.lit("r"), d % 3)).alias("rule_hits"), F.lit("m").alias("model_used"))
    table.insert(rows, 0)
    score = F.col("id") % 10 / 10
    table.insert(rows.where("id % 4 = 0").withColumns({"score": score, "is_critical": score >= 0.5}), 1)
    status = lambda n, s: rows.where(F.col("id") % n == 0).select("id", F.lit(s).alias("push_status")).unionByName(spark.createDataFrame([(-1, s)], "id long, push_status string"))
    table.mark(status(7, "failed"), 2)
    table.mark(status(5, "sent"), 3)
    return table.table.current().select("id", "summary", "score", "is_critical", "rule_hits", "push_status")


@query("""WITH r AS (SELECT o_custkey AS subject_id, o_orderpriority AS predicate, o_orderkey % 50 AS object_id, o_orderkey % 20 AS source_news_id, max(o_totalprice) AS confidence, arg_max(o_orderdate, o_totalprice) AS valid_from FROM orders GROUP BY ALL),
    v AS (SELECT subject_id, predicate, object_id, source_news_id, CASE WHEN subject_id % 3 = 0 THEN 1.0 ELSE confidence END AS confidence, valid_from FROM r) SELECT subject_id, predicate, object_id, source_news_id, confidence FROM v WHERE valid_from <= TIMESTAMP '1996-01-01'""")
def relation_rows(spark, sf_dir):
    """Relations with confidence and dates, a third of them inserted again, that hold at a time."""
    o, table = src.table(spark, sf_dir, "orders"), Relations(spark, new_folder(spark, "relations"))
    rows = o.select(F.col("o_custkey").alias("subject_id"), F.col("o_orderpriority").alias("predicate"), (F.col("o_orderkey") % 50).alias("object_id"), (F.col("o_orderkey") % 20).alias("source_news_id"), F.col("o_totalprice").alias("confidence"), F.col("o_orderdate").alias("valid_from"))
    table.insert(rows, 0)
    table.insert(table.table.current(1).where("subject_id % 3 = 0").withColumn("confidence", F.lit(1.0)), 1)
    return table.valid(F.lit("1996-01-01").cast("timestamp")).select("subject_id", "predicate", "object_id", "source_news_id", "confidence")


@query(f"""WITH {BARS}, k AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY trade_date DESC) AS k FROM bars WHERE ticker % 5 <> 0 OR ticker % 2 = 0)
    SELECT CAST(ticker AS VARCHAR) AS ticker, CAST(trade_date AS VARCHAR) AS day, close FROM k WHERE k <= CASE WHEN ticker % 2 = 0 AND ticker % 5 = 0 THEN 3 ELSE 8 END""")
def bars_loaded(spark, sf_dir):
    """The last eight bars of every ticker: half of them held with three, the others fetched; for every fifth the fetch has nothing."""
    every = src.daily_bars(src.table(spark, sf_dir, "events")).withColumn("ticker", F.col("ticker").cast("string"))
    last = Window.partitionBy("ticker").orderBy(F.col("trade_date").desc())
    numbered = durable(every.withColumn("_n", F.row_number().over(last)))
    table = DailyBars(spark, new_folder(spark, "bars"))
    table.table.upsert(numbered.where("_n <= 3 AND CAST(ticker AS INT) % 2 = 0"), 0)
    fetch = lambda short: numbered.join(short, "ticker").where("_n <= fetch AND CAST(ticker AS INT) % 5 <> 0").drop("_n", "fetch")
    return table.load(every.select("ticker"), 8, fetch, 1).select("ticker", F.date_format("trade_date", "yyyy-MM-dd").alias("day"), "close")
