"""What operators of the pipeline ask of its tables: counts, newest rows, pending work, states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import store
from ..operators.messages import fixed
from ..sources import articles as src

QUERIES, ORACLES = {}, {}

#: Events as raw items, what was made of them, and where it was sent. A third is not processed; url_hash repeats.
RAW = "raw AS (SELECT event_id AS id, event_type AS source, 'title ' || event_id AS title, user_id % 40 AS url_hash, CASE WHEN event_id % 3 = 0 THEN 'pending' WHEN event_id % 7 = 0 THEN 'dead' ELSE 'processed' END AS status, ts AS fetched_at FROM events)"
PROC = """proc AS (SELECT event_id AS id, event_id AS raw_id, value AS score, value > 90 AS is_critical, CASE WHEN user_id % 2 = 0 THEN 'rules' ELSE 'model-' || user_id % 5 END AS model, CASE WHEN event_id % 4 = 0 THEN 'pending' ELSE 'sent' END AS push_status,
    'hit ' || user_id AS rule_hits, ts + INTERVAL 1 MINUTE AS extracted_at FROM events WHERE event_id % 3 <> 0)"""
SENT = "sent AS (SELECT event_id AS news_id, 'ch' || event_id % 4 AS channel, CASE WHEN value < 10 THEN 'failed' ELSE 'ok' END AS status, ts + INTERVAL 2 MINUTE AS sent_at FROM events WHERE event_id % 5 <> 0)"
LAST = "(SELECT max(fetched_at) FROM raw)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.table(spark, sf_dir, "events")
    status = F.when(F.col("event_id") % 3 == 0, "pending").when(F.col("event_id") % 7 == 0, "dead").otherwise("processed")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("source"), F.concat(F.lit("title "), F.col("event_id").cast("string")).alias("title"), (F.col("user_id") % 40).alias("url_hash"), status.alias("status"), F.col("ts").alias("fetched_at"))


def _proc(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.table(spark, sf_dir, "events").where("event_id % 3 <> 0")
    model = F.when(F.col("user_id") % 2 == 0, "rules").otherwise(F.concat(F.lit("model-"), (F.col("user_id") % 5).cast("string")))
    return e.select(
        F.col("event_id").alias("id"), F.col("event_id").alias("raw_id"), F.col("value").alias("score"), (F.col("value") > 90).alias("is_critical"), model.alias("model"), F.when(F.col("event_id") % 4 == 0, "pending").otherwise("sent").alias("push_status"),
        F.concat(F.lit("hit "), F.col("user_id").cast("string")).alias("rule_hits"), (F.col("ts") + F.make_dt_interval(mins=F.lit(1))).alias("extracted_at"),
    )


def _sent(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = src.table(spark, sf_dir, "events").where("event_id % 5 <> 0")
    return e.select(F.col("event_id").alias("news_id"), F.concat(F.lit("ch"), (F.col("event_id") % 4).cast("string")).alias("channel"), F.when(F.col("value") < 10, "failed").otherwise("ok").alias("status"), (F.col("ts") + F.make_dt_interval(mins=F.lit(2))).alias("sent_at"))


def _stamp(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed items with their raw ones."""
    raw = _raw(spark, sf_dir).select(F.col("id").alias("raw_id"), "source", "title", "status", "fetched_at")
    return _proc(spark, sf_dir).join(raw, "raw_id")


@query(f"WITH {RAW} SELECT source, count(*) AS n, count(*) FILTER (status = 'processed') AS processed FROM raw WHERE CAST(fetched_at AS DATE) = CAST({LAST} AS DATE) GROUP BY source")
def source_counts_today(spark, sf_dir):
    """Items of the last day by source, and how many were processed."""
    r = _raw(spark, sf_dir)
    today = r.where(F.to_date("fetched_at") == F.to_date(r.agg(F.max("fetched_at")).scalar()))
    return today.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "processed").alias("processed"))


@query(f"""WITH {RAW} SELECT source, count(*) FILTER (CAST(fetched_at AS DATE) = CAST({LAST} AS DATE)) AS today, count(*) FILTER (fetched_at >= {LAST} - INTERVAL 30 MINUTE) AS last_30_min, count(*) FILTER (fetched_at >= {LAST} - INTERVAL 1 HOUR) AS last_hour
    FROM raw WHERE fetched_at >= {LAST} - INTERVAL 24 HOUR GROUP BY source""")
def source_counts_recent(spark, sf_dir):
    """Items by source: today, in the last 30 minutes, in the last hour; one pass over the last day."""
    r = _raw(spark, sf_dir)
    last = r.agg(F.max("fetched_at")).scalar()
    since = lambda minutes: F.col("fetched_at") >= last - F.make_dt_interval(mins=F.lit(minutes))
    day = r.where(since(1440)).groupBy("source")
    return day.agg(F.count_if(F.to_date("fetched_at") == F.to_date(last)).alias("today"), F.count_if(since(30)).alias("last_30_min"), F.count_if(since(60)).alias("last_hour"))


@query(f"WITH {RAW} SELECT count(*) AS n, count(*) > 0 AS alive FROM raw WHERE fetched_at >= {LAST} - INTERVAL 30 MINUTE")
def recent_items(spark, sf_dir):
    """How many items the last 30 minutes brought, and whether any: the health check."""
    r = _raw(spark, sf_dir)
    recent = r.where(F.col("fetched_at") >= r.agg(F.max("fetched_at")).scalar() - F.make_dt_interval(mins=F.lit(30)))
    return recent.agg(F.count(F.lit(1)).alias("n")).withColumn("alive", F.col("n") > 0)


@query(f"WITH {RAW}, {PROC} SELECT proc.id, title, score FROM proc JOIN raw ON raw_id = raw.id WHERE is_critical ORDER BY extracted_at DESC, proc.id DESC LIMIT 20")
def newest_critical(spark, sf_dir):
    """The twenty newest critical items with their titles."""
    return _joined(spark, sf_dir).where("is_critical").orderBy(F.col("extracted_at").desc(), F.col("id").desc()).limit(20).select("id", "title", "score")


@query(f"WITH {RAW}, {PROC} SELECT proc.id, source, title FROM proc JOIN raw ON raw_id = raw.id WHERE is_critical AND CAST(extracted_at AS DATE) = CAST((SELECT max(extracted_at) FROM proc) AS DATE)")
def critical_today(spark, sf_dir):
    p = _joined(spark, sf_dir)
    day = F.to_date(_proc(spark, sf_dir).agg(F.max("extracted_at")).scalar())
    return p.where(F.col("is_critical") & (F.to_date("extracted_at") == day)).select("id", "source", "title")


@query(f"WITH {PROC} SELECT model, count(*) AS n, count(*) FILTER (is_critical) AS critical FROM proc GROUP BY model")
def critical_counts(spark, sf_dir):
    return _proc(spark, sf_dir).groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_critical").alias("critical"))


@query("SELECT event_id AS id, event_type AS kind, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events WHERE value < 5 AND user_id % 3 <> 0 ORDER BY ts DESC, event_id DESC LIMIT 50")
def open_dead_letters(spark, sf_dir):
    """The fifty newest dead letters that nobody resolved."""
    letters = src.table(spark, sf_dir, "events").where("value < 5").withColumn("resolved_at", F.when(F.col("user_id") % 3 == 0, F.col("ts"))).where("resolved_at is null")
    return store.newest(letters, 50, "ts", "event_id").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), _stamp("ts").alias("at"))


@query(f"WITH {RAW}, {PROC} SELECT title, round(score, 4) AS score, is_critical, rule_hits, model FROM proc JOIN raw ON raw_id = raw.id ORDER BY extracted_at DESC, proc.id DESC LIMIT 10")
def decisions_explained(spark, sf_dir):
    """The last ten decisions with what led to them."""
    p = _joined(spark, sf_dir).orderBy(F.col("extracted_at").desc(), F.col("id").desc()).limit(10)
    return p.select("title", F.round("score", 4).alias("score"), "is_critical", "rule_hits", "model")


@query(f"WITH {RAW}, {PROC} SELECT proc.id, source, status, title FROM proc JOIN raw ON raw_id = raw.id ORDER BY extracted_at DESC, proc.id DESC LIMIT 20")
def newest_processed(spark, sf_dir):
    return _joined(spark, sf_dir).orderBy(F.col("extracted_at").desc(), F.col("id").desc()).limit(20).select("id", "source", "status", "title")


@query(f"""WITH {RAW}, {PROC}, {SENT} SELECT source, count(*) AS n, count(*) FILTER (sent.status = 'ok') AS ok FROM sent JOIN proc ON news_id = proc.id JOIN raw ON raw_id = raw.id
    WHERE CAST(sent_at AS DATE) = CAST((SELECT max(sent_at) FROM sent) AS DATE) GROUP BY source""")
def pushes_per_source_today(spark, sf_dir):
    """The last day's pushes by the source of what was pushed."""
    s = _sent(spark, sf_dir)
    today = s.where(F.to_date("sent_at") == F.to_date(s.agg(F.max("sent_at")).scalar())).withColumnRenamed("status", "outcome")
    j = today.join(_joined(spark, sf_dir).withColumnRenamed("id", "news_id"), "news_id")
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "ok").alias("ok"))


@query(f"""WITH {SENT}, b AS (SELECT CAST(max(sent_at) AS DATE) AS d FROM sent), w AS (SELECT d + CAST((7 - dayofweek(d)) % 7 AS INTEGER) - 7 AS since FROM b)
    SELECT channel, status, count(*) AS n FROM sent WHERE CAST(sent_at AS DATE) >= (SELECT since FROM w) GROUP BY channel, status""")
def pushes_week_to_date(spark, sf_dir):
    """Pushes since seven days before the coming Sunday, or before today if it is one."""
    s = _sent(spark, sf_dir)
    day = F.to_date(s.agg(F.max("sent_at")).scalar())
    return s.where(F.to_date("sent_at") >= F.date_sub(F.next_day(F.date_sub(day, 1), "Sun"), 7)).groupBy("channel", "status").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT event_type || ':' || user_id % 20 AS alert, strftime(max(ts) + INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S') AS local_time, count(*) AS triggers FROM events WHERE event_type = 'error' GROUP BY 1""")
def alert_states_latest(spark, sf_dir):
    """When each alert fired last, in UTC+8, and how often."""
    e = src.table(spark, sf_dir, "events").where("event_type = 'error'").select(F.concat_ws(":", "event_type", (F.col("user_id") % 20).cast("string")).alias("alert"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("epoch"))
    local = F.date_format(F.from_utc_timestamp(F.timestamp_seconds(F.max("epoch")), "+08:00"), "yyyy-MM-dd HH:mm:ss")
    return e.groupBy("alert").agg(local.alias("local_time"), F.count(F.lit(1)).alias("triggers"))


@query("SELECT n_nationkey AS rule, CAST(n_nationkey % 4 + coalesce(k, 0) AS BIGINT) AS count_today FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS k FROM customer WHERE c_acctbal < 0 GROUP BY 1) ON c_nationkey = n_nationkey")
def alert_state_bump(spark, sf_dir):
    """Trigger counts after held-back hits were added; hits of unknown alerts change nothing."""
    held = src.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("rule_id"), F.lit("t").alias("ticker"), (F.col("n_nationkey") % 4).cast("long").alias("count_today"))
    hits = src.table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("rule_id"), F.lit("t").alias("ticker"))
    unknown = hits.limit(1).select(F.lit(-1).cast("int").alias("rule_id"), "ticker")
    return store.bumped(held, hits.unionByName(unknown)).select(F.col("rule_id").alias("rule"), "count_today")


@query("""WITH s AS (SELECT user_id AS source, max(ts) AS last_at, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1) SELECT source, CASE WHEN source % 5 = 0 THEN NULL ELSE strftime(last_at + INTERVAL 24 HOUR, '%Y-%m-%d %H:%M:%S') END AS paused_until, CASE WHEN source % 5 = 0 THEN 0 ELSE errors END AS errors FROM s""")
def paused_reset(spark, sf_dir):
    """Source states after some were reset: no pause, no errors."""
    e = src.table(spark, sf_dir, "events").where("event_type = 'error'").groupBy(F.col("user_id").alias("source")).agg((F.max("ts") + F.make_dt_interval(days=F.lit(1))).alias("paused_until"), F.count(F.lit(1)).alias("errors"))
    reset = e.where("source % 5 = 0").select("source")
    return store.reset(e, reset, "source").withColumn("paused_until", _stamp("paused_until"))


@query(f"WITH {PROC} SELECT id FROM proc WHERE push_status = 'pending' ORDER BY extracted_at, id LIMIT 100")
def pending_pushes(spark, sf_dir):
    """The hundred items that have waited longest to be pushed."""
    return _proc(spark, sf_dir).where("push_status = 'pending'").orderBy("extracted_at", "id").limit(100).select("id")


@query(f"""WITH {RAW}, k AS (SELECT *, row_number() OVER (PARTITION BY url_hash ORDER BY fetched_at, id) AS k FROM raw) SELECT source, strftime(fetched_at, '%Y-%m-%d') AS day, count(*) FILTER (k = 1) AS new, count(*) FILTER (k > 1) AS dup FROM k GROUP BY ALL""")
def new_dup_counts(spark, sf_dir):
    """New items and duplicates by source and day; the first of a url is new. The first is an aggregate that is joined back."""
    r = _raw(spark, sf_dir)
    first = r.groupBy("url_hash").agg(F.min(F.struct("fetched_at", "id")).alias("first")).select(F.col("first.id").alias("id"), F.lit(True).alias("is_new"))
    n = r.join(first, "id", "left").groupBy("source", F.date_format("fetched_at", "yyyy-MM-dd").alias("day"))
    return n.agg(F.count_if("is_new").alias("new"), F.count_if(F.col("is_new").isNull()).alias("dup"))


@query("""WITH c AS (SELECT strftime(ts, '%Y-%m-%d') AS day, sum(user_id) / 1024.0 AS cost FROM events GROUP BY 1) SELECT day, printf('%.4f', cost) AS cost FROM c ORDER BY day DESC LIMIT 7""")
def cost_text(spark, sf_dir):
    """The last seven days' costs as text."""
    c = src.table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg((F.sum("user_id") / 1024.0).cast("double").alias("cost"))
    return c.orderBy(F.col("day").desc()).limit(7).select("day", fixed("cost", 4).alias("cost"))


@query("""WITH m AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS name, count(*) AS value FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY ALL) SELECT day, name, value FROM m ORDER BY day DESC, name LIMIT 12""")
def metrics_week(spark, sf_dir):
    """The last week's counters, newest day first and then by name; the first twelve."""
    e = src.table(spark, sf_dir, "events")
    m = e.where(F.col("ts") >= e.agg(F.max("ts")).scalar() - F.make_dt_interval(days=F.lit(7))).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("value"))
    return m.orderBy(F.col("day").desc(), "name").limit(12)


@query(f"""WITH {RAW}, {SENT}, k AS (SELECT unnest(['view', 'click', 'never']) AS name), l AS (SELECT unnest(['ch1', 'ch9']) AS name)
    SELECT 'source' AS kind, name, count(raw.id) AS n FROM k LEFT JOIN raw ON source = name AND fetched_at >= {LAST} - INTERVAL 7 DAY GROUP BY name
    UNION ALL SELECT 'channel', name, count(sent.news_id) FROM l LEFT JOIN sent ON channel = name AND status = 'ok' AND sent_at >= (SELECT max(sent_at) FROM sent) - INTERVAL 7 DAY GROUP BY name""")
def weekly_totals(spark, sf_dir):
    """The last week's items of each known source and pushes of each known channel, zero for those without any."""
    r, s = _raw(spark, sf_dir), _sent(spark, sf_dir)
    week = lambda df, c: df.where(F.col(c) >= df.agg(F.max(c)).scalar() - F.make_dt_interval(days=F.lit(7)))
    items = store.zero_filled(week(r, "fetched_at"), "source", ["view", "click", "never"]).withColumn("kind", F.lit("source"))
    pushes = store.zero_filled(week(s, "sent_at").where("status = 'ok'"), "channel", ["ch1", "ch9"]).withColumn("kind", F.lit("channel"))
    return items.unionByName(pushes).select("kind", "name", "n")


@query(f"""WITH {RAW}, {PROC} SELECT b.event_id AS id, title, score FROM (SELECT event_id FROM events WHERE event_type = 'purchase') b JOIN proc ON proc.id = b.event_id JOIN raw ON raw_id = raw.id WHERE raw.status <> 'dead'""")
def digest_join(spark, sf_dir):
    """A digest's buffer with the items it names; those that are gone are skipped."""
    buffer = src.table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("id"))
    return buffer.join(_joined(spark, sf_dir).where("status <> 'dead'"), "id").select("id", "title", "score")


@query("""SELECT p_partkey AS id, substr(url_encode(p_name || ' / ' || p_brand || '#é'), 1, 40) AS segment FROM part""")
def percent_encoded(spark, sf_dir):
    """Names as segments of an alert's path, 40 characters at most."""
    return src.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.path_segment(F.concat("p_name", F.lit(" / "), "p_brand", F.lit("#é")), 40).alias("segment"))


@query(f"WITH {RAW} SELECT id FROM raw WHERE fetched_at >= {LAST} - INTERVAL 1 DAY AND url_hash % 3 <> 0")
def late_drop(spark, sf_dir):
    """A scan that reads its overlap again: what is before the mark is dropped, what is held already is removed."""
    r = _raw(spark, sf_dir)
    held = r.where("url_hash % 3 = 0").select("url_hash").distinct()
    return r.where(F.col("fetched_at") >= r.agg(F.max("fetched_at")).scalar() - F.make_dt_interval(days=F.lit(1))).join(held, "url_hash", "left_anti").select("id")


@query("""WITH w AS (SELECT p_brand AS market, p_size % 2 = 0 AS by_rules, p_type AS ticker FROM part), e AS (SELECT market, count(*) FILTER (by_rules) > 10 AS rules_on FROM w GROUP BY market)
    SELECT DISTINCT market, ticker FROM w JOIN e USING (market) WHERE by_rules = rules_on""")
def effective_watchlist(spark, sf_dir):
    """The tickers a market is watched for: the rules' list where rules are on, the model's list elsewhere."""
    w = src.table(spark, sf_dir, "part").select(F.col("p_brand").alias("market"), (F.col("p_size") % 2 == 0).alias("by_rules"), F.col("p_type").alias("ticker"))
    on = w.groupBy("market").agg((F.count_if("by_rules") > 10).alias("rules_on"))
    return store.effective(w, on).distinct()
