"""Operational reports, graph and ad-hoc queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import articles as src

QUERIES, ORACLES = {}, {}
LOG = "log AS (SELECT event_id AS id, event_type AS channel, CASE WHEN value < 10 THEN 'failed' ELSE 'ok' END AS status, ts AS sent_at, user_id AS news_id, value FROM events)"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a push log: a small value is a failure."""
    e = src.table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("channel"), F.when(F.col("value") < 10, "failed").otherwise("ok").alias("status"), F.col("ts").alias("sent_at"), F.col("user_id").alias("news_id"), "value")


def _until_last(df: DataFrame, hours: int, column: str = "sent_at") -> DataFrame:
    """Rows of the last hours before the newest one, whose time is a scalar subquery."""
    return df.where(F.col(column) >= df.agg(F.max(column)).scalar() - F.make_dt_interval(hours=F.lit(hours)))


@query(f"WITH {LOG} SELECT channel, count(*) AS failures FROM log WHERE status = 'failed' AND sent_at >= (SELECT max(sent_at) FROM log) - INTERVAL 24 HOUR GROUP BY channel")
def channel_failures(spark, sf_dir):
    """Failures of each channel in the last day."""
    return _until_last(_log(spark, sf_dir), 24).where("status = 'failed'").groupBy("channel").agg(F.count(F.lit(1)).alias("failures"))


@query(f"WITH {LOG} SELECT count(*) AS failures FROM log WHERE status = 'failed' AND sent_at >= (SELECT max(sent_at) FROM log) - INTERVAL 24 HOUR")
def failures_last_day(spark, sf_dir):
    """Failures of all channels in the last day."""
    return _until_last(_log(spark, sf_dir), 24).where("status = 'failed'").agg(F.count(F.lit(1)).alias("failures"))


@query(f"WITH {LOG} SELECT channel, count(*) AS failures FROM log WHERE status = 'failed' GROUP BY channel HAVING count(*) >= 3")
def failure_alerts(spark, sf_dir):
    return _log(spark, sf_dir).where("status = 'failed'").groupBy("channel").agg(F.count(F.lit(1)).alias("failures")).where("failures >= 3")


@query(f"WITH {LOG} SELECT channel, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'failed') AS failed, round(avg(CASE WHEN status = 'ok' THEN 1.0 ELSE 0.0 END), 9) AS rate FROM log GROUP BY channel")
def push_success_rate(spark, sf_dir):
    ok = F.col("status") == "ok"
    return _log(spark, sf_dir).groupBy("channel").agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.round(F.avg(ok.cast("double")), 9).alias("rate"))


@query(f"WITH {LOG} SELECT channel, status, count(*) AS n FROM log GROUP BY channel, status")
def pushes_by_channel_status(spark, sf_dir):
    return _log(spark, sf_dir).groupBy("channel", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LOG} SELECT strftime(sent_at, '%Y-%m-%d') AS metric_date, 'push_' || status AS metric_name, 'channel=' || channel AS dimensions, CAST(count(*) AS DOUBLE) AS metric_value FROM log GROUP BY ALL")
def daily_metrics(spark, sf_dir):
    """Counters by day, name and dimensions."""
    keys = [F.date_format("sent_at", "yyyy-MM-dd").alias("metric_date"), F.concat(F.lit("push_"), "status").alias("metric_name"), F.concat(F.lit("channel="), "channel").alias("dimensions")]
    return _log(spark, sf_dir).groupBy(*keys).agg(F.count(F.lit(1)).cast("double").alias("metric_value"))


@query(f"""WITH {LOG}, w AS (SELECT * FROM log WHERE sent_at >= (SELECT max(sent_at) FROM log) - INTERVAL 168 HOUR)
    SELECT c.channel, CAST(coalesce(sum(CASE WHEN status = 'ok' THEN 1 END), 0) AS BIGINT) AS sent FROM (SELECT unnest(['view', 'signup', 'purchase', 'error', 'click', 'never']) AS channel) c LEFT JOIN w USING (channel) GROUP BY c.channel""")
def weekly_report(spark, sf_dir):
    """Pushes of the last week for each known channel, zero for those without any."""
    counts = _until_last(_log(spark, sf_dir), 168).where("status = 'ok'").groupBy("channel").agg(F.count(F.lit(1)).alias("n"))
    known = spark.createDataFrame([(c,) for c in ("view", "signup", "purchase", "error", "click", "never")], "channel string")
    return known.join(counts, "channel", "left").select("channel", F.coalesce("n", F.lit(0)).alias("sent"))


@query("SELECT event_type AS kind, count(*) AS n, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_seen FROM events WHERE value < 5 GROUP BY event_type")
def dlq_summary(spark, sf_dir):
    """Open dead letters of each kind, and the newest."""
    e = src.table(spark, sf_dir, "events").where("value < 5")
    return e.groupBy(F.col("event_type").alias("kind")).agg(F.count(F.lit(1)).alias("n"), F.date_format(F.max("ts"), "yyyy-MM-dd HH:mm:ss").alias("last_seen"))


@query("SELECT event_type AS kind, CAST(props::JSON->>'k' AS INTEGER) % 3 AS error, count(*) AS n FROM events WHERE value < 5 GROUP BY ALL")
def dlq_by_kind_error(spark, sf_dir):
    e = src.table(spark, sf_dir, "events").where("value < 5")
    return e.groupBy(F.col("event_type").alias("kind"), (F.get_json_object("props", "$.k").cast("int") % 3).alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 168 HOUR GROUP BY 1")
def rows_per_day(spark, sf_dir):
    return _until_last(src.table(spark, sf_dir, "events"), 168, "ts").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LOG} SELECT id, channel FROM log ORDER BY id DESC LIMIT 20")
def newest_pushes(spark, sf_dir):
    return _log(spark, sf_dir).orderBy(F.col("id").desc()).limit(20).select("id", "channel")


@query("""WITH s AS (SELECT user_id AS source, max(ts) AS last_error FROM events WHERE event_type = 'error' GROUP BY 1) SELECT source FROM s WHERE last_error + INTERVAL 24 HOUR > (SELECT max(ts) FROM events)""")
def paused_sources(spark, sf_dir):
    """Sources whose pause of a day after their last error isn't over."""
    e = src.table(spark, sf_dir, "events")
    now = e.agg(F.max("ts")).scalar()
    last = e.where("event_type = 'error'").groupBy(F.col("user_id").alias("source")).agg(F.max("ts").alias("at"))
    return last.where(F.col("at") + F.make_dt_interval(days=F.lit(1)) > now).select("source")


@query("""WITH c AS (SELECT strftime(ts, '%Y-%m-%d') AS day, ts, event_id, sum(value) OVER (PARTITION BY strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) AS spent FROM events),
    x AS (SELECT day, event_id, spent, row_number() OVER (PARTITION BY day ORDER BY ts, event_id) AS k FROM c WHERE spent >= 5000) SELECT day, event_id, round(spent, 6) AS spent FROM x WHERE k = 1""")
def cost_ceiling_crossing(spark, sf_dir):
    """The call with which each day's running cost reached its ceiling.

    Costs are summed by minute first; only the minute in which a day crosses needs the order of its calls, so no day's calls
    are sorted in one task. Costs aren't negative."""
    e = src.table(spark, sf_dir, "events").select("event_id", "ts", "value", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_trunc("minute", "ts").alias("minute"))
    minutes = e.groupBy("day", "minute").agg(F.sum("value").alias("cost"))
    before = Window.partitionBy("day").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
    minutes = minutes.withColumn("base", F.coalesce(F.sum("cost").over(before), F.lit(0.0))).where((F.col("base") < 5000) & (F.col("base") + F.col("cost") >= 4999.99))
    w = Window.partitionBy("day", "minute").orderBy("ts", "event_id")
    spent = e.join(minutes.select("day", "minute", "base"), ["day", "minute"]).withColumn("spent", F.col("base") + F.sum("value").over(w)).where("spent >= 5000")
    first = spent.groupBy("day").agg(F.min(F.struct("ts", "event_id", "spent")).alias("x"))
    return first.select("day", "x.event_id", F.round("x.spent", 6).alias("spent"))


EDGES = """edges AS (SELECT l_suppkey AS subject_id, 'supplies' AS predicate, l_partkey AS object_id, max(1 - l_discount) AS confidence, max(l_shipdate) AS seen FROM lineitem GROUP BY 1, 3)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph of suppliers and parts."""
    line = src.table(spark, sf_dir, "lineitem")
    return line.groupBy(F.col("l_suppkey").alias("subject_id"), F.col("l_partkey").alias("object_id")).agg(F.max(1 - F.col("l_discount")).alias("confidence"), F.max("l_shipdate").alias("seen"))


@query(f"WITH {EDGES} SELECT s_name AS subject, p_name AS object, object_id, round(confidence, 6) AS confidence FROM edges JOIN supplier ON subject_id = s_suppkey JOIN part ON object_id = p_partkey WHERE subject_id = 7 OR object_id = 7")
def relations_one_hop(spark, sf_dir):
    """What is one edge from an entity, on either side."""
    e = _edges(spark, sf_dir).where("subject_id = 7 or object_id = 7")
    s, p = src.table(spark, sf_dir, "supplier"), src.table(spark, sf_dir, "part")
    return e.join(s, e.subject_id == s.s_suppkey).join(p, e.object_id == p.p_partkey).select(F.col("s_name").alias("subject"), F.col("p_name").alias("object"), "object_id", F.round("confidence", 6).alias("confidence"))


@query("""SELECT o_orderkey AS id, c_name AS name, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_name = (SELECT min(n_name) FROM nation) ORDER BY o_orderdate DESC, o_orderkey LIMIT 10""")
def news_for_ticker(spark, sf_dir):
    """The ten newest items tied to an entity, through its links."""
    o, c, n = (src.table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    one = n.agg(F.min("n_name")).scalar()
    j = o.join(c, o.o_custkey == c.c_custkey).join(n.where(F.col("n_name") == one), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.orderBy(F.col("o_orderdate").desc(), "o_orderkey").limit(10).select(F.col("o_orderkey").alias("id"), F.col("c_name").alias("name"), F.col("o_totalprice").alias("price"))


@query("""SELECT l_orderkey AS id, l_linenumber AS line, s_name AS name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE r_name = (SELECT min(r_name) FROM region) AND l_returnflag = 'R' AND l_shipdate >= (SELECT max(l_shipdate) FROM lineitem) - INTERVAL 2000 DAY""")
def bearish_week(spark, sf_dir):
    """Bad items of an entity in a last stretch of time: four tables."""
    line, s, n, r = (src.table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation", "region"))
    last, first = line.agg(F.max("l_shipdate")).scalar(), r.agg(F.min("r_name")).scalar()
    rows = line.where((F.col("l_returnflag") == "R") & (F.col("l_shipdate") >= last - F.make_dt_interval(days=F.lit(2000))))
    near = s.join(n, s.s_nationkey == n.n_nationkey).join(r.where(F.col("r_name") == first), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.join(near, rows.l_suppkey == near.s_suppkey).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("s_name").alias("name"))


@query("""SELECT p_brand AS name, list_sort(list(DISTINCT p_type)) AS aliases, min(p_partkey) AS entity_id FROM part GROUP BY p_brand""")
def alias_merge(spark, sf_dir):
    """Entities of one name with the union of their aliases; the first id stays."""
    return src.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.array_sort(F.collect_set("p_type")).alias("aliases"), F.min("p_partkey").alias("entity_id"))


@query("""WITH old AS (SELECT o_orderkey AS id, o_orderstatus AS status FROM orders), upd AS (SELECT l_orderkey AS id, 'skipped' AS status, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS k FROM lineitem WHERE l_returnflag = 'R')
    SELECT old.id, coalesce(upd.status, old.status) AS status FROM old LEFT JOIN upd ON old.id = upd.id AND k = 1""")
def status_transition(spark, sf_dir):
    """Rows with the last of their status updates applied; unknown ids are no-ops."""
    w = Window.partitionBy("l_orderkey").orderBy(F.col("l_linenumber").desc())
    upd = src.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").withColumn("k", F.row_number().over(w)).where("k = 1").select(F.col("l_orderkey").alias("id"), F.lit("skipped").alias("new"))
    old = src.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("old"))
    return old.join(upd, "id", "left").select("id", F.coalesce("new", "old").alias("status"))


@query("""SELECT o_orderpriority AS model, count(*) AS n FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 720 HOUR GROUP BY 1""")
def processed_per_model(spark, sf_dir):
    return _until_last(src.table(spark, sf_dir, "orders"), 720, "o_orderdate").groupBy(F.col("o_orderpriority").alias("model")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT substr(sha1(concat_ws('|', CAST(user_id AS VARCHAR), event_type, '30d', props)), 1, 16) AS request, count(*) AS n FROM events GROUP BY 1""")
def chart_request_hash(spark, sf_dir):
    """Chart requests by the hash of what they ask for."""
    h = F.substring(F.sha1(F.concat_ws("|", F.col("user_id").cast("string"), "event_type", F.lit("30d"), "props")), 1, 16)
    return src.table(spark, sf_dir, "events").groupBy(h.alias("request")).agg(F.count(F.lit(1)).alias("n"))
