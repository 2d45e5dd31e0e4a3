"""Queries behind the desk's commands, prompts with a history, and the load-time checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import desk, enrich, store
from ..sources import articles as src
from .text_queries import ART

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _history_sql(days: int, most: int) -> str:
    return f"""WITH o AS (SELECT o_orderkey AS id, o_custkey AS ticker, o_orderdate AS at, o_orderpriority || ' ' || o_orderkey AS line FROM orders),
    h AS (SELECT a.id, b.line, row_number() OVER (PARTITION BY a.id ORDER BY b.at DESC, b.line) AS k FROM o a JOIN o b ON a.ticker = b.ticker AND b.at < a.at AND b.at >= a.at - INTERVAL {days} DAY)
    SELECT o.id, coalesce(string_agg(h.line, chr(10) ORDER BY k), '') AS history FROM o LEFT JOIN h ON o.id = h.id AND k <= {most} GROUP BY o.id"""


def _with_history(spark, sf_dir, days: int, most: int):
    items = src.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("ticker"), F.col("o_orderdate").alias("at"), F.concat("o_orderpriority", F.lit(" "), F.col("o_orderkey").cast("string")).alias("line"))
    return desk.history(items.select("id", "ticker", "at"), items, days, most).select("id", F.array_join("history", "\n").alias("history"))


@query(_history_sql(7, 5))
def recent_context(spark, sf_dir):
    """The week before each item, for the second tier's prompt."""
    return _with_history(spark, sf_dir, 7, 5)


@query(_history_sql(30, 20))
def deep_analysis_history(spark, sf_dir):
    """The month before each item, for a deep analysis."""
    return _with_history(spark, sf_dir, 30, 20)


@query(f"""WITH {ART}, n AS (SELECT source AS ticker, '• ' || strftime(fetched_at, '%Y-%m-%d %H:%M:%S') || ' ' || substr(coalesce(title, ''), 1, 120) AS line, row_number() OVER (PARTITION BY source ORDER BY fetched_at DESC, id) AS k FROM art)
    SELECT ticker, ticker || ' 近 10 条:' || chr(10) || string_agg(line, chr(10) ORDER BY k) AS reply FROM n WHERE k <= 10 GROUP BY ticker""")
def command_news(spark, sf_dir):
    """The reply to a request for a ticker's news, for every ticker."""
    art = src.articles(src.table(spark, sf_dir, "documents"))
    return desk.news_replies(art.select(F.col("source").alias("ticker"), F.col("fetched_at").alias("at"), "id", F.col("title").alias("summary")))


@query("""WITH c AS (SELECT CAST(ts AS DATE) AS day, sum(user_id * CASE WHEN event_type = 'view' THEN 0.5 WHEN event_type = 'click' THEN 0.25 ELSE 0 END) / 1024 AS cost FROM events GROUP BY 1)
    SELECT strftime(day, '%Y-%m-%d') AS day, cost >= 20 AS reached, cost >= 16 AS warned, '今日 LLM 成本: ' || printf('%.2f', CAST(cost AS DOUBLE)) || ' CNY' || chr(10) || '剩余预算: ' || printf('%.2f', CAST(greatest(0, 20 - cost) AS DOUBLE)) || ' CNY' AS reply FROM c""")
def command_cost(spark, sf_dir):
    """Each day's model budget and the reply that tells it; prices are exact in binary, so that sums agree."""
    calls = src.table(spark, sf_dir, "events").select(F.col("event_type").alias("model"), F.col("ts").alias("at"), F.col("user_id").alias("tokens_in"), F.lit(0).alias("tokens_out"))
    # prices are for a thousand tokens
    prices = spark.createDataFrame([("view", 0.5 * 1000 / 1024, 0.0), ("click", 0.25 * 1000 / 1024, 0.0)], "model string, price_in double, price_out double")
    day = enrich.costs(calls, prices, 20.0)
    return day.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "reached", "warned", desk.cost_reply(F.col("cost"), F.col("remaining")).alias("reply"))


@query("""WITH s AS (SELECT DISTINCT user_id AS source FROM events WHERE user_id % 2 = 0), c AS (SELECT user_id AS source, ts, CASE WHEN event_id % 3 > 0 THEN CAST(event_id % 50 AS INTEGER) END AS minutes FROM events WHERE event_type = 'error'),
    k AS (SELECT source, ts + to_minutes(coalesce(minutes, 30)) AS until, row_number() OVER (PARTITION BY source ORDER BY ts DESC, minutes DESC NULLS LAST) AS k FROM c)
    SELECT coalesce(s.source, k.source) AS source, strftime(until, '%Y-%m-%d %H:%M:%S') AS paused_until, CASE WHEN until IS NOT NULL THEN 'manual_pause' ELSE 'none' END AS error FROM s FULL JOIN (SELECT * FROM k WHERE k = 1) k ON s.source = k.source""")
def command_pause(spark, sf_dir):
    """Source states after pause commands."""
    e = src.table(spark, sf_dir, "events")
    states = e.where("user_id % 2 = 0").select(F.col("user_id").alias("source"), F.lit(None).cast("timestamp_ntz").alias("paused_until"), F.lit("none").alias("error")).distinct()
    commands = e.where("event_type = 'error'").select(F.col("user_id").alias("source"), F.col("ts").alias("at"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 50).cast("int").alias("minutes"))
    return desk.paused(states, commands).withColumn("paused_until", F.date_format("paused_until", "yyyy-MM-dd HH:mm:ss"))


@query("""WITH l AS (SELECT n_regionkey AS region, list_sort(list(n_name) FILTER (regexp_full_match(n_name, '[A-Za-z]+'))) AS us, list_sort(list(lpad(CAST(n_nationkey AS VARCHAR), 6, '0'))) AS cn, [min(n_name), 'NEW', '600000', 'NEW'] AS args FROM nation GROUP BY 1),
    a AS (SELECT region, us, cn, list_filter(['NEW', '600000'], lambda t: NOT list_contains(us, t) AND NOT list_contains(cn, t)) AS new, args FROM l)
    SELECT region, array_to_string(list_concat(us, ['NEW']), ',') AS us, array_to_string(list_concat(cn, ['600000']), ',') AS cn, '已加入: NEW, 600000' AS reply, CASE WHEN list_contains(us, args[1]) THEN '已移除: ' || args[1] ELSE '无变化' END AS unreply FROM a""")
def command_watch(spark, sf_dir):
    """Watchlists after tickers are added; what a removal would say."""
    n = src.table(spark, sf_dir, "nation")
    kept = n.groupBy(F.col("n_regionkey").alias("region")).agg(
        F.array_sort(F.collect_list(F.when(desk.is_us(F.col("n_name")), F.col("n_name")))).alias("us"),
        F.array_sort(F.collect_list(F.lpad(F.col("n_nationkey").cast("string"), 6, "0"))).alias("cn"),
        F.min("n_name").alias("first"),
    )
    us, cn, first = (F.col(c) for c in ("us", "cn", "first"))
    # the first name is known if it is of letters only
    known = F.when(desk.is_us(first), F.array(first)).otherwise(F.array().cast("array<string>"))
    both = kept.select("region", desk.watched(us, cn, F.concat(known, F.array(F.lit("NEW"), F.lit("600000"), F.lit("NEW")))).alias("w"), desk.unwatched(us, cn, F.array(first)).alias("u"))
    return both.select("region", F.array_join("w.us", ",").alias("us"), F.array_join("w.cn", ",").alias("cn"), F.col("w.reply").alias("reply"), F.col("u.reply").alias("unreply"))


@query("""WITH k AS (SELECT lang, list_sort(list(DISTINCT source)) AS us FROM documents GROUP BY lang)
    SELECT lang, '美股: ' || CASE WHEN len(us) = 0 THEN '(空)' ELSE array_to_string(us, ', ') END || chr(10) || 'A股: (空)' || chr(10) || '宏观: ' || lang || chr(10) || '板块: (空)' AS reply FROM k WHERE lang IS NOT NULL""")
def command_list(spark, sf_dir):
    """A watchlist for each language, as a reply."""
    none = F.array().cast("array<string>")
    k = src.table(spark, sf_dir, "documents").where("lang is not null").groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("us"))
    return k.select("lang", desk.listed(F.col("us"), none, F.array("lang"), none).alias("reply"))


@query(r"""WITH w AS (SELECT p_brand AS market, list_sort(list(DISTINCT p_type)) AS ws FROM part GROUP BY 1), m AS (SELECT market, list_concat(ws, ['芯片', 'été']) AS ws FROM w)
    SELECT market, array_to_string(list_filter(ws, lambda x: NOT regexp_matches(x, '[\x{4E00}-\x{9FFF}]')), ',') AS us, array_to_string(list_filter(ws, lambda x: regexp_matches(x, '[\x{4E00}-\x{9FFF}]')), ',') AS cn FROM m""")
def watchlist_migration(spark, sf_dir):
    """Flat keyword lists split by script."""
    w = src.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("market")).agg(F.concat(F.array_sort(F.collect_set("p_type")), F.array(F.lit("芯片"), F.lit("été"))).alias("ws"))
    split = w.select("market", desk.by_script(F.col("ws")).alias("s"))
    return split.select("market", F.array_join("s.us", ",").alias("us"), F.array_join("s.cn", ",").alias("cn"))


@query("""WITH r AS (SELECT p_partkey AS rule_id, CASE WHEN p_size % 2 = 0 THEN p_type END AS ticker, CASE WHEN p_size % 3 = 0 THEN p_brand END AS holding, p_size = 7 AS portfolio FROM part),
    h AS (SELECT DISTINCT p_brand AS ticker FROM part WHERE p_partkey <= 20), w AS (SELECT DISTINCT p_type AS ticker FROM part WHERE p_partkey <= 50)
    SELECT 'error' AS severity, 'unknown holding' AS check, rule_id FROM r WHERE holding IS NOT NULL AND holding NOT IN (SELECT ticker FROM h)
    UNION ALL SELECT 'warning', 'ticker not watched', rule_id FROM r WHERE ticker IS NOT NULL AND ticker NOT IN (SELECT ticker FROM w) UNION ALL SELECT 'error', 'no capital', rule_id FROM r WHERE portfolio""")
def rule_references(spark, sf_dir):
    """Alert rules whose holding, capital or watched ticker is missing."""
    p = src.table(spark, sf_dir, "part")
    rules = p.select(F.col("p_partkey").alias("rule_id"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("ticker"), F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).alias("holding"), (F.col("p_size") == 7).alias("portfolio"))
    named = lambda c, to: p.where(F.col("p_partkey") <= to).select(F.col(c).alias("ticker")).distinct()
    return desk.unresolved(rules, named("p_brand", 20), named("p_type", 50), None)


@query("SELECT event_id AS id, abs(value - 50) >= 45 AS critical FROM events")
def price_move_critical(spark, sf_dir):
    """Items whose price move alone is critical."""
    return src.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), desk.price_move(F.col("value") - 50, 45.0).alias("critical"))


@query("""WITH m AS (SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS name, count(*) AS n FROM events GROUP BY ALL), q AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders UNION SELECT day FROM m)
    SELECT q.day, m.n FROM q LEFT JOIN m ON q.day = m.day AND m.name = 'view'""")
def metric_lookup(spark, sf_dir):
    """A metric's value on every day asked for, null where there is none."""
    e = src.table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    metrics = e.groupBy("day", F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    days = src.table(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day")).union(e.select("day")).distinct()
    return store.looked_up(days.withColumn("name", F.lit("view")), metrics, ["day", "name"]).select("day", "n")


@query("SELECT DISTINCT l_orderkey AS news_id, l_suppkey AS entity_id FROM lineitem WHERE l_suppkey % 2 = 1")
def entity_links(spark, sf_dir):
    """What linking items to entities adds to a table that has the links of even entities; a link is kept once."""
    line = src.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("news_id"), F.col("l_suppkey").alias("entity_id"))
    return store.insert_new(line.where("entity_id % 2 = 0"), line, ["news_id", "entity_id"])


@query("SELECT s_suppkey AS id, s_name AS name FROM supplier")
def entity_by_name(spark, sf_dir):
    """Entities by their name, which must be one's own."""
    return store.unique(src.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")), ["name"]).select("id", "name")


@query("SELECT event_id AS id, user_id % 4 = 0 AS consumed FROM events WHERE event_type = 'purchase'")
def digest_consumed(spark, sf_dir):
    """The digest buffer after what was sent is marked."""
    held = src.table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("id"), "user_id", F.lit(None).cast("timestamp_ntz").alias("consumed_at"))
    done = store.resolve(held, held.where("user_id % 4 = 0"), F.lit("2024-03-01 00:00:00").cast("timestamp_ntz"), "consumed_at")
    return done.select("id", F.col("consumed_at").isNotNull().alias("consumed"))


@query("""WITH c AS (SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN 'chart' ELSE 'sentiment' END AS command, CASE event_id % 3 WHEN 0 THEN [] WHEN 1 THEN ['T' || user_id] ELSE ['T' || user_id, '14'] END AS args FROM events WHERE event_id % 5 <> 0)
    SELECT id, args[1] AS ticker, CASE WHEN len(args) > 0 THEN CASE WHEN command = 'chart' THEN 'kline' ELSE 'sentiment' END END AS kind, CASE WHEN len(args) > 0 THEN CASE WHEN command = 'chart' THEN coalesce(args[2], '30d') ELSE coalesce(args[2], '7') || 'd' END END AS window,
        CASE WHEN len(args) = 0 THEN CASE WHEN command = 'chart' THEN '用法: /chart TICKER [window=30d]' ELSE '用法: /sentiment TICKER [days=7]' END END AS usage FROM c""")
def command_chart(spark, sf_dir):
    """Which chart each command asks for."""
    e, t = src.table(spark, sf_dir, "events"), F.concat(F.lit("T"), F.col("user_id").cast("string"))
    args = F.when(F.col("event_id") % 3 == 0, F.array().cast("array<string>")).when(F.col("event_id") % 3 == 1, F.array(t)).otherwise(F.array(t, F.lit("14")))
    command = F.when(F.col("event_id") % 5 == 0, "news").when(F.col("event_id") % 2 == 0, "chart").otherwise("sentiment")
    return desk.chart_requests(e.select(F.col("event_id").alias("id"), command.alias("command"), args.alias("args"))).select("id", "ticker", "kind", "window", "usage")


_ANSWERS = """a AS (SELECT event_id AS id, user_id AS u, CASE event_id % 5 WHEN 0 THEN 'no' WHEN 1 THEN 'see {"is_critical": true, "reason": "r' || user_id || '"} so' WHEN 2 THEN '{"reason": "x"}' WHEN 3 THEN '{"is_critical": false}' END AS answer FROM events)"""


@query(f"""WITH {_ANSWERS} SELECT id, coalesce(id % 5 = 1, false) AS is_critical, CASE id % 5 WHEN 1 THEN 'r' || u WHEN 2 THEN 'x' ELSE '' END AS reason FROM a""")
def model_judge(spark, sf_dir):
    """A judge's answers; what can't be read isn't critical."""
    e = src.table(spark, sf_dir, "events")
    r = F.col("event_id") % 5
    answer = F.when(r == 0, "no").when(r == 1, F.concat(F.lit('see {"is_critical": true, "reason": "r'), F.col("user_id").cast("string"), F.lit('"} so'))).when(r == 2, '{"reason": "x"}').when(r == 3, '{"is_critical": false}')
    return enrich.judged(e.select(F.col("event_id").alias("id"), answer.alias("answer"))).select("id", "is_critical", "reason")


@query("""SELECT event_id AS id, event_id % 4 <> 0 AND event_id % 2 = 0 AS relevant, CASE WHEN event_id % 4 = 3 THEN 'tier2' ELSE 'tier1' END AS tier_hint, event_id % 4 = 0 AS dead FROM events""")
def title_tier(spark, sf_dir):
    """The first tier's answers with their defaults."""
    r = F.col("event_id") % 4
    answer = F.when(r == 1, "{}").when(r == 2, '{"relevant": true, "reason": "y"}').when(r == 3, '```json {"relevant": false, "tier_hint": "tier2"} ```')
    rows = src.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), answer.alias("answer"))
    return enrich.titled(rows).select("id", "relevant", "tier_hint", "dead")


@query("""SELECT p_partkey AS id, p_brand || '|' || p_type AS entities, CASE WHEN p_size % 2 = 0 THEN p_brand || ' supplies ' || p_type ELSE p_brand || ' mentions ' || p_type END AS relations FROM part WHERE p_size % 3 <> 0 UNION ALL SELECT p_partkey, '', '' FROM part WHERE p_size % 3 = 0""")
def deep_tier(spark, sf_dir):
    """The third tier's answers: nameless entities go, unknown kinds become the default, relations need known ends."""
    p = src.table(spark, sf_dir, "part")
    entity = lambda n: F.struct(F.lit("alien").alias("type"), n.alias("name"))
    relation = lambda a, b: F.struct(a.alias("subject_name"), b.alias("object_name"), F.when(F.col("p_size") % 2 == 0, "SUPPLIES").otherwise("likes").alias("predicate"))
    brand, kind = F.col("p_brand"), F.col("p_type")
    full = F.to_json(F.struct(F.lit("s").alias("summary"), F.array(entity(brand), entity(F.lit("")), entity(kind)).alias("entities"), F.array(relation(brand, kind), relation(brand, F.lit("nobody"))).alias("relations")))
    rows = enrich.deep(p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 == 0, '{"summary": "s"}').otherwise(full).alias("answer")))
    return rows.select("id", F.array_join(F.transform("entities", lambda e: e["name"]), "|").alias("entities"), F.array_join(F.transform("relations", lambda r: F.concat_ws(" ", r["subject"], r["predicate"], r["object"])), ";").alias("relations"))


@query("""WITH c AS (SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN 'claude-' || p_size ELSE 'other-' || p_size END AS m FROM part) SELECT id, 'standard' AS client, CASE WHEN m LIKE 'claude-%' THEN 'cheap' ELSE m END AS model FROM c""")
def model_choice(spark, sf_dir):
    """Which client and model each configured name leads to, without the premium client."""
    name = F.concat(F.when(F.col("p_size") % 2 == 0, "claude-").otherwise("other-"), F.col("p_size").cast("string"))
    return src.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), enrich.chosen_model(name, False, "cheap").alias("c")).select("id", "c.client", "c.model")


@query("""WITH e AS (SELECT event_id, user_id, '/' || event_type AS t FROM events), n AS (SELECT count(*) AS n FROM events WHERE event_type = 'view')
    SELECT event_id, CASE event_id % 10 WHEN 0 THEN '今日 LLM 成本: ' || printf('%.2f', user_id / 4.0) || ' CNY' || chr(10) || '剩余预算: ' || printf('%.2f', greatest(0, 20 - user_id / 4.0)) || ' CNY' WHEN 1 THEN '已暂停 u' || user_id || ' 45 分钟' WHEN 2 THEN '已暂停 u' || user_id || ' 30 分钟'
      WHEN 3 THEN '用法: /pause SOURCE [minutes=30]' WHEN 4 THEN '用法: /pause SOURCE [minutes=30]' WHEN 5 THEN '已发送 digest, 含 ' || n || ' 条' WHEN 6 THEN '用法: /digest now' WHEN 7 THEN 'OK (详情见 healthcheck endpoint)' WHEN 8 THEN '未知命令: ' || t END AS reply FROM e, n""")
def command_replies(spark, sf_dir):
    """Lines from the desk, each answered by its command: cost, pauses, digests, health, unknown ones, and what is no command."""
    e = src.table(spark, sf_dir, "events")
    u = F.col("user_id").cast("string")
    forms = [F.lit("/cost"), F.concat(F.lit(" /pause  u"), u, F.lit(" 45 ")), F.concat(F.lit("/pause u"), u), F.lit("/pause"), F.concat(F.lit("/pause u"), u, F.lit(" soon")), F.lit("/digest now"), F.lit("/digest"), F.lit("/health x"), F.concat(F.lit("/"), "event_type", F.lit(" y")), F.lit("hello")]
    line = F.element_at(F.array(*forms), (F.col("event_id") % 10 + 1).cast("int"))
    cost = F.col("user_id") / 4.0
    views = e.where("event_type = 'view'").agg(F.count(F.lit(1))).scalar()
    handlers = {"cost": lambda args: desk.cost_reply(cost, F.greatest(F.lit(0.0), 20 - cost)), "pause": desk.pause_reply, "digest": lambda args: desk.digest_reply(args, views), "health": lambda args: F.lit(desk.HEALTHY)}
    return e.select("event_id", desk.dispatched(line, handlers).alias("reply"))
