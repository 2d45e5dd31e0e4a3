"""Queries that render messages and prepare charts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching, messages
from ..operators.alerts import rank_market
from ..sources import articles as src
from . import market_queries as mq
from . import text_queries as tq

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _from_rules(spark, sf_dir):
    art = src.articles(src.table(spark, sf_dir, "documents"))
    verdict = matching.verdicts(art, tq.WATCH).where("matched").drop("article_market")
    return messages.from_rules(art.join(verdict, "id"))


LIST = "(list_concat(tickers, related_tickers))"
MSG = f"""{tq.HITS}, msg AS (SELECT art.id, title, CASE WHEN rtrim(substr(coalesce(body, ''), 1, 200)) = '' THEN title ELSE rtrim(substr(coalesce(body, ''), 1, 200)) END AS summary, source, url, art.market,
    list_concat({LIST}[1:5], list_transform(sectors[1:2], lambda s: '#' || s), CASE WHEN len(macros) > 0 THEN ['📊 ' || macros[1]] ELSE [] END) AS marks,
    list_concat(['[原文](' || url || ')'], list_transform({LIST}[1:3], lambda t: CASE WHEN art.market = 'us' THEN '[Yahoo ' || t || '](https://finance.yahoo.com/quote/' || t || ')' ELSE '[东财 ' || t || '](https://quote.eastmoney.com/' || CASE WHEN t LIKE '6%' THEN 'sh' ELSE 'sz' END || t || '.html)' END)) AS links
    FROM art JOIN scored USING (id) WHERE matched)"""


@query(f"WITH {MSG} SELECT id, summary, array_to_string(marks, '|') AS marks, array_to_string(links, ' | ') AS links FROM msg")
def rules_messages(spark, sf_dir):
    """Messages of matched articles in rules mode; the marks without generic words and the mode's own."""
    m = _from_rules(spark, sf_dir)
    marks = F.filter("badges", lambda b: ~b["text"].startswith("🔖 ") & (b["text"] != "rules"))
    links = F.transform("deeplinks", lambda d: F.concat(F.lit("["), d["label"], F.lit("]("), d["url"], F.lit(")")))
    return m.select("id", "summary", F.array_join(F.transform(marks, lambda b: b["text"]), "|").alias("marks"), F.array_join(links, " | ").alias("links"))


_LOW = "lower(coalesce(title, '') || '  ' || coalesce(body, ''))"
_GENERIC = ", ".join(f"{{'e': length(regexp_extract({_LOW}, '(?s)^(.*?" + (f"(?:^|[^a-z0-9])){w.lower()}(?:$|[^a-z0-9])" if w.isascii() else f"){w.lower()}") + f"', 1)) + {len(w)}, 'w': CASE WHEN list_contains(generic_hits, '{w}') THEN '{w}' END}}" for ws in tq.WATCH.generics.values() for w in ws)
FULL = MSG.replace("FROM art JOIN scored USING (id)", f", CASE WHEN len(generic_hits) > 0 THEN ['🔖 ' || list_sort(list_filter([{_GENERIC}], lambda g: g.w IS NOT NULL))[1].w] ELSE [] END AS generics FROM art JOIN scored USING (id)")


@query(f"""WITH {FULL}, b AS (SELECT *, list_concat(marks, generics, ['rules']) AS badges FROM msg), t AS (SELECT *, array_to_string(list_transform(badges, lambda b: '`' || b || '`'), ' ') AS m, array_to_string(links, ' | ') AS l FROM b),
    c AS (SELECT *, CASE WHEN badges[1] LIKE '📊 %' THEN 'yellow' WHEN badges[1] LIKE '🔖 %' OR badges[1] LIKE '#%' THEN 'grey' WHEN badges[1] = 'rules' THEN 'green' ELSE 'blue' END AS colour FROM t)
    SELECT id, '**' || title || '**' || chr(10) || '> ' || source || chr(10) || chr(10) || summary || chr(10) || chr(10) || m || chr(10) || chr(10) || l AS content,
      '{{"msg_type":"interactive","card":{{"header":{{"title":{{"tag":"plain_text","content":' || CAST(to_json(substr(title, 1, 128)) AS VARCHAR) || '}},"template":"' || colour || '"}},"elements":[{{"tag":"div","text":{{"tag":"lark_md","content":'
      || CAST(to_json('**' || summary || '**' || chr(10) || chr(10) || m || chr(10) || chr(10) || l) AS VARCHAR) || '}}}}]}}}}' AS card FROM c""")
def markdown_messages(spark, sf_dir):
    """The same as markdown and as cards, with all marks."""
    return messages.card(messages.markdown(_from_rules(spark, sf_dir))).select("id", "content", "card")


@query(f"""WITH {mq.CONTEXT} SELECT x.ticker, CAST(x.trade_date AS VARCHAR) AS day, CASE WHEN pct < 0 THEN '🔻' WHEN pct > 0 THEN '🚀' ELSE '⚡' END || ' n' || x.ticker || ' (' || x.ticker || ') drop' AS title,
    '⚡ 触发: drop(pct_change <= -60 and price < 20)' || chr(10) || '当前价: ' || printf('%.2f', price) || '  (' || printf('%+.2f', pct) || '%)' || chr(10) || '今日量: ' || printf('%.1f', volume / 10000.0) || '万手' || chr(10) || '⏱ 00:00:00' AS summary
    FROM x JOIN hits USING (ticker, trade_date) WHERE rule_id = 'drop'""")
def alert_messages(spark, sf_dir):
    """Messages of one rule's hits."""
    hits = mq._hits(spark, sf_dir).where("rule_id = 'drop'").withColumns({"name": F.concat(F.lit("n"), F.col("ticker").cast("string")), "expr": F.lit(mq.RULES[0].expr), "volume_ratio": F.lit(0.0), "at": F.col("trade_date").cast("timestamp_ntz")})
    hits = hits.withColumn("ticker", F.col("ticker").cast("string"))
    return messages.alerts(hits).select(F.col("ticker").cast("long").alias("ticker"), F.date_format("trade_date", "yyyy-MM-dd").alias("day"), "title", "summary")


@query(mq.ORACLES["market_scan_topk"].replace("SELECT category, ticker, CAST(rank AS INTEGER) AS rank FROM u WHERE rank <= 5", """, y AS (SELECT category, rank, CASE WHEN category = 'volume_ratio' THEN '- n' || ticker || ' (' || ticker || ') 量比 ' || printf('%.2f', round_even(ratio, 2)) ELSE rank || '. n' || ticker || ' (' || ticker || ')  ' || printf('%+.2f', round_even(pct, 2)) || '%' END AS line FROM u JOIN x USING (ticker) WHERE rank <= 5),
    z AS (SELECT CASE category WHEN 'gainers' THEN 1 WHEN 'losers' THEN 2 ELSE 3 END AS o, CASE category WHEN 'gainers' THEN '🚀 涨幅' WHEN 'losers' THEN '📉 跌幅' ELSE '📈 量比异动' END || ' top ' || count(*) || ':' || chr(10) || string_agg(line, chr(10) ORDER BY rank) AS s FROM y GROUP BY category)
    SELECT coalesce(string_agg(s, chr(10) || chr(10) ORDER BY o), '无异动') AS summary FROM z""").replace(", ticker) ", ", CAST(ticker AS VARCHAR)) "))
def scan_digest(spark, sf_dir):
    """The market scan as one message."""
    scan = mq._scan(spark, sf_dir).withColumns({"name": F.concat(F.lit("n"), F.col("ticker").cast("string")), "ticker": F.col("ticker").cast("string")})
    return messages.scan_digest(rank_market(scan, 1.5, 5))


@query(f"""WITH {mq.BARS}, d AS (SELECT user_id AS ticker, CAST(ts AS DATE) AS trade_date, list(event_type || event_id ORDER BY event_type || event_id) AS titles FROM events WHERE event_type = 'signup' GROUP BY ALL)
    SELECT bars.ticker, CAST(bars.trade_date AS VARCHAR) AS day, titles, CASE WHEN titles IS NOT NULL THEN high * 1.02::DOUBLE END AS mark_at FROM bars LEFT JOIN d USING (ticker, trade_date)""")
def chart_markers(spark, sf_dir):
    """Daily bars with that day's news, for a chart."""
    e = src.table(spark, sf_dir, "events")
    news = e.where("event_type = 'signup'").select(F.col("user_id").alias("ticker"), F.col("ts").alias("published_at"), F.concat("event_type", F.col("event_id").cast("string")).alias("title"))
    return messages.markers(src.daily_bars(e), news).select("ticker", F.date_format("trade_date", "yyyy-MM-dd").alias("day"), "titles", "mark_at")


@query("""WITH t AS (SELECT p_brand AS market, p_type AS ticker, 'size' || p_size AS sector FROM part), k AS (SELECT DISTINCT p_brand AS market, 'size' || p_size AS keyword FROM part WHERE p_size < 45)
    SELECT 'ticker twice' AS check, market || ':' || ticker AS item FROM t GROUP BY market, ticker HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'unknown sector', market || ':' || sector FROM t WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.market = t.market AND k.keyword = t.sector)
    UNION ALL SELECT 'bad holding', s_name FROM supplier WHERE s_acctbal <= 0""")
def config_violations(spark, sf_dir):
    """What the configuration checks find in made-up settings."""
    p = src.table(spark, sf_dir, "part")
    size = F.concat(F.lit("size"), F.col("p_size").cast("string"))
    tickers = p.select(F.col("p_brand").alias("market"), F.col("p_type").alias("ticker"), F.array(size).alias("sectors"))
    keywords = p.where("p_size < 45").select(F.col("p_brand").alias("market"), size.alias("keyword")).distinct()
    holdings = src.table(spark, sf_dir, "supplier").select(F.col("s_name").alias("ticker"), F.col("s_acctbal").alias("qty"), F.lit(1.0).alias("cost_per_share"))
    return messages.violations(tickers, keywords, holdings)


_EXPR = "CASE rule_id " + " ".join(f"WHEN '{r.id}' THEN '{r.expr}'" for r in mq.RULES) + " END"


@query(f"""WITH {mq.CONTEXT}, b AS (SELECT ticker, trade_date, count(*) AS n, string_agg('✓ ' || rule_id || ': ' || {_EXPR}, chr(10) ORDER BY kind_order, rule_id) AS rules FROM hits GROUP BY ticker, trade_date HAVING count(*) > 1)
    SELECT x.ticker, CAST(x.trade_date AS VARCHAR) AS day, CASE WHEN pct < 0 THEN '🔻' WHEN pct > 0 THEN '🚀' ELSE '⚡' END || ' n' || x.ticker || ' (' || x.ticker || ') 多规则触发(x' || n || ')' AS title,
      rules || chr(10) || '当前价: ' || printf('%.2f', round_even(price, 2)) || '  (' || printf('%+.2f', round_even(pct, 2)) || '%)' || chr(10) || '⏱ 00:00:00' AS summary, '#' || x.ticker || ' 多规则x' || n || ' alert' AS badges FROM b JOIN x USING (ticker, trade_date)""")
def burst_messages(spark, sf_dir):
    """Messages of bars on which several rules hold."""
    hits = mq._hits(spark, sf_dir)
    expr = F.element_at(F.create_map(*[F.lit(x) for r in mq.RULES for x in (r.id, r.expr)]), F.col("rule_id"))
    hits = hits.withColumns({"name": F.concat(F.lit("n"), F.col("ticker").cast("string")), "expr": expr, "at": F.col("trade_date").cast("timestamp_ntz")}).withColumn("ticker", F.col("ticker").cast("string"))
    return messages.bursts(hits).select(F.col("ticker").cast("long").alias("ticker"), F.date_format("at", "yyyy-MM-dd").alias("day"), "title", "summary", F.array_join(F.transform("badges", lambda b: b["text"]), " ").alias("badges"))
