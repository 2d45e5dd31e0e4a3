"""Queries on articles: scans, normalisation, rules, routing, dedup, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import market, text
from ..operators import dedup, gate, matching
from ..sources import articles as src

ART = """art AS (SELECT doc_id AS id, source, CASE WHEN lang = 'en' THEN 'us' ELSE 'cn' END AS market, 'https://doc/' || doc_id AS url,
    substr(split_part(text, chr(10), 1), 1, 80) AS title, text AS body, TIMESTAMP '2024-01-01 00:00:00' + to_minutes(doc_id) AS fetched_at FROM documents)"""
SINCE = "2024-01-01 08:00:00"

WATCH = matching.Watchlist(
    entries=(
        matching.Entry("us", "THTI", "thonthe", ("ering", "anst"), ("anea",), ("erly",)),
        matching.Entry("us", "ENAT", "onhe", ("inhe",), ("anea", "ndst"), ()),
        matching.Entry("cn", "600519", "zu", ("für",), ("keit",), ("Anea",)),
        matching.Entry("cn", "000858", "les", ("que",), (), ("à",)),
    ),
    sectors={"us": ("anea", "ndst"), "cn": ("keit",)},
    macros={"us": ("erly",), "cn": ("Anea", "pour")},
    generics={"us": ("wherer", "the"), "cn": ("ñ",)},
)


def _values(rows: list[tuple], names: str) -> str:
    lit = lambda v: str(v).lower() if isinstance(v, bool) else "'" + str(v).replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({names})"


HITS = rf"""{ART}, pat AS (SELECT * FROM {_values(WATCH.patterns(), "pattern, is_ascii, kind, pmarket, owner")}),
    tied AS (SELECT * FROM {_values(WATCH.tied(), "kind, word, ticker")}),
    hit AS (SELECT id, kind, pmarket, owner FROM art, pat WHERE CASE WHEN is_ascii = 'true' THEN regexp_matches(lower(coalesce(title, '') || '  ' || coalesce(body, '')), '(^|[^a-z0-9])' || pattern || '($|[^a-z0-9])')
        ELSE contains(lower(coalesce(title, '') || '  ' || coalesce(body, '')), pattern) END),
    verdict AS (SELECT art.id, art.market AS article_market, count(kind) > 0 AS matched,
        coalesce(list_sort(list(DISTINCT owner) FILTER (kind IN ('ticker', 'name', 'alias'))), []) AS tickers, coalesce(list_sort(list(DISTINCT owner) FILTER (kind = 'sector')), []) AS sectors,
        coalesce(list_sort(list(DISTINCT owner) FILTER (kind = 'macro')), []) AS macros, coalesce(list_sort(list(DISTINCT owner) FILTER (kind = 'generic')), []) AS generic_hits, coalesce(list_sort(list(DISTINCT pmarket) FILTER (pmarket IS NOT NULL)), []) AS markets FROM art LEFT JOIN hit USING (id) GROUP BY art.id, art.market),
    rel AS (SELECT hit.id, list_sort(list(DISTINCT ticker)) AS all_related FROM hit JOIN tied ON hit.kind = tied.kind AND lower(hit.owner) = tied.word GROUP BY hit.id),
    scored AS (SELECT v.*, list_filter(coalesce(all_related, []), lambda t: NOT list_contains(tickers, t)) AS related_tickers,
        CAST(least(100, CASE WHEN len(tickers) > 0 THEN 50 ELSE 0 END + CASE WHEN len(sectors) > 0 THEN 20 ELSE 0 END + CASE WHEN len(macros) > 0 THEN 15 ELSE 0 END) AS DOUBLE) AS score_boost FROM verdict v LEFT JOIN rel USING (id))"""

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.articles(src.table(spark, sf_dir, "documents"))


@query(f"WITH {ART} SELECT id, source, market FROM art WHERE fetched_at >= TIMESTAMP '{SINCE}'")
def incremental_scan(spark, sf_dir):
    """Articles from a time on."""
    return src.since(_articles(spark, sf_dir), SINCE).select("id", "source", "market")


@query(f"WITH {ART} SELECT id, title FROM art WHERE id % 3 <> 0 ORDER BY fetched_at, id LIMIT 25")
def pending_batch(spark, sf_dir):
    """The 25 oldest articles that are pending; every third has been processed."""
    return _articles(spark, sf_dir).where("id % 3 <> 0").orderBy("fetched_at", "id").limit(25).select("id", "title")


@query(f"WITH {ART} SELECT source, strftime(max(fetched_at), '%Y-%m-%d %H:%M:%S') AS high_water FROM art GROUP BY source")
def high_water_marks(spark, sf_dir):
    """The newest time of each source."""
    return _articles(spark, sf_dir).groupBy("source").agg(F.date_format(F.max("fetched_at"), "yyyy-MM-dd HH:mm:ss").alias("high_water"))


@query(f"WITH {ART} SELECT id, sha1(url) AS url_hash FROM art")
def url_hash(spark, sf_dir):
    return _articles(spark, sf_dir).select("id", F.sha1("url").alias("url_hash"))


@query(f"WITH {ART} SELECT id, 'https://wire/' || strftime(fetched_at, '%Y%m%d%H%M%S') || '-' || substr(sha1(coalesce(title, '')), 1, 12) AS url FROM art")
def synthetic_url(spark, sf_dir):
    """Urls for items without one."""
    return _articles(spark, sf_dir).select("id", src.synthetic_url("https://wire/", F.col("fetched_at"), F.coalesce("title", F.lit(""))).alias("url"))


@query("SELECT page_id, md5(trim(regexp_replace(html, '<[^>]+>', '', 'g'))) AS text_md5, CAST(length(trim(regexp_replace(html, '<[^>]+>', '', 'g'))) AS BIGINT) AS chars FROM pages")
def html_strip(spark, sf_dir):
    t = text.html_text(F.col("html"))
    return src.table(spark, sf_dir, "pages").select("page_id", F.md5(t.cast("binary")).alias("text_md5"), F.length(t).cast("long").alias("chars"))


@query("SELECT event_id, CAST(props::JSON->>'k' AS INTEGER) AS k FROM events")
def json_extract_best_effort(spark, sf_dir):
    """The object in a text that may hold other things besides."""
    wrapped = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Here: ```json\n"), "props", F.lit("\n``` done"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("so "), "props", F.lit(" ok"))).otherwise(F.col("props"))
    return src.table(spark, sf_dir, "events").select("event_id", text.best_json(wrapped, "struct<k:int>")["k"].alias("k"))


@query("""SELECT lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS ticker, 'SH' AS market, p_name AS name, p_retailprice AS price, p_retailprice AS open, CAST(p_size AS BIGINT) AS volume FROM part WHERE p_partkey % 7 <> 0""")
def quote_text_parse(spark, sf_dir):
    """Quotes from response lines; every seventh line is empty."""
    fields = [F.col("p_name"), *[F.col("p_retailprice")] * 7, F.col("p_size"), F.col("p_retailprice"), *[F.lit("1")] * 20, F.lit("2024-01-02"), F.lit("10:00:00"), F.lit("00")]
    payload = F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.concat_ws(",", *[f.cast("string") for f in fields]))
    lines = src.table(spark, sf_dir, "part").select(F.concat(F.lit("var hq_str_sh"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit('="'), payload, F.lit('";\n')).alias("body"))
    return src.quotes(lines, "body").select("ticker", "market", "name", "price", "open", "volume")


@query("SELECT p_partkey, CASE WHEN c LIKE '60%' OR c LIKE '68%' THEN 'SH' WHEN c LIKE '00%' OR c LIKE '30%' THEN 'SZ' WHEN c[1] IN ('8', '4', '9') THEN 'BJ' ELSE 'SH' END AS exchange FROM (SELECT p_partkey, lpad(CAST(p_partkey * 457 % 1000000 AS VARCHAR), 6, '0') AS c FROM part)")
def market_inference(spark, sf_dir):
    code = F.lpad((F.col("p_partkey") * 457 % 1000000).cast("string"), 6, "0")
    return src.table(spark, sf_dir, "part").select("p_partkey", src.exchange(code).alias("exchange"))


@query(f"WITH {HITS} SELECT id, article_market, matched, tickers, sectors, macros, generic_hits, markets, related_tickers, score_boost FROM scored")
def rules_match_verdict(spark, sf_dir):
    """Keyword rules over title and body of every article, with the verdict and the score."""
    return matching.verdicts(_articles(spark, sf_dir), WATCH).withColumn("generic_hits", F.array_sort(F.array_distinct("generic_hits")))


@query(f"""WITH {HITS}, s AS (SELECT id, least(100.0, score_boost + CASE WHEN id % 5 = 0 THEN 30 ELSE 0 END + CASE WHEN id % 7 = 0 THEN 20 ELSE 0 END + CASE WHEN id % 11 = 0 AND id % 7 <> 0 THEN 25 ELSE 0 END) AS score FROM scored WHERE matched)
    SELECT id, score, CASE WHEN score >= 70 THEN 'critical' WHEN score < 40 THEN 'not_critical' ELSE 'gray' END AS decision FROM s""")
def rules_score(spark, sf_dir):
    """Importance of matched articles: rule weights and the verdict's boost, capped, and the gray zone between 40 and 70."""
    df = matching.verdicts(_articles(spark, sf_dir), WATCH).where("matched")
    df = df.withColumns({"first_party": F.col("id") % 5 == 0, "magnitude": F.lit("low"), "sentiment": F.lit("neutral"), "event_type": F.when(F.col("id") % 7 == 0, "earnings").when(F.col("id") % 11 == 0, "filing").otherwise("other")})
    weight = F.aggregate(matching.importance(df), F.lit(0), lambda n, x: n + x["weight"])
    df = df.withColumn("score", F.least(F.lit(100.0), weight + F.col("score_boost")))
    return df.select("id", "score", matching.decision(F.col("score")).alias("decision"))


@query(f"""WITH {HITS}, m AS (SELECT id, score_boost, unnest(CASE WHEN len(markets) = 0 THEN [article_market] ELSE markets END) AS market FROM scored WHERE matched)
    SELECT id, m.market, channel, score_boost >= 70 AS immediate FROM m JOIN (VALUES ('us', 'push_us'), ('us', 'mail_us'), ('cn', 'push_cn')) AS c(market, channel) ON m.market = c.market""")
def route_markets(spark, sf_dir):
    """Matched articles to the channels of their markets, alert channels aside."""
    df = matching.verdicts(_articles(spark, sf_dir), WATCH).where("matched")
    df = df.select("id", "score_boost", F.explode(F.when(F.size("markets") == 0, F.array("article_market")).otherwise(F.col("markets"))).alias("market"))
    channels = spark.createDataFrame([("us", "push_us"), ("us", "mail_us"), ("us", "desk_alert"), ("cn", "push_cn")], "market string, channel string")
    channels = channels.where(~F.col("channel").endswith("_alert"))
    return df.join(channels, "market").select("id", "market", "channel", (F.col("score_boost") >= 70).alias("immediate"))


@query(f"""WITH {ART} SELECT id, CASE WHEN hour(CASE WHEN market = 'us' THEN (fetched_at AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' ELSE (fetched_at AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Shanghai' END) < 12 THEN 'morning_' ELSE 'evening_' END || market AS digest FROM art""")
def digest_bucket(spark, sf_dir):
    return _articles(spark, sf_dir).select("id", market.digest_key(F.col("fetched_at"), F.col("market")).alias("digest"))


@query(f"""WITH {ART}, d AS (SELECT id, market, title, row_number() OVER (PARTITION BY market ORDER BY fetched_at, id) AS place FROM art) SELECT id, market, title, CAST(place AS INTEGER) AS place FROM d WHERE place <= 30""")
def digest_items_top30(spark, sf_dir):
    """The first 30 items of each market's digest."""
    w = Window.partitionBy("market").orderBy("fetched_at", "id")
    return _articles(spark, sf_dir).withColumn("place", F.row_number().over(w)).where("place <= 30").select("id", "market", "title", "place")


@query("SELECT min(doc_id) AS id, count(*) AS copies FROM documents GROUP BY sha1(coalesce(text, ''))")
def exact_dedup(spark, sf_dir):
    """One article for each distinct text: the first."""
    return src.table(spark, sf_dir, "documents").groupBy(F.sha1(F.coalesce("text", F.lit(""))).alias("h")).agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies")).drop("h")


SIM = rf"""{ART}, t AS (SELECT id, url, fetched_at, trim(title) AS s FROM art),
    f AS (SELECT id, CASE WHEN length(s) < 2 THEN [s] ELSE list_transform(range(1, length(s)), lambda i: substr(s, i, 2)) END AS fs FROM t),
    h AS (SELECT id, len(fs) AS n, list_transform(fs, lambda x: CAST('0x' || substr(md5(x), 17, 16) AS UBIGINT)) AS hs FROM f),
    sim AS (SELECT id, CAST(list_sum(list_transform(range(0, 64), lambda b: CASE WHEN 2 * list_sum(list_transform(hs, lambda x: CAST((x >> CAST(b AS UBIGINT)) & 1 AS INTEGER))) > n THEN CASE WHEN b = 63 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << CAST(b AS INTEGER)) END ELSE 0::HUGEINT END)) AS BIGINT) AS simhash FROM h)"""


def _hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    art = _articles(spark, sf_dir)
    return art.select("id", "fetched_at", F.sha1("url").alias("url_hash"), text.simhash(F.coalesce("title", F.lit(""))).alias("simhash"))


@query(f"WITH {SIM} SELECT id, simhash FROM sim")
def simhash_values(spark, sf_dir):
    return _hashed(spark, sf_dir).select("id", "simhash")


PAIRS = """pairs AS (SELECT b.id AS later, arg_min(a.id, {'t': a.fetched_at, 'i': a.id}) AS earlier, arg_min(bit_count(xor(a.simhash, b.simhash)), {'t': a.fetched_at, 'i': a.id}) AS distance FROM (sim JOIN t USING (id)) a JOIN (sim JOIN t USING (id)) b
    ON (a.fetched_at < b.fetched_at OR (a.fetched_at = b.fetched_at AND a.id < b.id)) AND b.fetched_at <= a.fetched_at + INTERVAL 24 HOUR WHERE bit_count(xor(a.simhash, b.simhash)) <= 4 GROUP BY b.id)"""


@query(f"WITH {SIM}, {PAIRS} SELECT earlier, later, CAST(distance AS INTEGER) AS distance FROM pairs")
def near_dup_pairs(spark, sf_dir):
    """Each title's first neighbour within 4 bits and 24 hours, by a join on bands of the hash."""
    rows = dedup.durable(_hashed(spark, sf_dir))
    return dedup.near_pairs(rows)


@query(f"""WITH RECURSIVE {SIM}, a AS (SELECT id, fetched_at AS t, url AS u, simhash AS h FROM sim JOIN t USING (id)), b AS (SELECT * FROM a UNION ALL SELECT id + 1000000000, t + INTERVAL 40 DAY, u, h FROM a WHERE id % 10 = 0),
    o AS (SELECT *, row_number() OVER (ORDER BY t, id) AS n FROM b),
    r AS (SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS id, '' AS decision, CAST(NULL AS BIGINT) AS duplicate_of, CAST([] AS STRUCT(id BIGINT, t TIMESTAMP, u VARCHAR, h BIGINT)[]) AS acc
      UNION ALL SELECT n, id, CASE WHEN of_url IS NOT NULL THEN 'url_hash' WHEN of_hash IS NOT NULL THEN 'simhash' ELSE 'new' END, coalesce(of_url, of_hash),
        CASE WHEN of_url IS NULL AND of_hash IS NULL THEN list_append(acc, {{'id': id, 't': t, 'u': u, 'h': h}}) ELSE acc END
      FROM (SELECT o.*, r.acc, list_filter(r.acc, lambda x: x.u = o.u)[1].id AS of_url, list_filter(r.acc, lambda x: x.t >= o.t - INTERVAL 24 HOUR AND bit_count(xor(x.h, o.h)) <= 4)[1].id AS of_hash FROM r JOIN o ON o.n = r.n + 1))
    SELECT id, decision, duplicate_of FROM r WHERE n > 0""")
def greedy_dedup(spark, sf_dir):
    """New articles and duplicates by url or title, in order of arrival; every tenth comes again under its url."""
    rows = _hashed(spark, sf_dir)
    again = rows.where("id % 10 = 0").select((F.col("id") + 1_000_000_000).alias("id"), (F.col("fetched_at") + F.make_dt_interval(days=F.lit(40))).alias("fetched_at"), "url_hash", "simhash")
    return dedup.check_and_register(dedup.durable(rows.unionByName(again)))


@query("""WITH c AS (SELECT conv_id, turn, role, ceil(length(coalesce(text, '')) / 4.0) AS tokens FROM conversations)
    SELECT role, CAST(sum(tokens) AS BIGINT) AS tokens, round(sum(tokens * CASE WHEN role = 'user' THEN 0.0003 ELSE 0.0006 END) / 1000, 9) AS cost FROM c GROUP BY role""")
def llm_cost(spark, sf_dir):
    """Tokens and cost of conversations by role."""
    df = src.table(spark, sf_dir, "conversations").select("role", F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4).alias("tokens"))
    price = F.when(F.col("role") == "user", 0.0003).otherwise(0.0006)
    return df.groupBy("role").agg(F.sum("tokens").alias("tokens"), F.round(F.sum(F.col("tokens") * price) / 1000, 9).alias("cost"))


@query(f"""WITH {HITS} SELECT id, CASE WHEN id % 5 = 0 THEN 'tier2' WHEN NOT matched AND id % 2 = 0 THEN 'skip' WHEN len(tickers) > 0 THEN 'tier2' ELSE 'tier1' END AS tier FROM scored""")
def tier_routing(spark, sf_dir):
    """Which model tier an article goes to: first-party 2, irrelevant none, watched 2, else 1."""
    df = matching.verdicts(_articles(spark, sf_dir), WATCH)
    tier = F.when(F.col("id") % 5 == 0, "tier2").when(~F.col("matched") & (F.col("id") % 2 == 0), "skip").when(F.size("tickers") > 0, "tier2").otherwise("tier1")
    return df.select("id", tier.alias("tier"))


@query("""WITH p AS (SELECT l.quality, CASE WHEN len(string_split(d.text, '!!')) > 5 THEN 0 ELSE 1 END AS said FROM labels l JOIN documents d USING (doc_id)) SELECT count(*) AS n, round(avg(CASE WHEN quality = said THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM p""")
def eval_accuracy(spark, sf_dir):
    """How often a simple classifier agrees with the gold labels."""
    df = src.table(spark, sf_dir, "labels").join(src.table(spark, sf_dir, "documents"), "doc_id")
    said = F.when(F.size(F.split("text", "!!")) > 5, 0).otherwise(1)
    return df.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("quality") == said).cast("double")), 9).alias("accuracy"))


@query(f"""WITH {HITS} SELECT id, CASE WHEN len(tickers) > 0 OR id % 5 = 0 THEN 'tier2' ELSE 'tier1' END AS tier FROM scored WHERE matched""")
def matched_tiers(spark, sf_dir):
    """The model tier of articles that the rules matched: 2 with a ticker of its own or from a first-party source."""
    df = matching.verdicts(_articles(spark, sf_dir), WATCH).where("matched")
    return df.select("id", F.when((F.size("tickers") > 0) | (F.col("id") % 5 == 0), "tier2").otherwise("tier1").alias("tier"))


_MODES = (("rules", True, False), ("both", True, True), ("model", False, True))


@query(f"""WITH {HITS}, m AS (SELECT unnest([{{'mode': 'rules', 'r': true, 'l': false}}, {{'mode': 'both', 'r': true, 'l': true}}, {{'mode': 'model', 'r': false, 'l': true}}]) AS m)
    SELECT m.mode AS mode, id, CASE WHEN m.r AND NOT matched THEN 'skipped_rules' WHEN m.l AND id % 17 = 0 THEN 'dead' WHEN m.l AND id % 19 = 0 THEN 'skipped' WHEN id % 23 = 0 THEN 'skipped_grayzone' ELSE 'processed' END AS status FROM scored, m""")
def mode_gate(spark, sf_dir):
    """What becomes of each article with rules only, with both, and with a model only."""
    df = matching.verdicts(_articles(spark, sf_dir), WATCH).select("id", "matched")
    every = lambda n: F.col("id") % n == 0
    each = [F.struct(F.lit(name).alias("mode"), gate.status(r, m, F.col("matched"), every(17), every(19), every(23)).alias("status")) for name, r, m in _MODES]
    return df.select("id", F.inline(F.array(*each))).select("mode", "id", "status")


@query(f"""WITH RECURSIVE {HITS}, x AS (SELECT scored.id, score_boost, list_concat(tickers, related_tickers) AS tickers, fetched_at, unnest(CASE WHEN len(markets) = 0 THEN [article_market] ELSE markets END) AS market FROM scored JOIN art USING (id) WHERE matched),
    p AS (SELECT 2 * id + CASE WHEN market = 'us' THEN 1 ELSE 0 END AS plan, id, fetched_at AS t, score_boost >= 50 AS immediate, tickers FROM x),
    o AS (SELECT *, row_number() OVER (ORDER BY t, plan) AS n FROM p WHERE immediate),
    r AS (SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS plan, CAST(0 AS BIGINT) AS id, true AS sent, CAST([] AS STRUCT(k VARCHAR, t TIMESTAMP)[]) AS held
      UNION ALL SELECT n, plan, id, sent, CASE WHEN sent THEN list_concat(live, list_transform(tickers, lambda x: {{'k': x, 't': t}})) ELSE live END
      FROM (SELECT *, len(list_filter(tickers, lambda x: len(list_filter(live, lambda h: h.k = x)) >= 3)) = 0 AS sent FROM (SELECT o.*, list_filter(r.held, lambda h: h.t >= o.t - INTERVAL 2 HOUR) AS live FROM r JOIN o ON o.n = r.n + 1)))
    SELECT plan, id, CASE WHEN sent THEN 'sent' ELSE 'suppressed' END AS outcome FROM r WHERE n > 0 UNION ALL SELECT min(plan), id, 'digest' FROM p WHERE NOT immediate GROUP BY id""")
def processing_branches(spark, sf_dir):
    """Matched articles by plan: sent, held back by the burst rule, or in the digest."""
    df = matching.verdicts(_articles(spark, sf_dir), WATCH).where("matched").join(_articles(spark, sf_dir).select("id", "fetched_at"), "id")
    df = df.select("id", "fetched_at", "score_boost", F.concat("tickers", "related_tickers").alias("tickers"), F.explode(F.when(F.size("markets") == 0, F.array("article_market")).otherwise(F.col("markets"))).alias("market"))
    plans = df.select((2 * F.col("id") + F.when(F.col("market") == "us", 1).otherwise(0)).alias("plan"), "id", F.col("fetched_at").alias("at"), (F.col("score_boost") >= 50).alias("immediate"), "tickers")
    return gate.pushed(plans, 7200.0, 3)
