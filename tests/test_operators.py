import random

import pytest
from pyspark.sql import functions as F

from tickloom.functions import market, text
from tickloom.operators import alerts, asof, dedup, gate, indicators, matching, state, store
from tickloom.sources import articles as src
from tickloom.sources import snapshots


def column(spark, expression, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {v}" for k, v in {k: {int: "long", float: "double", str: "string", list: "array<double>"}[type(v)] for k, v in values.items()}.items()))
    return row.select(expression.alias("x")).first().x


def test_simhash(spark):
    titles = ["NVDA earnings beat estimates", "NVDA earning beat estimates", "贵州茅台公布业绩", "a", "", "  　a ", "🚀 up"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "id long, t string").select("id", text.simhash(F.col("t")).alias("h"))
    h = {r.id: r.h for r in df.collect()}
    assert bin((h[0] ^ h[1]) & (1 << 64) - 1).count("1") == 5
    assert h[3] == h[5] and all(-(1 << 63) <= x < 1 << 63 for x in h.values())
    assert column(spark, text.hamming(F.col("a"), F.col("b")), a=-1, b=0) == 64


def sequential(rows, distance, hours):
    kept, out = [], {}
    for i, url, sim, minute in sorted(rows, key=lambda r: (r[3], r[0])):
        same = [k for k in kept if k[1] == url]
        near = [k for k in kept if minute - k[3] <= hours * 60 and bin((k[2] ^ sim) & (1 << 64) - 1).count("1") <= distance]
        out[i] = "url_hash" if same else "simhash" if near else "new"
        if out[i] == "new":
            kept.append((i, url, sim, minute))
    return out


def test_check_and_register_is_the_sequential_rule(spark):
    rnd = random.Random(4)
    centres = [rnd.getrandbits(64) for _ in range(12)]
    rows = []
    for i in range(260):
        sim = rnd.choice(centres)
        for _ in range(rnd.randrange(6)):
            sim ^= 1 << rnd.randrange(64)
        rows.append((i, f"u{rnd.randrange(90)}", sim - (1 << 64) if sim >> 63 else sim, rnd.randrange(4000)))
    df = spark.createDataFrame(rows, "id long, url_hash string, simhash long, minute int")
    df = df.select("id", "url_hash", "simhash", src.minutes_after("2024-01-01 00:00:00", F.col("minute")).alias("fetched_at"))
    got = {r.id: r.decision for r in dedup.check_and_register(df, 4, 24).collect()}
    assert got == sequential(rows, 4, 24)


def test_matches(spark):
    patterns = [("nvda", True), ("茅台", False), ("ai", True), ("ai", True), ("aa", False)]
    texts = ["ENVDAQ", "(NVDA), nvda_x", "贵州茅台", "AI 2", "xaaay aAi", None, "中ai文"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    got = {r.id: [(m["pattern"], m["start"], m["end"]) for m in r.m] for r in df.select("id", matching.find_all(matching.compiled(spark, patterns))("t").alias("m")).collect()}
    assert got == {0: [], 1: [(0, 1, 4), (0, 8, 11)], 2: [(1, 2, 3)], 3: [(2, 0, 1), (3, 0, 1)], 4: [(4, 1, 2), (4, 2, 3), (4, 6, 7)], 5: [], 6: [(2, 1, 2), (3, 1, 2)]}


def test_verdicts(spark):
    watch = matching.Watchlist((matching.Entry("us", "NVDA", "Nvidia", ("CUDA",), ("AI",), ()), matching.Entry("cn", "600519", "茅台", (), (), ("FOMC",))), {"us": ("AI",)}, {"us": ("FOMC",)}, {"us": ("beat",)})
    df = spark.createDataFrame([(1, "us", "FOMC加息影响A股茅台", None), (2, "us", "ai beat", "beat"), (3, "us", "nothing", ""), (4, "us", "Nvidia", "CUDA AI FOMC")], "id long, market string, title string, body string")
    got = {r.id: r for r in matching.verdicts(df, watch).collect()}
    assert (got[1].tickers, got[1].markets, got[1].macros, got[1].score_boost) == (["600519"], ["cn", "us"], ["FOMC"], 65)
    assert (got[2].tickers, got[2].related_tickers, got[2].generic_hits, got[2].score_boost) == ([], ["NVDA"], ["beat", "beat"], 20)
    assert not got[3].matched and got[3].markets == []
    assert got[4].score_boost == 85 and got[4].related_tickers == ["600519"]


CASES = [
    ("price > 1 and volume > 0", True), ("price > 1 or nothing > 0", True), ("nothing > 0 or price > 1", False), ("missing < 1 or True", False), ("True or missing < 1", True),
    ("price / zero > 1", False), ("price / zero > 1 or True", False), ("not zero", True), ("zero", False), ("1 < price < 3", True), ("1 < price < 2", False), ("price == 2", True), ("missing == None", True), ("missing != 1", True),
    ("abs(-price) == 2 and max(price, 5) == 5 and min(price, 5) == 2", True), ("5 if price > 1 else nothing", True), ("-price + 3 * 2 - 1 % 4 == 3", True), ("unknown(1)", False), ("twice(price) == 4", True), ("price >\n 1\n and volume > 0", True), ("-7 % 3 == 2", True), ("__import__('os') or True", False),
]


@pytest.mark.parametrize("rule, expected", CASES)
def test_rules_compile(spark, rule, expected):
    df = spark.createDataFrame([(2.0, 10, None, 0)], "price double, volume long, missing double, zero int")
    assert df.select(alerts.compile_rule(rule, set(df.columns), {"twice": lambda c: 2 * c}).alias("x")).first().x is expected


@pytest.mark.parametrize("rule", ["price >", "price.real", "[1]", "lambda: 1", "a := 1", "f'{price}'"])
def test_rules_reject(rule):
    with pytest.raises(ValueError):
        alerts.compile_rule(rule, {"price"})


def test_one_bad_rule_rejects_all():
    good = alerts.Rule("a", "threshold", "price > 1")
    for bad in (alerts.Rule("a", "event", "price > 2"), alerts.Rule("b", "event", "price >"), alerts.Rule("b", "never", "price > 1")):
        with pytest.raises(ValueError):
            alerts.validated([good, bad])


def test_folds(spark):
    values = F.col("v")
    assert column(spark, indicators.rsi(values, 14), v=[float(i) for i in range(20)]) == 100
    assert column(spark, indicators.rsi(values, 14), v=[float(-i) for i in range(20)]) == 0
    assert column(spark, indicators.rsi(values, 14), v=[5.0] * 15) == 100
    assert column(spark, indicators.rsi(values, 14), v=[5.0] * 14) is None
    assert column(spark, indicators.macd(values), v=[1.0] * 34) is None
    assert tuple(column(spark, indicators.macd(values), v=[1.0] * 35)) == (0, 0, 0)
    assert column(spark, indicators.ema(values, 3), v=[2.0, 4.0, 8.0]) == 5.5


def test_means_and_crossings(spark):
    closes = [100.0] * 30 + [200.0]
    df = spark.createDataFrame([("t", i, c) for i, c in enumerate(closes)], "ticker string, trade_date int, close double")
    w = indicators.by()
    df = df.withColumns({"ma5": indicators.sma(F.col("close"), 5, w), "ma20": indicators.sma(F.col("close"), 20, w)})
    rows = df.withColumn("up", indicators.cross_above(F.col("ma5"), F.col("ma20"), w)).orderBy("trade_date").collect()
    assert (rows[-1].ma5, rows[-1].ma20, rows[-1].up) == (120, 105, True) and rows[3].ma5 is None and not rows[-2].up


def test_cooldown(spark):
    times = [1000, 1500, 2800, 2900, 4700]
    df = spark.createDataFrame([("r", "t", t) for t in times] + [("r", "u", 5)], "rule string, ticker string, epoch long")
    got = state.cooldown_fires(df, ["rule", "ticker"], 1800).where("fired and ticker = 't'").orderBy("epoch").collect()
    assert [r.epoch for r in got] == [1000, 2800, 4700]
    assert state.cooldown_fires(df.limit(0), ["rule", "ticker"], 1800).count() == 0


def sent(spark, rows, window, threshold):
    df = spark.createDataFrame([(i, t, list(names)) for i, (t, names) in enumerate(rows)], "id long, epoch double, tickers array<string>")
    return [r.sent for r in state.burst(df.repartition(3), window, threshold).orderBy("id").collect()]


def suppressed(rows, window, threshold):
    held, out = {}, []
    for now, names in rows:
        for t in names:
            held[t] = [x for x in held.get(t, []) if x >= now - window]
        out.append(not any(len(held[t]) >= threshold for t in names))
        if out[-1]:
            for t in names:
                held[t].append(now)
    return out


def test_burst(spark):
    times = [0.0, 1.0, 2.0, 3.0, 100.0, 300.0, 301.0]
    assert sent(spark, [(t, ("a",)) for t in times], 300, 3) == [True, True, True, False, False, False, True]
    assert sent(spark, [(0.0, ("a",)), (1.0, ("b",)), (2.0, ("a", "b")), (3.0, ("b",))], 300, 2) == [True, True, True, False]
    assert sent(spark, [(0.0, ())] * 4, 300, 1) == [True] * 4
    rnd = random.Random(6)
    rows = [(float(i * 7), tuple(rnd.sample("abcdefghijkl", rnd.choice([0, 1, 1, 2])))) for i in range(300)]
    assert sent(spark, rows, 60, 2) == suppressed(rows, 60, 2)


def test_top_k_ties_and_nulls(spark):
    rows = [("b", 9.0, None), ("a", 9.0, 8.0), ("c", -8.0, 7.9), ("d", -8.1, 20.0), ("e", 8.0, 9.0)]
    df = spark.createDataFrame(rows, "ticker string, pct_change double, volume_ratio double")
    got = [tuple(r) for r in alerts.rank_market(df, 8.0, 2).select("category", "rank", "ticker").orderBy("category", "rank").collect()]
    assert got == [("gainers", 1, "a"), ("gainers", 2, "b"), ("losers", 1, "d"), ("volume_ratio", 1, "d"), ("volume_ratio", 2, "e")]


def test_asof(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t int")
    right = spark.createDataFrame([("a", 1, 10.0), ("a", 4, 40.0), ("a", 5, 50.0)], "k string, d int, v double")
    got = {(r.k, r.t): r.v for r in asof.prior(left, right, "k", "t", "d", ["v"]).collect()}
    assert got == {("a", 5): 40.0, ("a", 1): None, ("b", 9): None}


@pytest.mark.parametrize("at, session, open_cn, open_us", [
    ("2024-01-02 01:29:00", "pre", False, False), ("2024-01-02 01:30:00", "morning", True, False), ("2024-01-02 03:30:00", "noon_break", True, False), ("2024-01-02 05:00:00", "afternoon", True, False),
    ("2024-01-02 07:00:00", "post", True, False), ("2024-01-02 07:01:00", "post", False, False), ("2024-01-06 02:00:00", "closed", False, False), ("2024-01-02 14:30:00", "post", False, True), ("2024-01-02 21:01:00", "pre", False, False),
])
def test_sessions(spark, at, session, open_cn, open_us):
    t = F.col("t").cast("timestamp_ntz")
    df = spark.createDataFrame([(at,)], "t string").select(market.session(t).alias("s"), market.is_open(t, "cn").alias("cn"), market.is_open(t, "us").alias("us"))
    assert tuple(df.first()) == (session, open_cn, open_us)


def test_sources(spark):
    body = 'var hq_str_sh600519="茅台,' + ",".join(["1.5"] * 7) + ',100,9.5,' + ",".join(["0"] * 20) + ',2024-01-02,10:00:00,00";\nvar hq_str_sz000001="";\nvar hq_str_bj830001="x,bad' + ",1" * 31 + '";'
    q = src.quotes(spark.createDataFrame([(body,)], "b string"), "b").collect()
    assert len(q) == 1 and (q[0].ticker, q[0].market, q[0].name, q[0].volume, q[0].at) == ("600519", "SH", "茅台", 100, "2024-01-02 10:00:00")
    assert column(spark, src.cookies(F.col("t")), t="a=1; b = 2=3;;x; a=4") == {"a": "4", "b": "2=3"}
    rows = [("t", "b" * 100, "2024-01-02 08:00:00", "l"), (None, "b" * 100, "2024-01-02 08:00:00", "l"), ("t", "b", "", "l"), ("t", "b", "2024-01-02 08:00:00", " "), (" ", None, "2024-01-02 08:00:00", "l")]
    w = src.wire(spark.createDataFrame(rows, "h string, b string, p string, u string"), "h", "b", "p", "u", "wire", "cn").collect()
    assert [(r.title, str(r.published_at)) for r in w] == [("t", "2024-01-02 00:00:00"), ("b" * 80, "2024-01-02 00:00:00")]
    items = src.json_items(spark.createDataFrame([('[{"headline":"x","datetime":1},{"headline":"y"}]',), ("oops",)], "j string"), "j", "struct<headline:string,datetime:bigint>").collect()
    assert [(r.headline, r.datetime) for r in items] == [("x", 1), ("y", None)]


@pytest.mark.parametrize("t, k", [('{"k": 1}', 1), ('say ```json\n{"k": 2}\n``` ok', 2), ('x {"k": 3} y', 3), ("[1]", None), ("none", None), ('{"k": }', None)])
def test_best_json(spark, t, k):
    assert column(spark, text.best_json(F.col("t"), "struct<k:int>")["k"], t=t) == k


def test_near_pairs_are_in_proportion(spark):
    rows = spark.range(4000).select("id", F.lit(7).cast("long").alias("simhash"), src.minutes_after("2024-01-01 00:00:00", (F.col("id") / 10).cast("int")).alias("fetched_at"))
    got = dedup.near_pairs(rows)
    assert got.count() == 3999 and got.where("earlier <> 0").isEmpty()
    # within a day only the first is new, whatever the number
    r = dedup.check_and_register(rows.withColumn("url_hash", F.col("id").cast("string"))).groupBy("decision").count().collect()
    assert {x.decision: x["count"] for x in r} == {"new": 1, "simhash": 3999}


def test_near_pairs_against_brute_force(spark):
    rnd = random.Random(9)
    centres = [rnd.getrandbits(64) for _ in range(6)]
    rows = []
    for i in range(200):
        sim = rnd.choice(centres)
        for _ in range(rnd.randrange(5)):
            sim ^= 1 << rnd.randrange(64)
        rows.append((i, sim - (1 << 64) if sim >> 63 else sim, rnd.randrange(9000)))
    df = spark.createDataFrame(rows, "id long, simhash long, m int").select("id", "simhash", src.minutes_after("2024-01-01 00:00:00", F.col("m")).alias("fetched_at"))
    expected = {}
    for i, h, m in rows:
        near = sorted((n, j) for j, g, n in rows if (n, j) < (m, i) and n >= m - 1440 and bin((h ^ g) & (1 << 64) - 1).count("1") <= 4)
        if near:
            expected[i] = near[0][1]
    assert {r.later: r.earlier for r in dedup.near_pairs(df).collect()} == expected


def test_preview_is_the_end_of_a_series(spark):
    df = spark.createDataFrame([("t", i, float(i)) for i in range(700)], "ticker string, trade_date int, close double")
    assert indicators.preview(df, 500).select(F.size("values").alias("n"), F.col("values")[0].alias("first")).first() == (500, 200.0)


def test_macd_context_and_crossings(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "v array<double>").select(*[c.alias(k) for k, c in indicators.macd_context(F.col("v")).items()])
    assert tuple(df.first()) == (0.0, 0.0, 0.0)
    x = spark.createDataFrame([(2.0, 1.0, 1.0, 1.0)], "a double, b double, p double, q double")
    a, b, p, q = map(F.col, "abpq")
    assert tuple(x.select(indicators.crossed(a, b), indicators.crossed(a, b, p, q), indicators.crossed(b, a, above=False), indicators.crossed(b, a, p, q, above=False)).first()) == (True, True, True, True)
    assert tuple(x.select(indicators.crossed(a, b, a, b), indicators.crossed(b, a)).first()) == (False, False)


def test_rules_are_swapped_only_for_good_ones(spark):
    held = [alerts.Rule("a", "threshold", "price > 1")]
    assert alerts.reloaded(held, '{"alerts": [{"id": "b", "kind": "threshold", "expr": "price > 2"}]}')[0].id == "b"
    for bad in ("{", '[{"id": "b"}]', '[{"id": "b", "kind": "no", "expr": "1"}]', '[{"id": "b", "kind": "event", "expr": "import os"}]', '"x"'):
        assert alerts.reloaded(held, bad) is held


def test_insert_or_get(spark):
    held = spark.createDataFrame([(7, "u")], "id long, url string")
    rows = spark.createDataFrame([(10, "u", 1), (12, "v", 3), (11, "v", 2)], "id long, url string, n int")
    got = {r.url: (r.id, r.is_new, r.stored and r.stored.n) for r in store.insert_or_get(held, rows, "url", ["n"]).collect()}
    assert got == {"u": (7, False, None), "v": (11, True, 2)}
    assert [tuple(r) for r in store.insert_new(held, rows, "url", ["n"]).collect()] == [(11, "v", 2)]


def test_settings(spark):
    got = snapshots.settings(spark, {"a": '{"x": {"y": [1, "two"]}, "z": null}', "b": None}, {"b"})
    assert sorted(map(tuple, got.collect())) == [("a", "x.y[0]", "1"), ("a", "x.y[1]", "two"), ("a", "z", None)]
    with pytest.raises(FileNotFoundError):
        snapshots.settings(spark, {"b": None}, set())


def test_portfolio_rules(spark):
    held = spark.createDataFrame([(-5.0,), (2.0,)], "unrealized_pnl double")
    rules = [alerts.Rule("r", "composite", "holding_count_in_loss == 1 and total_unrealized_pnl_pct < 0")]
    assert [(r.ticker, r.rule_id) for r in alerts.evaluate_portfolio(held, 100.0, rules).collect()] == [("_portfolio", "r")]
    assert alerts.evaluate_portfolio(held.limit(0), 100.0, rules).count() == 0


def test_gate_needs_a_mode(spark):
    with pytest.raises(ValueError):
        gate.status(False, False, F.lit(True), F.lit(False), F.lit(False))
