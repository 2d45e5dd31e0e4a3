from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tickloom.operators import desk, store

D = lambda d, h=0: datetime(2024, 1, d, h)


def test_history(spark):
    items = spark.createDataFrame([("A", D(1), "old"), ("A", D(8), "edge"), ("A", D(14), "b"), ("A", D(14), "a"), ("A", D(15), "now"), ("B", D(14), "other"), (None, D(14), "none")], "ticker string, at timestamp, line string")
    asked = spark.createDataFrame([(1, "A", D(15)), (2, "C", D(15)), (3, None, D(15)), (4, "A", None)], "id long, ticker string, at timestamp")
    got = {r.id: r.history for r in desk.history(asked, items, 7, 9).collect()}
    assert got == {1: ["a", "b", "edge"], 2: [], 3: [], 4: []}
    assert {r.id: r.history for r in desk.history(asked, items, 7, 1).collect()}[1] == ["a"]
    assert desk.history(asked.limit(0), items, 7, 1).count() == 0


def test_news_replies(spark):
    rows = [("A", D(1, k), k, "x" * 200 if k == 11 else None) for k in range(12)]
    got = desk.news_replies(spark.createDataFrame(rows, "ticker string, at timestamp, id long, summary string")).collect()
    lines = got[0].reply.split("\n")
    assert lines[0] == "A 近 10 条:" and len(lines) == 11 and lines[1] == "• 2024-01-01 11:00:00 " + "x" * 120 and lines[2] == "• 2024-01-01 10:00:00 "


def test_cost_reply(spark):
    assert spark.range(1).select(desk.cost_reply(F.lit(1.234), F.lit(18.766))).first()[0] == "今日 LLM 成本: 1.23 CNY\n剩余预算: 18.77 CNY"


def test_paused(spark):
    states = spark.createDataFrame([("a", None, "x"), ("b", D(2), "y")], "source string, paused_until timestamp, error string")
    commands = spark.createDataFrame([("a", D(3), None), ("a", D(1), 600), ("c", D(3), 60)], "source string, at timestamp, minutes int")
    got = {r.source: (r.paused_until, r.error) for r in desk.paused(states, commands).collect()}
    assert got == {"a": (datetime(2024, 1, 3, 0, 30), "manual_pause"), "b": (D(2), "y"), "c": (D(3, 1), "manual_pause")}


def test_watch_and_unwatch(spark):
    def run(f, us, cn, args):
        df = spark.createDataFrame([(us, cn, args)], "us array<string>, cn array<string>, args array<string>")
        return tuple(df.select(f(F.col("us"), F.col("cn"), F.col("args")).alias("w")).first().w)

    assert run(desk.watched, ["A"], ["600519"], ["B", "A", "000001", "B"]) == (["A", "B"], ["600519", "000001"], "已加入: B, 000001")
    assert run(desk.watched, ["A"], [], ["A"]) == (["A"], [], "无变化")
    assert run(desk.watched, [], [], [])[2].startswith("用法")
    assert run(desk.unwatched, ["A", "X"], ["X", "1"], ["X", "1", "Q"]) == (["A"], ["X"], "已移除: X, 1")
    assert run(desk.unwatched, ["A"], [], ["Q"]) == (["A"], [], "无变化")


def test_lists_by_script(spark):
    df = spark.createDataFrame([(["chip", "芯片", "été"],)], "w array<string>")
    assert tuple(df.select(desk.by_script(F.col("w")).alias("s")).first().s) == (["chip", "été"], ["芯片"])
    none = F.array().cast("array<string>")
    assert df.select(desk.listed(none, F.array(F.lit("1"), F.lit("2")), none, none)).first()[0] == "美股: (空)\nA股: 1, 2\n宏观: (空)\n板块: (空)"


def test_references(spark):
    rules = spark.createDataFrame([("r1", "A", "A", False), ("r2", "Z", None, False), ("r3", None, "Z", False), ("r4", None, None, True)], "rule_id string, ticker string, holding string, portfolio boolean")
    held = spark.createDataFrame([("A",)], "ticker string")
    got = {tuple(r) for r in desk.unresolved(rules, held, held, None).collect()}
    assert got == {("error", "unknown holding", "r3"), ("warning", "ticker not watched", "r2"), ("error", "no capital", "r4")}
    assert desk.unresolved(rules, held, held, 1e6).where("check = 'no capital'").count() == 0


def test_store_keys(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id long, name string, n int")
    assert store.unique(rows, ["name"]).count() == 2
    with pytest.raises(Exception, match="more than one"):
        store.unique(rows.union(rows), ["name"]).collect()
    asked = spark.createDataFrame([("a",), ("q",)], "name string")
    assert {(r.name, r.n) for r in store.looked_up(asked, rows, ["name"]).collect()} == {("a", 5), ("q", None)}
    assert store.insert_new(rows.where("id = 1"), rows.union(rows), ["id", "name"]).count() == 1
