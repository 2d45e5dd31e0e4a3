import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom import registry
from tickloom.operators import matching


def watchlist(n):
    """n tickers with names, some tied to sectors and macros."""
    rnd = random.Random(3)
    entries = tuple(matching.Entry(("us", "cn")[i % 2], f"T{i}", f"名{i}x" if i % 3 else f"Name {i}", (f"alias{i}",), (f"sector{i % 50}",), (f"macro{i % 20}",)) for i in range(n))
    return matching.Watchlist(entries, {"us": tuple(f"sector{i}" for i in range(50))}, {"cn": tuple(f"macro{i}" for i in range(20))}, {"us": ("the", "beat")}), rnd


def articles(spark, rnd, n, rows):
    words = ["the", "Beat", "x", "T5", "(T7)", "名8x", "sector3", "MACRO4", "alias11", "xalias12", "Name 9"] + [f"t{rnd.randrange(n)}" for _ in range(30)]
    data = [(i, "us", None if i % 9 == 0 else " ".join(rnd.choice(words) for _ in range(3)), " ".join(rnd.choice(words) for _ in range(rnd.randrange(20)))) for i in range(rows)]
    return spark.createDataFrame(data, "id long, market string, title string, body string")


def plan(df):
    return re.sub(r"#\d+L?|\[id=\d+\]|plan_id=\d+|\d{2,}", "", df._jdf.queryExecution().toString())


def test_a_hundred_thousand_patterns_in_a_plan_that_does_not_grow(spark):
    small, rnd = watchlist(10)
    large, _ = watchlist(34_000)
    assert len(large.patterns()) > 100_000
    df = articles(spark, rnd, 34_000, 300)
    a, b = matching.verdicts(df, small), matching.verdicts(df, large)
    assert plan(a) == plan(b) and len(plan(b)) < 20_000
    got = {r.id: r for r in b.collect()}
    names = {f"t{i}": f"T{i}" for i in range(34_000)}
    for r in df.collect():
        text = f"{r.title or ''}  {r.body}".lower()
        tickers = {names[w] for w in re.findall(r"(?<![a-z0-9])t\d+(?![a-z0-9])", text) if w in names}
        tickers |= {f"T{i}" for i in (8,) if "名8x" in text} | {"T11" for _ in re.findall(r"(?<![a-z0-9])alias11(?![a-z0-9])", text)} | {"T9" for _ in re.findall(r"(?<![a-z0-9])name 9(?![a-z0-9])", text)}
        assert got[r.id].tickers == sorted(tickers), text
    assert matching.compiled(spark, large.patterns(), large.tied()) is matching.compiled(spark, large.patterns(), large.tied())


def test_parts_of_an_automaton_give_the_same_verdicts(spark):
    watch, rnd = watchlist(400)
    df = articles(spark, rnd, 400, 200)
    whole = sorted(matching.verdicts(df, watch).collect())
    most = len(matching.compiled(spark, watch.patterns(), watch.tied()).parts[0].value) // 3
    cut = matching.compiled(spark, watch.patterns(), watch.tied(), most)
    assert len(cut.parts) > 2 and max(len(p.value) for p in cut.parts) <= most
    parted = matching.verdicts(df, watch, most)
    assert parted.columns == matching.verdicts(df, watch).columns and sorted(parted.collect()) == whole
    assert any(r.related_tickers for r in whole) and any(len(r.generic_hits) > 1 for r in whole) and any(not r.matched for r in whole)


def test_no_patterns_and_no_rows(spark):
    none = matching.Watchlist(())
    df = spark.createDataFrame([(1, "us", "a", None)], "id long, market string, title string, body string")
    assert tuple(matching.verdicts(df, none).first()) == (1, "us", False, [], [], [], [], [], [], 0.0)
    assert matching.verdicts(df.where(F.lit(False)), none).count() == 0


@pytest.mark.parametrize("name", ["rules_score", "rules_messages", "route_markets", "rules_match_verdict"])
def test_texts_are_matched_once(spark, name):
    text = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?:ArrowEvalPython|MapInArrow)\b", text)) == 1


def test_texts_leave_arrow_in_parts(spark):
    watch, _ = watchlist(10)
    run = matching._verdicts_of(matching.compiled(spark, watch.patterns(), watch.tied()))
    texts = ["x" * 700_000 + " T5", None, "", "y" * 3_000_000, "T7", *["t1 " * 1000] * 1000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(["us"] * len(texts)), pa.array(texts)], ["id", "article_market", "text"])
    parts = list(run(iter([batch.slice(0, 0), batch])))
    at = 0
    for p in parts:
        assert p.num_rows == 1 or sum(len(t or "") for t in texts[at : at + p.num_rows]) <= matching.TEXT_BYTES
        at += p.num_rows
    got = pa.Table.from_batches(parts)
    assert got["id"].to_pylist() == list(range(len(texts)))
    assert got["tickers"].to_pylist() == [["T5"], [], [], [], ["T7"], *[["T1"]] * 1000]
