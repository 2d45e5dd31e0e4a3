import datetime

from pyspark.sql import functions as F

from tickloom.operators.records import Processed, Relations
from tickloom.sources.bars import DailyBars, fetched_by


def test_processed_rows_are_written_once_and_marked(spark, tmp_path):
    table = Processed(spark, str(tmp_path / "p"))
    at = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, 10, "a", at, True), (1, 11, "later", at + datetime.timedelta(hours=1), True), (2, 20, "b", None, False)], "id long, raw_id long, summary string, extracted_at timestamp, is_critical boolean")
    table.insert(rows, 0)
    table.insert(rows, 0)  # run again
    assert sorted((r.id, r.summary, r.push_status, r.key_quotes) for r in table.table.current().collect()) == [(1, "a", "pending", None), (2, "b", "pending", None)]
    done = spark.createDataFrame([(2, "sent"), (9, "sent")], "id long, push_status string")
    table.mark(done, 1)
    table.mark(done, 1)
    assert {r.id for r in table.pending().collect()} == {1}
    got = {r.id: (r.summary, r.push_status) for r in table.get(spark.createDataFrame([(2,), (9,)], "id long")).collect()}
    assert got == {2: ("b", "sent"), 9: (None, None)}


def test_relations_hold_between_their_dates(spark, tmp_path):
    table = Relations(spark, str(tmp_path / "r"))
    day = lambda d: datetime.datetime(2024, 1, d)
    rows = [(1, "supplies", 2, 7, 0.9, None, None), (1, "supplies", 2, 7, 0.4, None, None), (1, "owns", 3, 7, 0.5, day(5), day(8)), (2, "owns", 3, 8, None, day(9), None)]
    table.insert(spark.createDataFrame(rows, "subject_id long, predicate string, object_id long, source_news_id long, confidence double, valid_from timestamp, valid_until timestamp"), 0)
    held = lambda d: sorted((r.subject_id, r.predicate, r.confidence) for r in table.valid(F.lit(day(d))).collect())
    assert held(4) == [(1, "supplies", 0.9)] and held(5) == [(1, "owns", 0.5), (1, "supplies", 0.9)] and held(8) == [(1, "supplies", 0.9)] and held(20) == [(1, "supplies", 0.9), (2, "owns", None)]


def test_bars_are_fetched_when_short(spark, tmp_path):
    table = DailyBars(spark, str(tmp_path / "b"))
    first = datetime.date(2024, 1, 1)

    def client(ticker, days):
        if ticker == "bad":
            raise OSError("no answer")
        return [(first + datetime.timedelta(days=i), 1.0, 2.0, 0.5, float(i), 10, 1.5) for i in range(30 - days, 30)]

    tickers = spark.createDataFrame([("a",), ("bad",), ("a",)], "ticker string")
    got = table.load(tickers, 5, fetched_by(client), 0).collect()
    assert sorted((r.ticker, r.close) for r in got) == [("a", float(i)) for i in range(25, 30)]
    assert table.table.current().count() == 10

    def never(ticker, days):
        assert ticker == "bad"
        return []

    # what was fetched is held
    assert table.load(tickers, 5, fetched_by(never), 1).count() == 5
