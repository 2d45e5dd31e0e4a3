"""Queries against their SQL on small tables whose values lie where roundings differ."""

from datetime import datetime, timedelta

import duckdb
import pytest

from tickloom import registry

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def both(spark, folder, rows, name):
    """The query's and its SQL's rows over a table of events."""
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(f"{folder}/events.parquet")
    df = registry.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{folder}/events.parquet/*.parquet')")
    result = con.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    return sorted(tuple(r[c] for c in columns) for r in df.collect()), sorted(tuple(r[names.index(c)] for c in columns) for r in result.fetchall())


@pytest.mark.parametrize("name", ["cooldown_fires", "alert_throttle", "burst_suppress", "burst_several_tickers"])
@pytest.mark.parametrize("start", [datetime(2024, 1, 1), datetime(1969, 12, 1)])
def test_seconds_are_of_rounded_milliseconds(spark, tmp_path, name, start):
    # just under and at the half of a millisecond before a second, and a day, a quarter and two hours after that
    parts = [timedelta(seconds=s, microseconds=us) for s in (0, 900, 7200, 7201, 86400) for us in (0, 500, 999_499, 999_500, 999_999)]
    rows = [(100 * u + i, start + p, u, kind, 1.0, "{}") for u in range(3) for i, p in enumerate(parts) for kind in (("error", "purchase")[(u + i) % 2],)]
    rows += [(1000 + 10 * u + i, start + timedelta(seconds=s, microseconds=us), u, "error", 1.0, "{}") for u, us in ((7, 999_500), (8, 999_499), (9, 0)) for i, s in enumerate((0, 86400, 86401))]
    got, want = both(spark, tmp_path, rows, name)
    assert got == want


def test_limits_at_prices_between_the_decimal_and_the_double_product(spark, tmp_path):
    rows = []
    for i in range(270):
        prev = 10 + i % 90
        for k, price in enumerate((prev * 1.099, round(prev * 1.099, 3), round(prev * 1.099, 3) + 0.001, prev * 0.901, round(prev * 0.901, 3), round(prev * 0.901, 3) - 0.001, 0.0, None)):
            rows.append((i + 270 * k, datetime(2024, 1, 1), 1, "view", price, "{}"))
    got, want = both(spark, tmp_path, rows, "limit_events")
    assert got == want and len(got) > 100
