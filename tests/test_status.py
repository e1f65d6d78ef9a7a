import datetime

import pytest

from weftline.operators import comparison, status
from weftline.sources import bars

FORECAST = "forecast_id string, asset string, as_of date, predicted double, tail_probability double, grade string"
BENCHMARK = "forecast_id string, atr_baseline double, last_range double"
SETTLED = "forecast_id string, actual double, tail_event boolean, covered50 boolean, covered80 boolean"
day = lambda k: datetime.date(2024, 1, k)


def test_status(spark):
    made = spark.createDataFrame([("a1", "A", day(1), 1.0, 0.25, "calm"), ("a2", "A", day(2), 2.0, 0.5, "storm"), ("b1", "B", day(1), 4.0, 1.0, None), ("c1", "C", day(3), 1.0, 0.0, "storm")], FORECAST)
    marks = spark.createDataFrame([("a1", 2.0, 4.0), ("c1", 0.0, 0.0)], BENCHMARK)
    done = spark.createDataFrame([("a1", 3.0, True, False, True), ("b1", 3.0, False, True, True), ("gone", 9.0, True, False, False)], SETTLED)
    r = status.ledger_status(made, marks, done).first()
    assert (r.forecasts, r.benchmarks, r.settlements, r.unsettled, r.latest_assets, r.settled) == (4, 2, 3, 1, 3, 2)
    assert r.latest_grades == {"": 1, "storm": 2}
    assert (r.range_mae, r.coverage50, r.coverage80) == (1.5, 0.5, 1.0)
    assert r.tail_brier == pytest.approx((0.75**2 + 1.0) / 2, abs=1e-6)
    assert (r.atr_baseline_mae, r.last_range_mae) == (1.0, 1.0)  # b1 has no benchmark


def test_status_of_empty_ledgers(spark):
    none = [spark.createDataFrame([], kind) for kind in (FORECAST, BENCHMARK, SETTLED)]
    r = status.ledger_status(*none).first()
    assert (r.forecasts, r.settlements, r.unsettled, r.latest_assets, r.settled, r.range_mae, r.atr_baseline_mae) == (0, 0, 0, 0, 0, None, None)


def test_quotes(spark):
    markets = spark.createDataFrame([("A", "x"), ("B", "y"), ("C", "z"), (None, "n"), ("D", "w")], "asset string, status string").withColumnRenamed("status", "label")
    rows = [("A", day(k), 1.0, 2.0, 0.5, float(k)) for k in range(1, 10)] + [("B", day(1), 1.0, 1.0, 1.0, 1.0), ("D", day(1), 0.0, 0.0, 0.0, 0.0), ("D", day(2), 1.0, 1.0, 1.0, 1.0), ("E", day(1), 1.0, 1.0, 1.0, 1.0)]
    got = {r.asset: r for r in status.dashboard_quotes(markets, spark.createDataFrame(rows, "asset string, date date, open double, high double, low double, close double")).collect()}
    assert sorted(got, key=str) == ["A", "B", "C", "D", None]
    assert [c.date.day for c in got["A"].candles] == [4, 5, 6, 7, 8, 9] and (got["A"].price, got["A"].day_change, got["A"].status, got["A"].label) == (9.0, 12.5, "live", "x")
    assert all((got[k].candles, got[k].price, got[k].day_change, got[k].status) == ([], None, None, "error") for k in ("B", "C", None))
    assert (got["D"].price, got["D"].day_change, got["D"].status) == (1.0, None, "live")


def test_all_grades_are_listed(spark):
    rows = [("calm", "normal", 2.0, 1.0, 0), ("calm", "storm", 4.0, 0.0, 1), ("storm", "storm", 6.0, 2.0, 1), (None, "calm", 1.0, 1.0, 0)]
    df = spark.createDataFrame(rows, "g string, a string, y double, m double, e int")
    got = {r.grade: r for r in comparison.weather_report(df, "g", "a", "y", "m", "e").collect()}
    assert sorted(got) == ["calm", "normal", "rough", "storm"]
    c = got["calm"]
    assert (c.rows, c.mean_actual, c.exact, c.within_one, c.event_rate, c.mean_prior_ratio, c.share) == (2, 3.0, 0.0, 0.5, 0.5, 2.0, 0.5)
    assert (got["rough"].rows, got["rough"].share, got["rough"].exact) == (0, None, None)
    assert {r.rows for r in comparison.weather_report(df.limit(0), "g", "a", "y", "m", "e").collect()} == {0}


def test_live(spark):
    df = spark.createDataFrame([("A", k) for k in range(5)] + [("B", 1), ("B", 2), (None, 3)], "asset string, date int")
    assert sorted(map(tuple, bars.live(df, 3, 3).collect()), key=str) == [("A", 2, "live"), ("A", 3, "live"), ("A", 4, "live"), ("B", 1, "mock"), ("B", 2, "mock"), (None, 3, "mock")]
