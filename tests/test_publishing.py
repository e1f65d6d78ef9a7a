import datetime
import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import export
from weftline.sources import paging

DAY = paging.DAY_MS


def _land(folder, pages):
    for (series, cursor), rows in pages.items():
        at = folder / f"series={series}" / f"cursor={cursor}"
        at.mkdir(parents=True)
        (at / "part-0.txt").write_text(json.dumps(rows))
    return str(folder)


def _read(spark, path, **options):
    got = paging.paged_history(spark, path, "series string, time long, close double, note string", **options)
    return sorted(map(tuple, got.collect()), key=lambda r: (str(r[0]), r[1]))


def test_cursors_are_followed(spark, tmp_path):
    path = _land(tmp_path, {
        ("a", 0): [[0, "1.5", "x"], [DAY, "2", None]], ("a", 2 * DAY): [[2 * DAY, "oops"], [3 * DAY, "NaN", 7]], ("a", 4 * DAY): [[4 * DAY, "5", "y"]],
        ("a", 5 * DAY): [[5 * DAY, "never", "after a short page"]], ("b", 0): [[0, 1, "z"], [0, 1, "z"]], ("b", DAY): [], ("c d", 7): [[7, "0", ""]],
    })
    assert _read(spark, path, size=2) == [("a", 0, 1.5, "x"), ("a", DAY, 2.0, None), ("a", 2 * DAY, None, None), ("a", 3 * DAY, None, "7"), ("a", 4 * DAY, 5.0, "y"), ("b", 0, 1.0, "z"), ("b", 0, 1.0, "z")]
    assert _read(spark, path, size=2, start=2 * DAY, end=3 * DAY) == [("a", 2 * DAY, None, None), ("a", 3 * DAY, None, "7")]
    assert _read(spark, path, size=2, end=0) == [("a", 0, 1.5, "x"), ("b", 0, 1.0, "z"), ("b", 0, 1.0, "z")]
    assert _read(spark, path, start=7) == [("c d", 7, 0.0, "")]


def test_pages_must_advance(spark, tmp_path):
    path = _land(tmp_path, {("a", 0): [[0, "1", ""], [-DAY, "2", ""]]})
    with pytest.raises(Exception, match="a: pages do not advance"):
        _read(spark, path, size=2)


def test_landed_pages_come_back(spark, tmp_path):
    rows = [("x:/=%", k * DAY * (1 + k % 2), k / 7, None if k == 3 else f'q"{k},]') for k in range(1, 26, 2)] + [(None, 9 * DAY, 1.0, "n"), (None, 10 * DAY, None, "")]
    df = spark.createDataFrame(rows, "s string, t long, close double, note string")
    for size in (1, 4, 13, 100):
        folder = str(tmp_path / str(size))
        paging.land_pages(df, folder, "s", "t", ["close", "note"], start=0, size=size)
        assert _read(spark, folder, size=size) == sorted(rows, key=lambda r: (str(r[0]), r[1]))
        assert _read(spark, "file://" + folder, size=size) == sorted(rows, key=lambda r: (str(r[0]), r[1]))
    (tmp_path / "none").mkdir()
    assert _read(spark, str(tmp_path / "none")) == []


def test_what_the_source_reads(spark, tmp_path):
    with pytest.raises(Exception, match="reads a string"):
        paging.paged_history(spark, str(tmp_path), "series string, time string").collect()
    with pytest.raises(Exception, match="at least one row"):
        paging.paged_history(spark, str(tmp_path), size=0).collect()


def test_days(spark):
    df = spark.createDataFrame([(datetime.date(1969, 12, 31),), (datetime.date(2024, 2, 29),), (None,)], "d date").withColumn("t", paging.day_ms(F.col("d")))
    assert [tuple(r) for r in df.select("t", paging.ms_day(F.col("t"))).collect()] == [(-DAY, datetime.date(1969, 12, 31)), (19782 * DAY, datetime.date(2024, 2, 29)), (None, None)]


FORECAST = "forecast_id string, asset string, as_of date, policy string, predicted double, low50 double, high50 double, low80 double, high80 double, grade string"
SETTLED = "forecast_id string, actual double, covered50 boolean, covered80 boolean, settled_at timestamp"


def _forecast(fid, asset, day, predicted=1.23456789):
    return (fid, asset, day and datetime.date(2024, 1, day), "official", predicted, 0.5, 1.5, 0.25, 2.0000005, "calm")


def test_export(spark):
    made = spark.createDataFrame([_forecast("a1", "B", 1), _forecast("a3", "B", 2), _forecast("a2", "B", 2), _forecast("a9", "B", None), _forecast("c1", "A", 1)], FORECAST)
    at = lambda h: datetime.datetime(2024, 1, 3, h)
    done = spark.createDataFrame([("a1", 1.0, True, True, at(1)), ("a2", 2.0, False, True, at(2)), ("a2", 2.5, False, False, at(3)), ("gone", 1.0, True, True, at(4)), ("a3", 3.0, None, None, at(1))], SETTLED)
    heads = spark.createDataFrame([("forecasts", "f0"), ("settlements", None)], "ledger string, head string")
    doc = export.public_export(made, done, heads, {"SP500": "SPY"}).first()
    assert [(f.asset, f.as_of.day, f.expected, f.interval80, f.status) for f in doc.forecasts] == [("A", 1, 1.234568, [0.25, 2.000001], "pending"), ("B", 2, 1.234568, [0.25, 2.000001], "settled")]
    assert doc.forecasts[0].settlement is None and doc.forecasts[1].settlement.actual == 2.5
    assert [(r.asset, r.actual) for r in doc.recent_settlements] == [("B", 2.5), ("B", 2.0), ("B", 1.0), ("B", 3.0)]
    assert tuple(doc.integrity) == (5, 5, "f0", None) and doc.aliases == {"SP500": "SPY"}
    # of the last two settlements one has no forecast
    assert [r.actual for r in export.public_export(made, done, heads, most=2).first().recent_settlements] == [2.5]


def test_export_at_its_ends(spark):
    none, heads = spark.createDataFrame([], SETTLED), spark.createDataFrame([], "ledger string, head string")
    doc = export.public_export(spark.createDataFrame([_forecast("a", "A", 1)], FORECAST), none, heads).first()
    assert doc.recent_settlements == [] and doc.integrity.settlements == 0 and doc.aliases == {}
    with pytest.raises(Exception, match="no forecasts to publish"):
        export.public_export(spark.createDataFrame([], FORECAST), none, heads).collect()
