"""Queries of paged histories by their data source, and of the public export."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftline.functions.shared import shared_dir
from weftline.functions.scalar import half_up
from weftline.operators import comparison, export, status
from weftline.plans.comparison import _HITS, _judged
from weftline.plans.evaluation import _FORECASTS, forecasts, settlements
from weftline.plans.reference_sql import chain
from weftline.plans.reference_sql import half_up as h
from weftline.sources import bars as source
from weftline.sources import paging

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


#: Rows of a page in these queries, so that the smallest series have many pages.
PAGE = 100
PRICES = ("open", "high", "low", "close", "volume")


@query("paged_source", chain("bars") + "SELECT asset, date, CAST(open AS DOUBLE) AS open, CAST(high AS DOUBLE) AS high, CAST(low AS DOUBLE) AS low, CAST(close AS DOUBLE) AS close, CAST(volume AS DOUBLE) AS volume FROM bars")
def paged_source(spark, sf_dir):
    """Daily bars landed as pages and read by their cursors."""
    folder = f"{shared_dir(spark)}/weftline-pages-{uuid.uuid4().hex}"
    bars = source.daily_bars(spark, sf_dir).withColumn("t", paging.day_ms(F.col("date")))
    paging.land_pages(bars, folder, "asset", "t", list(PRICES), start=0, size=PAGE)
    pages = paging.paged_history(spark, folder, size=PAGE)
    return pages.select(F.col("series").alias("asset"), paging.ms_day(F.col("time")).alias("date"), *PRICES)


_MILLIONTHS = "CAST(floor({0} * 1e6 + 0.5) AS BIGINT)"
_LATEST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY as_of DESC, forecast_id) AS n FROM f) WHERE n = 1"
_TOLD = f"concat_ws('|', asset, CAST(as_of AS VARCHAR), {_MILLIONTHS.format('predicted')}, {_MILLIONTHS.format('low50')}, {_MILLIONTHS.format('high80')}, grade, CASE WHEN id IS NULL THEN 'pending' ELSE 'settled' END, coalesce(CAST(covered50 AS VARCHAR), '-'))"
_LAST = "SELECT * FROM s ORDER BY as_of DESC, forecast_id LIMIT 30"


@query(
    "public_export",
    chain("ind", "lab", more=_FORECASTS)
    + f"""SELECT (SELECT string_agg({_TOLD}, chr(10) ORDER BY asset) FROM (SELECT l.asset AS asset, l.as_of AS as_of, l.predicted AS predicted, low50, high80, CASE WHEN l.predicted >= 3 THEN 'storm' ELSE 'calm' END AS grade, s.forecast_id AS id, covered50 FROM ({_LATEST}) l LEFT JOIN s ON l.forecast_id = s.forecast_id)) AS latest,
(SELECT string_agg(concat_ws('|', asset, CAST(as_of AS VARCHAR), {_MILLIONTHS.format('predicted')}, CAST(covered80 AS VARCHAR)), chr(10) ORDER BY as_of DESC, forecast_id) FROM ({_LAST})) AS recent,
(SELECT count(*) FROM f) AS forecasts, (SELECT count(*) FROM s) AS settlements, (SELECT max(forecast_id) FROM f) AS forecast_head, (SELECT max(forecast_id) FROM s) AS settlement_head""",
)
def public_export(spark, sf_dir):
    """The export of all forecasts, its parts as lines of text; the day of a settlement stands for its time, the last id for a chain's head."""
    made, done = forecasts(spark, sf_dir), settlements(spark, sf_dir)
    graded = made.withColumns({"policy": F.lit("official"), "grade": F.when(F.col("predicted") >= 3, "storm").otherwise("calm")})
    head = lambda rows, name: rows.agg(F.max("forecast_id").alias("head")).select(F.lit(name).alias("ledger"), "head")
    whole = export.public_export(graded, done.withColumn("settled_at", F.col("as_of")), head(made, "forecasts").unionByName(head(done, "settlements")))
    millionths = lambda c: F.floor(c * 1e6 + 0.5).cast("long").cast("string")
    told = lambda f: F.concat_ws("|", f["asset"], f["as_of"].cast("string"), millionths(f["expected"]), millionths(f["interval50"][0]), millionths(f["interval80"][1]), f["grade"], f["status"], F.coalesce(f["settlement"]["covered50"].cast("string"), F.lit("-")))
    last = lambda r: F.concat_ws("|", r["asset"], r["as_of"].cast("string"), millionths(r["expected"]), r["covered80"].cast("string"))
    return whole.select(
        F.array_join(F.transform("forecasts", told), "\n").alias("latest"),
        F.array_join(F.transform("recent_settlements", last), "\n").alias("recent"),
        F.col("integrity.forecasts").alias("forecasts"),
        F.col("integrity.settlements").alias("settlements"),
        F.col("integrity.forecast_head").alias("forecast_head"),
        F.col("integrity.settlement_head").alias("settlement_head"),
    )


_TAIL = "least(f.predicted / 20e0, 1e0)"


@query(
    "ledger_status",
    chain("ind", "lab", more=_FORECASTS | {
        "b": "SELECT forecast_id, floor(predicted * 0.95e0 * 1e6 + 0.5) / 1e6 AS atr_baseline, floor(predicted * 1.1e0 * 1e6 + 0.5) / 1e6 AS last_range FROM f WHERE day(as_of) % 2 = 0",
        "p": f"SELECT s.*, {_TAIL} AS tail, s.actual > f.high80 AS event, atr_baseline, last_range FROM s JOIN f ON f.forecast_id = s.forecast_id LEFT JOIN b ON b.forecast_id = s.forecast_id",
        "l": "SELECT CASE WHEN predicted >= 3 THEN 'storm' ELSE 'calm' END AS grade, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY as_of DESC, forecast_id) AS k FROM f) WHERE k = 1 GROUP BY grade",
    })
    + f"""SELECT (SELECT count(*) FROM f) AS forecasts, (SELECT count(*) FROM b) AS benchmarks, (SELECT count(*) FROM s) AS settlements, (SELECT count(*) FROM f) - (SELECT count(*) FROM s) AS unsettled,
(SELECT count(DISTINCT asset) FROM f) AS latest_assets, (SELECT string_agg(grade || '=' || n, ',' ORDER BY grade) FROM l) AS grades, count(*) AS settled, {h('avg(abs(actual - predicted))', 6)} AS range_mae,
{h('avg(CAST(covered50 AS INT))', 6)} AS coverage50, {h('avg(CAST(covered80 AS INT))', 6)} AS coverage80, {h('avg((CAST(event AS INT) - tail) * (CAST(event AS INT) - tail))', 6)} AS tail_brier,
{h('avg(abs(actual - atr_baseline))', 6)} AS atr_baseline_mae, {h('avg(abs(actual - last_range))', 6)} AS last_range_mae FROM p""",
)
def ledger_status(spark, sf_dir):
    """State of all ledgers; benchmarks are registered on even days, the outcome is a tail event above the outer bound."""
    made, done = forecasts(spark, sf_dir), settlements(spark, sf_dir)
    scaled = lambda k, name: half_up(F.col("predicted") * k, 6).alias(name)
    registered = made.where(F.day("as_of") % 2 == 0).select("forecast_id", scaled(0.95, "atr_baseline"), scaled(1.1, "last_range"))
    graded = made.withColumns({"tail_probability": F.least(F.col("predicted") / 20.0, F.lit(1.0)), "grade": F.when(F.col("predicted") >= 3, "storm").otherwise("calm")})
    judged = done.join(made.select("forecast_id", "high80"), "forecast_id").withColumn("tail_event", F.col("actual") > F.col("high80"))
    grades = F.array_join(F.transform(F.map_entries("latest_grades"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return status.ledger_status(graded, registered, judged).withColumn("grades", grades).drop("latest_grades")


@query(
    "dashboard_quotes",
    chain("bars")
    + f"""SELECT m.asset AS asset, CASE WHEN c.n >= 2 THEN 'live' ELSE 'error' END AS status, CASE WHEN c.n >= 2 THEN least(c.n, 6) ELSE 0 END AS n_candles, CASE WHEN c.n >= 2 THEN c.last END AS price,
CASE WHEN c.n >= 2 THEN {h('(c.last - c.prev) / c.prev * 100e0', 6)} END AS day_change FROM (SELECT DISTINCT l_returnflag || l_linestatus AS asset FROM lineitem UNION SELECT DISTINCT o_orderstatus FROM orders) m
LEFT JOIN (SELECT asset, count(*) AS n, max(CASE WHEN k = 1 THEN CAST(close AS DOUBLE) END) AS last, max(CASE WHEN k = 2 THEN CAST(close AS DOUBLE) END) AS prev FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date DESC) AS k FROM bars) GROUP BY asset) c ON c.asset = m.asset""",
)
def dashboard_quotes(spark, sf_dir):
    """Quotes of all series and of the states of orders, which have no bars."""
    named = source.read(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("asset")).unionByName(source.read(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("asset"))).distinct()
    got = status.dashboard_quotes(named, source.daily_bars(spark, sf_dir).withColumn("close", F.col("close").cast("double")))
    return got.select("asset", "status", F.size("candles").cast("long").alias("n_candles"), "price", "day_change")


_PRIOR = {"a3": "SELECT w.grade AS grade, a1.y AS y, w.high_event AS event, w.prior_median AS pm, list_position(['calm', 'normal', 'rough', 'storm'], w.grade) AS o, CASE WHEN ar < 25 THEN 1 WHEN ar < 75 THEN 2 WHEN ar < 90 THEN 3 ELSE 4 END AS ao FROM w JOIN a1 USING (asset, date)"}


@query(
    "weather_report",
    chain("panel", more=_HITS | _PRIOR)
    + f"""SELECT g.grade AS grade, count(y) AS rows, {h('avg(y)', 6)} AS mean_actual, {h('quantile_cont(y, 0.5)', 6)} AS median_actual, {h('avg(CAST(o = ao AS INT))', 6)} AS exact, {h('avg(CAST(abs(o - ao) <= 1 AS INT))', 6)} AS within_one,
{h('avg(event)', 6)} AS event_rate, {h('avg(y / nullif(pm, 0))', 6)} AS mean_prior_ratio, CASE WHEN count(y) > 0 THEN {h('count(y) / CAST((SELECT count(*) FROM a3) AS DOUBLE)', 6)} END AS share FROM (SELECT unnest(['calm', 'normal', 'rough', 'storm']) AS grade) g LEFT JOIN a3 ON a3.grade = g.grade GROUP BY g.grade""",
)
def weather_report(spark, sf_dir):
    """Hits of every grade, those never forecast included."""
    return comparison.weather_report(_judged(spark, sf_dir), "grade", "actual_grade", "next_true_range", "prior_median", "high_event")


@query("live_bars", "SELECT event_id, user_id, CASE WHEN count(*) OVER (PARTITION BY user_id) < 20 THEN 'mock' ELSE 'live' END AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 96")
def live_bars(spark, sf_dir):
    """The last 96 events of each user; fewer than 20 are not enough."""
    events = source.read(spark, sf_dir, "events").select("event_id", "user_id")
    return source.live(events, 96, 20, key="user_id", time="event_id")
