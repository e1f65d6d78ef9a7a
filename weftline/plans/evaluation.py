"""Queries of metrics, models, intervals, audits and ledgers over price series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions.scalar import WEATHER, half_up, weather_grade
from weftline.operators import audit, bootstrap, indicators, ledger, metrics, models
from weftline.plans.reference_sql import CONFUSION, chain
from weftline.plans.reference_sql import half_up as h
from weftline.plans.series import indicator_rows, observations, panel_rows
from weftline.sources import bars as source

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def _rates(columns: str) -> str:
    return ", ".join(f"{h(c, 6)} AS {c}" if c != "precision" else f'{h(chr(34) + c + chr(34), 6)} AS "precision"' for c in columns.split(", "))


_COUNTS = "count_if({p} AND {a}) AS tp, count_if({p} AND NOT {a}) AS fp, count_if(NOT {p} AND {a}) AS fn, count_if(NOT {p} AND NOT {a}) AS tn"
_DERIVED = """SELECT *, 1.0 - specificity AS false_positive_rate, CASE WHEN "precision" + recall > 0 THEN 2.0 * "precision" * recall / ("precision" + recall) END AS f1,
  (recall + specificity) / 2.0 AS balanced_accuracy, CASE WHEN base_rate > 0 THEN "precision" / base_rate END AS lift FROM x1"""


@query(
    "confusion_storm",
    chain("obs", more={"x0": f"SELECT asset, {_COUNTS.format(p='(weather = ' + chr(39) + WEATHER[0] + chr(39) + ')', a='(fwd_drawdown3 <= -20)')} FROM obs GROUP BY asset", "x1": f"SELECT *, {CONFUSION} FROM x0", "x2": _DERIVED})
    + f"SELECT asset, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, {_rates('precision, recall, specificity, base_rate, accuracy, coverage, false_positive_rate, f1, balanced_accuracy, lift')} FROM x2",
)
def confusion_storm(spark, sf_dir):
    rows = observations(spark, sf_dir)
    counts = rows.groupBy("asset").agg(*metrics.confusion_counts(F.col("weather") == WEATHER[0], F.col("fwd_drawdown3") <= -20))
    return metrics.rounded(metrics.confusion_rates(counts))


SIGNALS = {"always-up": "true", "previous-day": "return1 > 0", "five-day-momentum": "return5 > 0", "above-sma20": "sma_gap20 > 0", "rsi-50": "rsi14 >= 50", "temperature-50": "temperature >= 50"}
RISKS = {"rain-60": "rain >= 60", "storm": f"weather = '{WEATHER[0]}'", "atr-rank-80": "atr_rank252 >= 80", "vol-rank-80": "vol_rank252 >= 80", "rain-60-or-atr-80": "(rain >= 60 OR atr_rank252 >= 80)"}
UPS = {f"up{n}": (f"up{n} = 1", f"fwd_return{n}") for n in (1, 3, 5)}
HITS = {"tail1": ("tail1 = 1", None), "drop2": ("drop2 = 1", None), "correction3": ("correction3 = 1", None)}


def _grid_sql(signals: dict, targets: dict) -> str:
    cells = " UNION ALL ".join(f"SELECT asset, '{s}' AS signal, '{t}' AS target, coalesce({p}, false) AS p, coalesce({a}, false) AS a, {v or 'CAST(NULL AS DOUBLE)'} AS v FROM panel" for s, p in signals.items() for t, (a, v) in targets.items())
    means = "accuracy, balanced_accuracy, precision, recall, specificity, coverage, f1, base_rate, mean_value"
    quoted = lambda c: '"precision"' if c == "precision" else c
    averages = ", ".join(f"avg({quoted(c)}) AS {quoted(c)}" for c in means.split(", "))
    more = {
        "cells": cells,
        "x0": f"SELECT asset, signal, target, {_COUNTS.format(p='p', a='a')}, avg(v) FILTER (p) AS mean_value FROM cells GROUP BY ALL",
        "x1": f"SELECT *, {CONFUSION} FROM x0",
        "x2": _DERIVED,
        "x3": f"SELECT signal, target, count(*) AS assets, CAST(sum(tp + fp + fn + tn) AS BIGINT) AS observations, {averages} FROM x2 GROUP BY signal, target",
    }
    return chain("panel", more=more) + f"SELECT signal, target, assets, observations, {_rates(means)}, {h('CASE WHEN base_rate > 0 THEN ' + chr(34) + 'precision' + chr(34) + ' / base_rate END', 6)} AS lift FROM x3"


def _grid(spark, sf_dir, signals, targets):
    text = " ".join([*signals.values(), *(e for e, _ in targets.values())])
    needed = [n for n in indicators.TRAILING if n in text] + [indicators.TAIL] * ("tail1" in text)
    values = {k: F.col(v) for k, (_, v) in targets.items() if v}
    return metrics.signal_grid(panel_rows(spark, sf_dir, *needed), {k: F.expr(e) for k, e in signals.items()}, {k: F.expr(e) for k, (e, _) in targets.items()}, values)


@query("direction_grid", _grid_sql(SIGNALS, UPS))
def direction_grid(spark, sf_dir):
    return _grid(spark, sf_dir, SIGNALS, UPS)


@query("risk_grid", _grid_sql(RISKS, HITS))
def risk_grid(spark, sf_dir):
    return _grid(spark, sf_dir, RISKS, HITS)


BINS = [("0-19", 0, 19), ("20-39", 20, 39), ("40-59", 40, 59), ("60-79", 60, 79), ("80-100", 80, 100)]


@query(
    "bin_temperature",
    chain("obs", more={"b": "SELECT * FROM (VALUES " + ", ".join(f"('{n}', {a}, {b})" for n, a, b in BINS) + ") AS t(bin, lo, hi)"})
    + f"SELECT bin, count(temperature) AS rows, {h('avg(fwd_return1)', 6)} AS return1, {h('avg(fwd_return5)', 6)} AS return5, {h('avg(CAST(fwd_return1 > 0 AS INT))', 6)} AS up_share FROM b LEFT JOIN obs ON temperature BETWEEN lo AND hi GROUP BY bin",
)
def bin_temperature(spark, sf_dir):
    mean = lambda c, name: half_up(F.avg(c), 6).alias(name)
    return metrics.by_bins(observations(spark, sf_dir), "temperature", BINS, [mean("fwd_return1", "return1"), mean("fwd_return5", "return5"), mean((F.col("fwd_return1") > 0).cast("int"), "up_share")])


@query(
    "group_weather",
    chain("obs") + "SELECT weather, " + ", ".join(f"count({c}) AS {c}_n, {h(f'avg({c})', 6)} AS {c}_mean, {h(f'quantile_cont({c}, 0.5)', 6)} AS {c}_median, {h(f'stddev_samp({c})', 6)} AS {c}_sd" for c in ("fwd_return1", "fwd_return5")) + " FROM obs GROUP BY weather",
)
def group_weather(spark, sf_dir):
    return metrics.numeric_summary(observations(spark, sf_dir), ["weather"], ["fwd_return1", "fwd_return5"])


@query("rain_risk", chain("obs") + f"SELECT CAST(floor(rain / 20.0) AS INT) AS level, count(*) AS days, {h('avg(next_range)', 6)} AS next_range, {h('avg(CAST(fwd_return1 <= -1 AS INT))', 6)} AS p1, {h('avg(CAST(fwd_return1 <= -3 AS INT))', 6)} AS p3 FROM obs GROUP BY level")
def rain_risk(spark, sf_dir):
    share = lambda n: half_up(F.avg((F.col("fwd_return1") <= -n).cast("int")), 6).alias(f"p{n}")
    return observations(spark, sf_dir).groupBy(F.floor(F.col("rain") / 20.0).cast("int").alias("level")).agg(F.count("*").alias("days"), half_up(F.avg("next_range"), 6).alias("next_range"), share(1), share(3))


@query(
    "spearman_by_asset",
    chain(
        "panel",
        more={
            "r": "SELECT asset, rank() OVER (PARTITION BY asset ORDER BY atr14) + (count(*) OVER (PARTITION BY asset, atr14) - 1) / 2.0 AS x, rank() OVER (PARTITION BY asset ORDER BY next_true_range) + (count(*) OVER (PARTITION BY asset, next_true_range) - 1) / 2.0 AS y FROM panel",
            "m": "SELECT asset, count(*) AS n, CAST(count(*) AS DOUBLE) AS c, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy FROM r GROUP BY asset",
        },
    )
    + f"SELECT asset, n, {h('CASE WHEN n >= 3 THEN (c * sxy - sx * sy) / sqrt((c * sxx - sx * sx) * (c * syy - sy * sy)) END', 6)} AS spearman FROM m",
)
def spearman_by_asset(spark, sf_dir):
    return metrics.spearman(panel_rows(spark, sf_dir), "atr14", "next_true_range", ["asset"])


@query(
    "range_errors",
    chain(
        "panel",
        more={
            "q": "SELECT *, atr14 - next_true_range AS e, quantile_cont(atr14, 0.8) OVER (PARTITION BY asset) AS l FROM panel",
        },
    )
    + f"SELECT asset, count(*) AS n, {h('avg(abs(e))', 6)} AS mae, {h('sqrt(avg(e * e))', 6)} AS rmse, {h('avg(atr14) / avg(next_true_range)', 6)} AS calibration, {h('1.0 - sum(e * e) / (var_pop(next_true_range) * count(*))', 6)} AS r2, {h('(avg(next_true_range) FILTER (' + h('atr14', 6) + ' >= ' + h('l', 6) + ')) / avg(next_true_range)', 6)} AS top_lift FROM q GROUP BY asset",
)
def range_errors(spark, sf_dir):
    return metrics.range_errors(panel_rows(spark, sf_dir), "atr14", "next_true_range", "asset")


@query(
    "top_quintile_lift",
    chain("panel", more={"r": "SELECT *, row_number() OVER (PARTITION BY asset ORDER BY vol_rank252 DESC, date) AS place, count(*) OVER (PARTITION BY asset) AS all_rows FROM panel"}) + f"SELECT asset, {h('(avg(next_true_range) FILTER (place <= greatest(1, ceil(all_rows * 0.2e0)))) / avg(next_true_range)', 6)} AS lift FROM r GROUP BY asset",
)
def top_quintile_lift(spark, sf_dir):
    return metrics.top_share_lift(panel_rows(spark, sf_dir, "vol_rank252"), "vol_rank252", "next_true_range", "asset", "date")


@query(
    "auc_by_asset",
    chain("panel", more={"r": "SELECT asset, tail1, rank() OVER (PARTITION BY asset ORDER BY rain) + (count(*) OVER (PARTITION BY asset, rain) - 1) / 2.0 AS r FROM panel", "m": "SELECT asset, sum(r) FILTER (tail1 = 1) AS s, count(*) FILTER (tail1 = 1) AS p, count(*) FILTER (tail1 = 0) AS q FROM r GROUP BY asset"})
    + f"SELECT asset, p AS positives, q AS negatives, {h('(s - CAST(p AS DOUBLE) * (p + 1) / 2) / (CAST(p AS DOUBLE) * q)', 6)} AS auc FROM m",
)
def auc_by_asset(spark, sf_dir):
    return metrics.roc_auc(panel_rows(spark, sf_dir, indicators.TAIL), "rain", "tail1", ["asset"])


@query(
    "average_precision",
    chain("panel", more={"r": "SELECT asset, tail1, row_number() OVER w AS n, sum(tail1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM panel WINDOW w AS (PARTITION BY asset ORDER BY rain DESC, date)"}) + f"SELECT asset, {h('avg(CAST(k AS DOUBLE) / n) FILTER (tail1 = 1)', 6)} AS average_precision FROM r GROUP BY asset",
)
def average_precision(spark, sf_dir):
    return metrics.average_precision(panel_rows(spark, sf_dir, indicators.TAIL), "rain", "tail1", ["asset"], "date")


@query("calibration_bins", chain("panel", more={"p": "SELECT rain / 100.0 AS p, tail1 FROM panel"}) + f"SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, {h('avg(p)', 6)} AS mean_p, {h('avg(tail1)', 6)} AS rate FROM p GROUP BY bin")
def calibration_bins(spark, sf_dir):
    return metrics.calibration_bins(panel_rows(spark, sf_dir, indicators.TAIL).withColumn("p", F.col("rain") / 100.0), "p", "tail1")


@query(
    "probability_metrics",
    chain(
        "panel",
        more={
            "p": "SELECT asset, rain / 100.0 AS p, least(1 - 1e-6, greatest(1e-6, rain / 100.0)) AS q, CAST(tail1 AS DOUBLE) AS y FROM panel",
            "b": "SELECT asset, least(floor(p * 10), 9) AS bin, count(*) AS n, sum(p - y) AS gap, sum((p - y) * (p - y)) AS square, sum(-(y * ln(q) + (1 - y) * ln(1 - q))) AS loss FROM p GROUP BY ALL",
        },
    )
    + f"SELECT asset, CAST(sum(n) AS BIGINT) AS n, {h('sum(square) / sum(n)', 6)} AS brier, {h('sum(loss) / sum(n)', 6)} AS log_loss, {h('sum(abs(gap)) / sum(n)', 6)} AS ece FROM b GROUP BY asset",
)
def probability_metrics(spark, sf_dir):
    return metrics.probability_metrics(panel_rows(spark, sf_dir, indicators.TAIL).withColumn("p", F.col("rain") / 100.0), "p", "tail1", ["asset"])


@query(
    "top_decile",
    chain("panel", more={"c": f"SELECT *, {h('quantile_cont(atr_rank252, 0.9) OVER (PARTITION BY asset)', 8)} AS cut FROM panel", "o": f"SELECT asset, {h('atr_rank252', 8)} >= cut AS p, tail1 = 1 AS a FROM c", "x0": f"SELECT asset, {_COUNTS.format(p='p', a='a')} FROM o GROUP BY asset", "x1": f"SELECT *, {CONFUSION} FROM x0", "x2": _DERIVED})
    + f"SELECT asset, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, {_rates('precision, recall, lift')} FROM x2",
)
def top_decile(spark, sf_dir):
    return metrics.top_decile(panel_rows(spark, sf_dir, "atr_rank252", indicators.TAIL), "atr_rank252", "tail1", "asset")


_RANK = "rank() OVER (PARTITION BY asset, year ORDER BY {0}) + (count(*) OVER (PARTITION BY asset, year, {0}) - 1) / 2.0"


def _rank_correlation(x: str, y: str) -> str:
    vx, vy = (f"(count(*) * sum({c} * {c}) - sum({c}) * sum({c}))" for c in (x, y))
    return h(f"CASE WHEN {vx} > 0 AND {vy} > 0 THEN (count(*) * sum({x} * {y}) - sum({x}) * sum({y})) / sqrt(CAST({vx} AS DOUBLE) * {vy}) END", 6)


@query(
    "walk_forward_year",
    chain(
        "obs",
        more={
            "y": f"SELECT asset, year(date) AS year, temperature, rain, weather, {h('fwd_return1', 9)} AS r1, {h('next_true_range', 9)} AS tr FROM obs",
            "t": f"SELECT c.asset AS asset, c.year AS year, {h('quantile_cont(p.tr, 0.8)', 6)} AS cut, count(*) AS prior FROM (SELECT DISTINCT asset, year FROM y) c JOIN y p ON p.asset = c.asset AND p.year < c.year GROUP BY ALL",
            "k": f"SELECT *, {_RANK.format('temperature')} AS kt, {_RANK.format('rain')} AS kr, {_RANK.format('r1')} AS k1, {_RANK.format('tr')} AS kx, weather = '태풍경보' AS s FROM y",
            "g": f"SELECT asset, year, prior, count(*) AS rows, cut AS threshold, {_rank_correlation('kt', 'k1')} AS temperature_return_spearman, {_rank_correlation('kr', 'kx')} AS rain_range_spearman, count_if(s) AS alerts, count_if({h('tr', 6)} >= cut) AS events, count_if(s AND {h('tr', 6)} >= cut) AS hits FROM k JOIN t USING (asset, year) WHERE prior >= 750 GROUP BY asset, year, prior, cut HAVING count(*) >= 50",
        },
    )
    + f"SELECT asset, year, prior, rows, threshold, temperature_return_spearman, rain_range_spearman, CASE WHEN alerts > 0 THEN {h('hits / CAST(alerts AS DOUBLE)', 6)} END AS storm_precision, CASE WHEN events > 0 THEN {h('hits / CAST(events AS DOUBLE)', 6)} END AS storm_recall, CASE WHEN alerts > 0 AND events > 0 THEN {h('(hits / CAST(alerts AS DOUBLE)) / (events / CAST(rows AS DOUBLE))', 6)} END AS storm_lift FROM g",
)
def walk_forward_year(spark, sf_dir):
    """Years of at least 50 rows with 750 before them: the range threshold of the rows before, rank correlations, and storms against ranges from the threshold on."""
    rows = observations(spark, sf_dir).select("asset", F.year("date").alias("year"), "temperature", "rain", "weather", half_up(F.col("fwd_return1"), 9).alias("r1"), half_up(F.col("next_true_range"), 9).alias("tr"))
    years = rows.groupBy("asset", "year").agg(F.count("*").alias("rows"))
    prior = rows.select("asset", F.col("year").alias("_old"), F.col("tr").alias("_r"))
    cuts = years.join(prior, "asset").where("_old < year").groupBy("asset", "year", "rows").agg(half_up(F.percentile("_r", 0.8), 6).alias("threshold"), F.count("*").alias("prior")).where("prior >= 750 and rows >= 50")
    storm, event = F.col("weather") == WEATHER[0], half_up(F.col("tr"), 6) >= F.col("threshold")
    keys = ["asset", "year"]
    judged = rows.join(cuts, keys).groupBy(*keys, "prior", "rows", "threshold").agg(F.count_if(storm).alias("alerts"), F.count_if(event).alias("events"), F.count_if(storm & event).alias("hits"))
    for x, y, name in (("temperature", "r1", "temperature_return_spearman"), ("rain", "tr", "rain_range_spearman")):
        judged = judged.join(metrics.spearman(rows, x, y, keys).select(*keys, F.col("spearman").alias(name)), keys)
    precision = F.try_divide(F.col("hits").cast("double"), F.col("alerts"))
    return judged.select(
        *keys, "prior", "rows", "threshold", "temperature_return_spearman", "rain_range_spearman",
        half_up(precision, 6).alias("storm_precision"),
        half_up(F.try_divide(F.col("hits").cast("double"), F.col("events")), 6).alias("storm_recall"),
        half_up(F.try_divide(precision, F.when(F.col("events") > 0, F.col("events") / F.col("rows"))), 6).alias("storm_lift"),
    )


@query("yearly_stability", chain("obs") + f"SELECT asset, year(date) AS year, count(*) AS rows, {h('avg(fwd_return1)', 6)} AS return1, {h('avg(CAST((temperature >= 50) = (fwd_return1 > 0) AS INT))', 6)} AS accuracy FROM obs GROUP BY ALL")
def yearly_stability(spark, sf_dir):
    right = (F.col("temperature") >= 50) == (F.col("fwd_return1") > 0)
    return observations(spark, sf_dir).groupBy("asset", F.year("date").alias("year")).agg(F.count("*").alias("rows"), half_up(F.avg("fwd_return1"), 6).alias("return1"), half_up(F.avg(right.cast("int")), 6).alias("accuracy"))


@query("grouping_sets_metrics", chain("obs", more={"y": "SELECT *, year(date) AS year FROM obs"}) + f"SELECT asset, year, count(*) AS rows, {h('avg(next_true_range)', 6)} AS mean_range FROM y GROUP BY GROUPING SETS ((), (asset), (year), (asset, year))")
def grouping_sets_metrics(spark, sf_dir):
    rows = observations(spark, sf_dir).withColumn("year", F.year("date"))
    year, asset = F.col("year"), F.col("asset")
    return rows.groupingSets([[], [asset], [year], [asset, year]], asset, year).agg(F.count("*").alias("rows"), half_up(F.avg("next_true_range"), 6).alias("mean_range")).select("asset", "year", "rows", "mean_range")


#: Regimes within the years of the tables.
_PERIODS = (("first", "1995-01-01", "1996-12-31", 250), ("second", "1996-07-01", "1997-06-30", 200), ("later", "2020-01-01", "2020-12-31", 150))
_UNCOVERED = ", ".join(f"CASE WHEN count_if(date BETWEEN DATE '{a}' AND DATE '{b}') < {n} THEN '{name}' END" for name, a, b, n in _PERIODS)


def _audit_sql(daily: bool) -> str:
    year, gap, stale = (330, 2, 1) if daily else (200, 10, 4)
    expected = "SELECT asset, CAST(last_date - first_date + 1 AS BIGINT) AS expected FROM g" if daily else "SELECT g.asset AS asset, count(DISTINCT m.date) AS expected FROM g LEFT JOIN market m ON m.date BETWEEN first_date AND last_date GROUP BY g.asset"
    return (
        chain(
            "bars",
            "market",
            more={
                "r": "SELECT *, lag(close) OVER w AS b, date - lag(date) OVER w AS gap FROM bars WINDOW w AS (PARTITION BY asset ORDER BY date)",
                "g": f"SELECT asset, count(*) AS rows, min(date) AS first_date, max(date) AS last_date, {h('avg(CASE WHEN volume <= 0 THEN 100e0 ELSE 0e0 END)', 6)} AS zero_volume, {h('count_if(close = b) * 100e0 / greatest(1, count(*) - 1)', 6)} AS unchanged, CAST(count_if({h('abs(close / b - 1.0) * 100.0', 9)} >= 25) AS BIGINT) AS jumps, CAST(coalesce(max(gap), 0) AS INT) AS max_gap, array_to_string(list_filter([{_UNCOVERED}], lambda x: x IS NOT NULL), ' ') AS u FROM r GROUP BY asset",
                "e": expected,
                "c": f"SELECT *, {h('least(100e0, rows * 100.0 / expected)', 6)} AS coverage, {h('(last_date - first_date) / 365.25e0', 6)} AS years, CAST(DATE '2001-11-05' - last_date AS INT) AS stale_days FROM g JOIN e USING (asset)",
                "i": f"SELECT *, list_filter([CASE WHEN rows < 3 * {year} THEN 'error:history' END, CASE WHEN coverage < 97 THEN 'error:coverage' END, CASE WHEN zero_volume > 1 THEN 'error:volume' END, CASE WHEN max_gap > {gap} THEN 'error:gap' END, CASE WHEN stale_days > {stale} THEN 'error:stale' END, CASE WHEN jumps > 0 THEN 'info:jumps' END, CASE WHEN u <> '' THEN 'info:regimes ' || u END], lambda x: x IS NOT NULL) AS l FROM c",
            },
        )
        + "SELECT asset, rows, expected, coverage, years, zero_volume, unchanged, jumps, max_gap, stale_days, array_to_string(l, ',') AS issues, CASE WHEN len(list_filter(l, lambda x: starts_with(x, 'error'))) > 0 THEN 'fail' ELSE 'pass' END AS gate FROM i"
    )


def _audited(spark, sf_dir, calendar):
    out = audit.audit(source.daily_bars(spark, sf_dir), calendar, F.lit("2001-11-05").cast("date"), minimum_years=3, regimes=_PERIODS)
    return out.select("asset", "rows", "expected", "coverage", "years", "zero_volume", "unchanged", "jumps", "max_gap", "stale_days", "issues", "gate")


@query("quality_audit", _audit_sql(False))
def quality_audit(spark, sf_dir):
    return _audited(spark, sf_dir, source.market_bars(spark, sf_dir))


@query("quality_audit_daily", _audit_sql(True))
def quality_audit_daily(spark, sf_dir):
    """The same for series that trade every day."""
    return _audited(spark, sf_dir, None)


REGIMES = [("early", "1992-01-01", "1993-12-31"), ("middle", "1993-07-01", "1996-06-30"), ("late", "1996-01-01", "1998-12-31")]


@query("regime_counts", chain("bars") + "SELECT asset, " + ", ".join(f"CAST(count_if(date BETWEEN DATE '{a}' AND DATE '{b}') AS BIGINT) AS {n}" for n, a, b in REGIMES) + " FROM bars GROUP BY asset")
def regime_counts(spark, sf_dir):
    return audit.regime_counts(source.daily_bars(spark, sf_dir), REGIMES)


@query(
    "redundant_pairs",
    chain("ind", more={"p": f"SELECT a.asset AS \"left\", b.asset AS \"right\", count(*) AS days, {h('CASE WHEN count(*) >= 3 THEN corr(a.change1, b.change1) END', 6)} AS correlation FROM ind a JOIN ind b ON a.date = b.date AND a.asset < b.asset WHERE a.change1 IS NOT NULL AND b.change1 IS NOT NULL GROUP BY 1, 2"})
    + 'SELECT "left", "right", days, correlation, CASE WHEN days < 252 OR correlation IS NULL OR correlation < 0.92 THEN \'distinct\' WHEN correlation >= 0.98 THEN \'same\' ELSE \'redundant\' END AS level FROM p',
)
def redundant_pairs(spark, sf_dir):
    return audit.redundant_pairs(indicator_rows(spark, sf_dir), "change1")


@query("max_drawdown", chain("bars", more={"p": "SELECT asset, close / max(close) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1.0 AS d FROM bars"}) + f"SELECT asset, {h('least(0e0, min(d)) * 100.0', 6)} AS max_drawdown FROM p GROUP BY asset")
def max_drawdown(spark, sf_dir):
    return indicators.max_drawdown(source.daily_bars(spark, sf_dir))


@query("calendar_gap", chain("bars", more={"g": "SELECT asset, date - lag(date) OVER (PARTITION BY asset ORDER BY date) AS g FROM bars"}) + "SELECT asset, CAST(coalesce(max(g), 0) AS INT) AS max_gap FROM g GROUP BY asset")
def calendar_gap(spark, sf_dir):
    return indicators.calendar_gap(source.daily_bars(spark, sf_dir))


_WEIGHTS = {
    "k": "SELECT *, left(asset, 1) AS cluster FROM panel",
    "wr": "SELECT cluster, asset, count(*) AS n_rows FROM k GROUP BY ALL",
    "wc": "SELECT cluster, count(*) AS n_assets, sum(n_rows) AS n_in FROM wr GROUP BY cluster",
    "wt": "SELECT count(*) AS n_clusters, sum(n_in) AS n_all FROM wc",
    "w": "SELECT k.*, CAST(n_all AS DOUBLE) / n_clusters / n_assets / n_rows AS weight FROM k JOIN wr USING (cluster, asset) JOIN wc USING (cluster) CROSS JOIN wt",
}


def weighted_rows(spark, sf_dir):
    columns = ("asset", "date", "atr14", "rsi14", "sma_gap20", "realized_vol20", "rain", "next_true_range", "tail1")
    rows = panel_rows(spark, sf_dir, indicators.TAIL).select(*columns, F.substring("asset", 1, 1).alias("cluster")).cache()  # counted at three levels
    return models.hierarchical_weights(rows, "cluster", "asset")


@query("weights_hierarchical", chain("panel", more=_WEIGHTS) + f"SELECT cluster, asset, count(*) AS rows, {h('max(weight)', 6)} AS weight FROM w GROUP BY cluster, asset")
def weights_hierarchical(spark, sf_dir):
    return weighted_rows(spark, sf_dir).groupBy("cluster", "asset").agg(F.count("*").alias("rows"), half_up(F.max("weight"), 6).alias("weight"))


_MOMENTS = ", ".join(f"{h(f'sum(weight * {c}) / sum(weight)', 6)} AS {c}_mean, {h(f'sqrt(sum(weight * {c} * {c}) / sum(weight) - (sum(weight * {c}) / sum(weight)) * (sum(weight * {c}) / sum(weight)))', 6)} AS {c}_spread" for c in ("rsi14", "sma_gap20"))


@query("weighted_moments", chain("panel", more=_WEIGHTS) + f"SELECT count(*) AS rows, {_MOMENTS} FROM w")
def weighted_moments(spark, sf_dir):
    out = [F.count("*").alias("rows")]
    for c in ("rsi14", "sma_gap20"):
        mean = F.sum(F.col("weight") * F.col(c)) / F.sum("weight")
        out += [half_up(mean, 6).alias(f"{c}_mean"), half_up(F.sqrt(F.sum(F.col("weight") * F.col(c) * F.col(c)) / F.sum("weight") - mean * mean), 6).alias(f"{c}_spread")]
    return weighted_rows(spark, sf_dir).agg(*out)


@query("base_rate_and_scale", chain("panel", more=_WEIGHTS) + f"SELECT cluster, {h('sum(weight * tail1) / sum(weight)', 6)} AS base_rate, {h('exp(sum(weight * ln(next_true_range / atr14)) / sum(weight))', 6)} AS atr_scale FROM w GROUP BY cluster")
def base_rate_and_scale(spark, sf_dir):
    w = F.col("weight")
    scale = F.exp(F.sum(w * F.ln(F.col("next_true_range") / F.col("atr14"))) / F.sum(w))
    return weighted_rows(spark, sf_dir).groupBy("cluster").agg(half_up(F.sum(w * F.col("tail1")) / F.sum(w), 6).alias("base_rate"), half_up(scale, 6).alias("atr_scale"))


PREDICTORS = ["log_atr", "rsi14", "sma_gap20", "realized_vol20"]


def _placed(spark, sf_dir):
    """Weighted panel with the logarithm of the range predictor and each row's place (0 to 1) in its series."""
    w = Window.partitionBy("asset")
    place = (F.row_number().over(w.orderBy("date")) - 1) / F.count("*").over(w)
    rows = weighted_rows(spark, sf_dir).withColumns({"log_atr": F.ln(F.greatest(F.col("atr14"), F.lit(0.01))), "place": place})
    return rows.cache()  # each step of a fit reads them


def _log_range():
    return F.ln(F.greatest(F.col("next_true_range"), F.lit(0.01)))


@query("ridge_predictions")
def ridge_predictions(spark, sf_dir):
    """Ranges predicted by a ridge model of the logarithm, fitted on the first 60% of each series, for the rest."""
    rows = _placed(spark, sf_dir)
    model = models.ridge(rows.where("place < 0.6"), PREDICTORS, _log_range(), 0.1)
    return rows.where("place >= 0.6").select("asset", "date", half_up(model.range_prediction(), 4).alias("predicted"), "next_true_range")


@query("logistic_predictions")
def logistic_predictions(spark, sf_dir):
    """Tail probabilities of a logistic model fitted on the first 60% of each series, for the rest."""
    rows = _placed(spark, sf_dir)
    model = models.logistic(rows.where("place < 0.6"), PREDICTORS, "tail1", 0.01)
    return rows.where("place >= 0.6").select("asset", "date", half_up(model.probability(), 4).alias("p"), "tail1")


@query("walk_forward_search")
def walk_forward_search(spark, sf_dir):
    """Mean absolute errors, equal by asset, of ridge penalties over three folds, the least first."""
    rows = _placed(spark, sf_dir)
    out = None
    for fold, start in enumerate((0.4, 0.6, 0.8)):
        for penalty in (0.01, 0.1, 1.0):
            model = models.ridge(rows.where(F.col("place") < start), PREDICTORS, _log_range(), penalty)
            held = rows.where((F.col("place") >= start) & (F.col("place") < start + 0.2))
            part = held.select(F.lit(penalty).alias("penalty"), F.lit(fold).alias("fold"), "asset", F.abs(model.range_prediction() - F.col("next_true_range")).alias("error"))
            out = part if out is None else out.unionByName(part)
    by_asset = out.groupBy("penalty", "fold", "asset").agg(F.avg("error").alias("mae"))
    return by_asset.groupBy("penalty").agg(half_up(F.avg("mae"), 4).alias("mae")).orderBy("mae", "penalty")


@query(
    "weighted_quantile",
    chain(
        "panel",
        more=_WEIGHTS
        | {
            "v": f"SELECT cluster, {h('next_true_range / atr14', 8)} AS q, weight FROM w",
            "m": "SELECT *, (sum(weight) OVER (PARTITION BY cluster ORDER BY q, weight ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - weight / 2.0) / sum(weight) OVER (PARTITION BY cluster) AS m FROM v",
            "n": "SELECT *, lead(q) OVER (PARTITION BY cluster ORDER BY q, weight) AS nq, lead(m) OVER (PARTITION BY cluster ORDER BY q, weight) AS nm, first_value(q) OVER (PARTITION BY cluster ORDER BY q, weight) AS fq, first_value(m) OVER (PARTITION BY cluster ORDER BY q, weight) AS fm FROM m",
        },
    )
    + "SELECT cluster, " + ", ".join(f"{h(f'coalesce(max(CASE WHEN m <= {p} AND nm > {p} THEN q + (nq - q) * (({p} - m) / (nm - m)) WHEN m <= {p} AND nm IS NULL THEN q END), max(CASE WHEN fm > {p} THEN fq END))', 4)} AS q{k}" for k, p in enumerate((0.1, 0.25, 0.75, 0.9))) + " FROM n GROUP BY cluster",
)
def weighted_quantile(spark, sf_dir):
    rows = weighted_rows(spark, sf_dir).withColumn("q", models.outcome_ratio("atr14", "next_true_range"))
    got = models.weighted_quantile(rows, "q", "weight", [0.1, 0.25, 0.75, 0.9], ["cluster"])
    return got.select("cluster", *(half_up(F.col(f"q{k}"), 4).alias(f"q{k}") for k in range(4)))


_PAST = "(PARTITION BY asset ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)"
@query(
    "trailing_prior",
    chain("panel") + f"SELECT asset, date, {h(f'(coalesce(sum(tail1) OVER {_PAST}, 0) + 100.0e0 * 0.1e0) / (count(tail1) OVER {_PAST} + 100.0e0)', 6)} AS prior FROM panel",
)
def trailing_prior(spark, sf_dir):
    return models.trailing_prior(panel_rows(spark, sf_dir, indicators.TAIL), "tail1", F.lit(0.1)).select("asset", "date", half_up(F.col("prior"), 6).alias("prior"))


_GRADES = {
    "l": f"SELECT asset, date, atr14, next_true_range, list({'atr14'}) OVER {_PAST} AS ls, count(next_true_range) OVER {_PAST} AS k, {h(f'quantile_cont(next_true_range, 0.5) OVER {_PAST}', 8)} AS md, {h(f'quantile_cont(next_true_range, 0.9) OVER {_PAST}', 8)} AS q9 FROM panel",
    "g": f"SELECT *, {h('len(list_filter(ls, lambda x: x <= atr14)) * 100.0 / 252', 6)} AS rank FROM l WHERE len(ls) = 252",
    "w": f"SELECT asset, date, rank, CASE WHEN rank < 25 THEN 'calm' WHEN rank < 75 THEN 'normal' WHEN rank < 90 THEN 'rough' ELSE 'storm' END AS grade, md AS prior_median, CAST(next_true_range > q9 AS INT) AS high_event, {h('atr14 / md', 6)} AS relative FROM g",
}


def _graded(spark, sf_dir):
    rows = models.trailing_reference(panel_rows(spark, sf_dir), "atr14", "next_true_range").where("prediction_rank is not null")
    return rows.withColumn("grade", weather_grade(F.col("prediction_rank")))


@query("weather_grades", chain("panel", more=_GRADES) + "SELECT asset, date, rank, grade, prior_median, high_event, relative FROM w")
def weather_grades(spark, sf_dir):
    return _graded(spark, sf_dir).select("asset", "date", F.col("prediction_rank").alias("rank"), "grade", "prior_median", "high_event", "relative")


@query("grade_report", chain("panel", more=_GRADES) + f"SELECT grade, count(*) AS days, {h('avg(high_event)', 6)} AS event_rate, {h('quantile_cont(relative, 0.5)', 6)} AS median_relative, {h('count(*) * 1e0 / (SELECT count(*) FROM w)', 6)} AS share FROM w GROUP BY grade")
def grade_report(spark, sf_dir):
    got = _graded(spark, sf_dir).groupBy("grade").agg(F.count("*").alias("days"), half_up(F.avg("high_event"), 6).alias("event_rate"), half_up(F.percentile("relative", 0.5), 6).alias("median_relative"))
    total = got.agg(F.sum("days").alias("_all"))
    return got.crossJoin(F.broadcast(total)).select("grade", "days", "event_rate", "median_relative", half_up(F.col("days") / F.col("_all"), 6).alias("share"))


@query("grade_monotone", chain("panel", more=_GRADES | {"e": "SELECT CASE grade WHEN 'calm' THEN 0 WHEN 'normal' THEN 1 WHEN 'rough' THEN 2 ELSE 3 END AS o, floor(avg(high_event) * 1e6 + 0.5) / 1e6 AS r FROM w GROUP BY o", "f": "SELECT coalesce(r >= lag(r) OVER (ORDER BY o), true) AS ok FROM e"}) + "SELECT count(*) AS bins, bool_and(ok) AS monotone FROM f")
def grade_monotone(spark, sf_dir):
    order = F.when(F.col("grade") == "calm", 0).when(F.col("grade") == "normal", 1).when(F.col("grade") == "rough", 2).otherwise(3)
    bins = _graded(spark, sf_dir).groupBy(order.alias("o")).agg(half_up(F.avg("high_event"), 6).alias("r"))
    return metrics.monotone(bins, "o", "r")


_FORECASTS = {
    "f": "SELECT asset || ':' || CAST(date AS VARCHAR) AS forecast_id, asset, date AS as_of, atr14 AS predicted, floor(atr14 * 0.7e0 * 1e6 + 0.5) / 1e6 AS low50, floor(atr14 * 1.2e0 * 1e6 + 0.5) / 1e6 AS high50, floor(atr14 * 0.5e0 * 1e6 + 0.5) / 1e6 AS low80, floor(atr14 * 1.6e0 * 1e6 + 0.5) / 1e6 AS high80 FROM ind WHERE atr14 IS NOT NULL",
    "s": f"SELECT forecast_id, f.asset AS asset, as_of, predicted, next_true_range AS actual, {h('abs(predicted - next_true_range)', 6)} AS error, next_true_range BETWEEN low50 AND high50 AS covered50, next_true_range BETWEEN low80 AND high80 AS covered80 FROM f JOIN lab ON f.asset = lab.asset AND f.as_of = lab.date WHERE next_true_range IS NOT NULL",
}


def forecasts(spark, sf_dir):
    bound = lambda k, name: half_up(F.col("atr14") * k, 6).alias(name)
    rows = indicator_rows(spark, sf_dir).where("atr14 is not null")
    return rows.select(F.concat("asset", F.lit(":"), F.col("date").cast("string")).alias("forecast_id"), "asset", F.col("date").alias("as_of"), F.col("atr14").alias("predicted"), bound(0.7, "low50"), bound(1.2, "high50"), bound(0.5, "low80"), bound(1.6, "high80"))


def settlements(spark, sf_dir):
    outcomes = indicators.with_labels(source.daily_bars(spark, sf_dir)).where("next_true_range is not null").select("asset", F.col("date").alias("as_of"), F.col("next_true_range").alias("actual"))
    return ledger.settle(forecasts(spark, sf_dir), outcomes).withColumn("error", half_up(F.col("error"), 6))


@query("settlement_join", chain("ind", "lab", more=_FORECASTS) + "SELECT * FROM s")
def settlement_join(spark, sf_dir):
    return settlements(spark, sf_dir)


@query("unsettled_anti", chain("ind", "lab", more=_FORECASTS) + "SELECT forecast_id, asset, as_of FROM f ANTI JOIN s USING (forecast_id)")
def unsettled_anti(spark, sf_dir):
    return ledger.not_yet(forecasts(spark, sf_dir), settlements(spark, sf_dir), "forecast_id").select("forecast_id", "asset", "as_of")


@query("latest_forecasts", chain("ind", "lab", more=_FORECASTS) + "SELECT asset, forecast_id, as_of, predicted FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY as_of DESC, forecast_id) AS n FROM f) WHERE n = 1")
def latest_forecasts(spark, sf_dir):
    return ledger.latest(forecasts(spark, sf_dir), "asset", "as_of", "forecast_id").select("asset", "forecast_id", "as_of", "predicted")


@query("status_report", chain("ind", "lab", more=_FORECASTS) + f"SELECT asset, count(*) AS settled, {h('avg(error)', 6)} AS mae, {h('avg(CAST(covered50 AS INT))', 6)} AS coverage50, {h('avg(CAST(covered80 AS INT))', 6)} AS coverage80, CASE WHEN count(*) >= 120 THEN 'full' WHEN count(*) >= 60 THEN 'interim' ELSE 'preliminary' END AS stage FROM s GROUP BY asset")
def status_report(spark, sf_dir):
    rate = lambda c: half_up(F.avg(F.col(c).cast("int")), 6)
    got = settlements(spark, sf_dir).groupBy("asset").agg(F.count("*").alias("settled"), half_up(F.avg("error"), 6).alias("mae"), rate("covered50").alias("coverage50"), rate("covered80").alias("coverage80"))
    return got.withColumn("stage", F.when(F.col("settled") >= 120, "full").when(F.col("settled") >= 60, "interim").otherwise("preliminary"))


_CHAIN = """WITH RECURSIVE e AS (SELECT event_type, event_id, sha256(concat_ws('|', event_id, user_id, event_type)) AS h, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS position FROM events WHERE user_id < {0}),
c AS (SELECT event_type, position, event_id, 'GENESIS' AS previous_hash, sha256('GENESIS|' || h) AS record_hash FROM e WHERE position = 0
  UNION ALL SELECT e.event_type, e.position, e.event_id, c.record_hash, sha256(c.record_hash || '|' || e.h) FROM c JOIN e ON e.event_type = c.event_type AND e.position = c.position + 1)
"""


def _payload():
    return F.concat_ws("|", F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type")


def _ledger(spark, sf_dir):
    rows = source.read(spark, sf_dir, "events").select("event_type", "event_id", "user_id")
    return ledger.chained(rows, "event_type", ["event_id"], _payload())


@query("hash_chain", _CHAIN.format("1e18") + "SELECT event_type, CAST(position AS INT) AS position, event_id, previous_hash, record_hash FROM c")
def hash_chain(spark, sf_dir):
    return _ledger(spark, sf_dir).select("event_type", "position", "event_id", "previous_hash", "record_hash")


@query("chain_breaks", "SELECT event_type, event_id FROM events WHERE event_id % 1000 = 7")
def chain_breaks(spark, sf_dir):
    """Records that were altered after they had been chained are found, and no others."""
    altered = _ledger(spark, sf_dir).withColumn("user_id", F.when(F.col("event_id") % 1000 == 7, F.col("user_id") + 1).otherwise(F.col("user_id")))
    return ledger.chain_breaks(altered, "event_type", _payload()).select("event_type", "event_id")


@query("bootstrap_mean")
def bootstrap_mean(spark, sf_dir):
    got = bootstrap.mean_interval(observations(spark, sf_dir), "fwd_return1", "asset", "date")
    return metrics.rounded(got)


@query("block_bootstrap")
def block_bootstrap(spark, sf_dir):
    rows = panel_rows(spark, sf_dir).select("asset", "date", F.abs(F.col("atr14") * 0.9 - F.col("next_true_range")).alias("better"), F.abs(F.col("atr14") - F.col("next_true_range")).alias("worse"))
    return metrics.rounded(bootstrap.block_delta(rows, "better", "worse", "asset", "date"))


@query("random_direction")
def random_direction(spark, sf_dir):
    return metrics.rounded(bootstrap.random_direction(observations(spark, sf_dir), "fwd_return1", "asset", "date"))


@query("look_ahead", "SELECT CAST(NULL AS VARCHAR) AS asset WHERE false")
def look_ahead(spark, sf_dir):
    """Features up to the middle of 1998, long after the warm-up, that change when later bars do: none."""
    features = lambda b: indicators.with_features(indicators.with_indicators(b))
    return audit.future_change(features, source.daily_bars(spark, sf_dir), "1998-06-30", ["return1", "atr14", "rsi14", "return_z252", *indicators.TRAILING]).select("asset")


