"""Queries of the model suite, frozen models, bootstraps, cohort bundles with their gates, trailing state and score parity."""

from __future__ import annotations

import dataclasses
import math
import uuid

from pyspark.sql import functions as F

from weftline.functions.scalar import half_up
from weftline.functions.shared import shared_dir, written
from weftline.operators import bootstrap, calibration, cohorts, comparison, frozen, indicators, joins, metrics, models, parity, suite
from weftline.plans.calibration import _FOLDS, _MOMENT_VALUES, _PRIOR, _TAPE, _WEATHER, FOLD_PREDICTORS, _log_y, _means, folds, tape
from weftline.plans.intervals import _BOUNDS, _ERROR, CUTOFF, HELD_OUT, judged_bounds
from weftline.plans.reference_sql import chain
from weftline.plans.reference_sql import half_up as h
from weftline.plans.series import feature_rows, indicator_rows, panel_rows, score_rows
from weftline.sources import bars as source
from weftline.streaming import prediction

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


YEAR = int(CUTOFF[:4])
#: Ranges of the test tables are hundreds of percent; models keep theirs between 0.01 and 100, so they are fitted in this unit.
UNIT = 100.0


# ---- the suite ----
#: Columns of the specifications, and penalties to try.
CORE = ("return_z", "abs_return_z", "gap_rank", "close_rank", "rsi_share", "atr_rank", "vol_rank", "volume_rank", "drawdown_atr")
RANGE = ("log_atr", "log_downside", *CORE)
SCORED = ("rain_share", "temperature_share", "volatility_share", "momentum_share")
RIDGE_PENALTIES = (0.0, 0.001, 0.01, 0.1, 1.0, 10.0)
LOGISTIC_PENALTIES = (0.0, 0.001, 0.01, 0.1, 1.0)
#: Context that the tables have: the market and the breadth of the series.
CONTEXT = ("market_return1", "market_return5", "market_atr_rank", "log_market_vol", "breadth_up_share", "breadth_sma20_share")

SPECS = [
    suite.Spec("range-core", "range", RANGE, RIDGE_PENALTIES),
    suite.Spec("range-core-score", "range", RANGE + SCORED, RIDGE_PENALTIES),
    suite.Spec("range-context", "range", RANGE + SCORED + CONTEXT, RIDGE_PENALTIES, "full_context"),
    suite.Spec("tail-core", "tail", CORE, LOGISTIC_PENALTIES),
    suite.Spec("tail-core-score", "tail", CORE + SCORED, LOGISTIC_PENALTIES),
    suite.Spec("tail-context", "tail", CORE + SCORED + CONTEXT, LOGISTIC_PENALTIES, "full_context"),
    suite.Spec("direction-core", "direction", CORE, LOGISTIC_PENALTIES),
    suite.Spec("direction-core-score", "direction", CORE + SCORED, LOGISTIC_PENALTIES),
]


def context(spark, sf_dir):
    """date with what the market and the series' breadth say on the latest day of each up to it, at most four days before; null without."""
    market = source.market_bars(spark, sf_dir).withColumn("asset", F.lit("market"))
    known = indicators.with_features(indicators.with_indicators(market), trailing=("atr_rank252",))
    known = known.select("date", F.col("return1").alias("market_return1"), F.col("return5").alias("market_return5"), F.col("atr_rank252").alias("market_atr_rank252"), F.col("realized_vol20").alias("market_vol20"))
    features = feature_rows(spark, sf_dir)
    days = features.select("date").distinct()
    members = features.select(F.col("asset").alias("member"), "date", "return1", "sma_gap20")
    wide = joins.breadth(days, members, least=3).select("date", F.col("up_share").alias("breadth_up"), F.col("above_share").alias("breadth_sma20"))
    return joins.asof(wide, known, "date", [c for c in known.columns if c != "date"], tolerance_days=4)


def suite_rows(spark, sf_dir):
    """Records of panel rows with folds, targets, role and whether all context is there; written once, as every fit reads them."""
    rows = panel_rows(spark, sf_dir, *indicators.TRAILING).join(context(spark, sf_dir), "date", "left")
    there = F.lit(True)
    for c in ("market_return1", "market_return5", "market_atr_rank252", "market_vol20", "breadth_up", "breadth_sma20"):
        there = there & F.col(c).isNotNull()
    rows = calibration.yearly_folds(rows.withColumn("cluster", F.substring("asset", 1, 1)))
    rows = rows.withColumns({"full_context": there, "role": F.when(F.col("asset") == HELD_OUT, "holdout").otherwise("development"), "y": F.col("next_true_range") / UNIT, "log_range": F.ln(F.greatest(F.col("next_true_range") / UNIT, F.lit(0.01))), "atr": F.greatest(F.col("atr14") / UNIT, F.lit(0.01))})
    return written(calibration.model_record(rows, "asset", "date", "cluster", "fold", "known", "settled", "role", "full_context", "y", "atr", "log_range", "tail1", "up1"))


def _trained(rows):
    """The suite tuned on the development rows' folds before the cutoff."""
    learn = rows.where("role = 'development'")
    years = sorted(r[0] for r in learn.where(F.col("fold") < YEAR).select("fold").distinct().collect())
    return suite.train(learn.where(F.col("fold") < YEAR), SPECS, years, YEAR)


def _baselines(rows) -> tuple[float, float, float]:
    """Scale of the ATR, and base rates of tails and rises, of development rows known before the cutoff."""
    learn = rows.where((F.col("role") == "development") & (F.col("known") < YEAR))
    per = learn.groupBy("cluster", "asset").agg(F.avg(F.col("log_range") - F.ln("atr")).alias("s"), F.avg("tail1").alias("t"), F.avg("up1").alias("u"))
    r = per.groupBy("cluster").agg(*(F.avg(c).alias(c) for c in "stu")).agg(*(F.avg(c).alias(c) for c in "stu")).first()
    return math.exp(r.s), float(r.t), float(r.u)


@query("model_suite")
def model_suite(spark, sf_dir):
    """Mean walk-forward score of every specification and penalty, and which is chosen."""
    got = _trained(suite_rows(spark, sf_dir)).tuning
    return spark.createDataFrame([(n, float(p), round(s, 6), k, c) for n, p, s, k, c in got], "model string, penalty double, score double, folds int, chosen boolean")  # as many rows as models


@query("suite_coefficients")
def suite_coefficients(spark, sf_dir):
    """The eight columns of greatest absolute standardised coefficient of each final model."""
    final = _trained(suite_rows(spark, sf_dir)).final
    rows = [(name, k + 1, c, round(b, 6)) for name, f in final.items() for k, (c, b) in enumerate(calibration.top_coefficients(f.model))]
    return spark.createDataFrame(rows, "model string, place int, feature string, coefficient double")


def _judged(rows, trained):
    """Settled rows from the cutoff on with the predictions of all models and baselines."""
    scale, tail, up = _baselines(rows)
    later = rows.where((F.col("fold") >= YEAR) & F.col("settled"))
    return suite.predictions(later, trained).withColumns({"range-atr": F.col("atr"), "range-atr-scaled": F.col("atr") * scale, "tail-base": F.lit(tail), "tail-rain": F.col("rain_p"), "direction-base": F.lit(up), "direction-temperature": F.col("temperature_p")})


def _models(judged, task: str) -> list[str]:
    return [c for c in judged.columns if c.startswith(f"{task}-")]


def _unpivoted(judged, task: str):
    ids = ["role", "asset", "date", "full_context", "y", "tail1", "up1"]
    rows = judged.unpivot(ids, [F.col(f"`{c}`") for c in _models(judged, task)], "model", "p")
    return rows.where("full_context or model not like '%-context'")


@query("suite_evaluation")
def suite_evaluation(spark, sf_dir):
    """Every model and baseline from the cutoff on, by role, series alike: mean absolute error and rank correlation of ranges, Brier score and AUC of chances."""
    rows = suite_rows(spark, sf_dir)
    judged = written(_judged(rows, _trained(rows)))
    ranges = _unpivoted(judged, "range")
    keys = ["role", "model", "asset"]
    each = ranges.groupBy(*keys).agg(F.avg(F.abs(F.col("p") - F.col("y"))).alias("error")).join(metrics.spearman(ranges, "p", "y", keys).select(*keys, F.col("spearman").alias("order")), keys)
    for task, truth in (("tail", "tail1"), ("direction", "up1")):
        chances = _unpivoted(judged, task)
        brier = chances.groupBy(*keys).agg(F.avg((F.col("p") - F.col(truth)) * (F.col("p") - F.col(truth))).alias("error"))
        each = each.unionByName(brier.join(metrics.roc_auc(chances, "p", truth, keys).select(*keys, F.col("auc").alias("order")), keys))
    return metrics.rounded(each.groupBy("role", "model").agg(F.count("*").alias("assets"), F.avg("error").alias("error"), F.avg("order").alias("order")), 5)


#: Candidate and baseline of each comparison that a deployment rests on.
COMPARISONS = {
    "range-core": ("range-core", "range-atr-scaled", "y"),
    "range-score-adds": ("range-core-score", "range-core", "y"),
    "tail-core": ("tail-core", "tail-base", "tail1"),
    "tail-score-adds": ("tail-core-score", "tail-core", "tail1"),
    "direction-core": ("direction-core", "direction-base", "up1"),
}


@query("suite_deployment")
def suite_deployment(spark, sf_dir):
    """Errors of candidates less those of baselines, by role, with 95% intervals over circular blocks, and what the held-out series allow."""
    rows = suite_rows(spark, sf_dir)
    judged = _judged(rows, _trained(rows))

    def error(c: str, truth: str):
        d = F.col(f"`{c}`") - F.col(truth)
        return F.abs(d) if truth == "y" else d * d

    each = F.array(*(F.struct(F.lit(n).alias("comparison"), error(c, t).alias("candidate"), error(b, t).alias("baseline")) for n, (c, b, t) in COMPARISONS.items()))
    long = written(judged.select("role", "asset", "date", F.inline(each)))
    got = bootstrap.error_delta(long, "candidate", "baseline", "asset", "date", by=("role", "comparison"))
    return metrics.rounded(got.select("role", "comparison", "mean", "low", "high", calibration.deployment(F.col("low"), F.col("high")).alias("decision")), 5)


# ---- ridge models in closed form, frozen models ----
def _two(name: str, source_rows: str) -> dict[str, str]:
    """Coefficients of the ridge of two predictors from a query of means, by fold."""
    return {
        f"{name}0": f"SELECT *, sqrt(greatest(1e-12, m0_0 - x0 * x0)) AS s0, sqrt(greatest(1e-12, m1_1 - x1 * x1)) AS s1 FROM ({source_rows})",
        f"{name}1": f"SELECT *, (m0_0 - x0 * x0) / s0 / s0 + 0.1e0 AS d0, (m1_1 - x1 * x1) / s1 / s1 + 0.1e0 AS d1, (m0_1 - x0 * x1) / s0 / s1 AS r, (t0 - x0 * t) / s0 AS c0, (t1 - x1 * t) / s1 AS c1 FROM {name}0",
        name: f"SELECT fold, x0, x1, s0, s1, t, (d1 * c0 - r * c1) / (d0 * d1 - r * r) AS b0, (d0 * c1 - r * c0) / (d0 * d1 - r * r) AS b1 FROM {name}1",
    }


def _predicted(x0: str, x1: str) -> str:
    return f"{UNIT!r}e0 * exp(least(ln(100e0), greatest(ln(0.01e0), m.t - ln({UNIT!r}e0) + ({x0} - m.x0) / m.s0 * m.b0 + ({x1} - m.x1) / m.s1 * m.b1)))"


_FOLD_MEANS = _means(", ".join(f"avg({x}) AS {n}" for n, x in _MOMENT_VALUES.items()), list(_MOMENT_VALUES))
_RIDGE = _FOLDS | _two("rm", _FOLD_MEANS) | {"rt": f"SELECT k.*, {_predicted('ln(greatest(atr14, 0.01e0))', 'rsi14')} AS rp FROM k JOIN rm m USING (fold) WHERE settled"}
_FROZEN = _RIDGE | _two("fm", _FOLD_MEANS.replace("FROM k JOIN years ON known < years.fold", f"FROM (SELECT * FROM k WHERE asset <> '{HELD_OUT}') k JOIN (SELECT {YEAR} AS fold) years ON known < years.fold")) | {
    "ft": f"SELECT k.asset, k.date, {_predicted('ln(greatest(atr14, 0.01e0))', 'rsi14')} AS rp FROM k, fm m WHERE date >= DATE '{CUTOFF}'",
}


@query("ridge_tape", chain("panel", more=_RIDGE) + f"SELECT asset, date, fold, {h('rp', 4)} AS predicted, y FROM rt")
def ridge_tape(spark, sf_dir):
    """Out-of-fold ranges of ridge models of the logarithm, one for each year."""
    return _ridge(spark, sf_dir).select("asset", "date", "fold", half_up(F.col("predicted"), 4).alias("predicted"), "y")


def _ridge(spark, sf_dir):
    return _unit_tape(folds(spark, sf_dir))


def _unit_models(rows) -> dict:
    """A ridge model of each fold, in UNIT."""
    found = calibration.ridge_folds(rows, FOLD_PREDICTORS, _log_y(), 0.1)
    return {fold: dataclasses.replace(m, intercept=m.intercept - math.log(UNIT)) for fold, m in found.items()}


def _in_percent(rows):
    return rows.withColumn("predicted", F.col("predicted") * UNIT)


def _unit_tape(rows):
    return _in_percent(calibration.ridge_tape(rows, _unit_models(rows)))


@query("frozen_tape", chain("panel", more=_FROZEN) + f"SELECT asset, date, {h('rp', 4)} AS predicted FROM rt WHERE date < DATE '{CUTOFF}' UNION ALL SELECT asset, date, {h('rp', 4)} AS predicted FROM ft")
def frozen_tape(spark, sf_dir):
    """The tape up to the cutoff, from it on the predictions of a model that was frozen then, stored, verified and read back."""
    rows = written(folds(spark, sf_dir))
    model = _unit_models(rows.where(F.col("asset") != HELD_OUT).unionByName(_fold_of(rows)))[YEAR]
    body = {"model_id": "range-frozen", "cutoff": CUTOFF, "unit": UNIT, "predictors": FOLD_PREDICTORS, "range": frozen.packed(model, "range")}
    artefact = frozen.freeze(spark, f"{shared_dir(spark)}/weftline-frozen-{uuid.uuid4().hex}", body)
    before = calibration.ridge_tape(rows, _unit_models(rows))
    got = _in_percent(frozen.extend_tape(before, rows, artefact))
    return got.select("asset", "date", half_up(F.col("predicted"), 4).alias("predicted"))


def _fold_of(rows):
    """A row of the cutoff's year that learns nothing, so that this year is a fold even if no development row falls into it."""
    return rows.limit(1).withColumns({"fold": F.lit(YEAR), "known": F.lit(None).cast("int"), "settled": F.lit(False)})


# ---- cohorts: rows, bundles, gates ----
_ODDS = "1.0 / (1.0 + exp(-(ln(x / (1.0 - x)) + ln(prior / (1.0 - prior)) - ln(base / (1.0 - base)))))"
_COHORT = _BOUNDS | {k: v for k, v in _RIDGE.items() if k not in _FOLDS} | {k: v for k, v in _WEATHER.items() if k not in _TAPE} | {k: v for k, v in _PRIOR.items() if k not in _TAPE} | {
    "co0": "SELECT t.asset AS asset, t.date AS date, t.fold AS fold, t.cluster AS cluster, t.y AS y, t.tail1 AS tail1, rt.rp AS predicted, t.p AS baseline, t.base AS base, pr.prior AS prior, greatest(0.001e0, least(0.999e0, t.rain / 100.0)) AS x, rank, over_median, high_event, bound0, bound1, bound2, bound3 FROM t JOIN rt USING (asset, date) JOIN pr USING (asset, date) JOIN (SELECT * FROM bz WHERE scheme = 'shrunk252') z USING (asset, date) LEFT JOIN v USING (asset, date)",
    "co": f"SELECT *, CASE WHEN asset = '{HELD_OUT}' THEN 'holdout' ELSE 'development' END AS role, {h(_ODDS, 6)} AS prob FROM co0 WHERE base > 0 AND base < 1",
}


def bundle_sql(by: str) -> dict[str, str]:
    on = lambda c, when: f"avg(CASE WHEN {when} THEN {c} END)"
    return {
        "cr": f"SELECT *, rank() OVER (PARTITION BY {by}, asset ORDER BY prob) + (count(*) OVER (PARTITION BY {by}, asset, prob) - 1) / 2e0 AS place FROM co",
        "ca": f"""SELECT {by}, asset, count(*) AS n, avg(abs(y - predicted)) AS mae, avg(abs(y - baseline)) AS maeb, avg((prob - tail1) * (prob - tail1)) AS br, avg((base - tail1) * (base - tail1)) AS brb,
            avg(CAST(y BETWEEN bound1 AND bound2 AS INT)) AS c5, avg(CAST(y BETWEEN bound0 AND bound3 AS INT)) AS c8, avg(bound3 - bound0) AS w8,
            {on('over_median', 'rank < 25')} AS qr, {on('over_median', 'rank >= 90')} AS sr, {on('high_event', 'rank < 25')} AS qe, {on('high_event', 'rank >= 90')} AS se,
            {h('(sum(CASE WHEN tail1 = 1 THEN place END) - sum(tail1) * (sum(tail1) + 1) / 2e0) / nullif(CAST(sum(tail1) AS DOUBLE) * sum(1 - tail1), 0)', 6)} AS auc FROM cr GROUP BY {by}, asset""",
        "cb": f"""SELECT {by}, CAST(sum(n) AS BIGINT) AS rows, count(*) AS assets, {h('avg(mae)', 6)} AS mae, {h('avg(mae) - avg(maeb)', 6)} AS mae_delta, {h('avg(c5)', 6)} AS coverage50, {h('avg(c8)', 6)} AS coverage80, {h('avg(w8)', 6)} AS width80,
            {h(f'avg(CAST({h(_ERROR, 9)} <= 0.1 AS INT))', 6)} AS interval_pass, {h('avg(sr) - avg(qr)', 6)} AS storm_ratio, {h('avg(se) - avg(qe)', 6)} AS storm_event, {h('avg(br)', 6)} AS brier, {h('avg(br) - avg(brb)', 6)} AS brier_delta,
            {h('avg(auc)', 6)} AS auc, {h('(abs(avg(c5) - 0.5e0) + abs(avg(c8) - 0.8e0)) / 2e0', 6)} AS interval_error FROM ca GROUP BY {by}""",
    }


def cohort_rows(spark, sf_dir):
    """Judged rows from the cutoff on: the ridge's range against the scaled ATR, adaptive tail chances against the base rate, bounds and weather; written once."""
    scaled = written(tape(spark, sf_dir).withColumn("role", F.when(F.col("asset") == HELD_OUT, "holdout").otherwise("development")))
    bounds = judged_bounds(scaled).where("scheme = 'shrunk252'").select("asset", "date", *(f"bound{k}" for k in range(4)))
    over = half_up(F.col("y") / F.greatest("prior_median", F.lit(0.01)), 6)
    weather = models.trailing_reference(scaled, "predicted", "y").where("prediction_rank is not null").select("asset", "date", F.col("prediction_rank").alias("rank"), over.alias("over_median"), "high_event")
    ridge = _ridge(spark, sf_dir).select("asset", "date", "predicted")
    x = F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.col("rain") / 100.0))
    chances = models.trailing_prior(scaled.withColumn("x", x), "tail1", F.col("base_rate")).where("base_rate > 0 and base_rate < 1")
    p = half_up(models.shifted_probability(F.col("x"), F.col("prior"), F.col("base_rate"), 1.0), 6)
    rows = chances.select("asset", "date", "fold", "cluster", "role", "y", "tail1", F.col("predicted").alias("baseline"), "base_rate", p.alias("p"))
    return written(rows.join(ridge, ["asset", "date"]).join(bounds, ["asset", "date"]).join(weather, ["asset", "date"], "left"))


_SHOWN = "rows, assets, mae, mae_delta, coverage50, coverage80, width80, interval_pass, storm_ratio, storm_event, brier, brier_delta, auc, interval_error"


@query("cohort_bundle", chain("panel", more=_COHORT | bundle_sql("role")) + f"SELECT role, {_SHOWN} FROM cb")
def cohort_bundle(spark, sf_dir):
    """Range, interval, weather and tail measures of development and held-out series."""
    return cohorts.bundle(cohort_rows(spark, sf_dir), "role").select("role", *_SHOWN.split(", "))


@query("fold_bundle", chain("panel", more=_COHORT | bundle_sql("fold, role")) + f"SELECT fold, role, {_SHOWN} FROM cb")
def fold_bundle(spark, sf_dir):
    """The same for each year."""
    return cohorts.bundle(cohort_rows(spark, sf_dir), "fold", "role").select("fold", "role", *_SHOWN.split(", "))


def _gated(rows, *by: str):
    return cohorts.with_intervals(cohorts.bundle(rows, *by), cohorts.intervals_of(rows, *by), *by)


@query("stability_gate")
def stability_gate(spark, sf_dir):
    """Shares of the folds' cohorts that meet each of nine conditions, bootstrap bounds included, and whether three quarters meet the first."""
    got = calibration.pass_rates(_gated(cohort_rows(spark, sf_dir), "fold", "role"), cohorts.fold_conditions())
    return calibration.decide(got, {"range_improves": 0.75, "weather_ratio_positive": 0.75, "weather_event_positive": 0.75, "tail_improves": 0.75})


@query("cluster_gate")
def cluster_gate(spark, sf_dir):
    """Shares of clusters that meet each of seven conditions."""
    return calibration.pass_rates(_gated(cohort_rows(spark, sf_dir), "cluster"), cohorts.cluster_conditions())


@query("layer_decisions")
def layer_decisions(spark, sf_dir):
    """Which layers every cohort passes: range with its bound, intervals, weather, tails with their AUC."""
    return calibration.layer_decisions(_gated(cohort_rows(spark, sf_dir), "role"), cohorts.layer_conditions())


@query("bootstrap_coverage")
def bootstrap_coverage(spark, sf_dir):
    """Coverage of both bounds with 95% intervals over circular blocks, series alike."""
    return metrics.rounded(bootstrap.coverage_interval(cohort_rows(spark, sf_dir), "y", "asset", "date", by=("role",)))


@query("bootstrap_weather")
def bootstrap_weather(spark, sf_dir):
    """Storms less quiet days with 95% intervals over circular blocks, series alike."""
    rows = cohort_rows(spark, sf_dir).where("rank is not null")
    return metrics.rounded(bootstrap.weather_interval(rows, "rank", "over_median", "high_event", "asset", "date", by=("role",)))


# ---- trailing state in a stream ----
_STREAM_BASE = 0.1
_STREAM = _BOUNDS | {k: v for k, v in _WEATHER.items() if k not in _TAPE} | {
    "sp": f"SELECT asset, date, {h(f'(coalesce(sum(tail1) OVER w, 0) + 100e0 * {_STREAM_BASE}e0) / (count(tail1) OVER w + 100e0)', 6)} AS prior FROM t WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)",
}


@query("stream_forecasts", chain("panel", more=_STREAM) + f"SELECT bz.asset AS asset, bz.date AS date, residuals, bound0, bound1, bound2, bound3, v.rank AS rank, prior FROM bz JOIN sp USING (asset, date) LEFT JOIN v USING (asset, date) WHERE scheme = 'shrunk252' AND bz.date >= DATE '{CUTOFF}'")
def stream_forecasts(spark, sf_dir):
    """Forecasts of a stream of tape rows with the state of each series: a first run up to a middle year, then what comes later after a restart from the checkpoint."""
    rows = written(tape(spark, sf_dir).withColumn("role", F.when(F.col("asset") == HELD_OUT, "holdout").otherwise("development")))
    table = models.conformal_quantiles(models.known_before(rows, CUTOFF), "predicted", "y").where("scope = 'all'").first()
    common = tuple(float(table[c]) for c in comparison.POINTS.values())
    folder, mark, out = (f"{shared_dir(spark)}/weftline-stream-{uuid.uuid4().hex}" for _ in range(3))
    sent = rows.select("asset", "date", "predicted", "y", F.col("tail1").alias("event"))
    for part in (F.col("date") < CUTOFF, F.col("date") >= CUTOFF):
        sent.where(part).write.mode("append").parquet(folder)
        stream = prediction.stream_forecasts(spark.readStream.schema(sent.schema).parquet(folder), common, _STREAM_BASE)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(prediction.OUTPUT).parquet(out).where(F.col("date") >= F.lit(CUTOFF).cast("date")).drop("predicted")


# ---- parity, bounds of each series ----
@query("score_parity", chain("score", more={"n": "SELECT *, count(*) OVER (PARTITION BY asset) AS k, row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS i FROM score"}) + "SELECT asset, date, temperature, rain, ultraviolet, weather, true AS parity FROM n WHERE i IN (0, (k - 1) // 2, k - 1)")
def score_parity(spark, sf_dir):
    """Scores of three bars of each series, computed anew from arrays of 96 bars, and whether the windowed scores agree."""
    return parity.score_parity(source.daily_bars(spark, sf_dir), score_rows(spark, sf_dir))


_PARTS = {"train": 0.6, "validation": 0.8, "test": 1.0}


@query(
    "split_by_bounds",
    chain("ind", more={
        "a": "SELECT asset, date, row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY asset) AS n FROM ind",
        "b": "SELECT asset, min(CASE WHEN i >= floor(n * 0.6e0) THEN date END) AS b0, min(CASE WHEN i >= floor(n * 0.8e0) THEN date END) AS b1 FROM a GROUP BY asset",
    })
    + "SELECT asset, CASE WHEN date < b0 THEN 'train' WHEN date < b1 THEN 'validation' ELSE 'test' END AS split, count(*) AS rows, min(date) AS first_date, max(date) AS last_date FROM a JOIN b USING (asset) GROUP BY ALL",
)
def split_by_bounds(spark, sf_dir):
    """Rows joined with their series' own bounds."""
    rows = indicator_rows(spark, sf_dir).select("asset", "date")
    met = joins.interval_join(rows, joins.fraction_bounds(rows, _PARTS))
    return met.groupBy("asset", "split").agg(F.count("*").alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
