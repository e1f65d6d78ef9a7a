"""Queries of model records, yearly tapes, calibration, transfer, gates, checks and prospective forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.scalar import half_up
from weftline.operators import audit, calibration, comparison, indicators, ledger, models, prospective, rules, score
from weftline.plans.evaluation import weighted_rows
from weftline.plans.reference_sql import chain
from weftline.plans.reference_sql import half_up as h
from weftline.plans.series import _SPLIT, feature_rows, indicator_rows, observations, panel_rows, score_rows, split_purge_embargo
from weftline.sources import bars as source
from weftline.sources import scans

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


# ---- model records ----
_ATR = "greatest(coalesce(atr14, 0.01e0), 0.01e0)"
_RECORD = {
    "log_atr": f"ln({_ATR})", "log_downside": "ln(greatest(coalesce(downside_vol20, 0.01e0), 0.01e0))", "return_z": "coalesce(return_z252, 0e0)", "abs_return_z": "abs(coalesce(return_z252, 0e0))",
    "rsi_share": "coalesce(rsi14, 50e0) / 100e0", "drawdown_atr": f"least(0e0, greatest(-30e0, coalesce(drawdown63, 0e0) / {_ATR}))",
    "rain_p": "least(0.999e0, greatest(0.001e0, rain / 100e0))", "temperature_p": "least(0.999e0, greatest(0.001e0, temperature / 100e0))", "breadth_up_share": "0.5e0", "log_proxy": "0e0", "log_market_vol": "ln(0.01e0)",
} | {n: f"coalesce({c}, 0e0) / 100e0" for n, c in (("gap_rank", "gap_rank252"), ("close_rank", "close_rank252"), ("atr_rank", "atr_rank252"), ("vol_rank", "vol_rank252"), ("volume_rank", "volume_rank252"), ("rain_share", "rain"), ("temperature_share", "temperature"), ("volatility_share", "volatility"), ("momentum_share", "momentum"))}


@query("model_records", chain("feat", "score", more={"j": "SELECT feat.*, score.rain, score.temperature, score.volatility, score.momentum FROM feat JOIN score USING (asset, date)"}) + "SELECT asset, date, " + ", ".join(f"{h(x, 6)} AS {n}" for n, x in _RECORD.items()) + " FROM j")
def model_records(spark, sf_dir):
    """Records of all scored bars, warm or not; context that these tables lack takes its fallback."""
    return calibration.model_record(score.with_score(feature_rows(spark, sf_dir, *indicators.RANKED.values(), indicators.CLOSE_RANK)), "asset", "date").select("asset", "date", *_RECORD)


# ---- yearly folds and tapes ----
_FOLDS = {
    "k": "SELECT asset, date, left(asset, 1) AS cluster, atr14, rsi14, rain, temperature, next_true_range AS y, tail1, year(date) AS fold, year(lead(date, 5) OVER (PARTITION BY asset ORDER BY date)) AS known, row_number() OVER (PARTITION BY asset, year(date) ORDER BY date) > 5 AS settled FROM panel",
    "years": "SELECT DISTINCT fold FROM k",
}


def _means(values: str, names: list[str]) -> str:
    """Hierarchical means of each fold over the rows that it may learn from."""
    mean = lambda t: ", ".join(f"avg({n}) AS {n}" for n in names) + f" FROM {t}"
    per_asset = f"SELECT years.fold AS fold, cluster, asset, count(*) AS n, {values} FROM k JOIN years ON known < years.fold GROUP BY ALL"
    return f"SELECT fold, sum(n) AS n, {mean('(SELECT fold, cluster, sum(n) AS n, ' + mean('(' + per_asset + ')') + ' GROUP BY fold, cluster)')} GROUP BY fold"


_TAPE = _FOLDS | {
    "l": "SELECT fold, " + h("exp(s)", 9) + " AS scale, " + h("b", 9) + " AS base FROM (" + _means("avg(ln(y / atr14)) AS s, avg(CAST(tail1 AS DOUBLE)) AS b", ["s", "b"]) + ")",
    "t": f"SELECT k.*, scale, base, {h('atr14 * scale', 6)} AS p FROM k JOIN l USING (fold) WHERE settled",
}


def folds(spark, sf_dir):
    rows = panel_rows(spark, sf_dir, indicators.TAIL).withColumns({"cluster": F.substring("asset", 1, 1), "log_atr": F.ln(F.greatest("atr14", F.lit(0.01)))})
    return calibration.yearly_folds(rows.select("asset", "date", "cluster", "atr14", "log_atr", "rsi14", "rain", "temperature", F.col("next_true_range").alias("y"), "tail1"))


def tape(spark, sf_dir):
    """Rows predicted by the scale that their year may know."""
    return calibration.scaled_tape(folds(spark, sf_dir), "atr14", "y", "tail1")


@query(
    "fold_audit",
    chain("panel", more=_FOLDS | {"a": "SELECT years.fold AS fold, count(*) AS train_rows, max(date) AS last_learned FROM k JOIN years ON known < years.fold GROUP BY 1", "b": "SELECT fold, count(*) AS predicted_rows, min(date) AS first_predicted FROM k WHERE settled GROUP BY fold"})
    + "SELECT fold, CAST(train_rows AS BIGINT) AS train_rows, last_learned, predicted_rows, first_predicted, last_learned < first_predicted AS causal FROM a JOIN b USING (fold)",
)
def fold_audit(spark, sf_dir):
    return calibration.fold_audit(folds(spark, sf_dir))


@query("causal_tape", chain("panel", more=_TAPE) + "SELECT asset, date, fold, p AS predicted, y FROM t")
def causal_tape(spark, sf_dir):
    """Each row predicted by the scale that its year may know."""
    return tape(spark, sf_dir).select("asset", "date", "fold", "predicted", "y")


_MOMENT_SQL = {"x0": "ln(greatest(atr14, 0.01e0))", "x1": "rsi14"}
_MOMENT_VALUES = _MOMENT_SQL | {"t": "ln(greatest(y, 0.01e0))"} | {f"t{i}": f"{_MOMENT_SQL[f'x{i}']} * ln(greatest(y, 0.01e0))" for i in range(2)} | {f"m{i}_{j}": f"{_MOMENT_SQL[f'x{i}']} * {_MOMENT_SQL[f'x{j}']}" for i in range(2) for j in range(i, 2)}
FOLD_PREDICTORS = ["log_atr", "rsi14"]


def _log_y():
    return F.ln(F.greatest("y", F.lit(0.01)))


@query("fold_moments", chain("panel", more=_FOLDS) + "SELECT fold, CAST(n AS BIGINT) AS train_rows, " + ", ".join(f"{h(n, 5)} AS {n}" for n in _MOMENT_VALUES) + " FROM (" + _means(", ".join(f"avg({x}) AS {n}" for n, x in _MOMENT_VALUES.items()), list(_MOMENT_VALUES)) + ")")
def fold_moments(spark, sf_dir):
    """The means from which each fold's least squares are solved."""
    got = calibration.fold_means(folds(spark, sf_dir), calibration.moments(FOLD_PREDICTORS, _log_y()))
    return got.select("fold", "train_rows", *(half_up(F.col(n), 5).alias(n) for n in _MOMENT_VALUES))


# ---- weather and tails on the tape ----
_BACK = "(PARTITION BY asset ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)"
_WEATHER = _TAPE | {
    "v0": f"SELECT asset, date, fold, cluster, p, y, atr14, list(p) OVER {_BACK} AS ps, {h(f'quantile_cont(y, 0.5) OVER {_BACK}', 8)} AS md, {h(f'quantile_cont(y, 0.9) OVER {_BACK}', 8)} AS q9 FROM t",
    "v": f"SELECT asset, date, fold, cluster, {h('len(list_filter(ps, lambda x: x <= p)) * 100.0 / 252', 6)} AS rank, {h('y / greatest(md, 0.01e0)', 6)} AS over_median, {h('y / greatest(atr14, 0.01e0)', 6)} AS over_atr, CAST(y > q9 AS INT) AS high_event FROM v0 WHERE len(ps) = 252",
}


def _tape_weather(spark, sf_dir):
    rows = models.trailing_reference(tape(spark, sf_dir), "predicted", "y").where("prediction_rank is not null")
    over = lambda c: half_up(F.col("y") / F.greatest(c, F.lit(0.01)), 6)
    return rows.withColumns({"rank": F.col("prediction_rank"), "over_median": over("prior_median"), "over_atr": over("atr14")})


@query("tape_weather", chain("panel", more=_WEATHER) + "SELECT asset, date, rank, over_median, over_atr, high_event FROM v")
def tape_weather(spark, sf_dir):
    """Place of each prediction among the 252 before it on the tape, and its outcome against theirs; rows with fewer are left out."""
    return _tape_weather(spark, sf_dir).select("asset", "date", "rank", "over_median", "over_atr", "high_event")


#: Sets of the three borders between four grades.
BORDERS = {"20-70-90": (20, 70, 90), "25-75-90": (25, 75, 90), "25-70-85": (25, 70, 85), "30-75-90": (30, 75, 90)}


@query(
    "weather_borders",
    chain("panel", more=_WEATHER | {
        "b": " UNION ALL ".join(f"SELECT '{n}' AS borders, asset, CASE WHEN rank < {x} THEN 1 WHEN rank < {y} THEN 2 WHEN rank < {z} THEN 3 ELSE 4 END AS grade, over_median, high_event FROM v" for n, (x, y, z) in BORDERS.items()),
        "c": "SELECT borders, asset, grade, avg(over_median) AS o, avg(high_event) AS e FROM b GROUP BY ALL",
    })
    + f"SELECT borders, grade, count(*) AS series, {h('avg(o)', 6)} AS over_median, {h('avg(e)', 6)} AS event_rate FROM c GROUP BY borders, grade",
)
def weather_borders(spark, sf_dir):
    """Series-equal outcome of each grade under several sets of borders."""
    rank = F.col("rank")
    grade = lambda x, y, z: F.when(rank < x, 1).when(rank < y, 2).when(rank < z, 3).otherwise(4)
    each = F.array(*(F.struct(F.lit(n).alias("borders"), grade(*b).alias("grade")) for n, b in BORDERS.items()))
    rows = _tape_weather(spark, sf_dir).select("asset", "over_median", "high_event", F.inline(each))
    per = rows.groupBy("borders", "asset", "grade").agg(F.avg("over_median").alias("o"), F.avg("high_event").alias("e"))
    return per.groupBy("borders", "grade").agg(F.count("*").alias("series"), half_up(F.avg("o"), 6).alias("over_median"), half_up(F.avg("e"), 6).alias("event_rate"))


_PRIOR = _TAPE | {
    "pr": f"SELECT asset, date, (coalesce(sum(tail1) OVER w, 0) + 100e0 * base) / (count(tail1) OVER w + 100e0) AS prior, base, fold, cluster, y, p, atr14, tail1 FROM t WINDOW w AS {_BACK}",
}
_DELTA = f"""SELECT {{0}}, count(*) AS rows, {h('avg(abs(y - p)) - avg(abs(y - atr14))', 6)} AS mae_delta, {h('avg((prior - tail1) * (prior - tail1)) - avg((base - tail1) * (base - tail1))', 6)} AS brier_delta FROM pr GROUP BY {{0}}"""


def _deltas(rows, *keys):
    """Mean errors of the tape less those of the ATR, and Brier scores of the trailing prior less those of the base rate."""
    squared = lambda c: F.avg((F.col(c) - F.col("tail1")) * (F.col(c) - F.col("tail1")))
    mae = F.avg(F.abs(F.col("y") - F.col("predicted"))) - F.avg(F.abs(F.col("y") - F.col("atr14")))
    return rows.groupBy(*keys).agg(F.count("*").alias("rows"), half_up(mae, 6).alias("mae_delta"), half_up(squared("prior") - squared("base_rate"), 6).alias("brier_delta"))


def _with_prior(spark, sf_dir):
    return models.trailing_prior(tape(spark, sf_dir), "tail1", F.col("base_rate"))


@query("fold_stability", chain("panel", more=_PRIOR) + _DELTA.format("fold, cluster"))
def fold_stability(spark, sf_dir):
    """Candidate less baseline for each year and cluster."""
    return _deltas(_with_prior(spark, sf_dir), "fold", "cluster")


@query(
    "fold_gate",
    chain("panel", more=_PRIOR | {"d": _DELTA.format("fold, cluster"), "a": f"SELECT count(*) AS evaluations, {h('avg(CAST(mae_delta < 0 AS INT))', 6)} AS range_improves, {h('avg(CAST(brier_delta < 0 AS INT))', 6)} AS tail_improves FROM d"}) + "SELECT *, range_improves >= 0.75 AND tail_improves >= 0.75 AS passed FROM a",
)
def fold_gate(spark, sf_dir):
    """Shares of years and clusters that improve, and whether they reach three quarters."""
    got = calibration.pass_rates(fold_stability(spark, sf_dir), {"range_improves": F.col("mae_delta") < 0, "tail_improves": F.col("brier_delta") < 0})
    return calibration.decide(got, {"range_improves": 0.75, "tail_improves": 0.75})


_TRANSFER = {
    "k": "SELECT asset, left(asset, 1) AS cluster, atr14, next_true_range AS y, tail1, row_number() OVER (PARTITION BY asset ORDER BY date) * 1e0 / count(*) OVER (PARTITION BY asset) <= 0.6e0 AS learn FROM panel",
    "a": "SELECT cluster, avg(s) AS s, avg(b) AS b, sum(n) AS n FROM (SELECT cluster, asset, avg(ln(y / atr14)) AS s, avg(tail1) AS b, count(*) AS n FROM k WHERE learn GROUP BY cluster, asset) GROUP BY cluster",
    "x": f"SELECT c.cluster AS cluster, {h('exp(avg(o.s))', 9)} AS scale, {h('avg(o.b)', 9)} AS base, CAST(sum(o.n) AS BIGINT) AS train_rows FROM a c JOIN a o ON o.cluster <> c.cluster GROUP BY c.cluster",
    "d": f"SELECT cluster, train_rows, count(*) AS rows, {h('avg(abs(y - atr14 * scale)) - avg(abs(y - atr14))', 6)} AS mae_delta, {h('avg((base - tail1) * (base - tail1))', 6)} AS brier FROM k JOIN x USING (cluster) WHERE NOT learn GROUP BY cluster, train_rows",
}


@query("cluster_transfer", chain("panel", more=_TRANSFER) + "SELECT * FROM d")
def cluster_transfer(spark, sf_dir):
    """Each cluster judged by a scale and base rate of the others: their means of means, so one pass serves all clusters."""
    w = models.Window.partitionBy("asset")
    place = F.row_number().over(w.orderBy("date")) / F.count("*").over(w) <= 0.6
    rows = panel_rows(spark, sf_dir, indicators.TAIL).select("asset", F.substring("asset", 1, 1).alias("cluster"), "atr14", F.col("next_true_range").alias("y"), "tail1", place.alias("learn"))
    per_asset = rows.where("learn").groupBy("cluster", "asset").agg(F.avg(F.ln(F.col("y") / F.col("atr14"))).alias("s"), F.avg("tail1").alias("b"), F.count("*").alias("n"))
    per = per_asset.groupBy("cluster").agg(F.avg("s").alias("s"), F.avg("b").alias("b"), F.sum("n").alias("n"))
    total = per.agg(F.count("*").alias("_k"), *(F.sum(c).alias(f"_{c}") for c in "sbn"))  # one row
    rest = per.crossJoin(F.broadcast(total)).where("_k > 1")
    mean = lambda c: (F.col(f"_{c}") - F.col(c)) / (F.col("_k") - 1)
    learned = rest.select("cluster", half_up(F.exp(mean("s")), 9).alias("scale"), half_up(mean("b"), 9).alias("base"), (F.col("_n") - F.col("n")).alias("train_rows"))
    held = rows.where("not learn").join(learned, "cluster")
    mae = F.avg(F.abs(F.col("y") - F.col("atr14") * F.col("scale"))) - F.avg(F.abs(F.col("y") - F.col("atr14")))
    brier = F.avg((F.col("base") - F.col("tail1")) * (F.col("base") - F.col("tail1")))
    return held.groupBy("cluster", "train_rows").agg(F.count("*").alias("rows"), half_up(mae, 6).alias("mae_delta"), half_up(brier, 6).alias("brier"))


# ---- probability calibration ----
def _rain(spark, sf_dir):
    rows = weighted_rows(spark, sf_dir).withColumn("p", F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.col("rain") / 100.0)))
    w = models.Window.partitionBy("asset")
    return rows.select("asset", "date", "weight", "p", "tail1", (F.row_number().over(w.orderBy("date")) / F.count("*").over(w) <= 0.6).alias("learn"))


@query("calibrated_probabilities")
def calibrated_probabilities(spark, sf_dir):
    """Rain chances of the last 40% of each series calibrated by Platt's and the Beta method on the first 60%."""
    rows = _rain(spark, sf_dir).cache()  # each step of both fits reads them
    held = rows.where("not learn")
    for kind in calibration.CALIBRATORS:
        held = calibration.calibrated(held, calibration.fit_calibrator(rows.where("learn"), kind, "p", "tail1"), "p", kind)
    return held.select("asset", "date", "p", half_up(F.col("platt"), 4).alias("platt"), half_up(F.col("beta"), 4).alias("beta"), "tail1")


@query("calibrator_choice")
def calibrator_choice(spark, sf_dir):
    """Brier scores of raw, Platt and Beta probabilities, the least marked."""
    got = calibrated_probabilities(spark, sf_dir).unpivot("tail1", ["p", "platt", "beta"], "method", "q")
    scores = got.groupBy("method").agg(half_up(F.avg((F.col("q") - F.col("tail1")) * (F.col("q") - F.col("tail1"))), 6).alias("brier"))
    best = scores.agg(F.min(F.struct("brier", "method")).alias("_b"))  # three methods
    return scores.crossJoin(F.broadcast(best)).select("method", "brier", (F.col("method") == F.col("_b.method")).alias("chosen"))


_STRENGTHS = (0.0, 0.25, 0.5, 0.75, 1.0)
_SHIFT = "1.0 / (1.0 + exp(-(ln(x / (1.0 - x)) + {s}e0 * (ln(prior / (1.0 - prior)) - ln(base / (1.0 - base))))))"


@query(
    "shift_strengths",
    chain("panel", more=_PRIOR | {"z": f"SELECT *, greatest(0.001e0, least(0.999e0, {h('p / (p + 9e0)', 6)})) AS x FROM pr WHERE base > 0 AND base < 1"}) + " UNION ALL ".join(f"SELECT {s}e0 AS strength, {h(f'avg(({_SHIFT.format(s=s)} - tail1) * ({_SHIFT.format(s=s)} - tail1))', 6)} AS brier FROM z" for s in _STRENGTHS),
)
def shift_strengths(spark, sf_dir):
    """Brier scores of a raw probability moved towards the trailing prior by several strengths."""
    raw = F.greatest(F.lit(0.001), F.least(F.lit(0.999), half_up(F.col("predicted") / (F.col("predicted") + 9.0), 6)))
    rows = _with_prior(spark, sf_dir).where("base_rate > 0 and base_rate < 1").withColumn("x", raw)
    moved = lambda s: models.shifted_probability(F.col("x"), F.col("prior"), F.col("base_rate"), s) - F.col("tail1")
    means = rows.agg(*(half_up(F.avg(moved(s) * moved(s)), 6).alias(f"s{i}") for i, s in enumerate(_STRENGTHS)))
    return means.select(F.inline(F.array(*(F.struct(F.lit(s).alias("strength"), F.col(f"s{i}").alias("brier")) for i, s in enumerate(_STRENGTHS)))))


# ---- checks ----
@query(
    "series_checks",
    chain("obs", more={"c": "SELECT asset, date > lag(date) OVER w OR lag(date) OVER w IS NULL AS later, abs(fwd_return1 - (lead(close) OVER w / close - 1e0) * 100e0) < 1e-5 OR lead(close) OVER w IS NULL AS aligned, temperature BETWEEN 0 AND 100 AND isfinite(fwd_return5) AND isfinite(next_true_range) AS finite FROM obs WINDOW w AS (PARTITION BY asset ORDER BY date)"})
    + "SELECT asset, count(*) AS rows, bool_and(later) AS chronological, bool_and(aligned) AS aligned, bool_and(finite) AS finite FROM c GROUP BY asset",
)
def series_checks(spark, sf_dir):
    """Per series: dates rise, the first outcome is the next bar's change, and values are finite."""
    return audit.series_checks(observations(spark, sf_dir))


@query(
    "split_protocol",
    chain("bars", more=_SPLIT | {
        "a": "SELECT asset, count_if(bucket = 'purged') AS purged, count_if(bucket = 'embargoed') AS embargoed, max(CASE WHEN bucket = 'train' THEN date END) AS t1, min(CASE WHEN bucket = 'validation' THEN date END) AS v0, max(CASE WHEN bucket = 'validation' THEN date END) AS v1, min(CASE WHEN bucket = 'sealed-test' THEN date END) AS s0 FROM s GROUP BY asset",
    })
    + "SELECT asset, purged = 10 AS purged, embargoed = 10 AS embargoed, coalesce(t1 < v0, false) AS train_first, coalesce(v1 < s0, false) AS test_last, purged = 10 AND embargoed = 10 AND coalesce(t1 < v0, false) AND coalesce(v1 < s0, false) AS passed FROM a",
)
def split_protocol(spark, sf_dir):
    return audit.split_protocol(split_purge_embargo(spark, sf_dir))


# ---- prospective forecasts ----
_SNAP = """
 i AS (SELECT CAST(c_custkey AS VARCHAR) AS asset, DATE '2024-01-10' - CAST(c_custkey % 3 AS INT) AS d, c_custkey AS k FROM customer),
 r AS (SELECT CAST(o_custkey AS VARCHAR) AS asset, max(DATE '2024-01-01' + CAST(o_orderkey % 11 AS INT)) AS last FROM orders GROUP BY 1)"""


@query(
    "contract_breaks",
    f"WITH {_SNAP} SELECT asset, reason FROM (SELECT i.asset AS asset, unnest(list_filter([CASE WHEN k % 50 = 7 THEN 'duplicate' END, CASE WHEN k % 40 = 1 THEN 'has labels' END, CASE WHEN k % 3 = 2 THEN 'not the last close' END, CASE WHEN k % 6 = 0 THEN 'later context' END, CASE WHEN k % 4 = 0 AND k % 8 <> 0 THEN 'coin context of the day' END, CASE WHEN last >= d THEN 'resolved overlaps' END], lambda x: x IS NOT NULL)) AS reason FROM i LEFT JOIN r USING (asset))",
)
def contract_breaks(spark, sf_dir):
    """Customers as inference rows, their orders as resolved rows."""
    k = F.col("c_custkey")
    day = F.date_sub(F.lit("2024-01-10").cast("date"), (k % 3).cast("int"))
    c = source.read(spark, sf_dir, "customer").select(k.cast("string").alias("asset"), day.alias("date"), "c_custkey")
    inference = c.select("asset", "date", (k % 4 == 0).alias("us_close"), F.date_add("date", F.when(k % 6 == 0, 1).otherwise(0)).alias("context_last"), F.when(k % 8 == 0, F.date_sub("date", 1)).otherwise(F.col("date")).alias("coin_last"), (k % 40 == 1).alias("has_labels"), k.alias("c_custkey"))
    inference = inference.unionByName(inference.where(k % 50 == 7))
    sources = c.select("asset", F.when(k % 3 == 2, F.date_add("date", 1)).otherwise(F.col("date")).alias("last_closed"))
    resolved = source.read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("asset"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 11).cast("int")).alias("date"))
    return prospective.contract_breaks(inference, sources, resolved)


@query(
    "registered_benchmarks",
    chain("ind", "lab", more={"j": f"SELECT ind.asset AS asset, ind.date AS date, count(next_true_range) OVER {_BACK.replace('asset', 'ind.asset').replace('date', 'ind.date')} AS k, atr14, last_value(next_true_range) OVER {_BACK.replace('asset', 'ind.asset').replace('date', 'ind.date')} AS l, " + ", ".join(f"quantile_cont(next_true_range, {p}) OVER {_BACK.replace('asset', 'ind.asset').replace('date', 'ind.date')} AS {n}" for n, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75), ("q90", 0.9))) + " FROM ind JOIN lab ON ind.asset = lab.asset AND ind.date = lab.date WHERE atr14 IS NOT NULL"})
    + f"SELECT asset, date, {h('atr14 * 0.930263e0', 6)} AS base_scaled, l AS last_outcome, " + ", ".join(f"{h(n, 8)} AS {n}" for n in ("q25", "median", "q75", "q90")) + " FROM j WHERE k = 252",
)
def registered_benchmarks(spark, sf_dir):
    rows = indicators.with_labels(indicator_rows(spark, sf_dir)).where("atr14 is not null")
    return prospective.benchmarks(rows, "atr14", "next_true_range", 0.930263).select("asset", "date", "base_scaled", "last_outcome", "q25", "median", "q75", "q90")


# ---- views and scans ----
@query(
    "situation_texts",
    chain("ind", more={"d": "SELECT date, max(CASE WHEN asset = 'AF' THEN change1 END) AS s, max(CASE WHEN asset = 'NO' THEN change1 END) AS n, max(CASE WHEN asset = 'RF' THEN change1 END) AS x, max(CASE WHEN asset = 'NF' THEN rsi14 END) / 2e0 AS v FROM ind GROUP BY date"})
    + "SELECT date, CASE WHEN s IS NULL OR n IS NULL THEN '미국 증시 확인 중' WHEN (s + n) / 2e0 > 0.35 THEN '미국 증시 강세' WHEN (s + n) / 2e0 < -0.35 THEN '미국 증시 약세' ELSE '미국 증시 혼조' END AS us_text, CASE WHEN x IS NULL THEN '달러 흐름 확인 중' WHEN x > 0.25 THEN '달러 강세' WHEN x < -0.25 THEN '달러 약세' ELSE '달러 보합' END AS dollar_text, CASE WHEN v IS NULL THEN '변동성 확인 중' WHEN v >= 25 THEN '변동성 경계' WHEN v >= 18 THEN '변동성 주의' ELSE '변동성 안정' END AS volatility_text FROM d",
)
def situation_texts(spark, sf_dir):
    of = lambda a, c: F.max(F.when(F.col("asset") == a, F.col(c)))
    days = indicator_rows(spark, sf_dir).groupBy("date").agg(of("AF", "change1").alias("s"), of("NO", "change1").alias("n"), of("RF", "change1").alias("x"), (of("NF", "rsi14") / 2.0).alias("v"))
    return days.select("date", *(c.alias(n) for n, c in rules.situation_texts(F.col("s"), F.col("n"), F.col("v"), F.col("x")).items()))


_SYMBOL = "CASE c_custkey % 9 WHEN 0 THEN '^KS11' WHEN 1 THEN c_custkey || '.KQ' WHEN 2 THEN c_custkey || '.t' WHEN 3 THEN 'BTC' || c_custkey WHEN 4 THEN c_custkey || '.HK' WHEN 5 THEN '^STOXX50E' WHEN 6 THEN 'XRPUSDT' WHEN 7 THEN c_custkey || '.L' ELSE c_name END"


@query(
    "stations",
    f"SELECT c_custkey, CASE WHEN k IN (3, 6) THEN (CASE WHEN s LIKE 'BTC%' THEN 'btc' ELSE 'crypto' END) WHEN k < 2 THEN 'kr' WHEN k = 2 THEN 'jp' WHEN k = 4 THEN 'hk' WHEN k = 5 THEN 'eu' WHEN k = 7 THEN 'gb' ELSE 'us' END AS tone, CASE WHEN k IN (3, 6) THEN '24시간 코인 시장' WHEN k < 2 THEN '한국 시장' WHEN k = 2 THEN '일본 시장' WHEN k = 4 THEN '홍콩 시장' WHEN k = 5 THEN '유럽 시장' WHEN k = 7 THEN '영국 시장' ELSE '미국 시장' END AS market FROM (SELECT c_custkey, c_custkey % 9 AS k, {_SYMBOL} AS s FROM customer)",
)
def stations(spark, sf_dir):
    symbol = F.expr(_SYMBOL)
    kind = F.when(F.col("c_custkey") % 9 % 3 == 0, F.when(F.col("c_custkey") % 9 > 0, "crypto"))
    return source.read(spark, sf_dir, "customer").select("c_custkey", rules.station(symbol, kind).alias("s")).select("c_custkey", "s.tone", "s.market")


@query("pulse_bars", chain("bars", more={
    "r": "SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date DESC) AS n FROM bars",
    "c": f"SELECT asset, date, {h('(close - lag(close) OVER (PARTITION BY asset ORDER BY date)) / lag(close) OVER (PARTITION BY asset ORDER BY date) * 100e0', 6)} AS change, {h('(last_value(close) OVER w - first_value(close) OVER w) / first_value(close) OVER w * 100e0', 6)} AS total FROM r WHERE n <= 6 WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
}) + f"SELECT asset, date, change, {h('abs(change) / greatest(0.5e0, max(abs(change)) OVER (PARTITION BY asset))', 6)} AS height, total FROM c WHERE change IS NOT NULL")
def pulse_bars(spark, sf_dir):
    return rules.pulse(source.daily_bars(spark, sf_dir))


@query("time_buckets", "SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) <= DATE '1996-12-31' THEN 'train' WHEN CAST(o_orderdate AS DATE) <= DATE '1998-12-31' THEN 'validation' ELSE 'sealed-test' END AS bucket FROM orders")
def time_buckets(spark, sf_dir):
    return source.read(spark, sf_dir, "orders").select("o_orderkey", rules.time_bucket(F.to_date("o_orderdate"), "1996-12-31", "1997-01-01", "1998-12-31", "1999-01-01").alias("bucket"))


@query("symbol_texts", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'index' ELSE 'stock' END AS kind, coalesce(nullif(c_mktsegment, 'BUILDING'), 'US Market') || ' ' || CASE WHEN c_custkey % 3 = 0 THEN 'Equity' WHEN c_custkey % 2 = 0 THEN 'INDEX' ELSE 'ETF' END || ' 관측소' AS description FROM customer")
def symbol_texts(spark, sf_dir):
    k, segment = F.col("c_custkey"), F.col("c_mktsegment")
    type_name = F.when(k % 3 == 0, "Equity").when(k % 2 == 0, "").otherwise("ETF")
    quote_type = F.when(k % 2 == 0, "INDEX").otherwise("EQUITY")
    text = rules.symbol_description(F.lit(""), F.when(segment != "BUILDING", segment), type_name, quote_type)
    return source.read(spark, sf_dir, "customer").select("c_custkey", rules.symbol_kind(quote_type).alias("kind"), text.alias("description"))


@query("symbol_aliases", "SELECT c_custkey, coalesce(n_name, CAST(c_nationkey AS VARCHAR)) AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 2) ON c_nationkey = n_nationkey")
def symbol_aliases(spark, sf_dir):
    aliases = source.read(spark, sf_dir, "nation").where("n_regionkey < 2").select(F.col("n_nationkey").cast("string").alias("nation"), F.col("n_name").alias("alias"))
    return rules.aliased(source.read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("nation")), aliases, "nation")


@query("score_quotes", chain("score") + f"SELECT asset, CASE WHEN asset IN ('AF', 'NO') THEN 'live' ELSE 'error' END AS status, price, day_change FROM (SELECT asset, {h('close', 6)} AS price, change1 AS day_change, row_number() OVER (PARTITION BY asset ORDER BY date DESC) AS n FROM score) WHERE n = 1 AND asset <> 'RF'")
def score_quotes(spark, sf_dir):
    latest = ledger.latest(score_rows(spark, sf_dir), "asset", "date", "asset").select("asset", half_up(F.col("close"), 6).alias("price"), F.col("change1").alias("day_change"))
    data = source.daily_bars(spark, sf_dir).select("asset").distinct().where("asset <> 'RF'").withColumn("status", F.when(F.col("asset").isin("AF", "NO"), "live").otherwise("stale"))
    return rules.quotes(data, latest)


@query("paged_history", "SELECT o_orderkey AS id, CAST(o_totalprice AS DOUBLE) AS close FROM orders")
def paged_history(spark, sf_dir):
    """Orders in pages of up to a thousand keys, flattened again."""
    rows = source.read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 4).alias("asset"), F.floor(F.col("o_orderkey") / 1000).alias("page"), F.struct(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("double").alias("close")).alias("r"))
    pages = rows.groupBy("asset", "page").agg(F.sort_array(F.collect_list("r")).alias("rows"))
    return scans.paged(pages, "asset", "page", "rows", F.col("row.id")).select("row.id", "row.close")


@query("cached_series", "SELECT CAST(c_custkey AS VARCHAR) AS asset, c_name AS symbol FROM customer WHERE c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0")
def cached_series(spark, sf_dir):
    """Customers as cached series, some of an old version, of another symbol or of another last date."""
    k = F.col("c_custkey")
    c = source.read(spark, sf_dir, "customer").select(k.cast("string").alias("asset"), "c_custkey", "c_name")
    cached = c.select("asset", F.when(k % 3 == 0, 0).otherwise(1).alias("version"), F.when(k % 5 == 0, "other").otherwise(F.col("c_name")).alias("symbol"), F.when(k % 7 == 0, "2024-01-01").otherwise("2024-01-02").alias("end_date"))
    return scans.accepted_cache(cached, c.select("asset", F.col("c_name").alias("symbol"), F.lit("2024-01-02").alias("end_date"))).select("asset", "symbol")


@query("rows_by_source", "SELECT c_custkey AS asset, c_acctbal AS v FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT o_custkey, max(o_totalprice) FROM orders WHERE o_custkey % 3 = 1 GROUP BY 1")
def rows_by_source(spark, sf_dir):
    c = source.read(spark, sf_dir, "customer")
    assets = c.select(F.col("c_custkey").alias("asset"), F.when(F.col("c_custkey") % 3 == 0, "balance").when(F.col("c_custkey") % 3 == 1, "orders").otherwise("none").alias("source"))
    spent = source.read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("asset")).agg(F.max("o_totalprice").alias("v"))
    return scans.by_source(assets, {"balance": c.select(F.col("c_custkey").alias("asset"), F.col("c_acctbal").alias("v")), "orders": spent})


@query("digested_texts", "SELECT doc_id, doc_id % 4 <> 0 AND doc_id % 9 <> 0 AND text IS NOT NULL AS valid FROM documents")
def digested_texts(spark, sf_dir):
    """Documents as files with stated digests, some wrong, some missing."""
    d = source.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.encode("text", "utf-8").alias("content"))
    stated = d.where("name % 9 <> 0").select("name", F.concat(F.upper(F.sha2("content", 256)), F.when(F.col("name") % 4 == 0, "0").otherwise("\n")).alias("sha256"))
    return scans.digested(d, stated).select(F.col("name").alias("doc_id"), "valid")


_VISIBLE = "CAST(l_shipdate AS DATE)"


@query("visible_rows", " UNION ALL ".join(f"SELECT '{v}' AS view, count(*) AS rows FROM lineitem WHERE {c}" for v, c in (("training", f"l_returnflag = 'A' AND {_VISIBLE} <= DATE '1996-12-31'"), ("history", f"{_VISIBLE} <= DATE '1996-12-31'"), ("test", f"{_VISIBLE} >= DATE '1997-01-15'"), ("all", "true"))))
def visible_rows(spark, sf_dir):
    """Rows that training, history, tests and all see."""
    rows = source.read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("date"), F.when(F.col("l_returnflag") == "A", "development").otherwise("holdout").alias("role"), F.lit("1996-12-31").cast("date").alias("last_validation"), F.lit("1997-01-15").cast("date").alias("first_test"))
    out = None
    for v in ("training", "history", "test", "all"):
        part = scans.visible(rows, v).agg(F.lit(v).alias("view"), F.count("*").alias("rows"))
        out = part if out is None else out.unionByName(part)
    return out
