"""Model records, yearly folds whose fits see only known outcomes, tapes of their predictions, calibrators and gates.

A fold is a year. It may learn from the rows of earlier years whose outcome, five
rows ahead, was known before the year began. Weighted means count clusters alike,
assets alike in a cluster and rows alike in an asset, so they are means of means:
sums of each asset and year are cumulated over the years, and a fold costs no
further pass over the rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scalar import half_up, logit
from weftline.operators.models import LinearModel, logistic

#: Rows between a row and its outcome; as many are left out at the start of a year.
AHEAD = 5


def _finite(rows: DataFrame, name: str, fallback: float = 0.0) -> Column:
    """The column as a double; the fallback where it is missing, null or not finite."""
    if name not in rows.columns:
        return F.lit(fallback)
    x = F.col(name).cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x).otherwise(fallback)


def _between(x: Column, low: float, high: float) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), x))


def model_record(rows: DataFrame, *keep: str) -> DataFrame:
    """What models read, with the columns of ``keep`` first: logarithms, shares and clamps of features, score and context.

    Columns that rows lack count as null. A null or non-finite value takes its
    fallback: 0.01 for what goes into a logarithm, 1 for the market's level, 50
    for RSI and breadth, else 0.
    """
    get = lambda c, fallback=0.0: _finite(rows, c, fallback)
    log = lambda c, least=0.01: F.ln(F.greatest(get(c, least), F.lit(least)))
    atr = F.greatest(get("atr14", 0.01), F.lit(0.01))
    shares = {"gap_rank": "gap_rank252", "close_rank": "close_rank252", "atr_rank": "atr_rank252", "vol_rank": "vol_rank252", "volume_rank": "volume_rank252", "rain_share": "rain", "temperature_share": "temperature", "volatility_share": "volatility", "momentum_share": "momentum", "proxy_rank": "proxy_rank252", "market_atr_rank": "market_atr_rank252", "coin_vol_rank": "coin_vol_rank252"}
    context = ("market_return1", "market_return5", "bond_return5", "credit_return5", "dollar_return5", "gold_return5", "commodity_return5", "coin_return1")
    out = {"log_atr": F.ln(atr), "log_downside": log("downside_vol20"), "return_z": get("return_z252"), "abs_return_z": F.abs(get("return_z252")), "rsi_share": get("rsi14", 50.0) / 100.0, "drawdown_atr": _between(get("drawdown63") / atr, -30.0, 0.0)}
    out |= {n: get(c) / 100.0 for n, c in shares.items()}
    out |= {n: get(n) for n in context}
    out |= {"rain_p": _between(get("rain") / 100.0, 0.001, 0.999), "temperature_p": _between(get("temperature") / 100.0, 0.001, 0.999), "log_proxy": log("proxy_level", 1.0), "log_market_vol": log("market_vol20"), "breadth_up_share": get("breadth_up", 50.0) / 100.0, "breadth_sma20_share": get("breadth_sma20", 50.0) / 100.0}
    return rows.select(*keep, *(half_up(x, 6).alias(n) for n, x in out.items()))


def yearly_folds(rows: DataFrame, asset: str = "asset", time: str = "date") -> DataFrame:
    """rows with fold (the row's year), known (the year in which its outcome is known, null at the end) and settled (false for the first rows of a year)."""
    w = Window.partitionBy(asset).orderBy(time)
    place = F.row_number().over(Window.partitionBy(asset, F.year(time)).orderBy(time))
    return rows.withColumns({"fold": F.year(time), "known": F.year(F.lead(time, AHEAD).over(w)), "settled": place > AHEAD})


def _later(sums: DataFrame, folds: DataFrame) -> DataFrame:
    """Sums of a known year once for each later fold; there are as many of them as assets and years."""
    last = F.broadcast(folds.agg(F.max("fold").alias("_end")))  # one row
    later = sums.crossJoin(last).where("known < _end").withColumn("fold", F.explode(F.sequence(F.col("known") + 1, F.col("_end"))))
    return later.drop("_end").join(folds.select("fold").distinct(), "fold", "left_semi")


def fold_means(folds: DataFrame, values: dict[str, Column], cluster: str = "cluster", asset: str = "asset") -> DataFrame:
    """Per fold: rows it may learn from and the hierarchical means of values over them; folds without such rows are missing."""
    sums = folds.where("known is not null").groupBy(cluster, asset, "known").agg(F.count("*").alias("_n"), *(F.sum(x).alias(n) for n, x in values.items()))
    past = _later(sums, folds).groupBy("fold", cluster, asset).agg(F.sum("_n").alias("_n"), *(F.sum(n).alias(n) for n in values))
    in_cluster = past.groupBy("fold", cluster).agg(F.sum("_n").alias("_n"), *(F.avg(F.col(n) / F.col("_n")).alias(n) for n in values))
    return in_cluster.groupBy("fold").agg(F.sum("_n").alias("train_rows"), *(F.avg(n).alias(n) for n in values))


def fold_audit(folds: DataFrame) -> DataFrame:
    """Per fold that can learn: its rows to learn from and to predict, the last day of the first, the first of the second, and whether they are in order."""
    learned = folds.where("known is not null").groupBy("known").agg(F.count("*").alias("_n"), F.max("date").alias("_last"))
    predicted = folds.where("settled").groupBy("fold").agg(F.count("*").alias("predicted_rows"), F.min("date").alias("first_predicted"))
    past = _later(learned, folds).groupBy("fold").agg(F.sum("_n").alias("train_rows"), F.max("_last").alias("last_learned"))
    return predicted.join(past, "fold").withColumn("causal", F.col("last_learned") < F.col("first_predicted"))


def scaled_tape(folds: DataFrame, base: str, actual: str, truth: str) -> DataFrame:
    """Rows of folds with a prediction: base times the scale learned by the fold, and the fold's base rate of truth."""
    learned = fold_means(folds, {"_s": F.ln(F.col(actual) / F.col(base)), "_b": F.col(truth).cast("double")})
    learned = learned.select("fold", half_up(F.exp("_s"), 9).alias("scale"), half_up(F.col("_b"), 9).alias("base_rate"))
    return folds.where("settled").join(learned, "fold").withColumn("predicted", half_up(F.col(base) * F.col("scale"), 6))


def moments(columns: list[str], target: Column) -> dict[str, Column]:
    """Values whose means give a least-squares fit of the target on columns."""
    out = {f"x{i}": F.col(c) for i, c in enumerate(columns)} | {"t": target}
    out |= {f"t{i}": F.col(c) * target for i, c in enumerate(columns)}
    return out | {f"m{i}_{j}": F.col(columns[i]) * F.col(columns[j]) for i in range(len(columns)) for j in range(i, len(columns))}


def ridge_folds(folds: DataFrame, columns: list[str], target: Column, penalty: float) -> dict[int, LinearModel]:
    """A ridge model for each fold, from one aggregation: a row of means for each year comes to the driver."""
    out, k = {}, len(columns)
    for r in fold_means(folds, moments(columns, target)).collect():  # as many rows as years
        mean = np.array([r[f"x{i}"] for i in range(k)])
        cross = np.array([[r[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        spread = np.sqrt(np.maximum(1e-12, np.diag(cross) - mean * mean))
        inner = (cross - np.outer(mean, mean)) / np.outer(spread, spread)
        outer = (np.array([r[f"t{i}"] for i in range(k)]) - mean * r["t"]) / spread
        beta = np.linalg.solve(inner + penalty * np.eye(k), outer)
        out[r["fold"]] = LinearModel(columns, {c: (float(mean[i]), float(spread[i])) for i, c in enumerate(columns)}, beta.tolist(), float(r["t"]), penalty)
    return out


def ridge_tape(folds: DataFrame, models: dict[int, LinearModel]) -> DataFrame:
    """Settled rows with the prediction of their own fold's model, for folds that have one: a row has one fold, so one prediction."""
    predicted = F.lit(None).cast("double")
    for fold, model in sorted(models.items()):
        predicted = F.when(F.col("fold") == fold, model.range_prediction()).otherwise(predicted)
    return folds.where("settled").withColumn("predicted", predicted).where("predicted is not null")


def top_coefficients(model: LinearModel, n: int = 8) -> list[tuple[str, float]]:
    """The n columns of greatest absolute coefficient, the first by name among equals."""
    return sorted(zip(model.columns, model.coefficients, strict=True), key=lambda p: (-abs(p[1]), p[0]))[:n]


#: Predictors of the two calibrators.
CALIBRATORS = {"platt": ["_logit"], "beta": ["_log_p", "_log_rest"]}


def _calibration_columns(rows: DataFrame, p: str) -> DataFrame:
    x = _between(F.col(p), 1e-6, 1.0 - 1e-6)
    return rows.withColumns({"_logit": logit(x), "_log_p": F.ln(x), "_log_rest": -F.ln(1.0 - x)})


def fit_calibrator(rows: DataFrame, kind: str, p: str, truth: str, penalty: float = 0.01) -> LinearModel:
    """Platt (log-odds) or Beta (both logarithms) calibration of probabilities, fitted on rows with weight."""
    return logistic(_calibration_columns(rows, p), CALIBRATORS[kind], truth, penalty)


def calibrated(rows: DataFrame, model: LinearModel, p: str, name: str) -> DataFrame:
    return _calibration_columns(rows, p).withColumn(name, model.probability()).drop("_logit", "_log_p", "_log_rest")


def never_falls(spark, model: LinearModel) -> bool:
    """Whether the calibrated probability never falls over 999 points from 0.001 to 0.999."""
    grid = calibrated(spark.range(1, 1000).withColumn("p", F.col("id") / 1000.0), model, "p", "q")
    step = F.col("q") - F.lag("q").over(Window.orderBy("p"))  # 999 rows at any size of the data
    return grid.select(step.alias("d")).where("d < -1e-10").isEmpty()


def pass_rates(results: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Evaluations and, for each condition, the share of them that meets it; null counts as a failure."""
    return results.agg(F.count("*").alias("evaluations"), *(half_up(F.avg(F.coalesce(c, F.lit(False)).cast("int")), 6).alias(n) for n, c in conditions.items()))


def decide(rates: DataFrame, least: dict[str, float]) -> DataFrame:
    """rates with passed: every named rate reaches its least value; rates of no evaluation fail."""
    met = F.lit(True)
    for name, bound in least.items():
        met = met & F.coalesce(F.col(name) >= bound, F.lit(False))
    return rates.withColumn("passed", met)


def layer_decisions(cohorts: DataFrame, layers: dict[str, Column]) -> DataFrame:
    """One row: for each layer whether all cohorts meet its condition, and overall; without cohorts nothing passes."""
    got = cohorts.agg(*(F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(False)).alias(n) for n, c in layers.items()))
    overall = F.lit(True)
    for n in layers:
        overall = overall & F.col(n)
    return got.withColumn("overall", overall)


def deployment(low: Column, high: Column) -> Column:
    """What a 95% interval of (candidate less baseline) of an error allows: deploy below 0, reject above 0, else keep the baseline."""
    return F.when(high < 0, "deploy").when(low > 0, "reject").otherwise("keep baseline")
