"""Weights, standardising, ridge and logistic fits, conformal intervals and trailing calibration.

Fits go through moments: one aggregation brings the weighted sums of products of
the predictors (a small matrix whatever the number of rows) to the driver, which
solves the normal equations or a Newton step. Predictions are column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scalar import half_up, logit, sigmoid
from weftline.operators.quantiles import weighted_quantile
from weftline.operators.trailing import Quantiles, Rank, with_trailing


def hierarchical_weights(rows: DataFrame, cluster: str, asset: str) -> DataFrame:
    """rows with weight: clusters count alike, assets alike in a cluster, rows alike in an asset; the mean is 1."""
    per_asset = rows.groupBy(cluster, asset).agg(F.count("*").alias("_rows"))
    per_cluster = per_asset.groupBy(cluster).agg(F.count("*").alias("_assets"), F.sum("_rows").alias("_in"))
    total = per_cluster.agg(F.count("*").alias("_clusters"), F.sum("_in").alias("_all"))
    share = per_asset.join(per_cluster, cluster).crossJoin(F.broadcast(total))  # total has one row
    return rows.join(share.select(cluster, asset, (F.col("_all") / F.col("_clusters") / F.col("_assets") / F.col("_rows")).alias("weight")), [cluster, asset])


def standardiser(rows: DataFrame, columns: list[str], weight: str = "weight", floor: float = 1e-12) -> dict[str, tuple[float, float]]:
    """Weighted mean and population deviation of each column."""
    w = F.col(weight)
    sums = [F.sum(w).alias("w")]
    for c in columns:
        sums += [F.sum(w * F.col(c)).alias(f"{c}_1"), F.sum(w * F.col(c) * F.col(c)).alias(f"{c}_2")]
    r = rows.agg(*sums).first()
    out = {}
    for c in columns:
        mean = r[f"{c}_1"] / r["w"]
        out[c] = mean, max(floor, r[f"{c}_2"] / r["w"] - mean * mean) ** 0.5
    return out


@dataclass
class LinearModel:
    columns: list[str]
    scaling: dict[str, tuple[float, float]]
    coefficients: list[float]
    intercept: float
    penalty: float
    extra: dict = field(default_factory=dict)

    def score(self) -> Column:
        """Intercept plus coefficients times standardised columns."""
        out = F.lit(self.intercept)
        for c, b in zip(self.columns, self.coefficients, strict=True):
            mean, spread = self.scaling[c]
            out = out + (F.col(c) - mean) / spread * b
        return out

    def range_prediction(self) -> Column:
        """Prediction of a model of the logarithm, kept between 0.01 and 100."""
        return F.exp(F.least(F.lit(np.log(100.0)), F.greatest(F.lit(np.log(0.01)), self.score())))

    def probability(self) -> Column:
        return sigmoid(self.score())


def _design(columns: list[str], scaling: dict[str, tuple[float, float]]) -> list[Column]:
    return [F.lit(1.0), *((F.col(c) - scaling[c][0]) / scaling[c][1] for c in columns)]


def _cross(rows: DataFrame, x: list[Column], weight: Column, target: Column) -> tuple[np.ndarray, np.ndarray, float]:
    """Weighted sums of products of x with x and with the target, and of the weights, by one aggregation."""
    k = len(x)
    sums = [F.sum(weight).alias("w"), *(F.sum(weight * x[i] * target).alias(f"t{i}") for i in range(k)), *(F.sum(weight * x[i] * x[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k))]
    r = rows.agg(*sums).first()
    m = np.array([[r[f"m{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], dtype=float)
    return m, np.array([r[f"t{i}"] for i in range(k)], dtype=float), float(r["w"])


def ridge(rows: DataFrame, columns: list[str], target: Column, penalty: float, weight: str = "weight") -> LinearModel:
    """Weighted least squares on standardised columns with a squared penalty, the intercept left out of it."""
    scaling = standardiser(rows, columns, weight)
    m, t, total = _cross(rows, _design(columns, scaling), F.col(weight), target)
    m = m / total + penalty * np.diag([0.0, *[1.0] * len(columns)])
    b = np.linalg.solve(m, t / total)
    return LinearModel(columns, scaling, b[1:].tolist(), float(b[0]), penalty)


def logistic(rows: DataFrame, columns: list[str], truth: str, penalty: float, weight: str = "weight", steps: int = 40) -> LinearModel:
    """Weighted logistic regression with a squared penalty by Newton's method; each step is one aggregation."""
    scaling = standardiser(rows, columns, weight)
    x = _design(columns, scaling)
    model = LinearModel(columns, scaling, [0.0] * len(columns), 0.0, penalty)
    ridge_part = penalty * np.diag([0.0, *[1.0] * len(columns)])
    held = rows.select(*columns, truth, weight)
    for _ in range(steps):
        p = model.probability()
        m, _, _ = _cross(held, x, F.col(weight) * p * (1.0 - p), F.lit(0.0))
        r = held.agg(F.sum(weight).alias("w"), *(F.sum(F.col(weight) * c * (F.col(truth) - p)).alias(f"g{i}") for i, c in enumerate(x))).first()
        beta = np.array([model.intercept, *model.coefficients])
        step = np.linalg.solve(m / r["w"] + ridge_part + 1e-10 * np.eye(len(x)), np.array([r[f"g{i}"] for i in range(len(x))]) / r["w"] - ridge_part @ beta)
        beta = beta + step
        model.intercept, model.coefficients = float(beta[0]), beta[1:].tolist()
        if np.abs(step).max() < 1e-8:
            break
    return model


def trailing_reference(rows: DataFrame, predicted: str, actual: str, key: str = "asset", time: str = "date", n: int = 252) -> DataFrame:
    """rows with what n earlier values say: prior_median, prior_q90, high_event (actual strictly above q90), relative (prediction over median) and rank of the prediction; null without n of them."""
    out = with_trailing(rows, [Quantiles(("prior_median", "prior_q90"), actual, (0.5, 0.9), n, n), Rank("prediction_rank", predicted, predicted, n)], key, time)
    out = out.withColumns({"prior_median": half_up(F.col("prior_median"), 8), "prior_q90": half_up(F.col("prior_q90"), 8), "prediction_rank": half_up(F.col("prediction_rank"), 6)})
    return out.withColumns({"high_event": F.when(F.col("prior_q90").isNotNull(), (F.col(actual) > F.col("prior_q90")).cast("int")), "relative": half_up(F.try_divide(predicted, "prior_median"), 6)})


def trailing_prior(rows: DataFrame, truth: str, base: Column, key: str = "asset", time: str = "date", n: int = 252, pull: float = 100.0) -> DataFrame:
    """rows with prior: the event rate of up to n earlier rows, shrunk to the base rate by ``pull`` rows; the base rate without any."""
    before = Window.partitionBy(key).orderBy(time).rowsBetween(-n, -1)
    hits, seen = F.coalesce(F.sum(truth).over(before), F.lit(0)), F.count(truth).over(before)
    return rows.withColumn("prior", (hits + pull * base) / (seen + pull))


def shifted_probability(p: Column, prior: Column, base: Column, strength: float) -> Column:
    """Probability moved by strength times the log-odds of the prior over the base."""
    return sigmoid(logit(p) + strength * (logit(prior) - logit(base)))


#: Levels of outcome over prediction that intervals use.
LEVELS = (0.1, 0.25, 0.5, 0.75, 0.9, 0.95)


def outcome_ratio(predicted: str, actual: str) -> Column:
    """Outcome over prediction; predictions below 0.01 divide as 0.01."""
    return half_up(F.try_divide(F.col(actual), F.greatest(F.col(predicted), F.lit(0.01))), 8)


def conformal_quantiles(rows: DataFrame, predicted: str, actual: str, cluster: str = "cluster", asset: str = "asset", points: tuple[float, ...] = LEVELS, excluded: list[str] | None = None, digits: int = 6) -> DataFrame:
    """scope, rows, q0, q1, ...: weighted quantiles of outcome over prediction, of all rows (scope ``all``) and of each cluster.

    In a scope clusters count alike, assets alike in a cluster and rows alike in an
    asset. With ``excluded``, for each of these clusters also a scope ``not NAME`` of
    all other clusters' rows; weights of what is left are those of the whole but for
    a factor, so one pass serves every scope and rows meet their scopes by name.
    """
    per_asset = rows.groupBy(cluster, asset).agg(F.count("*").alias("_rows"))
    per_cluster = per_asset.groupBy(cluster).agg(F.count("*").alias("_assets"))
    weights = per_asset.join(per_cluster, cluster).select(cluster, asset, (F.lit(1.0) / F.col("_assets") / F.col("_rows")).alias("_weight"))
    scopes = [F.lit("all"), F.concat(F.lit("in "), F.col(cluster)), *(F.when(F.col(cluster) != name, F.lit(f"not {name}")) for name in excluded or [])]
    held = rows.select(cluster, asset, outcome_ratio(predicted, actual).alias("_q")).join(weights, [cluster, asset])
    each = held.select(F.explode(F.array_compact(F.array(*scopes))).alias("scope"), "_q", "_weight")
    return weighted_quantile(each, "_q", "_weight", list(points), ["scope"], digits)


def known_before(tape: DataFrame, cutoff: str, role: str | None = "development", time: str = "date", role_col: str = "role") -> DataFrame:
    """Rows of a tape strictly before a cutoff, of one role: what may calibrate forecasts from the cutoff on."""
    held = tape.where(F.col(time) < F.lit(cutoff).cast("date"))
    return held.where(F.col(role_col) == role) if role else held

