"""Grouped metrics of signals, ranges, probabilities and intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scalar import half_up, ratio

COUNTS = ("tp", "fp", "fn", "tn")


def confusion_counts(predicted: Column, actual: Column) -> list[Column]:
    """tp, fp, fn, tn; rows with a null on either side count nowhere."""
    return [
        F.count_if(predicted & actual).alias("tp"),
        F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & actual).alias("fn"),
        F.count_if(~predicted & ~actual).alias("tn"),
    ]


def confusion_rates(counts: DataFrame) -> DataFrame:
    """Counts with precision, recall, specificity, false_positive_rate, f1, base_rate, accuracy, balanced_accuracy, coverage, lift; null for a zero denominator."""
    c = {k: F.col(k).cast("double") for k in COUNTS}
    n = c["tp"] + c["fp"] + c["fn"] + c["tn"]
    rows = counts.withColumns(
        {
            "precision": ratio(c["tp"], c["tp"] + c["fp"]),
            "recall": ratio(c["tp"], c["tp"] + c["fn"]),
            "specificity": ratio(c["tn"], c["tn"] + c["fp"]),
            "base_rate": ratio(c["tp"] + c["fn"], n),
            "accuracy": ratio(c["tp"] + c["tn"], n),
            "coverage": ratio(c["tp"] + c["fp"], n),
        }
    )
    return rows.withColumns(
        {
            "false_positive_rate": 1.0 - F.col("specificity"),
            "f1": F.when(F.col("precision") + F.col("recall") > 0, 2.0 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))),
            "balanced_accuracy": (F.col("recall") + F.col("specificity")) / 2.0,
            "lift": ratio(F.col("precision"), F.col("base_rate")),
        }
    )


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """All double columns rounded half up."""
    return df.withColumns({c: half_up(F.col(c), digits) for c, t in df.dtypes if t == "double"})


def signal_grid(rows: DataFrame, signals: dict[str, Column], targets: dict[str, Column], values: dict[str, Column] | None = None, key: str = "asset") -> DataFrame:
    """Asset-equal rates of each signal against each target: per asset first, then the mean over assets without nulls.

    Signals and targets are unpivoted, so all cells come from one aggregation.
    lift is mean precision over mean base rate; mean_value the mean of the
    target's value where the signal is on.
    """
    values = values or {}
    pack = lambda d: F.array(*(F.struct(F.lit(k).alias("name"), v.alias("on")) for k, v in d.items()))
    goal = F.array(*(F.struct(F.lit(k).alias("name"), v.alias("on"), values.get(k, F.lit(None).cast("double")).alias("value")) for k, v in targets.items()))
    long = rows.select(key, F.explode(pack(signals)).alias("s"), goal.alias("t")).select(key, "s", F.explode("t").alias("t"))
    on, hit = F.coalesce("s.on", F.lit(False)), F.coalesce("t.on", F.lit(False))
    cells = long.groupBy(key, F.col("s.name").alias("signal"), F.col("t.name").alias("target")).agg(*confusion_counts(on, hit), F.avg(F.when(on, F.col("t.value"))).alias("mean_value"))
    rates = confusion_rates(cells)
    names = ("accuracy", "balanced_accuracy", "precision", "recall", "specificity", "coverage", "f1", "base_rate", "mean_value")
    out = rates.groupBy("signal", "target").agg(F.count("*").alias("assets"), F.sum(F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("observations"), *(F.avg(c).alias(c) for c in names))
    return rounded(out.withColumn("lift", ratio(F.col("precision"), F.col("base_rate"))))


def mean_rank(value: str, keys: list[str]) -> Column:
    """Average rank of ties within keys, from 1."""
    return F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / 2.0


def spearman(rows: DataFrame, x: str, y: str, keys: list[str], least: int = 3) -> DataFrame:
    """Rank correlation within keys over rows that have both; null below ``least`` rows or without variance."""
    held = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"_x": mean_rank(x, keys), "_y": mean_rank(y, keys)})
    got = held.groupBy(*keys).agg(F.count("*").alias("n"), *_moments("_x", "_y"))
    return got.select(*keys, "n", half_up(F.when(F.col("n") >= least, _correlation()), 6).alias("spearman"))


def _moments(x: str, y: str) -> list[Column]:
    a, b = F.col(x), F.col(y)
    return [F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(b * b).alias("syy"), F.sum(a * b).alias("sxy")]


def _correlation() -> Column:
    """Correlation from counts and sums; exact for ranks, whose sums are."""
    n = F.col("n").cast("double")
    vx, vy = n * F.col("sxx") - F.col("sx") * F.col("sx"), n * F.col("syy") - F.col("sy") * F.col("sy")
    return F.when((vx > 0) & (vy > 0), (n * F.col("sxy") - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy))


def top_share_lift(rows: DataFrame, score: str, value: str, key: str, order: str, share: float = 0.2) -> DataFrame:
    """Mean value of the ceil(share * n) highest scores over the mean of all, ties by ``order``."""
    w = Window.partitionBy(key)
    at = F.row_number().over(w.orderBy(F.desc(score), order))
    held = rows.where(F.col(score).isNotNull()).withColumn("_top", at <= F.greatest(F.lit(1), F.ceil(F.count("*").over(w) * F.lit(share))))
    return held.groupBy(key).agg(half_up(ratio(F.avg(F.when(F.col("_top"), F.col(value))), F.avg(value)), 6).alias("lift"))


def range_errors(rows: DataFrame, predicted: str, actual: str, key: str) -> DataFrame:
    """Per key n, mae, rmse, calibration (mean predicted over mean actual), r2 (null without variance) and the lift of predictions from their 80% quantile up, ties included."""
    held = rows.where(F.col(predicted).isNotNull() & F.col(actual).isNotNull())
    error = F.col(predicted) - F.col(actual)
    limits = held.groupBy(key).agg(half_up(F.percentile(predicted, 0.8), 6).alias("_limit"))
    got = held.join(limits, key).withColumn("_top", half_up(F.col(predicted), 6) >= F.col("_limit")).groupBy(key).agg(
        F.count("*").alias("n"),
        half_up(F.avg(F.abs(error)), 6).alias("mae"),
        half_up(F.sqrt(F.avg(error * error)), 6).alias("rmse"),
        half_up(ratio(F.avg(predicted), F.avg(actual)), 6).alias("calibration"),
        half_up(1.0 - F.try_divide(F.sum(error * error), F.when(F.var_pop(actual) > 0, F.var_pop(actual) * F.count("*"))), 6).alias("r2"),
        half_up(ratio(F.avg(F.when(F.col("_top"), F.col(actual))), F.avg(actual)), 6).alias("top_lift"),
    )
    return got


def roc_auc(rows: DataFrame, score: str, truth: str, keys: list[str]) -> DataFrame:
    """Area under the ROC curve by rank sums, ties shared; null where a class is missing."""
    held = rows.where(F.col(score).isNotNull() & F.col(truth).isNotNull()).withColumn("_r", mean_rank(score, keys))
    got = held.groupBy(*keys).agg(F.sum(F.when(F.col(truth) == 1, F.col("_r"))).alias("s"), F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) == 0).alias("q"))
    p, q = F.col("p").cast("double"), F.col("q").cast("double")
    return got.select(*keys, F.col("p").alias("positives"), F.col("q").alias("negatives"), half_up(F.try_divide(F.col("s") - p * (p + 1) / 2, p * q), 6).alias("auc"))


def average_precision(rows: DataFrame, score: str, truth: str, keys: list[str], order: str) -> DataFrame:
    """Mean precision at the positives in the order of falling scores, ties by ``order``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), order)
    held = rows.where(F.col(score).isNotNull()).withColumns({"_n": F.row_number().over(w), "_hits": F.sum(truth).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return held.groupBy(*keys).agg(half_up(F.avg(F.when(F.col(truth) == 1, F.col("_hits") / F.col("_n"))), 6).alias("average_precision"))


def calibration_bins(rows: DataFrame, p: str, truth: str, bins: int = 10) -> DataFrame:
    """Rows, mean prediction and event rate of equal bins of a probability, the last one closed."""
    at = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return rows.where(F.col(p).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n"), half_up(F.avg(p), 6).alias("mean_p"), half_up(F.avg(truth), 6).alias("rate"))


def probability_metrics(rows: DataFrame, p: str, truth: str, keys: list[str]) -> DataFrame:
    """Brier score, log loss (clipped at 1e-6) and expected calibration error in ten bins."""
    held = rows.where(F.col(p).isNotNull() & F.col(truth).isNotNull())
    q = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), F.col(p)))
    bins = held.groupBy(*keys, F.least(F.floor(F.col(p) * 10), F.lit(9)).alias("bin")).agg(
        F.count("*").alias("n"),
        F.sum(F.col(p) - F.col(truth)).alias("gap"),
        F.sum((F.col(p) - F.col(truth)) ** 2).alias("square"),
        F.sum(-(F.col(truth) * F.ln(q) + (1 - F.col(truth)) * F.ln(1 - q))).alias("loss"),
    )
    n = F.sum("n")
    return bins.groupBy(*keys).agg(n.alias("n"), half_up(F.sum("square") / n, 6).alias("brier"), half_up(F.sum("loss") / n, 6).alias("log_loss"), half_up(F.sum(F.abs("gap")) / n, 6).alias("ece"))


def top_decile(rows: DataFrame, p: str, truth: str, key: str) -> DataFrame:
    """Precision, recall and lift of the scores from their 90% quantile up, ties included."""
    cut = half_up(F.percentile(p, 0.9).over(Window.partitionBy(key)), 8)
    held = rows.where(F.col(p).isNotNull()).withColumn("_on", half_up(F.col(p), 8) >= cut)
    got = confusion_rates(held.groupBy(key).agg(*confusion_counts(F.col("_on"), F.col(truth) == 1)))
    return rounded(got.select(key, "tp", "fp", "precision", "recall", "lift"))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """95% Wilson interval of a share; null without rows."""
    n = n.cast("double")
    p = F.try_divide(hits.cast("double"), n)
    wide = 1.0 + F.try_divide(F.lit(z * z), n)
    mid = (p + F.try_divide(F.lit(z * z), 2.0 * n)) / wide
    half = z * F.sqrt(F.try_divide(p * (1.0 - p), n) + F.try_divide(F.lit(z * z), 4.0 * n * n)) / wide
    return mid - half, mid + half


def interval_coverage(rows: DataFrame, low: str, high: str, actual: str, key: str, goal: float) -> DataFrame:
    """Rows, coverage (bounds inclusive), Wilson bounds, mean width and distance from the wanted coverage."""
    inside = (F.col(actual) >= F.col(low)) & (F.col(actual) <= F.col(high))
    got = rows.where(F.col(low).isNotNull() & F.col(actual).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.count_if(inside).alias("hits"), F.avg(F.col(high) - F.col(low)).alias("width"))
    share = F.col("hits") / F.col("n")
    a, b = wilson(F.col("hits"), F.col("n"))
    return rounded(got.select(key, "n", share.alias("coverage"), a.alias("wilson_low"), b.alias("wilson_high"), "width", F.abs(share - goal).alias("coverage_error")))


def numeric_summary(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Count, mean, median and sample deviation of each column over its finite values."""
    out = []
    for c in columns:
        x = F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
        out += [F.count(x).alias(f"{c}_n"), half_up(F.avg(x), 6).alias(f"{c}_mean"), half_up(F.percentile(x, 0.5), 6).alias(f"{c}_median"), half_up(F.stddev_samp(x), 6).alias(f"{c}_sd")]
    return rows.groupBy(*keys).agg(*out)


def by_bins(rows: DataFrame, column: str, bins: list[tuple[str, int, int]], aggregates: list[Column]) -> DataFrame:
    """Aggregates of the rows whose value is within each bin (bounds inclusive); bins without rows stay, with count 0."""
    name = F.lit(None).cast("string")
    for label, low, high in reversed(bins):
        name = F.when((F.col(column) >= low) & (F.col(column) <= high), label).otherwise(name)
    all_bins = rows.sparkSession.range(1).select(F.explode(F.array(*(F.lit(b[0]) for b in bins))).alias("bin"))
    got = rows.withColumn("bin", name).where("bin is not null").groupBy("bin").agg(F.count("*").alias("rows"), *aggregates)
    return all_bins.join(got, "bin", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))


def monotone(bins: DataFrame, order: str, value: str) -> DataFrame:
    """One row: number of bins and whether the value never falls along the order (a few bins, one window)."""
    before = F.lag(value).over(Window.partitionBy(F.lit(1)).orderBy(order))
    return bins.select(F.coalesce(F.col(value) >= before, F.lit(True)).alias("ok")).agg(F.count("*").alias("bins"), F.bool_and("ok").alias("monotone"))
