"""Comparison of a candidate with a baseline, grades and storms of forecasts, interval schemes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scalar import half_up, ratio
from weftline.operators.metrics import rounded, wilson
from weftline.operators.models import outcome_ratio
from weftline.operators.trailing import Quantiles, with_trailing

#: Grades in order.
GRADES = ("calm", "normal", "rough", "storm")
SCHEMES = ("global", "cluster", "rolling252", "shrunk252")


def compare(rows: DataFrame, candidate: str, baseline: str, actual: str, *keys: str) -> DataFrame:
    """Per keys: rows, MAE, RMSE and R2 of both predictions, and what the candidate improves.

    mae_improvement and rmse_improvement in percent of the baseline's, r2_delta,
    and skill, one less the ratio of the mean squared errors. Null where a
    denominator is 0; rows that lack one of the three values are left out.
    """
    held = rows.dropna(subset=[candidate, baseline, actual])
    a = F.col(actual)
    spread = F.var_pop(a) * F.count("*")
    each = {}
    for name, c in (("candidate", candidate), ("baseline", baseline)):
        e = a - F.col(c)
        each |= {f"{name}_mae": F.avg(F.abs(e)), f"{name}_rmse": F.sqrt(F.avg(e * e)), f"{name}_r2": 1.0 - ratio(F.sum(e * e), F.when(spread > 0, spread))}
    got = held.groupBy(*keys).agg(F.count("*").alias("rows"), *(x.alias(n) for n, x in each.items())).where("rows > 0")
    better = lambda m: 100.0 * ratio(F.col(f"baseline_{m}") - F.col(f"candidate_{m}"), F.col(f"baseline_{m}"))
    squared = lambda n: F.col(f"{n}_rmse") * F.col(f"{n}_rmse")
    return rounded(got.withColumns({"mae_improvement": better("mae"), "rmse_improvement": better("rmse"), "r2_delta": F.col("candidate_r2") - F.col("baseline_r2"), "skill": 1.0 - ratio(squared("candidate"), squared("baseline"))}))


def macro(rows: DataFrame, *columns: str) -> DataFrame:
    """One row: the number of groups and the means of columns over groups, so that each group counts alike; nulls are left out."""
    return rounded(rows.agg(F.count("*").alias("groups"), *(F.avg(c).alias(c) for c in columns)))


def grade_hits(rows: DataFrame, predicted: str, actual_grade: str, actual: str, event: str, *more: Column) -> DataFrame:
    """Per predicted grade: rows and their share, mean and median of the actual value, the shares of exact and within-one grades, the event rate, and more aggregates. Grades without rows are not listed."""
    order = lambda c: F.array_position(F.array(*(F.lit(g) for g in GRADES)), F.col(c))
    got = rows.groupBy(predicted).agg(
        F.count("*").alias("rows"),
        F.avg(actual).alias("mean_actual"),
        F.percentile(actual, 0.5).alias("median_actual"),
        F.avg((order(predicted) == order(actual_grade)).cast("int")).alias("exact"),
        F.avg((F.abs(order(predicted) - order(actual_grade)) <= 1).cast("int")).alias("within_one"),
        F.avg(F.col(event).cast("int")).alias("event_rate"),
        *more,
    )
    total = got.agg(F.sum("rows").alias("_all"))
    return rounded(got.crossJoin(F.broadcast(total)).withColumn("share", F.col("rows") / F.col("_all")).drop("_all"))  # total has one row


def weather_report(rows: DataFrame, predicted: str, actual_grade: str, actual: str, prior: str, event: str) -> DataFrame:
    """All four grades from calm to storm: what ``grade_hits`` has of each, and the mean ratio of the actual value to the median before it.

    A grade without rows has 0 rows and nulls; rows of no grade count for the shares
    only; a prior median of 0 or null has no ratio.
    """
    mean_ratio = F.avg(F.try_divide(F.col(actual), F.col(prior))).alias("mean_prior_ratio")
    got = grade_hits(rows, predicted, actual_grade, actual, event, mean_ratio).withColumnRenamed(predicted, "grade")
    grades = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, GRADES))).alias("grade"))
    return grades.join(got, "grade", "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))


def storm_report(rows: DataFrame, alert: Column, event: Column, *keys: str) -> DataFrame:
    """Per keys: confusion of alerts and events, precision and recall with 95% Wilson intervals, F1, specificity, base rate and lift; null where a denominator is 0."""
    n = lambda c, name: F.count_if(c).alias(name)
    got = rows.groupBy(*keys).agg(F.count("*").alias("rows"), n(alert & event, "tp"), n(alert & ~event, "fp"), n(~alert & event, "fn"), n(~alert & ~event, "tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    got = got.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "base_rate": ratio(tp + fn, F.col("rows"))})
    for name, total in (("precision", tp + fp), ("recall", tp + fn)):
        low, high = wilson(tp, total)
        got = got.withColumns({f"{name}_low": low, f"{name}_high": high})
    return rounded(got.withColumns({"f1": ratio(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), "lift": ratio(F.col("precision"), F.col("base_rate"))}))


#: Quantile points of the outer and inner bounds, and their names in a table of conformal quantiles.
POINTS = {0.1: "q0", 0.25: "q1", 0.75: "q3", 0.9: "q4"}


def own_quantiles(tape: DataFrame, predicted: str, actual: str, key: str = "asset", time: str = "date", n: int = 252, least: int = 60) -> DataFrame:
    """tape with residuals, the number of up to n earlier rows with a ratio of outcome to prediction, and own0 to own3, these ratios' quantiles; null of fewer than ``least``."""
    held = tape.withColumn("_q", outcome_ratio(predicted, actual))
    before = Window.partitionBy(key).orderBy(time).rowsBetween(-n, -1)
    names = tuple(f"own{k}" for k in range(len(POINTS)))
    out = with_trailing(held.withColumn("residuals", F.count("_q").over(before)), [Quantiles(names, "_q", tuple(POINTS), n, least)], key, time)
    return out.withColumns({c: half_up(F.col(c), 10) for c in names}).drop("_q")


def interval_schemes(tape: DataFrame, table: DataFrame, predicted: str, actual: str, cluster: str = "cluster", key: str = "asset", time: str = "date", n: int = 252, least: int = 60, pull: float = 100.0, digits: int = 6) -> DataFrame:
    """One row per row of tape and scheme: scheme, residuals, bound0 to bound3 for POINTS of outcome over prediction.

    table: conformal quantiles, from rows whose outcome was known before the first
    row that is judged (``models.known_before``). global: its scope ``all``; cluster:
    the row's cluster's scope, ``all`` if there is none; rolling252: quantiles of up
    to n earlier ratios of the series on the tape; shrunk252: these blended with the
    global ones by k / (k + pull) for k ratios. With fewer than ``least`` earlier
    ratios the last two are global. No row's bounds use its own or a later outcome.
    """
    wanted = F.array(*(F.col(c) for c in POINTS.values()))
    total = table.where("scope = 'all'").select(wanted.alias("_g"))
    parts = table.where(F.startswith("scope", F.lit("in "))).select(F.substring("scope", 4, 1 << 30).alias(cluster), wanted.alias("_c"))
    own = F.array(*(F.col(f"own{k}") for k in range(len(POINTS))))
    held = own_quantiles(tape, predicted, actual, key, time, n, least).withColumn("_o", own)
    held = held.join(parts, cluster, "left").crossJoin(F.broadcast(total))  # total has one row
    enough, share = F.col("residuals") >= least, F.col("residuals") / (F.col("residuals") + pull)
    blend = F.when(enough, F.zip_with("_o", "_g", lambda o, g: share * o + (1.0 - share) * g)).otherwise(F.col("_g"))
    bounds = lambda q: [half_up(F.get(q, F.lit(k)) * F.col(predicted), digits).alias(f"bound{k}") for k in range(len(POINTS))]
    schemes = (F.col("_g"), F.coalesce("_c", "_g"), F.when(enough, F.col("_o")).otherwise(F.col("_g")), blend)
    each = F.array(*(F.struct(F.lit(s).alias("scheme"), *bounds(q)) for s, q in zip(SCHEMES, schemes, strict=True)))
    return held.select(*tape.columns, "residuals", F.inline(each))


def coverage_error(coverage50: Column, coverage80: Column) -> Column:
    """Mean distance of both coverages from their goals."""
    return (F.abs(coverage50 - 0.5) + F.abs(coverage80 - 0.8)) / 2.0


def series_coverage(bounds: DataFrame, actual: str, *keys: str) -> DataFrame:
    """Per keys: rows, coverage and width of the inner (50%) and outer (80%) bounds, and the mean coverage error; not rounded."""
    inside = lambda a, b: F.avg(((F.col(actual) >= F.col(a)) & (F.col(actual) <= F.col(b))).cast("int"))
    wide = lambda a, b: F.avg(F.col(b) - F.col(a))
    got = bounds.groupBy(*keys).agg(F.count("*").alias("rows"), inside("bound1", "bound2").alias("coverage50"), wide("bound1", "bound2").alias("width50"), inside("bound0", "bound3").alias("coverage80"), wide("bound0", "bound3").alias("width80"))
    return got.withColumn("error", coverage_error(F.col("coverage50"), F.col("coverage80")))


def scheme_metrics(bounds: DataFrame, actual: str, key: str = "asset") -> DataFrame:
    """Per scheme: means over series of the coverage and width of the inner (50%) and outer (80%) bounds, the mean error of both coverages, and whether it is chosen.

    Chosen is the narrowest outer width among the schemes whose error is within
    0.005 of the least; of equal widths the first name.
    """
    got = series_coverage(bounds, actual, "scheme", key).groupBy("scheme").agg(F.count("*").alias("series"), *(F.avg(c).alias(c) for c in ("coverage50", "width50", "coverage80", "width80")))
    got = rounded(got.withColumn("error", coverage_error(F.col("coverage50"), F.col("coverage80"))))
    best = got.agg(F.min("error").alias("_least"))
    fit = F.col("error") <= F.col("_least") + 0.005
    first = got.crossJoin(F.broadcast(best)).where(fit).agg(F.min(F.struct("width80", "scheme")).alias("_first"))  # a few schemes
    return got.crossJoin(F.broadcast(first)).withColumn("chosen", F.col("scheme") == F.col("_first.scheme")).drop("_first")


def pass_rate(bounds: DataFrame, actual: str, key: str = "asset", most: float = 0.1) -> DataFrame:
    """Per scheme: series and the share of them whose mean coverage error is at most ``most``."""
    each = series_coverage(bounds, actual, "scheme", key)
    return rounded(each.groupBy("scheme").agg(F.count("*").alias("series"), F.avg((half_up(F.col("error"), 9) <= most).cast("int")).alias("pass_rate")))


def equal_groups(rows: DataFrame, group: str, value: str, key: str = "asset", least: int = 20) -> DataFrame:
    """Per group: the series with at least ``least`` rows in it, their rows, and the mean over them of each one's mean value."""
    each = rows.groupBy(key, group).agg(F.count("*").alias("_n"), F.avg(value).alias("_m")).where(F.col("_n") >= least)
    return rounded(each.groupBy(group).agg(F.count("*").alias("series"), F.sum("_n").alias("rows"), F.avg("_m").alias("mean")))


def within_keys(rows: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """rows whose columns stand in keys, each once however often the keys repeat."""
    return rows.join(keys.select(*columns).distinct(), list(columns), "left_semi")


def with_other_score(rows: DataFrame, outcome_of: str, score_of: str, scores: list[str], key: str = "asset", time: str = "date") -> DataFrame:
    """Rows of one series with the scores of another on the same date; dates that either lacks are left out."""
    other = rows.where(F.col(key) == score_of).select(time, *scores)
    return rows.where(F.col(key) == outcome_of).drop(*scores).join(other, time)


def subset_bounds(bounds: DataFrame, subset: DataFrame, *keys: str) -> DataFrame:
    """Bounds of the rows of a subset, which must have one for each of its keys: a missing one is null."""
    return subset.select(*keys).distinct().join(bounds, list(keys), "left")
