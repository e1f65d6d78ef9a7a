"""The bundle of a cohort: range, interval, weather and tail measures in one pass over its rows, and the gates they must pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.scalar import half_up
from weftline.operators import bootstrap, metrics
from weftline.operators.comparison import coverage_error

#: Ranks below the first are quiet, from the second on a storm.
QUIET, STORM = 25.0, 90.0


def bundle(rows: DataFrame, *by: str, least_error: float = 0.1) -> DataFrame:
    """One row per cohort: rows, assets, and measures that count series alike.

    rows: asset, date, y, predicted, baseline (a range), p, base_rate (chances of
    tail1), rank, over_median, high_event (null until a series has its history) and
    bound0 to bound3. mae and brier are deltas, candidate less baseline; storm
    columns are means over storm rows less those over quiet rows, each over the
    series that have such rows; interval_pass is the share of series whose mean
    coverage error is at most ``least_error``; auc is null for a series without both
    outcomes, and passed over.
    """
    e = lambda c: F.avg(F.abs(F.col("y") - F.col(c)))
    square = lambda c: F.avg((F.col(c) - F.col("tail1")) * (F.col(c) - F.col("tail1")))
    inside = lambda a, b: F.avg(F.col("y").between(F.col(a), F.col(b)).cast("int"))
    quiet, storm = F.col("rank") < QUIET, F.col("rank") >= STORM
    of = lambda when, c: F.avg(F.when(when, F.col(c)))
    each = rows.groupBy(*by, "asset").agg(
        F.count("*").alias("_n"), e("predicted").alias("mae"), e("baseline").alias("mae_baseline"), square("p").alias("brier"), square("base_rate").alias("brier_baseline"),
        inside("bound1", "bound2").alias("c5"), inside("bound0", "bound3").alias("c8"), F.avg(F.col("bound3") - F.col("bound0")).alias("w8"),
        of(quiet, "over_median").alias("qr"), of(storm, "over_median").alias("sr"), of(quiet, "high_event").alias("qe"), of(storm, "high_event").alias("se"),
    )
    auc = metrics.roc_auc(rows, "p", "tail1", [*by, "asset"]).select(*by, "asset", "auc")
    each = each.join(auc, [*by, "asset"], "left").withColumn("_e", coverage_error(F.col("c5"), F.col("c8")))
    got = each.groupBy(*by).agg(
        F.sum("_n").alias("rows"), F.count("*").alias("assets"), F.avg("mae").alias("mae"), (F.avg("mae") - F.avg("mae_baseline")).alias("mae_delta"),
        F.avg("c5").alias("coverage50"), F.avg("c8").alias("coverage80"), F.avg("w8").alias("width80"), F.avg((half_up(F.col("_e"), 9) <= least_error).cast("int")).alias("interval_pass"),
        (F.avg("sr") - F.avg("qr")).alias("storm_ratio"), (F.avg("se") - F.avg("qe")).alias("storm_event"),
        F.avg("brier").alias("brier"), (F.avg("brier") - F.avg("brier_baseline")).alias("brier_delta"), F.avg("auc").alias("auc"),
    )
    return metrics.rounded(got.withColumn("interval_error", coverage_error(F.col("coverage50"), F.col("coverage80"))))


def intervals_of(rows: DataFrame, *by: str, samples: int = 300, block: int = 20) -> DataFrame:
    """by and the 95% bounds of a cohort's deltas: mae_low, mae_high, brier_low, brier_high, ratio_low, event_low; over circular blocks of each series. by is returned as text."""
    err = lambda c: F.abs(F.col("y") - F.col(c))
    sq = lambda c: (F.col(c) - F.col("tail1")) * (F.col(c) - F.col("tail1"))
    held = rows.select(*by, "asset", "date", "rank", "over_median", "high_event", err("predicted").alias("_m"), err("baseline").alias("_mb"), sq("p").alias("_b"), sq("base_rate").alias("_bb"))
    mae = bootstrap.error_delta(held, "_m", "_mb", "asset", "date", samples, block, by=by).select(*by, F.col("low").alias("mae_low"), F.col("high").alias("mae_high"))
    brier = bootstrap.error_delta(held, "_b", "_bb", "asset", "date", samples, block, by=by).select(*by, F.col("low").alias("brier_low"), F.col("high").alias("brier_high"))
    weather = bootstrap.weather_interval(held.where("rank is not null"), "rank", "over_median", "high_event", "asset", "date", samples, block, by=by, quiet=QUIET, storm=STORM)
    weather = weather.groupBy(*by).agg(*(F.max(F.when(F.col("measure") == m, F.col("low"))).alias(f"{m}_low") for m in ("ratio", "event")))
    return mae.join(brier, list(by)).join(weather, list(by), "left")


def with_intervals(bundles: DataFrame, intervals: DataFrame, *by: str) -> DataFrame:
    text = bundles.withColumns({f"_{c}": F.coalesce(F.col(c).cast("string"), F.lit("")) for c in by})
    return text.join(intervals.withColumnsRenamed({c: f"_{c}" for c in by}), [f"_{c}" for c in by], "left").drop(*(f"_{c}" for c in by))




def fold_conditions() -> dict[str, Column]:
    """What a cohort of a fold must meet, nine conditions."""
    c = F.col
    return {
        "range_improves": c("mae_delta") < 0, "range_bound_below_zero": c("mae_high") < 0, "weather_ratio_positive": c("storm_ratio") > 0, "weather_event_positive": c("storm_event") > 0,
        "weather_ratio_bound_above_zero": c("ratio_low") > 0, "weather_event_bound_above_zero": c("event_low") > 0, "tail_improves": c("brier_delta") < 0, "tail_bound_below_zero": c("brier_high") < 0, "auc_above_random": c("auc") > 0.5,
    }


def cluster_conditions() -> dict[str, Column]:
    """What a cluster must meet that no model has learned from, seven conditions."""
    c = F.col
    return {
        "range_improves": c("mae_delta") < 0, "range_bound_below_zero": c("mae_high") < 0, "coverage_within_ten_points": c("interval_error") <= 0.1, "weather_ratio_positive": c("storm_ratio") > 0,
        "weather_event_positive": c("storm_event") > 0, "tail_improves": c("brier_delta") < 0, "auc_above_random": c("auc") > 0.5,
    }


def layer_conditions() -> dict[str, Column]:
    """What every cohort must meet for a layer to pass."""
    c = F.col
    return {
        "range": (c("mae_delta") < 0) & (c("mae_high") < 0),
        "interval": (c("interval_error") <= 0.05) & (c("interval_pass") >= 0.8),
        "weather": (c("storm_ratio") > 0) & (c("storm_event") > 0),
        "tail": (c("brier_delta") < 0) & (c("auc") > 0.5),
    }
