"""State of the ledgers of forecasts in one row, and quotes of a dashboard with a row for each market."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scalar import half_up
from weftline.operators.export import latest_by_asset

CANDLES = 6


def ledger_status(forecasts: DataFrame, benchmarks: DataFrame, settlements: DataFrame) -> DataFrame:
    """One row: how many records the ledgers have, grades of the latest forecasts, and how the settled ones did.

    forecasts: forecast_id, asset, as_of, predicted, tail_probability, grade;
    benchmarks: forecast_id, atr_baseline, last_range; settlements: forecast_id,
    actual, tail_event, covered50, covered80. Ids are unique in each ledger.

    Settlements of unknown forecasts count as records, but not for the errors;
    baselines are judged where a benchmark was registered. What has no rows is null.
    latest_grades maps grades to the number of assets whose latest forecast has
    them; no grade is an empty one.
    """
    count = lambda rows, name: rows.agg(F.count("*").alias(name))
    latest = latest_by_asset(forecasts).groupBy(F.coalesce("grade", F.lit("")).alias("grade")).agg(F.count("*").alias("n"))
    grades = latest.agg(F.sum("n").alias("latest_assets"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("grade", "n")))).alias("latest_grades"))
    pairs = settlements.select("forecast_id", "actual", "tail_event", "covered50", "covered80").join(forecasts.select("forecast_id", "predicted", "tail_probability"), "forecast_id")
    pairs = pairs.join(benchmarks.select("forecast_id", "atr_baseline", "last_range"), "forecast_id", "left")
    mean = lambda c, name: half_up(F.avg(c), 6).alias(name)
    error = lambda c: F.abs(F.col("actual") - F.col(c))
    missed = F.col("tail_event").cast("double") - F.col("tail_probability")
    done = pairs.agg(
        F.count("*").alias("settled"), mean(error("predicted"), "range_mae"), mean(F.col("covered50").cast("int"), "coverage50"), mean(F.col("covered80").cast("int"), "coverage80"),
        mean(missed * missed, "tail_brier"), mean(error("atr_baseline"), "atr_baseline_mae"), mean(error("last_range"), "last_range_mae"),
    )
    parts = grades
    for part in (count(forecasts, "forecasts"), count(benchmarks, "benchmarks"), count(settlements, "settlements"), done):
        parts = parts.unionByName(part, allowMissingColumns=True)
    whole = parts.agg(*(F.first(c, ignorenulls=True).alias(c) for c in parts.columns))
    zero = F.lit(0).cast("long")
    return whole.withColumns({"latest_assets": F.coalesce("latest_assets", zero), "unsettled": F.col("forecasts") - F.col("settlements")})


def dashboard_quotes(markets: DataFrame, bars: DataFrame, key: str = "asset", time: str = "date") -> DataFrame:
    """markets with candles (the last six, by time), price, change in percent from the close before, and status.

    A market of fewer than two bars has no candles, price or change and the status
    ``error``; a close before of 0 has no change. Other columns of markets stay.
    """
    last = Window.partitionBy(key).orderBy(F.desc(time))
    held = bars.select(key, time, "open", "high", "low", "close").withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= CANDLES)
    candle = F.struct(time, "open", "high", "low", "close")
    found = held.groupBy(key).agg(F.sort_array(F.collect_list(candle)).alias("candles")).where(F.size("candles") >= 2)
    close = lambda k: F.element_at("candles", k)["close"]
    change: Column = half_up(F.try_divide(close(-1) - close(-2), close(-2)) * 100.0, 6)
    found = found.select(key, "candles", close(-1).alias("price"), change.alias("day_change"))
    out = markets.drop("candles", "price", "day_change", "status").join(found, key, "left")
    none = F.array().cast(found.schema["candles"].dataType)
    return out.withColumns({"status": F.when(F.col("candles").isNull(), "error").otherwise("live"), "candles": F.coalesce("candles", none)})
