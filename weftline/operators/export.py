"""Public export of forecasts: one nested document of the latest forecasts, the last settlements and the state of the ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.scalar import half_up

RECENT = 30


def _bounds(*names: str) -> Column:
    return F.array(*(half_up(F.col(c), 6) for c in names))


def latest_by_asset(forecasts: DataFrame) -> DataFrame:
    """The latest forecast of each asset, of equal dates the first by id; one aggregation, which combines before it shuffles. A forecast without a date is never the latest."""
    row = F.struct(*(c for c in forecasts.columns if c != "asset"))
    first = F.struct(F.negative(F.unix_date("as_of")).alias("age"), "forecast_id")
    return forecasts.where("as_of is not null").groupBy("asset").agg(F.min_by(row, first).alias("f")).select("asset", "f.*")


def public_export(forecasts: DataFrame, settlements: DataFrame, heads: DataFrame, aliases: dict[str, str] | None = None, most: int = RECENT) -> DataFrame:
    """One row: forecasts, recent_settlements, integrity and aliases.

    forecasts: forecast_id, asset, as_of, policy, predicted, low50, high50, low80,
    high80, grade; settlements: forecast_id, actual, covered50, covered80, settled_at;
    heads: ledger (``forecasts`` or ``settlements``) and head, a row for each.

    The latest forecast of each asset stands with its settlement, if it has one, in
    the order of the assets; of the last settlements, by settled_at, of equal ones the
    first by id, those stand whose forecast is known. Of several settlements of a forecast
    the last one counts. Without forecasts there is nothing to publish: an error.
    The document grows with the assets, not with the ledgers.
    """
    outcome = F.struct("actual", "covered50", "covered80", "settled_at")
    settlements = settlements.select("forecast_id", "actual", "covered50", "covered80", "settled_at")
    latest = latest_by_asset(forecasts)
    of_latest = settlements.join(latest.select("forecast_id"), "forecast_id", "left_semi")
    settled = of_latest.groupBy("forecast_id").agg(F.max_by(outcome, "settled_at").alias("settlement"))
    first = latest.join(settled, "forecast_id", "left").select(
        F.lit("forecast").alias("part"),
        F.struct(
            "asset", "as_of", "policy", half_up(F.col("predicted"), 6).alias("expected"), _bounds("low50", "high50").alias("interval50"), _bounds("low80", "high80").alias("interval80"),
            "grade", F.when(F.col("settlement").isNull(), "pending").otherwise("settled").alias("status"), "settlement",
        ).alias("f"),
    )
    last = settlements.orderBy(F.desc("settled_at"), "forecast_id").limit(most)
    known = last.join(forecasts.select("forecast_id", "asset", "as_of", "predicted"), "forecast_id")
    recent = known.select(
        F.lit("recent").alias("part"),
        F.struct(F.negative(F.unix_micros(F.col("settled_at").cast("timestamp"))).alias("order"), "forecast_id", "asset", "as_of", half_up(F.col("predicted"), 6).alias("expected"), "actual", "covered50", "covered80", "settled_at").alias("r"),
    )
    counts = forecasts.agg(F.count("*").alias("n")).select(F.lit("counts").alias("part"), F.lit("forecasts").alias("ledger"), "n").unionByName(settlements.agg(F.count("*").alias("n")).select(F.lit("counts").alias("part"), F.lit("settlements").alias("ledger"), "n"))
    ends = heads.select(F.lit("heads").alias("part"), "ledger", "head")
    parts = first.unionByName(recent, allowMissingColumns=True).unionByName(counts, allowMissingColumns=True).unionByName(ends, allowMissingColumns=True)
    of = lambda name, c: F.max(F.when(F.col("ledger") == name, F.col(c)))
    whole = parts.agg(
        F.sort_array(F.collect_list("f")).alias("forecasts"),
        F.sort_array(F.collect_list("r")).alias("_recent"),
        F.struct(of("forecasts", "n").alias("forecasts"), of("settlements", "n").alias("settlements"), of("forecasts", "head").alias("forecast_head"), of("settlements", "head").alias("settlement_head")).alias("integrity"),
    )
    some = F.when(F.size("forecasts") > 0, F.col("forecasts")).otherwise(F.raise_error("no forecasts to publish").cast(whole.schema["forecasts"].dataType))
    shown = F.transform("_recent", lambda r: r.dropFields("order", "forecast_id"))
    names = F.map_from_arrays(*(F.array(*map(F.lit, x)).cast("array<string>") for x in ((aliases or {}).keys(), (aliases or {}).values())))
    return whole.select(some.alias("forecasts"), shown.alias("recent_settlements"), "integrity", names.alias("aliases"))
