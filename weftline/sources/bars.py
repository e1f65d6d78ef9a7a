"""Price bars from raw rows, and validation of candles.

A bar is open, high, low, close and volume of an asset and a date. All functions
take the raw table and aggregate it once, with partial aggregation before the
shuffle; a window over bars follows on the same key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.scalar import half_up


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def to_bars(rows: DataFrame, keys: list[str], price: Column, order: list[str], volume: Column) -> DataFrame:
    """One bar for each key: first and last price by a total order, extremes, summed volume; prices to 6 digits."""
    at = F.struct(*order)
    return rows.withColumn("_p", half_up(price, 6)).withColumn("_v", volume).groupBy(*keys).agg(
        F.min_by("_p", at).alias("open"),
        F.max("_p").alias("high"),
        F.min("_p").alias("low"),
        F.max_by("_p", at).alias("close"),
        F.sum("_v").alias("volume"),
    )


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset (return flag and line status), date, prices per unit and quantity of lineitem."""
    rows = read(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus").alias("asset"), F.to_date("l_shipdate").alias("date"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"
    )
    return to_bars(rows, ["asset", "date"], F.col("l_extendedprice") / F.col("l_quantity"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], F.col("l_quantity").cast("double"))


def hourly_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """asset (event type), hour, prices (value) and number of events."""
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("asset"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "ts", "event_id", "value")
    return to_bars(rows, ["asset", "hour"], F.col("value"), ["ts", "event_id"], F.lit(1.0))


def market_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market series of all orders: date, prices (total price) and number of orders."""
    rows = read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"), "o_orderkey", "o_totalprice")
    return to_bars(rows, ["date"], F.col("o_totalprice"), ["o_orderkey"], F.lit(1.0))


def valid_candles(candles: DataFrame, arrival: str, least: int = 100) -> DataFrame:
    """Candles with finite values, positive prices and high >= low; of an asset and date the last by arrival; assets with too few left go."""
    prices = ["open", "high", "low", "close"]
    sound = F.col("high") >= F.col("low")
    for c in [*prices, "volume"]:
        sound &= F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    for c in prices:
        sound &= F.col(c) > 0
    last = Window.partitionBy("asset", "date").orderBy(F.desc(arrival))
    kept = candles.where(sound).withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
    return kept.withColumn("_c", F.count("*").over(Window.partitionBy("asset"))).where(F.col("_c") >= least).drop("_c")


def recent(bars: DataFrame, n: int, key: str = "asset", time: str = "date") -> DataFrame:
    """The last n bars of each asset."""
    w = Window.partitionBy(key).orderBy(F.desc(time))
    return bars.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def live(bars: DataFrame, n: int, least: int, key: str = "asset", time: str = "date") -> DataFrame:
    """The last n bars of each asset with status: ``live``, or ``mock`` where these are fewer than least, so that a stand-in is to be used."""
    held = F.count("*").over(Window.partitionBy(key))
    return recent(bars, n, key, time).withColumn("status", F.when(held < least, "mock").otherwise("live"))
