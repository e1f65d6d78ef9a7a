"""Replay of a score from a bounded array of bars, without windows: what the windowed columns are held against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scalar import change_of, half_up, ratio
from weftline.operators.score import FIRST_BAR, with_score

#: Bars that a replay may read.
HISTORY = 96
SHOWN = ("temperature", "rain", "ultraviolet", "weather")


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _last(bars: Column, n: int, before: int = 0) -> Column:
    """The n bars before the last ``before`` ones; fewer if there are not as many."""
    size = F.size(bars) - before
    return F.slice(bars, F.greatest(F.lit(1), size - n + 1), F.greatest(F.lit(0), F.least(F.lit(n), size)))


def indicators_of(bars: Column) -> dict[str, Column]:
    """The indicators that a score needs, of the last of an array of bars (open, high, low, close, volume) in order of time."""
    n = F.size(bars)
    bar = lambda k: F.get(bars, n - 1 - k)
    close = bar(0)["close"]
    full = lambda x, k: F.when(n >= k, x)
    mean = lambda k: _total(F.transform(_last(bars, k), lambda b: b["close"])) / k
    pairs = F.zip_with(_last(bars, 14), _last(bars, 14, 1), lambda b, p: F.struct(b.alias("b"), p["close"].alias("p")))
    step = lambda x: x["b"]["close"] - x["p"]
    gains = half_up(_total(F.transform(pairs, lambda x: F.greatest(step(x), F.lit(0.0)))), 9)
    losses = half_up(_total(F.transform(pairs, lambda x: F.greatest(-step(x), F.lit(0.0)))), 9)
    ranges = F.transform(pairs, lambda x: F.greatest(x["b"]["high"] - x["b"]["low"], F.abs(x["b"]["high"] - x["p"]), F.abs(x["b"]["low"] - x["p"])))
    before = _total(F.transform(_last(bars, 20, 1), lambda b: b["volume"])) / 20
    run = F.aggregate(F.reverse(_last(bars, 8)), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, b: F.struct((a["n"] + (a["on"] & (b["close"] > b["open"])).cast("int")).alias("n"), (a["on"] & (b["close"] > b["open"])).alias("on")), lambda a: a["n"])
    out = {f"sma{k}": full(half_up(mean(k), 9), k) for k in (5, 20)}
    out["rsi14"] = full(half_up(F.when(losses == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + F.try_divide(gains, losses))), 9), 15)
    out["atr14"] = full(half_up(F.when(close != 0, F.try_divide(_total(ranges) / 14, close) * 100.0), 9), 15)
    out |= {f"change{k}": half_up(change_of(close, bar(k)["close"]), 9) for k in (4, 5, 20, 24)}
    out["volume_ratio20"] = full(half_up(F.when(before > 0, ratio(bar(0)["volume"], before)), 9), 21)
    return out | {"green_run": run, "prev_close": bar(1)["close"], "open": bar(0)["open"], "close": close}


def sampled(bars: DataFrame, first: int = FIRST_BAR, key: str = "asset", time: str = "date") -> DataFrame:
    """key, bar_no: the first scored bar of each series, the one in the middle and the last."""
    numbered = bars.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= first)
    middle = F.floor((F.col("_n") - first) / 2) + first
    return numbered.select(key, F.explode(F.array_distinct(F.array(F.lit(first).cast("long"), middle, F.col("_n")))).alias("bar_no"))


def replay(bars: DataFrame, at: DataFrame, key: str = "asset", time: str = "date") -> DataFrame:
    """key, time, bar_no and the score of the bars at, each from an array of the HISTORY bars up to it."""
    numbered = bars.withColumn("_no", F.row_number().over(Window.partitionBy(key).orderBy(time)).cast("long"))
    wanted = at.withColumn("_no", F.explode(F.sequence(F.greatest(F.lit(1).cast("long"), F.col("bar_no") - HISTORY + 1), F.col("bar_no"))))
    met = wanted.join(numbered, [key, "_no"])
    arrays = met.groupBy(key, "bar_no").agg(F.sort_array(F.collect_list(F.struct("_no", time, "open", "high", "low", "close", "volume"))).alias("_bars"))  # HISTORY bars at most
    return with_score(arrays.select(key, "bar_no", F.element_at("_bars", -1)[time].alias(time), *(x.alias(n) for n, x in indicators_of(F.col("_bars")).items())))


def score_parity(bars: DataFrame, scores: DataFrame, key: str = "asset", time: str = "date") -> DataFrame:
    """key, time, SHOWN of the replays, and parity: whether the scores of the same bars are equal."""
    found = replay(bars, sampled(bars, key=key, time=time), key, time).select(key, time, *SHOWN)
    other = scores.select(key, time, F.struct(*SHOWN).alias("_other"))
    return found.join(other, [key, time], "left").withColumn("parity", F.struct(*SHOWN).eqNullSafe(F.col("_other"))).drop("_other")
