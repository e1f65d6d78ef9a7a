"""Trailing indicators and features of bars.

All columns come from frames over one window, partitioned by asset and ordered
by time, so that a plan has one exchange and one sort. Frames are gated: a value
is null until its window is full. Intermediate values are rounded to 9 digits,
features to 6, half up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scalar import change_of, growth, half_up, ratio
from weftline.operators.trailing import Quantiles, Rank, with_trailing


def span(key: str, time: str, first: int, last: int):
    return Window.partitionBy(key).orderBy(time).rowsBetween(first, last)


def full(value: Column, bars: int, number: str = "bar_no") -> Column:
    """value where at least that many bars have been seen."""
    return F.when(F.col(number) >= bars, value)


def with_indicators(bars: DataFrame, key: str = "asset", time: str = "date") -> DataFrame:
    """bars with bar_no, prev_close, step, true_range, sma5/20/50/200, rsi14, atr14, change1/4/5/20/24, volume_ratio20, green_run.

    rsi14: plain sums of 14 steps, 100 without a loss. atr14: mean of 14 true
    ranges in percent of the close. volume_ratio20: volume over the mean of the
    20 bars before, null if that is not positive. green_run: bars in a row that
    closed above their open, at most 8.
    """
    order = Window.partitionBy(key).orderBy(time)
    over = lambda first, last=0: span(key, time, first, last)
    high, low, close = F.col("high"), F.col("low"), F.col("close")
    base = bars.withColumns({"bar_no": F.row_number().over(order), "prev_close": F.lag("close").over(order), "_red": F.when(close <= F.col("open"), F.row_number().over(order))})
    base = base.withColumns({"step": close - F.col("prev_close"), "true_range": F.greatest(high - low, F.abs(high - F.col("prev_close")), F.abs(low - F.col("prev_close")))})
    up, down = F.when(F.col("step") >= 0, F.col("step")).otherwise(0.0), F.when(F.col("step") < 0, -F.col("step")).otherwise(0.0)
    gains, losses = half_up(F.sum(up).over(over(-13)), 9), half_up(F.sum(down).over(over(-13)), 9)
    before = F.avg("volume").over(over(-20, -1))
    out = {f"sma{n}": full(half_up(F.avg("close").over(over(1 - n)), 9), n) for n in (5, 20, 50, 200)}
    out["rsi14"] = full(half_up(F.when(losses == 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + F.try_divide(gains, losses))), 9), 15)
    out["atr14"] = full(half_up(F.when(close != 0, F.try_divide(F.avg("true_range").over(over(-13)), close) * 100.0), 9), 15)
    out |= {f"change{n}": half_up(change_of(close, F.lag("close", n).over(order)), 9) for n in (1, 4, 5, 20, 24)}
    out["volume_ratio20"] = full(half_up(F.when(before > 0, ratio(F.col("volume"), before)), 9), 21)
    out["green_run"] = F.least(F.lit(8), F.col("bar_no") - F.coalesce(F.last("_red", ignorenulls=True).over(over(Window.unboundedPreceding)), F.lit(0)))
    return base.withColumns(out).drop("_red")


#: Features whose percentile among the 252 values before is a feature too.
RANKED = {"atr14": "atr_rank252", "realized_vol20": "vol_rank252", "volume_ratio20": "volume_rank252", "sma_gap20": "gap_rank252"}
CLOSE_RANK, TAIL = "close_rank252", "return_q10_756"
#: Features that need the sorted rows before; computed only where named.
TRAILING = (*RANKED.values(), CLOSE_RANK, TAIL)


def with_features(ind: DataFrame, key: str = "asset", time: str = "date", per_year: int = 252, trailing: tuple[str, ...] = TRAILING) -> DataFrame:
    """Indicators with returns, gaps, volatilities, drawdown, z-score, and the named trailing ranks and quantile.

    History values are the rounded features of earlier bars, the current value is
    not rounded to 6 digits; one null among the 252 before makes a rank null. The
    quantile needs no least number of returns. Whether a rank is there is told for
    all of them, by counts.
    """
    order = Window.partitionBy(key).orderBy(time)
    over = lambda first, last=0: span(key, time, first, last)
    close = F.col("close")
    simple = F.try_divide(close, F.col("prev_close")) - 1.0
    one = ind.withColumns({f"return{n}": half_up(growth(close, F.lag("close", n).over(order)), 9) for n in (1, 5, 20)})
    one = one.withColumns({f"sma_gap{n}": F.when(F.col(f"sma{n}") != 0, half_up(growth(close, F.col(f"sma{n}")), 9)) for n in (5, 20, 50, 200)})
    one = one.withColumns({"_r": simple, "_d": F.least(simple, F.lit(0.0))})
    year = float(per_year) ** 0.5
    one = one.withColumns(
        {
            "realized_vol20": full(half_up(F.stddev_samp("_r").over(over(-19)) * year * 100.0, 9), 21),
            "downside_vol20": full(half_up(F.stddev_samp("_d").over(over(-19)) * year * 100.0, 9), 21),
            "drawdown63": full(half_up(growth(close, F.max("close").over(over(-62))), 9), 63),
        }
    ).drop("_r", "_d")
    before = over(-252, -1)
    old = lambda c: half_up(F.col(c), 6)
    mean, spread = F.avg(old("return1")).over(before), F.stddev_samp(old("return1")).over(before)
    more = {"return_z252": F.when((F.count("return1").over(before) == 252) & (spread > 0), half_up(F.try_divide(F.col("return1") - mean, spread), 6))}
    more |= {f"{name}_there": F.col(c).isNotNull() & (F.count(c).over(before) == 252) for c, name in RANKED.items()}
    more[f"{TAIL}_there"] = F.count("return1").over(over(-756, -1)) > 0
    wanted = [Rank(name, c, f"_old_{c}") for c, name in RANKED.items() if name in trailing]
    wanted += [Rank(CLOSE_RANK, "close", "close")] * (CLOSE_RANK in trailing) + [Quantiles((TAIL,), "_old_return1", (0.1,), 756)] * (TAIL in trailing)
    history = {c for c, name in (*RANKED.items(), ("return1", TAIL)) if name in trailing}
    two = one.withColumns(more).withColumns({f"_old_{c}": old(c) for c in sorted(history)})
    two = with_trailing(two, wanted, key, time, "bar_no").drop(*(f"_old_{c}" for c in history))
    two = two.withColumns({n: half_up(F.col(n), 8 if n == TAIL else 6) for n in trailing})
    rounded = ("return1", "return5", "return20", "sma_gap5", "sma_gap20", "sma_gap50", "sma_gap200", "realized_vol20", "downside_vol20", "drawdown63")
    return two.withColumns({c: half_up(F.col(c), 6) for c in rounded})


def with_labels(bars: DataFrame, key: str = "asset", time: str = "date") -> DataFrame:
    """bars with what follows: returns and worst lows in percent, range of the next bar; null near the end of a series."""
    order = Window.partitionBy(key).orderBy(time)
    close = F.col("close")
    ahead = lambda c, n: F.lead(c, n).over(order)
    high, low = ahead("high", 1), ahead("low", 1)
    out = {f"fwd_return{n}": half_up(growth(ahead("close", n), close), 6) for n in (1, 3, 5)}
    for n in (3, 5):
        worst = F.min("low").over(span(key, time, 1, n))
        out[f"fwd_drawdown{n}"] = F.when(ahead("close", n).isNotNull(), half_up(growth(worst, close), 6))
    out["next_range"] = half_up(F.try_divide(high - low, close) * 100.0, 6)
    out["next_true_range"] = half_up(F.try_divide(F.greatest(high - low, F.abs(high - close), F.abs(low - close)), close) * 100.0, 6)
    return bars.withColumns(out)


def with_events(rows: DataFrame) -> DataFrame:
    """Labels and features with 0/1 events: up, drop by 1, 2 and 3 percent, historical tail (where the features have its quantile), correction by one atr."""
    flag = lambda c: F.when(c.isNotNull(), c.cast("int"))
    out = {f"up{n}": flag(F.col(f"fwd_return{n}") > 0) for n in (1, 3, 5)}
    out |= {f"drop{n}": flag(F.col("fwd_return1") <= -n) for n in (1, 2, 3)}
    if TAIL in rows.columns:
        out["tail1"] = flag(F.col("fwd_return1") <= F.col(TAIL))
    out |= {f"correction{n}": flag(F.col(f"fwd_drawdown{n}") <= -F.col("atr14")) for n in (3, 5)}
    return rows.withColumns(out)


#: Features without which a panel row is left out, and bars that come before the first.
REQUIRED = ("return1", "return5", "return20", "sma_gap20", "sma_gap200", "rsi14", "atr14", "realized_vol20", "downside_vol20", "drawdown63", "volume_ratio20", "return_z252")
WARM_UP = 300


def panel(rows: DataFrame) -> DataFrame:
    """Rows after the warm-up that have all required features, ranks and the quantile included, and five bars ahead."""
    flags = [f"{n}_there" for n in (*RANKED.values(), TAIL)]
    held = rows.where(F.col("bar_no") > WARM_UP).dropna(subset=[*REQUIRED, "fwd_return5"])
    for flag in flags:
        held = held.where(flag)
    return held.drop(*flags)


def max_drawdown(bars: DataFrame, key: str = "asset", time: str = "date") -> DataFrame:
    """Worst fall from the running peak of the close in percent, at most 0."""
    peak = F.max("close").over(span(key, time, Window.unboundedPreceding, 0))
    return bars.select(key, (F.try_divide(F.col("close"), peak) - 1.0).alias("d"), peak.alias("p")).groupBy(key).agg(half_up(F.least(F.lit(0.0), F.min("d")) * 100.0, 6).alias("max_drawdown"))


def calendar_gap(bars: DataFrame, key: str = "asset", time: str = "date") -> DataFrame:
    """Longest gap between bars of a series in days."""
    gap = F.datediff(time, F.lag(time).over(Window.partitionBy(key).orderBy(time)))
    return bars.select(key, gap.alias("g")).groupBy(key).agg(F.coalesce(F.max("g"), F.lit(0)).cast("int").alias("max_gap"))
