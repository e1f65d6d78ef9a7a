"""The condition score of a bar and of a weighted basket, alerts, briefing and checklist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.scalar import WEATHER, WIND, clamp, dust_class, half_up, weather_class, wind_class

#: Weights of the parts, and of the members of the market basket.
PARTS = {"trend": 0.35, "momentum": 0.2, "volatility": 0.2, "activity": 0.15}
BASKET = {"SP500": 0.35, "NASDAQ": 0.30, "VIX": 0.20, "BTCUSDT": 0.15}
FIRST_BAR = 30


def _above(x: Column, bound: float) -> Column:
    return F.greatest(F.lit(0.0), x - bound)


def with_score(ind: DataFrame, target_atr: float = 1.5, quiet_activity: float = 55.0) -> DataFrame:
    """Indicators with trend, momentum, volatility and activity scores, temperature, rain, ultraviolet, classes and confidence; from bar 30 on.

    target_atr is 1.5, or 3.2 for crypto; quiet_activity is the activity without
    a volume ratio: 62 for an index, else 55.
    """
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    short, day, week, month = zero("change4"), zero("change24"), zero("change5"), zero("change20")
    rsi, atr, volume = F.col("rsi14"), F.col("atr14"), F.col("volume_ratio20")
    gap = F.when((F.col("sma5") != 0) & (F.col("sma20") != 0), F.try_divide(F.col("sma5") - F.col("sma20"), F.col("sma20")) * 100.0).otherwise(0.0)
    rows = ind.where(F.col("bar_no") >= FIRST_BAR).withColumns(
        {
            "trend": half_up(clamp(50.0 + week * 3.8 + month * 1.15 + gap * 2.8 + day * 0.9), 8),
            "momentum": half_up(F.when(rsi.isNull(), clamp(50.0 + day * 4.0)).otherwise(clamp(50.0 + (rsi - 50.0) * 1.35 + day * 2.5)), 8),
            "volatility": half_up(clamp(78.0 - _above(F.coalesce(atr, F.lit(target_atr)), target_atr) * 17.0 - _above(F.coalesce(atr, F.lit(0.75)), 0.8) * 12.0), 8),
            "activity": half_up(F.when(volume.isNull(), F.lit(quiet_activity)).otherwise(clamp(52.0 + F.log2(F.greatest(F.lit(0.08), volume)) * 24.0)), 8),
            "conflict": (F.signum(day) * F.signum(week)) < 0,
        }
    )
    heat = F.when(rsi > 72, (rsi - 72.0) * 0.7).otherwise(0.0) + _above(short, 1.2) * 2.0 + _above(F.col("green_run").cast("double"), 4.0) * 1.2
    risk = _above(F.coalesce(atr, F.lit(0.0)), target_atr * 1.5) * 3.0 + F.when(F.col("conflict"), 5.0).otherwise(0.0)
    rows = rows.withColumns({f"part_{k}": half_up((F.col(k) - 50.0) * w, 1) for k, w in PARTS.items()} | {"part_risk": half_up(-half_up((heat + risk) * 0.45, 8), 1)})
    total = F.lit(0.0)
    for k in (*PARTS, "risk"):
        total = total + F.col(f"part_{k}")
    rain = 22.0 + _above(-F.col("volatility"), -55.0) * 0.65 + _above(F.abs(short), 0.6) * 7.0 + F.when(F.col("conflict"), 15.0).otherwise(0.0) + F.when(F.col("activity") < 38, 10.0).otherwise(0.0) + F.when((rsi > 76) | (rsi < 28), 10.0).otherwise(0.0)
    light = 15.0 + _above(F.coalesce(rsi, F.lit(50.0)), 58.0) * 2.0 + _above(short, 0.0) * 10.0 + F.col("green_run") * 4.0
    rows = rows.withColumns(
        {
            "temperature": half_up(clamp(50.0 + half_up(total, 6))),
            "rain": half_up(half_up(clamp(rain), 6)),
            "ultraviolet": half_up(half_up(clamp(light), 6)),
            "wind": wind_class(atr),
            "dust": dust_class(volume),
        }
    )
    confidence = clamp(55.0 + F.when(F.col("bar_no") >= 60, 15.0).otherwise(0.0) + F.when(F.col("bar_no") >= 20, 25.0).otherwise(0.0) + F.when(F.col("prev_close").isNotNull(), 5.0).otherwise(0.0))
    return rows.withColumns({"weather": weather_class(F.col("temperature"), F.col("rain"), F.col("wind")), "confidence": confidence}).withColumns({k: half_up(F.col(k)) for k in PARTS})


def basket(scores: DataFrame, key: str, weights: dict[str, float] | None = None, fear: str = "VIX") -> DataFrame:
    """Weighted score of the members that are there, weights shared anew among them; one row for each value of key.

    scores: symbol, temperature, rain, ultraviolet, atr14, volume_ratio20, close.
    The fear index counts by its level: comfort 100 - 4.2 and rain 15 + 5 for each
    point above 12. A missing atr or volume ratio counts 0.8.
    """
    weights = weights or BASKET
    weight = F.element_at(F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)), F.col("symbol"))
    level = F.greatest(F.lit(0.0), F.col("close") - 12.0)
    is_fear = F.col("symbol") == fear
    rows = scores.where(F.col("symbol").isin(*weights)).withColumns(
        {
            "_w": weight,
            "_t": F.when(is_fear, F.coalesce(clamp(100.0 - level * 4.2), F.lit(50.0))).otherwise(F.col("temperature")),
            "_r": F.when(is_fear, F.coalesce(clamp(15.0 + level * 5.0), F.lit(50.0))).otherwise(F.col("rain")),
        }
    )
    mean = lambda c: half_up(F.try_divide(F.sum(c * F.col("_w")), F.sum("_w")), 6)
    out = rows.groupBy(key).agg(
        F.count("*").alias("members"),
        mean(F.col("_t")).alias("t"),
        mean(F.col("_r")).alias("r"),
        mean(F.col("ultraviolet")).alias("u"),
        mean(F.coalesce("atr14", F.lit(0.8))).alias("atr"),
        mean(F.coalesce("volume_ratio20", F.lit(0.8))).alias("volume"),
    )
    out = out.withColumns({"temperature": half_up(F.col("t")), "rain": half_up(F.col("r")), "ultraviolet": half_up(F.col("u")), "wind": wind_class(F.col("atr")), "dust": dust_class(F.col("volume"))})
    return out.withColumn("weather", weather_class(F.col("temperature"), F.col("rain"), F.col("wind"))).drop("t", "r", "u")


#: Levels of alerts from mild to severe, and the symbol of an alert for all.
LEVELS = ("안내", "한숨", "주의보", "경보")
EVERY = "전체"


def alerts(scores: DataFrame, key: str = "asset", run: str = "date", status: str | None = None) -> DataFrame:
    """key, run, kind, level: one row for each alert of a scored symbol in a run of scores (a date).

    Sample data (``status`` says mock), rain from 70, strong wind and gusts,
    ultraviolet from 72, temperature below 35. A run in which no symbol raises
    anything has one row ``calm`` for all symbols; without scores there is none.
    """
    row = lambda when, kind, level: F.when(when, F.struct(F.lit(kind).alias("kind"), level.alias("level")))
    info, sigh, watch, warning = map(F.lit, LEVELS)
    found = F.array_compact(
        F.array(
            row(F.col(status) == "mock" if status else F.lit(False), "mock", info),
            row(F.col("rain") >= 70, "rain", watch),
            row(F.col("wind").isin(WIND[2], WIND[3]), "wind", F.when(F.col("wind") == WIND[3], warning).otherwise(watch)),
            row(F.col("ultraviolet") >= 72, "ultraviolet", watch),
            row(F.col("temperature") < 35, "cold", sigh),
        )
    )
    rows = scores.select(key, run, found.alias("a"))
    calm = rows.groupBy(run).agg(F.sum(F.size("a")).alias("n")).where("n = 0").select(F.lit(EVERY).alias(key), run, F.lit("calm").alias("kind"), info.alias("level"))
    return rows.select(key, run, F.inline("a")).unionByName(calm)


def briefing(equity: Column, fear: Column, crypto: Column, temperature: Column) -> dict[str, Column]:
    """Tones of a market briefing: equities by a mean change beyond 0.35 either way, crypto beyond 1, fear from 25 and below 18, overall from 56 and below 40; neutral without a value."""
    tone = lambda good, bad: F.when(good, "positive").when(bad, "caution").otherwise("neutral")
    return {
        "equity_tone": tone(equity > 0.35, equity < -0.35),
        "fear_tone": tone(fear < 18, fear >= 25),
        "crypto_tone": tone(crypto > 1, crypto < -1),
        "overall_tone": tone(temperature >= 56, temperature < 40),
    }


def checklist(inputs: DataFrame) -> DataFrame:
    """Judges planned trades (direction, entry, stop, target, leverage, size as texts; temperature, rain, ultraviolet, wind, weather).

    A number that is missing, not finite or not positive is none; leverage is
    then 1. Without entry, stop or target nothing is calculated, the plan is not
    valid and its tone is ``danger``, as it is with a stop or target on the wrong
    side or from five warnings; ``caution`` from two, else ``calm``. Amounts need
    a size and are rounded to 2 digits.
    """

    def number(c: str) -> Column:
        x = F.col(c).try_cast("double")
        return F.when((x > 0) & ~F.isnan(x) & (x < float("inf")), x)

    rows = inputs.withColumns({f"_{c}": number(c) for c in ("entry", "stop", "target", "leverage", "size")})
    long = F.col("direction") == "long"
    planned = F.col("_entry").isNotNull() & F.col("_stop").isNotNull() & F.col("_target").isNotNull()
    rows = rows.withColumns(
        {
            "_planned": planned,
            "_stop_good": F.when(long, F.col("_stop") < F.col("_entry")).otherwise(F.col("_stop") > F.col("_entry")),
            "_target_good": F.when(long, F.col("_target") > F.col("_entry")).otherwise(F.col("_target") < F.col("_entry")),
            "_risk": F.abs(F.col("_entry") - F.col("_stop")),
            "_reward": F.abs(F.col("_target") - F.col("_entry")),
            "_lev": F.coalesce("_leverage", F.lit(1.0)),
        }
    )
    rows = rows.withColumns({"_ratio": half_up(F.try_divide("_reward", "_risk"), 9), "_loss": F.try_divide("_risk", "_entry"), "_profit": F.try_divide("_reward", "_entry")})
    rows = rows.withColumn("_apart", half_up(F.col("_loss") * 100.0, 9))
    warn = lambda when, name: F.when(when, F.lit(name))
    missing = [warn(F.col(f"_{c}").isNull(), f"no {c}") for c in ("entry", "stop", "target")]
    judged = [
        warn(~F.col("_stop_good"), "stop on the wrong side"),
        warn(~F.col("_target_good"), "target on the wrong side"),
        warn(F.col("_ratio") < 1.5, "reward below 1.5 risks"),
        warn(F.col("_lev") >= 5, "leverage from 5"),
        warn(F.col("_lev") >= 10, "leverage from 10"),
        warn((F.col("_lev") > 1) & (F.col("_apart") > 100.0 / F.col("_lev") * 0.65), "stop near liquidation"),
        warn(F.col("weather") == WEATHER[0], "storm"),
        warn(F.col("rain") >= 60, "rain"),
        warn(F.col("ultraviolet") >= 70, "ultraviolet"),
        warn(F.col("wind").isin(WIND[2], WIND[3]), "wind"),
    ]
    good = F.col("_planned") & F.col("_stop_good") & F.col("_target_good")
    amount = lambda x: F.when(F.col("_planned") & F.col("_size").isNotNull(), half_up(x, 2))
    return (
        rows.withColumns(
            {
                "valid": F.coalesce(good, F.lit(False)),
                "reward_risk": F.when(F.col("_planned"), half_up(F.col("_ratio"), 2)),
                "expected_profit": amount(F.col("_size") * F.col("_profit")),
                "expected_loss": amount(F.col("_size") * F.col("_loss")),
                "leveraged_profit": amount(F.col("_size") * F.col("_profit") * F.col("_lev")),
                "leveraged_loss": amount(F.col("_size") * F.col("_loss") * F.col("_lev")),
                "warnings": F.when(F.col("_planned"), F.array_compact(F.array(*judged))).otherwise(F.array_compact(F.array(*missing))),
            }
        )
        .withColumn("tone", F.when(~F.col("valid") | (F.size("warnings") >= 5), "danger").when(F.size("warnings") >= 2, "caution").otherwise("calm"))
        .drop("_entry", "_stop", "_target", "_leverage", "_size", "_planned", "_stop_good", "_target_good", "_risk", "_reward", "_lev", "_ratio", "_loss", "_profit", "_apart")
    )
