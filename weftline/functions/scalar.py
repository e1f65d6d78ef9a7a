"""Scalar expressions: rounding, guards, classes and number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Class names of the condition score.
WIND = ("잔잔함", "보통", "강함", "돌풍")
DUST = ("좋음", "보통", "나쁨")
WEATHER = ("태풍경보", "소나기", "쾌청", "맑음", "구름 조금", "흐림")


def half_up(x: Column, digits: int = 0) -> Column:
    """Round half towards plus infinity: -2.5 to -2."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / scale


def once(x: Column, f) -> Column:
    """f(x) with x written once, so that plans don't grow with every use of it."""
    return F.element_at(F.transform(F.array(x), f), 1)


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    """x within bounds; NaN and infinities give the lower bound, null stays null."""
    return once(x, lambda v: F.when(v.isNull(), None).when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(low)).otherwise(F.least(F.lit(high), F.greatest(F.lit(low), v))))


def finite(x: Column) -> Column:
    """Null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def change_of(current: Column, previous: Column) -> Column:
    """(current - previous) / previous in percent; null for a missing or zero price on either side."""
    return F.when((current != 0) & (previous != 0), ratio(current - previous, previous) * 100.0)


def growth(current: Column, previous: Column) -> Column:
    """(current / previous - 1) in percent; 0 where previous is 0."""
    return F.when(previous == 0, F.lit(0.0)).otherwise((F.try_divide(current, previous) - 1.0) * 100.0)


def sigmoid(x: Column, bound: float = 30.0) -> Column:
    return 1.0 / (1.0 + F.exp(-F.least(F.lit(bound), F.greatest(F.lit(-bound), x))))


def logit(p: Column, edge: float = 1e-6) -> Column:
    held = F.least(F.lit(1 - edge), F.greatest(F.lit(edge), p))
    return F.ln(held / (1.0 - held))


def steps(x: Column, bounds: list[float], names: list[str], missing: str | None = None) -> Column:
    """names[k] for the first bound above x, the last name beyond; missing for null."""
    out = F.when(x.isNull(), F.lit(missing))
    for bound, name in zip(bounds, names, strict=False):
        out = out.when(x < bound, F.lit(name))
    return out.otherwise(F.lit(names[-1]))


def wind_class(atr: Column) -> Column:
    return steps(atr, [0.55, 1.25, 2.3], list(WIND), WIND[1])


def dust_class(volume_ratio: Column) -> Column:
    return steps(volume_ratio, [0.45, 0.85], [DUST[2], DUST[1], DUST[0]], DUST[1])


def weather_class(temperature: Column, rain: Column, wind: Column) -> Column:
    return (
        F.when((rain >= 78) | (wind == WIND[3]), WEATHER[0])
        .when((rain >= 62) | (wind == WIND[2]), WEATHER[1])
        .when(temperature >= 82, WEATHER[2])
        .when(temperature >= 66, WEATHER[3])
        .when(temperature >= 48, WEATHER[4])
        .otherwise(WEATHER[5])
    )


def weather_grade(percentile: Column) -> Column:
    """Grade of a trailing percentile: calm, normal, rough or storm."""
    return steps(percentile, [25.0, 75.0, 90.0], ["calm", "normal", "rough", "storm"])


def text_hash(text: Column) -> Column:
    """Absolute value of the 32-bit hash with multiplier 31 over the code points of a text of the basic plane."""
    wrap = lambda x: F.pmod(x + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)
    points = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("long"))
    return F.abs(F.aggregate(points, F.lit(0).cast("long"), lambda h, c: wrap(h * 31 + c)))


def price_text(x: Column) -> Column:
    """Price with thousands separators; digits by magnitude: none from 1000 on, two from 1 on, else four."""
    return F.when(x.isNull(), "-").when(F.abs(x) >= 1000, F.format_number(x, 0)).when(F.abs(x) >= 1, F.format_number(x, 2)).otherwise(F.format_number(x, 4))


def percent_text(x: Column) -> Column:
    """Signed percentage with two digits; a fixed text without a value."""
    value = half_up(x, 2)
    return F.when(x.isNull(), "확인 중").otherwise(F.concat(F.when(x >= 0, "+").otherwise(""), F.format_string("%.2f%%", value)))
