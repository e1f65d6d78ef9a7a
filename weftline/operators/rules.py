"""Rules of views: cards, sessions, news and freshness."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scalar import WEATHER, half_up

#: News categories and their patterns in the order in which they are tried; OTHER is everything else. Words end at ASCII characters, whatever the Java release.
NEWS_RULES = (
    ("가상자산", r"bitcoin|crypto|ethereum|blockchain|btc|eth-usd|btc-usd"),
    ("금리·연준", r"fed|federal reserve|interest rate|treasury|bond|yield|inflation|cpi|powell"),
    ("기술·AI", r"artificial intelligence|(?<![a-z0-9_])ai(?![a-z0-9_])|nvidia|semiconductor|chip|technology|nasdaq"),
    ("원자재", r"oil|gold|crude|commodity|opec|natural gas"),
    ("증시", r"s&p|dow|stock|equity|wall street|market"),
)
OTHER = "글로벌"
#: City, time zone, minutes of the day at which its market opens and closes.
CITIES = (("Seoul", "Asia/Seoul", 540, 930), ("Tokyo", "Asia/Tokyo", 540, 930), ("London", "Europe/London", 480, 990), ("New York", "America/New_York", 570, 960))


def news_category(title: Column, tickers: Column | None = None, rules: tuple = NEWS_RULES) -> Column:
    """The first rule whose pattern the lower-cased title and related tickers (an array) hold; OTHER without any, or without both."""
    parts = [F.coalesce(title, F.lit("")), F.array_join(F.coalesce(tickers, F.array().cast("array<string>")), " ")] if tickers is not None else [F.coalesce(title, F.lit(""))]
    text = F.lower(F.concat_ws(" ", *parts))
    out = F.lit(OTHER)
    for name, pattern in reversed(rules):
        out = F.when(_holds(text, pattern), name).otherwise(out)
    return out


def _holds(text: Column, pattern: str) -> Column:
    """Whether text holds the pattern; alternatives that are plain words are searched for as such, which is faster."""
    alternatives = pattern.split("|")
    plain = [a for a in alternatives if re.fullmatch(r"[\w &-]+", a)]
    rest = [a for a in alternatives if a not in plain]
    try:
        for a in rest:
            re.compile(a)
    except re.error:  # a group or class spans alternatives
        plain, rest = [], [pattern]
    found = [text.contains(a) for a in plain]
    return reduce(Column.__or__, [*found, *([text.rlike("|".join(rest))] if rest else [])])


def dedupe_latest(items: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last value at the place of the first (column place)."""
    w = Window.partitionBy(key)
    last = items.withColumns({"_n": F.row_number().over(w.orderBy(F.desc(order))), "place": F.min(order).over(w)})
    return last.where("_n = 1").drop("_n")


def top_news(items: DataFrame, key: str, order: str, time: str, limit: int = 16) -> DataFrame:
    """The latest items after removal of repeated keys; equal times in order of place."""
    return dedupe_latest(items, key, order).orderBy(F.desc(time), "place").limit(limit)


def radar(items: DataFrame, category: str, limit: int = 4) -> DataFrame:
    """The most frequent categories but OTHER, ties by name."""
    return items.where(F.col(category) != OTHER).groupBy(category).agg(F.count("*").alias("items")).orderBy(F.desc("items"), category).limit(limit)


def five_day_card(bars: DataFrame, key: str = "asset", time: str = "date") -> DataFrame:
    """Per series the last five bars: change from the sixth last close (else the first open), trend from +-0.5, up and down days from +-0.05, widest range over its low."""
    w = Window.partitionBy(key).orderBy(time)
    rows = bars.withColumns({"_n": F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time))), "_before": F.lag("close").over(w)}).where("_n <= 5")
    day = F.try_divide(F.col("close") - F.coalesce("_before", F.col("open")), F.coalesce("_before", F.col("open"))) * 100.0
    got = rows.withColumn("_c", half_up(day, 8)).groupBy(key).agg(
        F.count("*").alias("days"),
        F.max_by("close", time).alias("last"),
        F.min_by(F.coalesce("_before", F.col("open")), time).alias("base"),
        F.count_if(F.col("_c") > 0.05).alias("up_days"),
        F.count_if(F.col("_c") < -0.05).alias("down_days"),
        half_up(F.max(F.try_divide(F.col("high") - F.col("low"), F.col("low")) * 100.0), 6).alias("widest"),
    )
    change = half_up(F.try_divide(F.col("last") - F.col("base"), F.col("base")) * 100.0, 6)
    return got.withColumn("change", change).withColumn("trend", F.when(F.col("change") > 0.5, "up").when(F.col("change") < -0.5, "down").otherwise("flat"))


def day_icon(change: Column, width: Column) -> Column:
    """Weather class of a day by its change and its range, both in percent; null where either is."""
    fall = change < 0
    found = (
        F.when((change <= -2.4) | (fall & (width >= 4.5)), WEATHER[0])
        .when((change <= -1.1) | (fall & (width >= 3.0)), WEATHER[1])
        .when(change < -0.25, WEATHER[5])
        .when(change < 0.25, WEATHER[4])
        .when(change < 1.2, WEATHER[3])
        .otherwise(WEATHER[2])
    )
    return F.when(change.isNotNull() & width.isNotNull(), found)


def session_status(instants: DataFrame, utc: str, cities: tuple = CITIES) -> DataFrame:
    """instants with city and status, one row for each city: whether its market is open by local wall clock, weekend first, then before, open or after."""
    at = F.col(utc).cast("timestamp")

    def status(zone: str, opens: int, closes: int) -> Column:
        local = F.from_utc_timestamp(at, zone)
        minute = F.hour(local) * 60 + F.minute(local)
        return F.when(F.dayofweek(local).isin(1, 7), "weekend").when(minute < opens, "before").when(minute < closes, "open").otherwise("after")

    each = F.array(*(F.struct(F.lit(c).alias("city"), status(*rest).alias("status")) for c, *rest in cities))
    return instants.select("*", F.inline(each))


def freshness(age_days: Column, us: Column) -> Column:
    return F.when(age_days <= F.when(us, 4).otherwise(1), "fresh").otherwise("old")


def rank_label(percentile: Column) -> Column:
    """Where a forecast stands among its past; from 90 on with the share in percent that is as high, at least 1."""
    share = F.greatest(F.lit(1), F.ceil(100.0 - percentile)).cast("string")
    return F.when(percentile >= 90, F.concat(F.lit("top "), share, F.lit("%"))).when(percentile >= 75, "high").when(percentile < 25, "low").otherwise("usual")


def score_label(score: Column) -> Column:
    """Strength of a part score."""
    return F.when(score >= 68, "strong").when(score >= 56, "firm").when(score >= 44, "even").when(score >= 32, "weak").otherwise("poor")


def direction(score: Column) -> Column:
    """Where a part score points: up from 58, down to 42."""
    return F.when(score >= 58, "up").when(score <= 42, "down").otherwise("flat")


#: Headlines of the market by least temperature.
HEADLINES = (
    (64, "위험선호가 우세하지만 과열 신호를 함께 확인할 구간"),
    (54, "완만한 위험선호 속에서 종목별 차별화가 이어지는 구간"),
    (44, "뚜렷한 방향보다 확인이 필요한 중립 구간"),
    (34, "방어적 흐름이 우세해 추격보다 위험 관리가 필요한 구간"),
)
LOWEST_HEADLINE = "시장 전반의 경계 신호가 강해진 방어 우선 구간"


def headline(temperature: Column) -> Column:
    """Headline of a market's temperature; null without one."""
    out = F.when(temperature.isNull(), F.lit(None).cast("string"))
    for least, text in HEADLINES:
        out = out.when(temperature >= least, text)
    return out.otherwise(LOWEST_HEADLINE)


def ago(minutes: Column) -> Column:
    """Relative time: now, minutes, hours or days."""
    m = minutes.cast("long")
    return F.when(m < 1, "now").when(m < 60, F.concat(m.cast("string"), F.lit(" min"))).when(m < 1440, F.concat(F.floor(m / 60).cast("string"), F.lit(" h"))).otherwise(F.concat(F.floor(m / 1440).cast("string"), F.lit(" d")))


def band(predicted: Column, high80: Column) -> Column:
    """Upper end of a range band."""
    return F.greatest(high80 * 1.12, predicted * 1.25, F.lit(0.1))


def sparkline(bars: DataFrame, points: int = 48, key: str = "asset", time: str = "date") -> DataFrame:
    """The last closes of each series scaled to 0..1 by their extremes; a flat line is 0."""
    rows = bars.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(time)))).where(F.col("_n") <= points)
    w = Window.partitionBy(key)
    low, high = F.min("close").over(w), F.max("close").over(w)
    return rows.select(key, time, half_up(F.try_divide(F.col("close") - low, F.when(high > low, high - low).otherwise(1.0)), 6).alias("y"))


def situation_texts(sp: Column, nasdaq: Column, vix: Column, dollar: Column) -> dict[str, Column]:
    """Texts of the US market (mean change of both indices), the dollar's change and the volatility level; nulls are being checked."""
    mean = (sp + nasdaq) / 2.0
    # Texts and bounds
    return {
        "us_text": F.when(mean.isNull(), "미국 증시 확인 중").when(mean > 0.35, "미국 증시 강세").when(mean < -0.35, "미국 증시 약세").otherwise("미국 증시 혼조"),
        "dollar_text": F.when(dollar.isNull(), "달러 흐름 확인 중").when(dollar > 0.25, "달러 강세").when(dollar < -0.25, "달러 약세").otherwise("달러 보합"),
        "volatility_text": F.when(vix.isNull(), "변동성 확인 중").when(vix >= 25, "변동성 경계").when(vix >= 18, "변동성 주의").otherwise("변동성 안정"),
    }


#: Tone and market of symbols by exact name, ending or part, the first that fits; the US for others.
MARKETS = (
    ("kr", "한국 시장", ("^KS11",), (".KS", ".KQ"), ()),
    ("jp", "일본 시장", ("^N225",), (".T",), ()),
    ("gb", "영국 시장", ("^FTSE",), (".L",), ()),
    ("hk", "홍콩 시장", ("^HSI",), (".HK",), ()),
    ("eu", "유럽 시장", (), (".DE",), ("STOXX", "GDAXI")),
)
US_MARKET, COIN_MARKET = ("us", "미국 시장"), "24시간 코인 시장"
COINS = ("BTC", "ETH", "SOL")


def station(symbol: Column, kind: Column) -> Column:
    """Struct of tone and market of a symbol; coins by their first letters, other coins are crypto; a null symbol of no coin is null."""
    s = F.upper(symbol)
    tone, market = F.lit(US_MARKET[0]), F.lit(US_MARKET[1])
    for name, text, exact, endings, parts in reversed(MARKETS):
        fits = s.isin(*exact) if exact else F.lit(False)
        for e in endings:
            fits = fits | s.endswith(e)
        for p in parts:
            fits = fits | s.contains(p)
        tone, market = F.when(fits, name).otherwise(tone), F.when(fits, text).otherwise(market)
    coin = F.lit("crypto")
    for c in reversed(COINS):
        coin = F.when(s.startswith(c), c.lower()).otherwise(coin)
    is_coin = F.coalesce(kind == "crypto", F.lit(False))
    found = F.struct(F.when(is_coin, coin).otherwise(tone).alias("tone"), F.when(is_coin, F.lit(COIN_MARKET)).otherwise(market).alias("market"))
    return F.when(is_coin | s.isNotNull(), found)


def time_bucket(day: Column, train_end: str, validation_start: str, validation_end: str, test_start: str) -> Column:
    """train, validation or sealed-test; a date in none of them, or null, is an error."""
    d = F.coalesce(day.cast("string"), F.lit("null"))
    return (
        F.when(day <= F.lit(train_end).cast("date"), "train")
        .when((day >= F.lit(validation_start).cast("date")) & (day <= F.lit(validation_end).cast("date")), "validation")
        .when(day >= F.lit(test_start).cast("date"), "sealed-test")
        .otherwise(F.raise_error(F.concat(F.lit("outside of the split: "), d)))
    )


def symbol_kind(quote_type: Column) -> Column:
    return F.when(quote_type == "INDEX", "index").otherwise("stock")


def symbol_description(exchange_name: Column, exchange: Column, type_name: Column, quote_type: Column) -> Column:
    """Exchange and type, each the first of its two names that is not empty."""
    first = lambda *c: F.coalesce(*(F.nullif(x, F.lit("")) for x in c))
    return F.concat(first(exchange_name, exchange, F.lit("US Market")), F.lit(" "), first(type_name, quote_type, F.lit("Equity")), F.lit(" 관측소"))


def aliased(rows: DataFrame, aliases: DataFrame, key: str) -> DataFrame:
    """rows whose key is replaced by its alias (columns key and alias), where it has one."""
    return rows.join(aliases.select(F.col(key), "alias"), key, "left").withColumn(key, F.coalesce("alias", key)).drop("alias")


def quotes(data: DataFrame, scores: DataFrame, key: str = "asset") -> DataFrame:
    """Price and day change of scores with live or error as status of data; only keys that both have."""
    return data.select(key, F.when(F.col("status") == "live", "live").otherwise("error").alias("status")).join(scores.select(key, "price", "day_change"), key)


def pulse(bars: DataFrame, days: int = 6, key: str = "asset", time: str = "date") -> DataFrame:
    """Changes in percent over the last days of each series with height, their share of the greatest move (of 0.5 at least), and total, the change over all of them."""
    last = Window.partitionBy(key).orderBy(F.desc(time))
    held = bars.withColumn("_n", F.row_number().over(last)).where(F.col("_n") <= days)
    series = Window.partitionBy(key).orderBy(time)
    change = F.try_divide(F.col("close") - F.lag("close").over(series), F.lag("close").over(series)) * 100.0
    all_days = Window.partitionBy(key)
    first, final = F.min_by("close", time).over(all_days), F.max_by("close", time).over(all_days)
    held = held.withColumns({"change": half_up(change, 6), "total": half_up(F.try_divide(final - first, first) * 100.0, 6)}).where("change is not null")
    most = F.greatest(F.lit(0.5), F.max(F.abs(F.col("change"))).over(all_days))
    return held.select(key, time, "change", half_up(F.abs(F.col("change")) / most, 6).alias("height"), "total")
