"""Queries over price series: bars, indicators, scores, features, labels, joins and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.scalar import half_up
from weftline.operators import indicators, joins, rules, score
from weftline.plans.reference_sql import chain, growth
from weftline.plans.reference_sql import half_up as h
from weftline.sources import bars as source

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def indicator_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.with_indicators(source.daily_bars(spark, sf_dir))


def feature_rows(spark: SparkSession, sf_dir: str, *trailing: str) -> DataFrame:
    """Features, and the trailing ranks and quantile that are named."""
    return indicators.with_features(indicator_rows(spark, sf_dir), trailing=trailing)


def score_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.with_score(indicator_rows(spark, sf_dir))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored bars with labels that have five bars ahead."""
    return score.with_score(indicators.with_labels(indicator_rows(spark, sf_dir))).where("fwd_return5 is not null")


def panel_rows(spark: SparkSession, sf_dir: str, *trailing: str) -> DataFrame:
    """Panel of features, the named trailing ones too, events and the score."""
    rows = indicators.with_events(indicators.with_labels(feature_rows(spark, sf_dir, *trailing)))
    return indicators.panel(score.with_score(rows))


BAR = "asset, date, open, high, low, close, volume"


@query("bars_daily", chain("bars") + f"SELECT {BAR} FROM bars")
def bars_daily(spark, sf_dir):
    return source.daily_bars(spark, sf_dir)


@query("bars_hourly", chain("hourly") + "SELECT asset, hour, open, high, low, close, volume FROM hourly")
def bars_hourly(spark, sf_dir):
    return source.hourly_bars(spark, sf_dir)


@query("bars_market", chain("market") + "SELECT date, open, high, low, close, volume FROM market")
def bars_market(spark, sf_dir):
    return source.market_bars(spark, sf_dir)


@query(
    "candles_valid",
    "WITH c AS (SELECT o_orderpriority AS asset, CAST(o_orderdate AS DATE) AS date, o_totalprice AS open, o_totalprice AS high, o_totalprice AS low, o_totalprice AS close, 1e0 AS volume, o_orderkey FROM orders),"
    "d AS (SELECT *, row_number() OVER (PARTITION BY asset, date ORDER BY o_orderkey DESC) AS n FROM c WHERE close > 0 AND isfinite(close)),"
    "e AS (SELECT *, count(*) OVER (PARTITION BY asset) AS k FROM d WHERE n = 1) SELECT asset, date, close, o_orderkey FROM e WHERE k >= 100",
)
def candles_valid(spark, sf_dir):
    o = source.read(spark, sf_dir, "orders")
    price = F.col("o_totalprice")
    rows = o.select(F.col("o_orderpriority").alias("asset"), F.to_date("o_orderdate").alias("date"), *(price.alias(c) for c in ("open", "high", "low", "close")), F.lit(1.0).alias("volume"), "o_orderkey")
    return source.valid_candles(rows, "o_orderkey").select("asset", "date", "close", "o_orderkey")


@query("recent_bars", chain("hourly") + "SELECT asset, hour, close FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY hour DESC) AS n FROM hourly) WHERE n <= 96")
def recent_bars(spark, sf_dir):
    return source.recent(source.hourly_bars(spark, sf_dir), 96, time="hour").select("asset", "hour", "close")


def _indicator(name: str, columns: str) -> None:
    @query(name, chain("ind") + f"SELECT asset, date, {columns} FROM ind")
    def run(spark, sf_dir):
        return indicator_rows(spark, sf_dir).select("asset", "date", *columns.split(", "))


_indicator("ind_sma", "sma5, sma20, sma50, sma200")
_indicator("ind_rsi14", "rsi14")
_indicator("ind_atr14", "true_range, atr14")
_indicator("ind_change", "change1, change4, change5, change20, change24")
_indicator("ind_volume_ratio", "volume_ratio20")
_indicator("ind_green_run", "green_run")

SCORES = "temperature, rain, ultraviolet, wind, dust, weather, trend, momentum, volatility, activity, confidence"


@query("score_replay", chain("score") + f"SELECT asset, date, {SCORES} FROM score")
def score_replay(spark, sf_dir):
    return score_rows(spark, sf_dir).select("asset", "date", *SCORES.split(", "))


@query("score_latest", chain("score") + f"SELECT asset, date, close, {SCORES} FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date DESC) AS n FROM score) WHERE n = 1")
def score_latest(spark, sf_dir):
    return source.recent(score_rows(spark, sf_dir), 1).select("asset", "date", "close", *SCORES.split(", "))


@query("weather_class_counts", chain("score") + "SELECT asset, weather, count(*) AS days FROM score GROUP BY asset, weather")
def weather_class_counts(spark, sf_dir):
    return score_rows(spark, sf_dir).groupBy("asset", "weather").agg(F.count("*").alias("days"))


MEMBERS = {"AF": "SP500", "NO": "NASDAQ", "RF": "VIX", "NF": "BTCUSDT"}
_MEMBER = "CASE asset WHEN 'AF' THEN 'SP500' WHEN 'NO' THEN 'NASDAQ' WHEN 'RF' THEN 'VIX' WHEN 'NF' THEN 'BTCUSDT' END"


@query(
    "basket_score",
    chain(
        "score",
        more={
            "m": f"SELECT *, {_MEMBER} AS symbol FROM score",
            "w": "SELECT *, CASE symbol WHEN 'SP500' THEN 0.35e0 WHEN 'NASDAQ' THEN 0.30e0 WHEN 'VIX' THEN 0.20e0 ELSE 0.15e0 END AS w FROM m WHERE symbol IS NOT NULL",
            "t": "SELECT *, CASE WHEN symbol = 'VIX' THEN least(100e0, greatest(0e0, 100.0 - greatest(0e0, close - 12.0) * 4.2)) ELSE temperature END AS t, CASE WHEN symbol = 'VIX' THEN least(100e0, greatest(0e0, 15.0 + greatest(0e0, close - 12.0) * 5.0)) ELSE rain END AS r FROM w",
            "a": f"SELECT date, count(*) AS members, {h(h('sum(t * w) / sum(w)', 6))} AS temperature, {h(h('sum(r * w) / sum(w)', 6))} AS rain, {h(h('sum(ultraviolet * w) / sum(w)', 6))} AS ultraviolet, {h('sum(coalesce(atr14, 0.8) * w) / sum(w)', 6)} AS atr, {h('sum(coalesce(volume_ratio20, 0.8) * w) / sum(w)', 6)} AS volume FROM t GROUP BY date",
        },
    )
    + "SELECT date, members, temperature, rain, ultraviolet, atr, volume FROM a",
)
def basket_score(spark, sf_dir):
    symbol = F.element_at(F.create_map(*(F.lit(x) for kv in MEMBERS.items() for x in kv)), F.col("asset"))
    rows = score_rows(spark, sf_dir).where(F.col("asset").isin(*MEMBERS)).withColumn("symbol", symbol)
    return score.basket(rows, "date").select("date", "members", "temperature", "rain", "ultraviolet", "atr", "volume")


@query(
    "alerts",
    chain(
        "score",
        more={
            "a": "SELECT asset, date, unnest(list_filter([CASE WHEN rain >= 70 THEN 'rain/주의보' END, CASE WHEN wind = '돌풍' THEN 'wind/경보' WHEN wind = '강함' THEN 'wind/주의보' END, CASE WHEN ultraviolet >= 72 THEN 'ultraviolet/주의보' END, CASE WHEN temperature < 35 THEN 'cold/한숨' END], lambda x: x IS NOT NULL)) AS a FROM score",
            "b": "SELECT asset, date, a FROM a UNION ALL SELECT DISTINCT '전체', date, 'calm/안내' FROM score WHERE date NOT IN (SELECT date FROM a)",
        },
    )
    + "SELECT asset, date, split_part(a, '/', 1) AS kind, split_part(a, '/', 2) AS level FROM b",
)
def alerts(spark, sf_dir):
    return score.alerts(score_rows(spark, sf_dir))


@query(
    "market_briefing",
    chain(
        "score",
        more={
            "d": f"SELECT date, max(CASE WHEN asset = 'AF' THEN change1 END) AS sp, max(CASE WHEN asset = 'NO' THEN change1 END) AS nq, max(CASE WHEN asset = 'RF' THEN close END) AS vix, max(CASE WHEN asset = 'NF' THEN change1 END) AS btc, {h('avg(temperature)')} AS temperature FROM score GROUP BY date",
            "e": f"SELECT *, {h('(sp + nq) / 2.0', 9)} AS eq FROM d",
        },
    )
    + "SELECT date, CASE WHEN eq > 0.35 THEN 'positive' WHEN eq < -0.35 THEN 'caution' ELSE 'neutral' END AS equity_tone, CASE WHEN vix >= 25 THEN 'caution' WHEN vix < 18 THEN 'positive' ELSE 'neutral' END AS fear_tone, CASE WHEN btc > 1 THEN 'positive' WHEN btc < -1 THEN 'caution' ELSE 'neutral' END AS crypto_tone, CASE WHEN temperature >= 56 THEN 'positive' WHEN temperature < 40 THEN 'caution' ELSE 'neutral' END AS overall_tone FROM e",
)
def market_briefing(spark, sf_dir):
    of = lambda asset, c: F.max(F.when(F.col("asset") == asset, F.col(c)))
    days = score_rows(spark, sf_dir).groupBy("date").agg(of("AF", "change1").alias("sp"), of("NO", "change1").alias("nq"), of("RF", "close").alias("vix"), of("NF", "change1").alias("btc"), half_up(F.avg("temperature")).alias("temperature"))
    tones = score.briefing(half_up((F.col("sp") + F.col("nq")) / 2.0, 9), F.col("vix"), F.col("btc"), F.col("temperature"))
    return days.select("date", *(c.alias(n) for n, c in tones.items()))


@query(
    "checklist",
    chain(
        "score",
        more={
            "i": "SELECT asset, date, CASE WHEN change5 >= 0 THEN 'long' ELSE 'short' END AS direction, close AS e, CASE WHEN volume <> 3 THEN low * 0.98e0 END AS s, high * 1.03e0 AS t, CASE WHEN atr14 > 40 THEN 12e0 WHEN atr14 > 20 THEN 1e0 ELSE 6e0 END AS l, rain, ultraviolet, wind, weather FROM score",
            "k": f"SELECT *, CASE WHEN direction = 'long' THEN s < e ELSE s > e END AS sg, CASE WHEN direction = 'long' THEN t > e ELSE t < e END AS tg, CASE WHEN abs(e - s) <> 0 THEN {h('abs(t - e) / abs(e - s)', 9)} END AS ratio, {h('abs(e - s) / e * 100.0', 9)} AS apart FROM i",
            "w": "SELECT *, CASE WHEN s IS NULL THEN ['no stop'] ELSE list_filter([CASE WHEN NOT sg THEN 'stop on the wrong side' END, CASE WHEN NOT tg THEN 'target on the wrong side' END, CASE WHEN ratio < 1.5 THEN 'reward below 1.5 risks' END, CASE WHEN l >= 5 THEN 'leverage from 5' END, CASE WHEN l >= 10 THEN 'leverage from 10' END, CASE WHEN l > 1 AND apart > 100.0 / l * 0.65 THEN 'stop near liquidation' END, CASE WHEN weather = '태풍경보' THEN 'storm' END, CASE WHEN rain >= 60 THEN 'rain' END, CASE WHEN ultraviolet >= 70 THEN 'ultraviolet' END, CASE WHEN wind IN ('강함', '돌풍') THEN 'wind' END], lambda x: x IS NOT NULL) END AS ws FROM k",
        },
    )
    + f"SELECT asset, date, direction, s IS NOT NULL AND sg AND tg AS valid, CASE WHEN s IS NOT NULL THEN {h('ratio', 2)} END AS reward_risk, CASE WHEN s IS NOT NULL THEN {h('1000e0 * (abs(e - s) / e)', 2)} END AS expected_loss, array_to_string(ws, ';') AS warnings, CASE WHEN s IS NULL OR NOT sg OR NOT tg OR len(ws) >= 5 THEN 'danger' WHEN len(ws) >= 2 THEN 'caution' ELSE 'calm' END AS tone FROM w",
)
def checklist(spark, sf_dir):
    """Every scored bar as a plan in the direction of its week; some plans lack a stop."""
    text = lambda c: c.cast("string")
    rows = score_rows(spark, sf_dir).select(
        "asset", "date", F.when(F.col("change5") >= 0, "long").otherwise("short").alias("direction"), text(F.col("close")).alias("entry"), text(F.when(F.col("volume") != 3, F.col("low") * 0.98)).alias("stop"), text(F.col("high") * 1.03).alias("target"),
        F.when(F.col("atr14") > 40, "12").when(F.col("atr14") > 20, "broken").otherwise("6").alias("leverage"), F.lit("1000").alias("size"), "rain", "ultraviolet", "wind", "weather",
    )
    return score.checklist(rows).select("asset", "date", "direction", "valid", "reward_risk", "expected_loss", F.array_join("warnings", ";").alias("warnings"), "tone")


@query(
    "five_day_card",
    chain(
        "bars",
        more={
            "r": "SELECT *, lag(close) OVER (PARTITION BY asset ORDER BY date) AS b, row_number() OVER (PARTITION BY asset ORDER BY date DESC) AS n FROM bars",
            "s": f"SELECT *, coalesce(b, open) AS base, {h('(close - coalesce(b, open)) / coalesce(b, open) * 100.0', 8)} AS c FROM r WHERE n <= 5",
            "g": f"SELECT asset, count(*) AS days, arg_max(close, date) AS last, arg_min(base, date) AS base, count_if(c > 0.05) AS up_days, count_if(c < -0.05) AS down_days, {h('max((high - low) / low * 100.0)', 6)} AS widest FROM s GROUP BY asset",
            "c": f"SELECT *, {h('(last - base) / base * 100.0', 6)} AS change FROM g",
        },
    )
    + "SELECT asset, days, CAST(up_days AS BIGINT) AS up_days, CAST(down_days AS BIGINT) AS down_days, widest, change, CASE WHEN change > 0.5 THEN 'up' WHEN change < -0.5 THEN 'down' ELSE 'flat' END AS trend FROM c",
)
def five_day_card(spark, sf_dir):
    return rules.five_day_card(source.daily_bars(spark, sf_dir)).select("asset", "days", "up_days", "down_days", "widest", "change", "trend")


@query("sparkline", chain("hourly", more={"r": "SELECT *, row_number() OVER (PARTITION BY asset ORDER BY hour DESC) AS n FROM hourly", "s": "SELECT *, min(close) OVER (PARTITION BY asset) AS lo, max(close) OVER (PARTITION BY asset) AS hi FROM r WHERE n <= 48"}) + f"SELECT asset, hour, {h('(close - lo) / (CASE WHEN hi > lo THEN hi - lo ELSE 1e0 END)', 6)} AS y FROM s")
def sparkline(spark, sf_dir):
    return rules.sparkline(source.hourly_bars(spark, sf_dir), time="hour")


@query(
    "day_icons",
    chain("ind") + "SELECT asset, date, CASE WHEN change1 IS NULL OR w IS NULL THEN NULL WHEN change1 <= -2.4 OR (change1 < 0 AND w >= 4.5) THEN '태풍경보' WHEN change1 <= -1.1 OR (change1 < 0 AND w >= 3) THEN '소나기' WHEN change1 < -0.25 THEN '흐림' WHEN change1 < 0.25 THEN '구름 조금' WHEN change1 < 1.2 THEN '맑음' ELSE '쾌청' END AS icon FROM (SELECT *, floor((high - low) / low * 100.0 * 1e6 + 0.5) / 1e6 AS w FROM ind)",
)
def day_icons(spark, sf_dir):
    rows = indicator_rows(spark, sf_dir).withColumn("_w", half_up(F.try_divide(F.col("high") - F.col("low"), F.col("low")) * 100.0, 6))
    return rows.select("asset", "date", rules.day_icon(F.col("change1"), F.col("_w")).alias("icon"))


def _feature(name: str, columns: str) -> None:
    @query(name, chain("feat") + f"SELECT asset, date, {columns} FROM feat")
    def run(spark, sf_dir):
        wanted = columns.split(", ")
        return feature_rows(spark, sf_dir, *(c for c in wanted if c in indicators.TRAILING)).select("asset", "date", *wanted)


_feature("feat_returns", "return1, return5, return20")
_feature("feat_sma_gap", "sma_gap5, sma_gap20, sma_gap50, sma_gap200")
_feature("feat_volatility", "realized_vol20, downside_vol20, drawdown63")
_feature("feat_ranks252", "atr_rank252, vol_rank252, volume_rank252, gap_rank252, close_rank252")
_feature("feat_zscore252", "return_z252")
_feature("feat_q10_756", "return_q10_756")

LABELS = "fwd_return1, fwd_return3, fwd_return5, fwd_drawdown3, fwd_drawdown5, next_range, next_true_range"


@query("labels_forward", chain("lab") + f"SELECT asset, date, {LABELS} FROM lab")
def labels_forward(spark, sf_dir):
    return indicators.with_labels(source.daily_bars(spark, sf_dir)).select("asset", "date", *LABELS.split(", "))


EVENTS = "up1, up3, up5, drop1, drop2, drop3, tail1, correction3, correction5"


@query("labels_events", chain("panel") + f"SELECT asset, date, {EVENTS} FROM panel")
def labels_events(spark, sf_dir):
    return panel_rows(spark, sf_dir, indicators.TAIL).select("asset", "date", *EVENTS.split(", "))


@query("panel_summary", chain("panel") + "SELECT asset, count(*) AS rows, min(date) AS first_date, max(date) AS last_date, floor(avg(up1) * 1e6 + 0.5) / 1e6 AS up_rate, floor(avg(tail1) * 1e6 + 0.5) / 1e6 AS tail_rate FROM panel GROUP BY asset")
def panel_summary(spark, sf_dir):
    rate = lambda c: half_up(F.avg(c), 6)
    return panel_rows(spark, sf_dir, indicators.TAIL).groupBy("asset").agg(F.count("*").alias("rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), rate("up1").alias("up_rate"), rate("tail1").alias("tail_rate"))


@query("feature_missing", chain("feat") + "SELECT asset, count(*) AS rows, count(*) - count(sma200) AS no_sma200, count(*) - count(atr_rank252) AS no_atr_rank252, count(*) - count(return_z252) AS no_return_z252 FROM feat GROUP BY asset")
def feature_missing(spark, sf_dir):
    from weftline.operators.audit import missing_counts

    return missing_counts(feature_rows(spark, sf_dir, "atr_rank252"), ["sma200", "atr_rank252", "return_z252"])


_ASOF = chain("bars", "market") + "SELECT bars.asset AS asset, bars.date AS date, market.date AS as_of, market.close AS market_close FROM bars ASOF LEFT JOIN market ON bars.date {0} market.date"


def _market(spark, sf_dir):
    return source.market_bars(spark, sf_dir).select("date", F.col("close").alias("market_close"))


@query("asof_inclusive", _ASOF.format(">="))
def asof_inclusive(spark, sf_dir):
    return joins.asof(source.daily_bars(spark, sf_dir).select("asset", "date"), _market(spark, sf_dir), "date", ["market_close"])


@query("asof_strict", _ASOF.format(">"))
def asof_strict(spark, sf_dir):
    return joins.asof(source.daily_bars(spark, sf_dir).select("asset", "date"), _market(spark, sf_dir), "date", ["market_close"], strict=True)


@query(
    "asof_tolerance",
    chain("hourly", "bars", more={"r": "SELECT asset, date, close FROM bars WHERE day(date) % 7 = 1", "j": "SELECT b.asset AS asset, b.date AS date, r.date AS d, r.close AS c FROM bars b ASOF LEFT JOIN r ON b.asset = r.asset AND b.date >= r.date"}) + "SELECT asset, date, CASE WHEN date - d <= 4 THEN d END AS as_of, CASE WHEN date - d <= 4 THEN c END AS weekly_close FROM j",
)
def asof_tolerance(spark, sf_dir):
    bars = source.daily_bars(spark, sf_dir)
    weekly = bars.where("day(date) % 7 = 1").select("asset", "date", F.col("close").alias("weekly_close"))
    return joins.asof(bars.select("asset", "date"), weekly, "date", ["weekly_close"], by=["asset"], tolerance_days=4)


@query(
    "breadth",
    chain(
        "feat",
        "market",
        more={
            "p": "SELECT DISTINCT m.date AS date, f.asset AS asset FROM market m, (SELECT DISTINCT asset FROM feat) f",
            "j": "SELECT p.date AS date, f.date AS d, f.return1 AS r, f.sma_gap20 AS g FROM p ASOF LEFT JOIN feat f ON p.asset = f.asset AND p.date >= f.date",
            "a": f"SELECT date, count(*) AS members, {h('avg(CASE WHEN coalesce(r, 0) > 0 THEN 100e0 ELSE 0e0 END)', 6)} AS u, {h('avg(CASE WHEN coalesce(g, 0) > 0 THEN 100e0 ELSE 0e0 END)', 6)} AS v FROM j WHERE date - d <= 4 GROUP BY date",
        },
    )
    + "SELECT m.date AS date, coalesce(members, 0) AS members, CASE WHEN members >= 4 THEN u END AS up_share, CASE WHEN members >= 4 THEN v END AS above_share FROM (SELECT DISTINCT date FROM market) m LEFT JOIN a USING (date)",
)
def breadth(spark, sf_dir):
    members = feature_rows(spark, sf_dir).select(F.col("asset").alias("member"), "date", "return1", "sma_gap20")
    return joins.breadth(source.market_bars(spark, sf_dir), members, least=4)


@query(
    "excess_return",
    chain(
        "bars",
        "market",
        more={
            "a": f"SELECT asset, date, {', '.join(growth(f'lead(close, {n}) OVER (PARTITION BY asset ORDER BY date)', 'close') + f' AS a{n}' for n in (1, 3, 5))} FROM bars",
            "m": f"SELECT date, {', '.join(growth(f'lead(close, {n}) OVER (ORDER BY date)', 'close') + f' AS m{n}' for n in (1, 3, 5))} FROM market",
        },
    )
    + f"SELECT asset, date, {', '.join(h(f'a{n} - m{n}', 6) + f' AS excess{n}' for n in (1, 3, 5))} FROM a LEFT JOIN m USING (date)",
)
def excess_return(spark, sf_dir):
    return joins.excess_returns(source.daily_bars(spark, sf_dir), source.market_bars(spark, sf_dir))


@query("split_fraction", chain("bars", more={"r": "SELECT *, row_number() OVER (PARTITION BY asset ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY asset) AS n FROM bars"}) + "SELECT asset, date, CASE WHEN i < floor(n * 0.6e0) THEN 'train' WHEN i < floor(n * 0.8e0) THEN 'validation' ELSE 'test' END AS split FROM r")
def split_fraction(spark, sf_dir):
    return joins.split_by_fraction(source.daily_bars(spark, sf_dir).select("asset", "date"))


VALIDATION, SEALED = "1996-01-01", "1997-07-01"
_SPLIT = {
    "b": f"SELECT asset, date, CASE WHEN date < DATE '{VALIDATION}' THEN 'train' WHEN date < DATE '{SEALED}' THEN 'validation' ELSE 'sealed-test' END AS b FROM bars",
    "n": "SELECT *, row_number() OVER (PARTITION BY asset, b ORDER BY date) AS u, row_number() OVER (PARTITION BY asset, b ORDER BY date DESC) AS d FROM b",
    "s": "SELECT asset, date, CASE WHEN b <> 'train' AND u <= 5 THEN 'embargoed' WHEN b <> 'sealed-test' AND d <= 5 THEN 'purged' ELSE b END AS bucket FROM n",
}


@query("split_purge_embargo", chain("bars", more=_SPLIT) + "SELECT asset, date, bucket FROM s")
def split_purge_embargo(spark, sf_dir):
    return joins.split_by_dates(source.daily_bars(spark, sf_dir).select("asset", "date"), VALIDATION, SEALED)


BUCKETS = ("train", "validation", "sealed-test", "purged", "embargoed")


@query(
    "split_summary",
    chain("bars", more=_SPLIT) + "SELECT asset, " + ", ".join(f"count(*) FILTER (bucket = '{b}') AS {b.replace('-', '_')}" for b in BUCKETS) + ", min(date) FILTER (bucket = 'train') AS first_train, max(date) FILTER (bucket = 'train') AS last_train, min(date) FILTER (bucket = 'sealed-test') AS first_sealed FROM s GROUP BY asset",
)
def split_summary(spark, sf_dir):
    rows = split_purge_embargo(spark, sf_dir)
    of = lambda b: F.when(F.col("bucket") == b, F.col("date"))
    return rows.groupBy("asset").agg(*(F.count_if(F.col("bucket") == b).alias(b.replace("-", "_")) for b in BUCKETS), F.min(of("train")).alias("first_train"), F.max(of("train")).alias("last_train"), F.min(of("sealed-test")).alias("first_sealed"))


@query(
    "fold_purge",
    chain(
        "bars",
        more={
            "b": "SELECT asset, date, CASE WHEN date <= DATE '1994-12-31' THEN 'train' WHEN date BETWEEN DATE '1995-01-01' AND DATE '1995-12-31' THEN 'validation' END AS part FROM bars",
            "n": "SELECT *, row_number() OVER (PARTITION BY asset, part ORDER BY date) AS u, row_number() OVER (PARTITION BY asset, part ORDER BY date DESC) AS d FROM b WHERE part IS NOT NULL",
        },
    )
    + "SELECT asset, date, part FROM n WHERE CASE WHEN part = 'train' THEN d > 5 ELSE u > 5 END",
)
def fold_purge(spark, sf_dir):
    return joins.fold_rows(source.daily_bars(spark, sf_dir).select("asset", "date"), "1994-12-31", "1995-01-01", "1995-12-31")
