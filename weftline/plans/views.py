"""Queries of views, news, sessions, payloads, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.operators import rules
from weftline.plans.reference_sql import chain
from weftline.plans.series import score_rows
from weftline.sources import bars as source
from weftline.sources import payloads, sinks
from weftline.streaming import settlement

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


#: The corpus stands in for news: the text for the title, the source for a ticker.
_TEXT = "lower(coalesce(text, '') || ' ' || coalesce(source, ''))"
_PATTERNS = (
    ("가상자산", "bitcoin|crypto|ethereum|blockchain|btc|eth-usd|btc-usd"),
    ("금리·연준", "fed|federal reserve|interest rate|treasury|bond|yield|inflation|cpi|powell"),
    ("기술·AI", r"artificial intelligence|\bai\b|nvidia|semiconductor|chip|technology|nasdaq"),
    ("원자재", "oil|gold|crude|commodity|opec|natural gas"),
    ("증시", "s&p|dow|stock|equity|wall street|market"),
)
_CATEGORY = "CASE " + " ".join(f"WHEN regexp_matches({_TEXT}, '{p}') THEN '{n}'" for n, p in _PATTERNS) + " ELSE '글로벌' END"


def _news(spark, sf_dir):
    docs = source.read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    return docs.withColumn("category", rules.news_category(F.col("text"), F.array_compact(F.array("source"))))


@query("news_categories", f"SELECT doc_id, {_CATEGORY} AS category FROM documents")
def news_categories(spark, sf_dir):
    return _news(spark, sf_dir).select("doc_id", "category")


@query("news_radar", f"SELECT category, count(*) AS items FROM (SELECT {_CATEGORY} AS category FROM documents) WHERE category <> '글로벌' GROUP BY category ORDER BY items DESC, category LIMIT 4")
def news_radar(spark, sf_dir):
    return rules.radar(_news(spark, sf_dir), "category")


_PLACED = "SELECT *, min(doc_id) OVER (PARTITION BY md5(text)) AS place, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id DESC) AS n FROM documents"


@query("headline_dedupe", f"SELECT doc_id, place FROM ({_PLACED}) WHERE n = 1")
def headline_dedupe(spark, sf_dir):
    items = source.read(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("headline"))
    return rules.dedupe_latest(items, "headline", "doc_id").select("doc_id", "place")


@query("news_top16", f"SELECT doc_id, n_chars FROM ({_PLACED}) WHERE n = 1 ORDER BY n_chars DESC, place LIMIT 16")
def news_top16(spark, sf_dir):
    items = source.read(spark, sf_dir, "documents").select("doc_id", "n_chars", F.md5("text").alias("headline"))
    return rules.top_news(items, "headline", "doc_id", "n_chars").select("doc_id", "n_chars")


_STATUS = "CASE WHEN dayofweek({0}) IN (0, 6) THEN 'weekend' WHEN hour({0}) * 60 + minute({0}) < {1} THEN 'before' WHEN hour({0}) * 60 + minute({0}) < {2} THEN 'open' ELSE 'after' END"
#: January has no summer time, so fixed offsets tell local clocks.
_OFFSETS = {"Seoul": 9, "Tokyo": 9, "London": 0, "New York": -5}


@query("session_status", " UNION ALL ".join(f"SELECT event_id, '{c}' AS city, {_STATUS.format(f'(ts + INTERVAL ({_OFFSETS[c]}) HOUR)', a, b)} AS status FROM events" for c, _, a, b in rules.CITIES))
def session_status(spark, sf_dir):
    events = source.read(spark, sf_dir, "events").select("event_id", "ts")
    return rules.session_status(events, "ts").select("event_id", "city", "status")


@query("score_labels", chain("score") + "SELECT asset, date, CASE WHEN trend >= 68 THEN 'strong' WHEN trend >= 56 THEN 'firm' WHEN trend >= 44 THEN 'even' WHEN trend >= 32 THEN 'weak' ELSE 'poor' END AS trend_label FROM score")
def score_labels(spark, sf_dir):
    return score_rows(spark, sf_dir).select("asset", "date", rules.score_label(F.col("trend")).alias("trend_label"))


@query("event_age", "SELECT event_id, CASE WHEN m < 1 THEN 'now' WHEN m < 60 THEN m || ' min' WHEN m < 1440 THEN (m // 60) || ' h' ELSE (m // 1440) || ' d' END AS age FROM (SELECT event_id, date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-01-31 00:00:00') // 60 AS m FROM events)")
def event_age(spark, sf_dir):
    seconds = F.expr("timestampdiff(SECOND, date_trunc('SECOND', ts), TIMESTAMP_NTZ '2024-01-31 00:00:00')")
    return source.read(spark, sf_dir, "events").select("event_id", rules.ago(F.floor(seconds / 60)).alias("age"))


@query("nation_balances", "SELECT n_name AS nation, r_name AS region, count(*) AS customers, floor(avg(c_acctbal) * 1e4 + 0.5) / 1e4 AS mean_balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL")
def nation_balances(spark, sf_dir):
    """Facts looked up in small dimensions; Spark broadcasts those under its threshold."""
    c, n, r = (source.read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    rows = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy(F.col("n_name").alias("nation"), F.col("r_name").alias("region")).agg(F.count("*").alias("customers"), (F.floor(F.avg("c_acctbal") * 1e4 + 0.5) / 1e4).alias("mean_balance"))


@query("chart_payload", chain("hourly") + "SELECT asset, hour, open, high, low, close, volume FROM hourly")
def chart_payload(spark, sf_dir):
    """Hourly bars packed into chart payloads, one for each asset and day, and parsed from their JSON."""
    bars = source.hourly_bars(spark, sf_dir).withColumn("t", F.unix_timestamp(F.col("hour").cast("timestamp")))
    names = ("t", "open", "high", "low", "close", "volume")
    packed = bars.groupBy("asset", F.to_date("hour").alias("day")).agg(F.sort_array(F.collect_list(F.struct(*names))).alias("b"))
    pick = lambda c: F.transform("b", lambda x: x[c])
    each = {c: pick(c) for c in names}
    quote = F.array(F.struct(*(each[c].alias(c) for c in names[1:])))
    text = F.to_json(F.struct(F.struct(F.array(F.struct(each["t"].alias("timestamp"), F.struct(quote.alias("quote")).alias("indicators"))).alias("result")).alias("chart")))
    candles = payloads.chart_candles(packed.select("asset", text.alias("payload")), "payload")
    return candles.select("asset", F.timestamp_millis("time").cast("timestamp_ntz").alias("hour"), "open", "high", "low", "close", "volume")


@query("kline_payload", "SELECT event_type AS asset, count(*) AS candles, floor(avg(value) * 1e6 + 0.5) / 1e6 AS mean_close FROM events GROUP BY event_type")
def kline_payload(spark, sf_dir):
    """Events as positional rows, parsed from their JSON; a row with a broken number goes."""
    e = source.read(spark, sf_dir, "events")
    t = F.unix_millis(F.col("ts").cast("timestamp")).cast("string")
    value = F.col("value").cast("string")
    text = F.to_json(F.array(F.array(t, value, value, value, value, F.lit("1"), t), F.array(t, F.lit("broken"), value, value, value, F.lit("1"), t)))
    rows = payloads.kline_candles(e.select(F.col("event_type").alias("asset"), text.alias("payload")), "payload")
    return rows.groupBy("asset").agg(F.count("*").alias("candles"), (F.floor(F.avg("close") * 1e6 + 0.5) / 1e6).alias("mean_close"))


@query("source_fallback", "SELECT o_orderkey, o_orderpriority FROM orders")
def source_fallback(spark, sf_dir):
    """A source with gaps before a full one: rows of the first where it has them."""
    o = source.read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    gaps = o.where("o_orderkey % 3 <> 0")
    return payloads.prefer([gaps, o.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise("wrong"))], ["o_orderkey"])


@query("json_lines_sink", chain("bars") + "SELECT asset, count(*) AS rows, min(date) AS first_date, max(date) AS last_date FROM bars GROUP BY asset")
def json_lines_sink(spark, sf_dir):
    """Bars written as gzip JSON lines, read back and held against their digest."""
    back = sinks.write_json_lines(source.daily_bars(spark, sf_dir), _scratch(spark))
    return sinks.series_manifest(back).select("asset", "rows", "first_date", "last_date")


def _scratch(spark) -> str:
    """A new folder under the one that all nodes share."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{shared.rstrip('/')}/weftline-views-{uuid.uuid4().hex}"


EVENTS = T.StructType(
    [T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())]
)


def _stream(spark, sf_dir):
    """The events table as a stream: the file itself, as it would arrive in a folder."""
    folder = _scratch(spark)
    source.read(spark, sf_dir, "events").select(*EVENTS.fieldNames()).write.parquet(folder)
    return settlement.event_stream(spark, folder, EVENTS)


@query("stream_hourly", "SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS events, min(value) AS low, max(value) AS high FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 2 HOUR GROUP BY ALL")
def stream_hourly(spark, sf_dir):
    """Hours that the watermark has closed, appended to a ledger by a stream."""
    out, mark = _scratch(spark), _scratch(spark)
    rows = settlement.hourly_counts(_stream(spark, sf_dir)).withColumn("key", F.concat_ws("|", "event_type", "hour"))
    settlement.append_once(rows, out, mark, "key", F.col("hour").cast("date")).awaitTermination()
    return spark.read.schema("event_type string, hour timestamp, events long, low double, high double").parquet(out).select("event_type", F.col("hour").cast("timestamp_ntz").alias("hour"), "events", "low", "high")


@query(
    "stream_settle",
    "SELECT c.event_id AS forecast_id, count(*) AS outcomes, floor(min(abs(c.value - p.value)) * 1e6 + 0.5) / 1e6 AS least_error FROM events c JOIN events p ON c.user_id = p.user_id AND c.event_type = 'click' AND p.event_type = 'purchase' AND p.ts >= c.ts AND p.ts <= c.ts + INTERVAL 1 HOUR GROUP BY c.event_id",
)
def stream_settle(spark, sf_dir):
    """Stream-stream join of forecasts and outcomes, appended to a ledger."""
    out, mark = _scratch(spark), _scratch(spark)
    rows = settlement.forecasts_and_outcomes(_stream(spark, sf_dir)).withColumn("key", F.concat_ws("|", "forecast_id", "seen", "actual"))
    settlement.append_once(rows, out, mark, "key", F.col("seen").cast("date")).awaitTermination()
    got = spark.read.schema("forecast_id long, error double").parquet(out)
    return got.groupBy("forecast_id").agg(F.count("*").alias("outcomes"), (F.floor(F.min("error") * 1e6 + 0.5) / 1e6).alias("least_error"))
