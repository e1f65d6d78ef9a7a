"""Provider payloads (JSON texts) to rows, snapshots and public documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHART = "chart struct<result: array<struct<timestamp: array<bigint>, indicators: struct<quote: array<struct<open: array<double>, high: array<double>, low: array<double>, close: array<double>, volume: array<double>>>, adjclose: array<struct<adjclose: array<double>>>>>>>"
NEWS = "news array<struct<uuid: string, title: string, publisher: string, link: string, providerPublishTime: bigint, relatedTickers: array<string>, thumbnail: struct<resolutions: array<struct<url: string, width: int, height: int>>>>>"
QUOTES = "quotes array<struct<symbol: string, shortname: string, longname: string, quoteType: string, exchange: string>>"


def chart_candles(payloads: DataFrame, json_col: str, adjusted: bool = False) -> DataFrame:
    """Parallel arrays of a chart payload to candles.

    Rows without all four prices are dropped, a missing volume is 0, seconds
    become milliseconds. adjusted: prices times adjusted close / close where that
    is finite; volumes are not adjusted.
    """
    held = [c for c in payloads.columns if c != json_col]
    result = F.from_json(json_col, CHART)["chart"]["result"][0]
    quote = result["indicators"]["quote"][0]
    adjclose = result["indicators"]["adjclose"]
    zipped = F.arrays_zip(
        result["timestamp"].alias("time"), quote["open"].alias("open"), quote["high"].alias("high"), quote["low"].alias("low"), quote["close"].alias("close"), quote["volume"].alias("volume"),
        F.coalesce(F.try_element_at(adjclose, F.lit(1))["adjclose"], F.array().cast("array<double>")).alias("adj"),
    )
    kind = "array<struct<time:bigint,open:double,high:double,low:double,close:double,volume:double,adj:double>>"
    rows = payloads.select(*held, F.inline(zipped.cast(kind))).dropna(subset=["open", "high", "low", "close"])
    factor = F.coalesce(F.try_divide("adj", "close"), F.lit(1.0)) if adjusted else F.lit(1.0)
    return rows.select(*held, (F.col("time") * 1000).alias("time"), F.to_date(F.timestamp_seconds("time")).alias("date"), *((F.col(c) * factor).alias(c) for c in ("open", "high", "low", "close")), F.coalesce("volume", F.lit(0.0)).alias("volume"))


def kline_candles(payloads: DataFrame, json_col: str) -> DataFrame:
    """Positional kline arrays to candles; rows with a value that is no finite number go."""
    held = [c for c in payloads.columns if c != json_col]
    row = payloads.select(*held, F.explode(F.from_json(json_col, "array<array<string>>")).alias("r"))
    number = lambda k: F.try_element_at("r", F.lit(k + 1)).try_cast("double")
    out = row.select(*held, F.try_element_at("r", F.lit(1)).try_cast("long").alias("time"), *(number(k + 1).alias(c) for k, c in enumerate(("open", "high", "low", "close", "volume"))))
    sound = F.col("time").isNotNull()
    for c in ("open", "high", "low", "close", "volume"):
        sound &= F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out.where(sound)


def news_items(payloads: DataFrame, json_col: str) -> DataFrame:
    """News items with title, link and id; image: the first at least 300 wide, else the first."""
    n = payloads.select(F.inline(F.from_json(json_col, NEWS)["news"]))
    images = F.col("thumbnail")["resolutions"]
    image = F.coalesce(F.try_element_at(F.filter(images, lambda i: i["width"] >= 300), F.lit(1))["url"], F.try_element_at(images, F.lit(1))["url"])
    full = (F.coalesce("uuid", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "") & (F.coalesce("link", F.lit("")) != "")
    return n.where(full).select(F.col("uuid").alias("id"), "title", "publisher", "link", F.timestamp_seconds("providerPublishTime").alias("published"), F.coalesce("relatedTickers", F.array().cast("array<string>")).alias("tickers"), image.alias("image"))


def search_hits(payloads: DataFrame, json_col: str, kinds: list[str], exchanges: list[str], limit: int = 8) -> DataFrame:
    """Symbols of the wanted kinds on wanted exchanges, or indices (leading ^), in payload order, at most limit for each payload."""
    q = F.filter(F.from_json(json_col, QUOTES)["quotes"], lambda x: x["quoteType"].isin(kinds) & (x["exchange"].isin(exchanges) | F.startswith(x["symbol"], F.lit("^"))))
    rows = payloads.select(F.inline(F.slice(q, 1, limit)))
    name = F.coalesce(F.nullif("shortname", F.lit("")), F.nullif("longname", F.lit("")), F.col("symbol"))
    return rows.select("symbol", name.alias("name"), F.when((F.col("quoteType") == "INDEX") | F.startswith("symbol", F.lit("^")), "index").otherwise("stock").alias("kind"), "exchange")


def prefer(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """Rows of several sources; of a key only those of the first source in the list that has it."""
    from pyspark.sql import Window

    both = None
    for k, df in enumerate(sources):
        tagged = df.withColumn("_source", F.lit(k))
        both = tagged if both is None else both.unionByName(tagged)
    return both.withColumn("_first", F.min("_source").over(Window.partitionBy(*keys))).where("_source = _first").drop("_source", "_first")


def usable_translation(source: Column, text: Column) -> Column:
    """Whether a translation is worth showing: not empty, not the source itself, with some letters."""
    t = F.trim(text)
    return F.coalesce((t != "") & (F.lower(t) != F.lower(F.trim(source))) & t.rlike(r"\p{L}"), F.lit(False))
