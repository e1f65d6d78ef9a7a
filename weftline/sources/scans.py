"""Scans that accept or refuse what they read: pages, caches, digests, strict JSON, roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def paged(pages: DataFrame, key: str, page: str, rows: str, time: Column) -> DataFrame:
    """Rows of all pages of each key; a page whose last row is not later than the page before's is an error.

    rows names an array of structs, time says how to read a struct's time from
    column ``row``. Empty pages hold nothing and end nothing.
    """
    last = F.col("_last")
    held = pages.where(F.size(rows) > 0).withColumn("row", F.element_at(rows, -1)).withColumn("_last", time).drop("row")
    held = held.withColumn("_before", F.lag("_last").over(Window.partitionBy(key).orderBy(page)))
    advances = F.when(F.col("_before") >= last, F.raise_error(F.concat(F.col(key).cast("string"), F.lit(": pages do not advance"))).cast("boolean")).otherwise(F.lit(True))
    return held.where(advances).select(key, page, F.explode(rows).alias("row"))


def accepted_cache(cached: DataFrame, wanted: DataFrame, version: int = 1) -> DataFrame:
    """Cached series (asset, version, symbol, end_date, ...) that have the version, and the symbol and last date that are wanted for the asset."""
    w = wanted.select("asset", F.col("symbol").alias("_symbol"), F.col("end_date").alias("_end"))
    return cached.join(w, "asset").where((F.col("version") == version) & (F.col("symbol") == F.col("_symbol")) & (F.col("end_date") == F.col("_end"))).drop("_symbol", "_end")


def by_source(assets: DataFrame, sources: dict[str, DataFrame], key: str = "asset") -> DataFrame:
    """Rows of the source that each asset names; an asset whose source is not offered has none."""
    out = None
    for name, rows in sources.items():
        part = rows.join(assets.where(F.col("source") == name).select(key), key, "left_semi")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no sources")
    return out


def strict_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON of a schema; a record that does not fit is an error when it is read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def digested(files: DataFrame, digests: DataFrame) -> DataFrame:
    """Files (name, content) with whether their content's SHA-256 is the stated one (name, sha256: the first word); one that is not stated is not valid."""
    stated = F.lower(F.regexp_extract("sha256", r"^\s*(\S+)", 1))
    return files.join(digests, "name", "left").withColumn("valid", F.coalesce(F.sha2("content", 256) == stated, F.lit(False)))


def visible(panel: DataFrame, view: str) -> DataFrame:
    """Rows of a panel (with role, date, last_validation, first_test) that a step may read.

    ``training``: development rows through validation; ``history``: all rows
    through validation; ``test``: rows of every role from the first test date;
    ``all``: everything. A null border hides the row from the views it bounds.
    """
    upto = F.col("date") <= F.col("last_validation")
    rules = {"training": (F.col("role") == "development") & upto, "history": upto, "test": F.col("date") >= F.col("first_test"), "all": F.lit(True)}
    if view not in rules:
        raise ValueError(f"{view} is not one of {', '.join(rules)}")
    return panel.where(rules[view])


def scorable(rows: DataFrame, labels: list[str]) -> DataFrame:
    """rows with zeros for the labels they lack, so that what reads records can read them."""
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) if c in rows.columns else F.lit(0.0) for c in labels})
