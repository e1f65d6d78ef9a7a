"""Sinks: compressed JSON lines with a digest, one-shot outputs, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's columns as text, nulls told from empty texts."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)


def table_digest(df: DataFrame) -> DataFrame:
    """rows and digest of a table, whatever its order: the sum of 48-bit prefixes of row digests, as text."""
    part = F.conv(F.substring(row_digest(df.columns), 1, 12), 16, 10).cast("decimal(20,0)")
    return df.select(part.alias("d")).agg(F.count("*").alias("rows"), F.coalesce(F.sum("d"), F.lit(0)).cast("string").alias("digest"))


def write_json_lines(df: DataFrame, path: str, once: bool = True) -> DataFrame:
    """Write gzip JSON lines, read them back and compare digests; an existing output is an error unless once is false."""
    df.write.mode("errorifexists" if once else "overwrite").option("compression", "gzip").json(path)
    back = df.sparkSession.read.schema(df.schema).json(path)
    want, got = table_digest(df).first(), table_digest(back).first()
    if want != got:
        raise ValueError(f"{path}: wrote {want}, read {got}")
    return back


def series_manifest(bars: DataFrame, asset: str = "asset", time: str = "date") -> DataFrame:
    """For each asset rows, first and last date and a digest of its bars that does not depend on their order."""
    columns = [c for c in bars.columns if c != asset]
    part = F.conv(F.substring(row_digest(columns), 1, 12), 16, 10).cast("decimal(20,0)")
    return bars.groupBy(asset).agg(F.count("*").alias("rows"), F.min(time).alias("first_date"), F.max(time).alias("last_date"), F.sum(part).cast("string").alias("digest"))


def markdown(df: DataFrame, title: str, most: int = 1000) -> str:
    """Small table as a Markdown report; more than most rows is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([f"# {title}", "", line(df.columns), line("---" for _ in df.columns), *(line(r) for r in rows), ""])
