"""URL filters by hash prefixes of host-suffix and path-prefix expressions.

Every distinct (host, path) is expanded into expressions: each suffix of the
host at label borders, joined with each prefix of the path whose length some
rule has. Expressions meet rules in an equi-join on the first bytes of their
SHA-256 digests; the full digests then confirm, and the longest rule wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import ascii_lower, free_name

PREFIX_HEX = 8


def url_host(url: Column) -> Column:
    """Host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty if there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judge_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """urls with host, path, rule and verdict (they replace columns of these names).

    rules: host, path, verdict; rows with a null are ignored, of repeated rules
    the blocking one counts. A rule fits its host and all subdomains if the path
    starts with the rule's; the longest expression wins, then the longer host.
    Of a host only the suffixes with as many labels as some rule's host are made,
    and of a path the prefixes as long as some rule's path, so long urls cost in
    proportion to their length. Repeated urls are judged once; an empty table
    gives no rows, other columns stay.
    A url without a fitting rule gets a null rule and the default verdict. Null
    urls and urls without ``://`` have an empty host and path and fit no rule.
    """
    held = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    verdict = free_name(urls, "r_verdict")
    split = urls.select(*held, url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    known = (
        rules.select(F.lower("host").alias("r_host"), F.col("path").alias("r_path"), "verdict")
        .dropna()
        .groupBy("r_host", "r_path")
        .agg(F.max_by("verdict", (F.col("verdict") == "block").cast("int")).alias("r_verdict"))
        .withColumn("rule", F.concat("r_host", "r_path"))
        .withColumn("digest", F.sha2(F.concat_ws("\n", "r_host", "r_path"), 256))
        .withColumn("short", F.substring("digest", 1, PREFIX_HEX))
    )
    labels = lambda host: F.length(host) - F.length(F.translate(host, ".", "")) + 1
    none = F.array().cast("array<int>")
    lengths = known.agg(F.coalesce(F.array_sort(F.collect_set(F.length("r_path"))), none).alias("lengths"), F.coalesce(F.array_sort(F.collect_set(labels("r_host"))), none).alias("depths"))
    places = split.select("host", "path").where("host <> ''").distinct()
    expressions = (
        places.crossJoin(F.broadcast(lengths))  # one row: the distinct lengths of rule paths and numbers of labels of rule hosts
        .withColumn("labels", labels("host"))
        .select("host", "path", "lengths", F.explode(F.filter("depths", lambda k: k <= F.col("labels"))).alias("depth"))
        .select("host", "path", "lengths", F.expr("substring_index(host, '.', -depth)").alias("suffix"))
        .select("host", "path", "suffix", F.explode(F.filter("lengths", lambda n: n <= F.length("path"))).alias("n"))
        .withColumn("x_digest", F.sha2(F.concat_ws("\n", "suffix", F.expr("substring(path, 1, n)")), 256))
        .withColumn("short", F.substring("x_digest", 1, PREFIX_HEX))
    )
    best = (
        expressions.join(known, "short")
        .where("x_digest = digest")
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("rule", "r_verdict"), F.struct(F.length("rule"), F.length("r_host"))).alias("best"))
        .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.r_verdict").alias(verdict))
    )
    return split.join(best, ["host", "path"], "left").select(*held, "host", "path", "rule", F.coalesce(verdict, F.lit(default)).alias("verdict"))
