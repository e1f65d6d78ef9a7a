"""Ledgers that grow: partitioned by bucket and day, appended without a full read, sealed segment by segment.

A segment is what one bucket of keys got on one day. Its digest covers its records'
hashes in the order of their keys; its head covers the digest and the head of the
bucket's segment before. Segments are hashed in parallel, and only their digests,
one for each bucket and day, are chained. A change is found in its segment.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.operators.ledger import GENESIS

BUCKET, DAY = "bucket", "day"


def bucket_of(key: str, buckets: int = 16) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger at path, or None before its first append."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append(batch: DataFrame, path: str, key: str, day: Column, bucket: Column | None = None, buckets: int = 16) -> DataFrame:
    """Append rows whose key the ledger does not have on that day, and return what was read to decide: the partitions that the batch touches.

    A key belongs to one day. Repeating a batch changes nothing; of repeated keys in a
    batch one row stays. A key's bucket spreads a day over files.
    """
    rows = batch.withColumns({DAY: day.cast("date"), BUCKET: bucket_of(key, buckets) if bucket is None else bucket}).dropDuplicates([key])
    there = stored(batch.sparkSession, path)
    seen = rows.limit(0)
    if there is not None:
        touched = rows.select(DAY, BUCKET).distinct().collect()  # days of a batch times buckets
        days, some = sorted({r[0] for r in touched if r[0] is not None}), sorted({r[1] for r in touched if r[1] is not None})
        seen = there.where(F.col(DAY).isin(days) & F.col(BUCKET).isin(some)) if touched else there.limit(0)
        rows = rows.join(seen.select(key), key, "left_anti")
    rows.repartition(DAY, BUCKET).write.mode("append").partitionBy(DAY, BUCKET).parquet(path)
    return seen


def sealed(ledger: DataFrame, key: str, payload: Column) -> DataFrame:
    """bucket, day, records, digest, head of every segment.

    digest = sha256 of the records' sha256 in the order of key and payload; head =
    sha256(head before | digest) along the days of a bucket, GENESIS before the first.
    """
    hashed = ledger.select(BUCKET, DAY, F.struct(F.col(key).alias("k"), F.sha2(payload, 256).alias("h")).alias("r"))
    each = hashed.groupBy(BUCKET, DAY).agg(F.sort_array(F.collect_list("r")).alias("r"))  # a bucket's records of one day
    digests = each.select(BUCKET, DAY, F.size("r").cast("long").alias("records"), F.sha2(F.array_join(F.transform("r", lambda x: x["h"]), ""), 256).alias("digest"))
    return headed(digests)


def headed(digests: DataFrame) -> DataFrame:
    """Segments with their heads; a bucket's digests, one for each day, are folded in one row."""
    chains = digests.groupBy(BUCKET).agg(F.sort_array(F.collect_list(F.struct(DAY, "records", "digest"))).alias("s"))
    heads = F.aggregate("s", F.array(F.lit(GENESIS)), lambda acc, x: F.concat(acc, F.array(F.sha2(F.concat_ws("|", F.element_at(acc, -1), x["digest"]), 256))))
    return chains.select(BUCKET, F.inline(F.arrays_zip("s", F.slice(heads, 2, 1 << 30).alias("head")))).select(BUCKET, "s.*", "head")


def broken(ledger: DataFrame, seals: DataFrame, key: str, payload: Column) -> DataFrame:
    """bucket, day and reason of segments that do not agree with their seals: ``changed``, ``missing`` (sealed, no records), ``unsealed``, or ``head`` (the seal does not follow the one before)."""
    now = sealed(ledger, key, payload).select(BUCKET, DAY, F.col("records").alias("_n"), F.col("digest").alias("_d"))
    w = Window.partitionBy(BUCKET).orderBy(DAY)
    before = F.coalesce(F.lag("head").over(w), F.lit(GENESIS))
    chained = seals.withColumn("_ok", F.sha2(F.concat_ws("|", before, "digest"), 256) == F.col("head"))
    met = chained.join(now, [BUCKET, DAY], "full")
    reason = (
        F.when(F.col("digest").isNull(), "unsealed")
        .when(F.col("_d").isNull(), "missing")
        .when((F.col("_d") != F.col("digest")) | (F.col("_n") != F.col("records")), "changed")
        .when(~F.col("_ok"), "head")
    )
    return met.select(BUCKET, DAY, reason.alias("reason")).where("reason is not null")
