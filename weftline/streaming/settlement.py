"""Structured Streaming forms: bars of an event stream, and a ledger that settles forecasts as outcomes arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators import segments


def event_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of events as they arrive; ts is read as a timestamp for watermarks.

    Files of one landing were written side by side, in no order of ts, so they belong
    into one batch: a batch's own rows are never late for it. With files_per_trigger,
    files must arrive in the order of their events, or rows beyond the watermark go.
    """
    stream = spark.readStream.schema(schema)
    stream = stream.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else stream
    return stream.parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))


def hourly_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events, sum and extremes of values by type and hour; rows later than the watermark are dropped, as windows close."""
    by_hour = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return by_hour.agg(F.count("*").alias("events"), F.min("value").alias("low"), F.max("value").alias("high")).select("event_type", F.col("w.start").alias("hour"), "events", "low", "high")


def forecasts_and_outcomes(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Stream-stream join: a user's click is a forecast, each of the user's purchases within the hour an outcome.

    Both sides have watermarks and the join a time bound, so state is dropped.
    """
    f = events.where("event_type = 'click'").select("user_id", F.col("ts").alias("made"), F.col("value").alias("predicted"), F.col("event_id").alias("forecast_id")).withWatermark("made", late)
    o = events.where("event_type = 'purchase'").select(F.col("user_id").alias("_user"), F.col("ts").alias("seen"), F.col("value").alias("actual")).withWatermark("seen", late)
    return f.join(o, F.expr("user_id = _user and seen >= made and seen <= made + interval 1 hour")).select("forecast_id", "made", "seen", "predicted", "actual", F.abs(F.col("predicted") - F.col("actual")).alias("error"))


def append_once(stream: DataFrame, path: str, checkpoint: str, key: str, day: Column, buckets: int = 1) -> StreamingQuery:
    """Append a stream to a Parquet ledger by day and bucket of the key (``segments.append``): a batch reads only the partitions it touches, and a repeated one changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        held = batch.persist()  # decided on and written from one computation of the batch
        try:
            segments.append(held, path, key, day, buckets=buckets)
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
