"""Tables written once and read again, in the folder that driver and executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; the warehouse, which is shared too, where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return found.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table of its own: what reads it more than once computes it once, and lost executors cost nothing. The file stays with the folder's owner, as the result reads it."""
    path = f"{shared_dir(df.sparkSession)}/weftline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
