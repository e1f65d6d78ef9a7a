"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


#: A key is heavy if it holds more than one row in SHARE and more than HEAVY rows; so at most SHARE keys are heavy.
SHARE = 10_000
HEAVY = 256
_BUCKETS = 1 << 16


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, from spark.checkpoint.dir, which must be set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return found.rstrip("/")


class Scratch:
    """Intermediate tables of one run, written as Parquet into the shared folder, which cuts lineage and survives lost executors.

    What a later table was made from is dropped as soon as that is written. The
    tables that a returned DataFrame reads stay; they belong to the folder's owner.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def write(self, df: DataFrame, *used_up: DataFrame) -> DataFrame:
        """df, written and read back; tables that are used up with it are removed."""
        path = f"{shared_dir(self.spark)}/weftline-{uuid.uuid4().hex}"
        df.write.parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(back)] = back, path
        self.drop(*used_up)
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables of this run; others are passed over."""
        for df in tables:
            if id(df) in self.paths:
                _, path = self.paths.pop(id(df))
                place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

    def keep(self, *tables: DataFrame) -> None:
        """Remove all tables of this run but these."""
        kept = {id(df) for df in tables}
        self.drop(*[df for k, (df, _) in list(self.paths.items()) if k not in kept])


def heavy(rows: DataFrame, key: str, *facts: Column) -> DataFrame:
    """key, n, facts (aggregates) of the heavy keys of rows, SHARE keys at most.

    Two passes with partial aggregation: hash buckets first, then only the keys
    of heavy buckets. A bucket that holds a heavy key is heavy itself.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(_BUCKETS)).cast("int").alias("_bucket")
    counts = rows.groupBy(bucket).agg(F.count("*").alias("n"))
    crowded = F.when(F.col("n") > HEAVY, F.struct("_bucket", "n"))
    seen = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.collect_list(crowded).alias("crowded")).first()  # one row for each bucket at most
    total = seen.total
    full = [x["_bucket"] for x in seen.crowded if x["n"] * SHARE > total]
    some = rows.where(bucket.isin(full)) if full else rows.where(F.lit(False))
    return some.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *facts).where((F.col("n") > HEAVY) & (F.col("n") * SHARE > total))


def join_facts(rows: DataFrame, facts: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows joined with facts, a written table of one row for each key and its number of rows, n, of total.

    Rows of heavy keys stay where they are and meet their facts in a broadcast of SHARE rows at most; the others are shuffled.
    """
    crowded = facts.where((F.col(n) > HEAVY) & (F.col(n) * SHARE > total))
    if crowded.isEmpty():
        return rows.join(facts, key)
    light = rows.join(F.broadcast(crowded.select(key)), key, "left_anti").join(facts, key)
    return light.unionByName(rows.join(F.broadcast(crowded), key))


def grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of rows of sorted batches with equal first columns: these, and the rest of each row."""
    now, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != now:
                if held:
                    yield now, held
                now, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield now, held


def widened(df: DataFrame) -> DataFrame:
    """df with as many partitions as the cluster has cores at least: a small file is one partition, whatever its texts cost."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


def hash_fold(doc_id: str, mod: int) -> Column:
    """crc32 of the id as text, modulo mod; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % F.lit(mod)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that all their bits depend on all bits of x."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35.0, 35.0)))


def golden_min(f, lo: float, hi: float, steps: int = 60) -> float:
    """Minimum of a unimodal function of one variable."""
    g = (5**0.5 - 1) / 2
    a, b = lo, hi
    c, d = b - g * (b - a), a + g * (b - a)
    fc, fd = f(c), f(d)
    for _ in range(steps):
        if fc <= fd:
            b, d, fd = d, c, fc
            c = b - g * (b - a)
            fc = f(c)
        else:
            a, c, fc = c, d, fd
            d = a + g * (b - a)
            fd = f(d)
    return (a + b) / 2
