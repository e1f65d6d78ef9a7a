"""Append-only, hash-chained ledgers of forecasts, benchmarks and settlements.

A record's hash covers its payload and the hash before it in its chain. There is
one chain for each value of the chain key (an asset), so chains are verified in
parallel; a chain itself is sequential.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GENESIS = "GENESIS"


def canonical(value) -> str:
    """Canonical JSON: sorted keys, no spaces, no NaN."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def value_hash(value) -> str:
    return sha256(canonical(value).encode()).hexdigest()


def chained(rows: DataFrame, chain: str, order: list[str], payload: Column) -> DataFrame:
    """rows with previous_hash and record_hash, where record_hash = sha256(previous_hash | payload) along each chain.

    A chain is sequential: one task folds its payload digests in the order of the
    positions, batch by batch, and holds no more than a batch and the last hash.
    Payloads are texts made by the caller.
    """
    w = Window.partitionBy(chain).orderBy(*order)
    numbered = rows.withColumns({"position": F.row_number().over(w) - 1, "_h": F.sha2(payload, 256)})

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = GENESIS
        for batch in batches:
            before, own = [], []
            for position, h in zip(batch.column("position").to_pylist(), batch.column("_h").to_pylist(), strict=True):
                if not position:
                    last = GENESIS
                before.append(last)
                last = sha256(f"{last}|{h}".encode()).hexdigest()
                own.append(last)
            yield pa.RecordBatch.from_arrays([batch.column(chain), batch.column("position"), pa.array(before, pa.string()), pa.array(own, pa.string())], names=[chain, "position", "previous_hash", "record_hash"])

    kind = rows.schema[chain].dataType.simpleString()
    each = numbered.select(chain, "position", "_h").repartition(chain).sortWithinPartitions(chain, "position").mapInArrow(fold, f"{chain} {kind}, position int, previous_hash string, record_hash string")
    return numbered.drop("_h").join(each, [chain, "position"])


def chain_breaks(ledger: DataFrame, chain: str, payload: Column) -> DataFrame:
    """Records whose hash does not cover payload and previous hash, or whose previous hash is not the one before."""
    w = Window.partitionBy(chain).orderBy("position")
    want = F.sha2(F.concat(F.col("previous_hash"), F.lit("|"), F.sha2(payload, 256)), 256)
    before = F.coalesce(F.lag("record_hash").over(w), F.lit(GENESIS))
    return ledger.withColumns({"_own": want, "_before": before}).where("_own <> record_hash or _before <> previous_hash").drop("_own", "_before")


def verify_json_chain(rows: DataFrame, text_col: str = "value", order_col: str = "line", chain_col: str | None = None) -> DataFrame:
    """chain, records, valid of ledgers of canonical JSON lines with previousHash and recordHash.

    recordHash is the hash of the record without it. Canonical numbers are those
    of Python, so this check runs in tasks that read each chain in order, batch by
    batch.
    """
    keyed = rows.select((F.col(chain_col).cast("string") if chain_col else F.lit("all")).alias("chain"), F.col(order_col).alias("_order"), F.col(text_col).alias("_text"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = lambda: pa.RecordBatch.from_arrays([pa.array([chain], pa.string()), pa.array([records], pa.int64()), pa.array([valid], pa.bool_())], names=["chain", "records", "valid"])
        chain, records, valid, before = None, 0, True, GENESIS
        for batch in batches:
            for key, text in zip(batch.column("chain").to_pylist(), batch.column("_text").to_pylist(), strict=True):
                if records and key != chain:
                    yield row()
                    records, valid, before = 0, True, GENESIS
                chain = key
                record = json.loads(text)
                own = record.pop("recordHash", None)
                valid = valid and record.get("previousHash") == before and own == value_hash(record)
                records, before = records + 1, own
        if records:
            yield row()

    ordered = keyed.repartition("chain").sortWithinPartitions("chain", F.asc_nulls_last("_order")).select("chain", "_text")
    return ordered.mapInArrow(check, "chain string, records long, valid boolean")


def canonical_hash(column: Column) -> Column:
    """SHA-256 of the canonical form of a JSON text."""

    @F.pandas_udf("string")
    def apply(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield s.map(lambda t: None if t is None else value_hash(json.loads(t)))

    return apply(column)


def not_yet(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """New rows whose key no existing row has: an append that can be repeated."""
    return new.join(existing.select(key), key, "left_anti")


def settle(forecasts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Forecasts whose outcome is there: absolute error and whether the bounds, inclusive, hold it.

    forecasts: forecast_id, asset, as_of, predicted, low50, high50, low80, high80;
    outcomes: asset, as_of, actual.
    """
    rows = forecasts.join(outcomes, ["asset", "as_of"])
    inside = lambda a, b: (F.col("actual") >= F.col(a)) & (F.col("actual") <= F.col(b))
    return rows.select("forecast_id", "asset", "as_of", "predicted", "actual", F.abs(F.col("predicted") - F.col("actual")).alias("error"), inside("low50", "high50").alias("covered50"), inside("low80", "high80").alias("covered80"))


def orphans(settlements: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Settlements without a forecast of their id and hash."""
    f = forecasts.select("forecast_id", F.col("record_hash").alias("_hash"))
    return settlements.join(f, "forecast_id", "left").where(~F.col("forecast_hash").eqNullSafe(F.col("_hash"))).drop("_hash")


def latest(rows: DataFrame, key: str, time: str, arrival: str) -> DataFrame:
    """The latest row of each key, of equal times the first to arrive."""
    w = Window.partitionBy(key).orderBy(F.desc(time), arrival)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def stale(snapshot: DataFrame, now: Column) -> DataFrame:
    """Snapshot rows that break the date rules, with the reason: US rows share one date of at most four days back (the same day from 22:00 UTC on), round-the-clock rows stand at yesterday."""
    us = F.col("calendar") == "US"
    today = F.to_date(now)
    span = snapshot.where(us).agg(F.min("last_date").alias("_lo"), F.max("last_date").alias("_hi"))
    rows = snapshot.crossJoin(F.broadcast(span))  # one row
    reason = (
        F.when(us & (F.col("_lo") != F.col("_hi")), "not synchronised")
        .when(us & (F.datediff(today, "last_date") > 4), "stale")
        .when(us & (F.col("last_date") == today) & (F.hour(now) < 22), "not closed")
        .when(us & (F.col("last_date") > today), "ahead")
        .when(~us & (F.col("last_date") != F.date_sub(today, 1)), "not yesterday")
    )
    return rows.withColumn("reason", reason).where("reason is not null").drop("_lo", "_hi")
