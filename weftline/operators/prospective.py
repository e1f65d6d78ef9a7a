"""Forecasts before their outcome: what a snapshot must keep to, benchmarks registered with it, a policy made once."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions.scalar import half_up
from weftline.operators.ledger import value_hash
from weftline.operators.models import shifted_probability


def contract_breaks(inference: DataFrame, sources: DataFrame, resolved: DataFrame) -> DataFrame:
    """asset and reason of each rule that an inference row breaks; empty if the snapshot keeps the contract.

    inference: asset, date, us_close (boolean), context_last (latest date of its
    context, or null), coin_last (date of the coin context, or null), has_labels.
    sources: asset, last_closed. resolved: asset, date of rows with outcomes.
    An asset may stand once; its date is its source's last close (an asset
    without a source breaks this); context is not later than its date; at a US
    close the coin context is strictly earlier; resolved rows are strictly
    earlier; no labels are given. A row may break several rules.
    """
    per = Window.partitionBy("asset")
    last = resolved.groupBy("asset").agg(F.max("date").alias("_resolved"))
    rows = inference.withColumn("_copies", F.count("*").over(per)).join(sources.select("asset", "last_closed"), "asset", "left").join(last, "asset", "left")
    day = F.col("date")
    rules = {
        "duplicate": F.col("_copies") > 1,
        "has labels": F.col("has_labels"),
        "not the last close": ~F.col("last_closed").eqNullSafe(day),
        "later context": F.col("context_last") > day,
        "coin context of the day": F.col("us_close") & F.coalesce(F.col("coin_last") >= day, F.lit(True)),
        "resolved overlaps": F.col("_resolved") >= day,
    }
    broken = F.array_compact(F.array(*(F.when(c, n) for n, c in rules.items())))
    return rows.select("asset", F.explode(broken).alias("reason")).distinct()


def benchmarks(rows: DataFrame, base: str, actual: str, scale: float, key: str = "asset", time: str = "date", n: int = 252) -> DataFrame:
    """rows with n earlier outcomes and what is registered before their own: scaled base, last outcome, median, quartiles and 90% point of the n."""
    before = Window.partitionBy(key).orderBy(time).rowsBetween(-n, -1)
    points = {"q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9}
    out = rows.withColumns(
        {"_k": F.count(actual).over(before), "base_scaled": half_up(F.col(base) * scale, 6), "last_outcome": F.last(actual).over(before)}
        | {name: half_up(F.percentile(actual, p).over(before), 8) for name, p in points.items()}
    )
    return out.where(F.col("_k") == n).drop("_k")


def register(forecasts: DataFrame, inference: DataFrame, resolved: DataFrame, existing: DataFrame, policy: dict, n: int = 252) -> DataFrame:
    """Benchmarks registered before an outcome: one row for each forecast that has none yet and whose asset and day are an inference row's.

    forecasts: forecast_id, record_hash, asset, as_of; inference: asset, date, atr14;
    resolved: asset, date, y; existing: forecast_id; policy: with its hash and
    atr_scale. Each row names its forecast, the forecast's hash and the policy's, and
    holds the scaled ATR, the last outcome and the median, quartiles and 90% point of
    the n outcomes before the day. Forecasts without an ATR are passed over; an asset
    with fewer than n earlier outcomes is an error, as nothing may be registered on less.
    """
    open_ = forecasts.join(existing.select("forecast_id"), "forecast_id", "left_anti")
    due = open_.join(inference.select("asset", F.col("date").alias("as_of"), "atr14").where("atr14 is not null"), ["asset", "as_of"])
    w = Window.partitionBy("forecast_id").orderBy(F.desc("date"))
    past = due.join(resolved.select("asset", "date", "y"), "asset", "left").where("date is null or date < as_of").withColumn("_n", F.when(F.col("date").isNotNull(), F.row_number().over(w))).where(f"_n is null or _n <= {n}")
    points = {"q25": 0.25, "median": 0.5, "q75": 0.75, "q90": 0.9}
    keys = ["forecast_id", "record_hash", "asset", "as_of", "atr14"]
    got = past.groupBy(*keys).agg(F.count("y").alias("observations"), F.max_by("y", "date").alias("last_outcome"), *(half_up(F.percentile("y", p), 8).alias(c) for c, p in points.items()))
    missed = due.select("forecast_id", "asset").join(got.where(F.col("observations") >= n).select("forecast_id"), "forecast_id", "left_anti").limit(5).collect()
    if missed:
        raise ValueError(f"fewer than {n} earlier outcomes: {sorted(r.asset for r in missed)}")
    return got.select("forecast_id", F.col("record_hash").alias("forecast_hash"), F.lit(policy["policy_sha256"]).alias("policy_sha256"), "asset", "as_of", half_up(F.col("atr14") * policy["atr_scale"], 6).alias("base_scaled"), "last_outcome", "observations", *points)


def with_policy_hash(body: dict) -> dict:
    """A policy with the hash of its canonical JSON."""
    return body | {"policy_sha256": value_hash(body)}


def ensure_policy(spark: SparkSession, path: str, body: dict, settlements: DataFrame) -> dict:
    """The policy stored at path, made once: an existing one must agree with its hash, and none is made after a settlement.

    The policy is one JSON line of a text table; body must hold only what JSON can.
    """
    try:
        stored = spark.read.text(path).collect()  # one line
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = []
    if stored:
        policy = json.loads(stored[0].value)
        if value_hash({k: v for k, v in policy.items() if k != "policy_sha256"}) != policy.get("policy_sha256"):
            raise ValueError(f"{path}: the policy does not agree with its hash")
        return policy
    if not settlements.isEmpty():
        raise ValueError("a policy cannot be made after outcomes are settled")
    policy = with_policy_hash(body)
    spark.createDataFrame([(json.dumps(policy, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(path)
    return policy

