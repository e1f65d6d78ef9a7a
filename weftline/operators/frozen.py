"""Frozen models: artefacts that are stored once with their hash, refused if a byte has changed, and used as column expressions."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.ledger import canonical, value_hash
from weftline.operators.models import LinearModel, shifted_probability

HASH = "artifact_sha256"


def packed(model: LinearModel, task: str) -> dict:
    """A model as JSON can hold it."""
    return {"task": task, "columns": model.columns, "penalty": model.penalty, "mean": [model.scaling[c][0] for c in model.columns], "scale": [model.scaling[c][1] for c in model.columns], "intercept": model.intercept, "coefficients": model.coefficients}


def unpacked(body: dict) -> LinearModel:
    scaling = {c: (m, s) for c, m, s in zip(body["columns"], body["mean"], body["scale"], strict=True)}
    return LinearModel(body["columns"], scaling, body["coefficients"], body["intercept"], body["penalty"])


def _stored(spark: SparkSession, path: str) -> list[str]:
    try:
        return [r.value for r in spark.read.text(path, wholetext=True).collect()]  # one artefact
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def load(spark: SparkSession, path: str) -> dict:
    """The artefact at path; an error if there is not one, or if it does not agree with its hash byte by byte."""
    texts = _stored(spark, path)
    if len(texts) != 1:
        raise ValueError(f"{path}: {len(texts)} artefacts")
    artefact = json.loads(texts[0])
    body = {k: v for k, v in artefact.items() if k != HASH}
    if value_hash(body) != artefact.get(HASH) or canonical(artefact) != texts[0].rstrip("\n"):
        raise ValueError(f"{path}: the artefact does not agree with its hash")
    return artefact


def freeze(spark: SparkSession, path: str, body: dict, ledgers: list[DataFrame] = (), replace: bool = False) -> dict:
    """Store body with its hash, once: a stored artefact is kept and returned, unless it is to be replaced, which rows in a ledger forbid."""
    if _stored(spark, path):
        if not replace:
            return load(spark, path)
        if any(not ledger.isEmpty() for ledger in ledgers):
            raise ValueError("a frozen model cannot be replaced once a ledger has rows")
    artefact = body | {HASH: value_hash(body)}
    rows = spark.createDataFrame([(canonical(artefact),)], "value string").coalesce(1)
    rows.write.mode("overwrite" if replace else "errorifexists").text(path)
    return load(spark, path)


def extend_tape(tape: DataFrame, later: DataFrame, artefact: dict, time: str = "date") -> DataFrame:
    """tape before the artefact's cutoff, and the frozen model's prediction for rows from it on; a row has one prediction.

    tape: the columns of later and predicted. Rows of the tape from the cutoff on are
    replaced, whatever predicted them.
    """
    day = F.lit(artefact["cutoff"]).cast("date")
    frozen = later.where(F.col(time) >= day).withColumn("predicted", unpacked(artefact["range"]).range_prediction())
    return tape.where(F.col(time) < day).select(frozen.columns).unionByName(frozen)


def forecasts(rows: DataFrame, artefact: dict, prior: Column) -> DataFrame:
    """rows with predicted and tail_risk of the frozen models; prior: the series' trailing event rate."""
    tail = unpacked(artefact["tail"]).probability()
    return rows.withColumns({"predicted": unpacked(artefact["range"]).range_prediction(), "tail_risk": shifted_probability(tail, prior, F.lit(artefact["base_rate"]), 1.0)})
