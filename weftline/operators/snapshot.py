"""Snapshots of several tables that become visible together, by one manifest with digests that is written last."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators.ledger import canonical, value_hash


def content(rows: DataFrame) -> dict:
    """rows and digest of a table's content, whatever the order of its rows: the sum of 60 bits of each row's hash."""
    part: Column = F.conv(F.substring(F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    r = rows.agg(F.count("*").alias("rows"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("digest")).first()
    return {"rows": r["rows"], "digest": r.digest}


def build(spark: SparkSession, path: str, tables: dict[str, DataFrame], facts: dict | None = None) -> str:
    """Write tables under a new name, then the manifest that makes them visible; returns the snapshot's id.

    Until the manifest is there nothing of the snapshot is read, so a build that
    breaks off leaves the one before in force. facts go into the manifest.
    """
    name = uuid.uuid4().hex
    listed = {}
    for table, rows in tables.items():
        rows.write.parquet(f"{path}/{name}/{table}")
        listed[table] = content(spark.read.parquet(f"{path}/{name}/{table}"))
    body = {"snapshot_id": name, "tables": listed, "facts": facts or {}}
    line = canonical(body | {"payload_sha256": value_hash(body)})
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{path}/manifests/{name}")
    return name


def open_snapshot(spark: SparkSession, path: str, name: str) -> tuple[dict[str, DataFrame], dict]:
    """Tables and manifest of a snapshot, verified: an error if the manifest is missing or altered, or a table is not what it says."""
    try:
        lines = spark.read.text(f"{path}/manifests/{name}").collect()  # one line
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = []
    if len(lines) != 1:
        raise ValueError(f"snapshot {name} has no manifest: it was never finished")
    manifest = json.loads(lines[0].value)
    if value_hash({k: v for k, v in manifest.items() if k != "payload_sha256"}) != manifest.get("payload_sha256"):
        raise ValueError(f"snapshot {name}: the manifest does not agree with its hash")
    tables = {}
    for table, said in manifest["tables"].items():
        try:
            tables[table] = spark.read.parquet(f"{path}/{name}/{table}")
        except AnalysisException as error:
            raise ValueError(f"snapshot {name}: table {table} cannot be read") from error
        if content(tables[table]) != said:
            raise ValueError(f"snapshot {name}: table {table} is not what the manifest says")
    return tables, manifest
