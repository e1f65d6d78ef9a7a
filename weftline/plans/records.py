"""Queries of growing ledgers, snapshots, registrations, texts of scores and checks by truncation."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from weftline.functions import scalar
from weftline.functions.scalar import half_up
from weftline.functions.shared import shared_dir, written
from weftline.operators import audit, indicators, ledger, prospective, rules, segments, snapshot
from weftline.plans.reference_sql import chain
from weftline.plans.reference_sql import half_up as h
from weftline.plans.series import indicator_rows, score_rows
from weftline.sources import bars as source

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/weftline-records-{uuid.uuid4().hex}"


# ---- ledgers in segments ----
#: Buckets of the ledgers of these queries: the last bits of the key, which SQL can compute too.
BUCKETS = 8


def _events(spark, sf_dir):
    rows = source.read(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    return rows.withColumns({segments.DAY: F.col("ts").cast("date"), segments.BUCKET: F.pmod("event_id", F.lit(BUCKETS)).cast("int")})


def _payload():
    return F.concat_ws("|", "event_id", "event_type", half_up(F.col("value") * 100.0).cast("long"))


_LEDGER = {
    "e": f"SELECT event_id, CAST(ts AS DATE) AS day, CAST(event_id % {BUCKETS} AS INT) AS bucket, sha256(event_id || '|' || event_type || '|' || CAST({h('value * 100e0')} AS BIGINT)) AS p FROM events",
    "g": "SELECT bucket, day, count(*) AS records, sha256(string_agg(p, '' ORDER BY event_id, p)) AS digest, row_number() OVER (PARTITION BY bucket ORDER BY day) AS i FROM e GROUP BY bucket, day",
    "c": "SELECT bucket, day, records, digest, i, sha256('GENESIS|' || digest) AS head FROM g WHERE i = 1 UNION ALL SELECT g.bucket, g.day, g.records, g.digest, g.i, sha256(c.head || '|' || g.digest) FROM c JOIN g ON g.bucket = c.bucket AND g.i = c.i + 1",
}
_SEALED = "WITH RECURSIVE " + ", ".join(f"{n} AS ({s})" for n, s in _LEDGER.items())


@query("ledger_segments", _SEALED + " SELECT bucket, day, records, digest, head FROM c")
def ledger_segments(spark, sf_dir):
    """Digests of every bucket's days, and the heads that chain them."""
    return segments.sealed(_events(spark, sf_dir), "event_id", _payload())


@query("segment_breaks", f"SELECT DISTINCT CAST(event_id % {BUCKETS} AS INT) AS bucket, CAST(ts AS DATE) AS day, 'changed' AS reason FROM events WHERE event_id % 997 = 5")
def segment_breaks(spark, sf_dir):
    """Segments in which a record was altered after they were sealed: these and no others."""
    rows = _events(spark, sf_dir)
    seals = written(segments.sealed(rows, "event_id", _payload()))
    altered = rows.withColumn("value", F.when(F.col("event_id") % 997 == 5, F.col("value") + 1.0).otherwise(F.col("value")))
    return segments.broken(altered, seals, "event_id", _payload())


@query("ledger_appends", f"SELECT CAST(event_id % {BUCKETS} AS INT) AS bucket, CAST(ts AS DATE) AS day, count(*) AS records FROM events GROUP BY 1, 2")
def ledger_appends(spark, sf_dir):
    """Records of a ledger that was appended to in three batches, the second of which repeats rows of the first, and the third is the second again."""
    rows, path = _events(spark, sf_dir).drop(segments.DAY, segments.BUCKET), _folder(spark)
    day, bucket = F.col("ts").cast("date"), F.pmod("event_id", F.lit(BUCKETS)).cast("int")
    middle = F.col("event_id") % 3
    for batch in (rows.where(middle < 2), rows.where(middle > 0), rows.where(middle > 0)):
        segments.append(batch, path, "event_id", day, bucket)
    return spark.read.parquet(path).groupBy(segments.BUCKET, segments.DAY).agg(F.count("*").alias("records"))


# ---- snapshots and registrations ----
_LAST = {
    "r": "SELECT ind.asset AS asset, ind.date AS date, ind.atr14 AS atr14, next_true_range AS y, max(ind.date) OVER (PARTITION BY ind.asset) AS last FROM ind JOIN lab ON ind.asset = lab.asset AND ind.date = lab.date",
}


def _parts(spark, sf_dir) -> dict:
    """Inference rows (a series' last), rows with outcomes, and sources of a snapshot."""
    rows = indicators.with_labels(indicator_rows(spark, sf_dir)).select("asset", "date", "atr14", F.col("next_true_range").alias("y"))
    last = rows.groupBy("asset").agg(F.max("date").alias("last_closed"), F.count("*").alias("observations"))
    ends = rows.join(last.select("asset", F.col("last_closed").alias("date")), ["asset", "date"])
    return {"inference": ends.select("asset", "date", "atr14"), "resolved": rows.where("y is not null").select("asset", "date", "y"), "sources": last}


@query("snapshot_build", chain("ind", "lab", more=_LAST) + "SELECT 'inference' AS part, count(*) AS rows, max(date) AS last_date, 0 AS breaks FROM r WHERE date = last UNION ALL SELECT 'resolved', count(*), max(date), 0 FROM r WHERE y IS NOT NULL UNION ALL SELECT 'sources', count(DISTINCT asset), max(last), 0 FROM r")
def snapshot_build(spark, sf_dir):
    """Tables of a snapshot after it was built, opened by its manifest, verified and held to its contract."""
    path = _folder(spark)
    tables, _ = snapshot.open_snapshot(spark, path, snapshot.build(spark, path, _parts(spark, sf_dir)))
    day = F.col("date")
    rows = tables["inference"].select("asset", "date", F.lit(False).alias("us_close"), day.alias("context_last"), F.date_sub(day, 1).alias("coin_last"), F.lit(False).alias("has_labels"))
    breaks = prospective.contract_breaks(rows, tables["sources"], tables["resolved"]).count()
    each = [t.select(F.lit(n).alias("part"), F.col("last_closed" if n == "sources" else "date").alias("d")) for n, t in tables.items()]
    return each[0].unionByName(each[1]).unionByName(each[2]).groupBy("part").agg(F.count("*").alias("rows"), F.max("d").alias("last_date"), F.lit(breaks).cast("int").alias("breaks"))


#: Fixed value: scale of the ATR in the evaluation policy.
ATR_SCALE = 0.930263
_REGISTERED = _LAST | {
    "i": "SELECT asset, date AS as_of, atr14, 'market:' || asset || ':' || date AS forecast_id FROM r WHERE date = last AND asset <> 'AF'",
    "p": "SELECT i.*, y, r.date AS date, row_number() OVER (PARTITION BY i.asset ORDER BY r.date DESC) AS n FROM i JOIN r ON r.asset = i.asset AND r.date < i.as_of AND y IS NOT NULL",
}


@query(
    "benchmark_registration",
    chain("ind", "lab", more=_REGISTERED)
    + f"SELECT forecast_id, sha256(forecast_id) AS forecast_hash, asset, as_of, {h(f'atr14 * {ATR_SCALE}e0', 6)} AS base_scaled, arg_max(y, date) AS last_outcome, count(*) AS observations, " + ", ".join(f"{h(f'quantile_cont(y, {p})', 8)} AS {n}" for n, p in (("q25", 0.25), ("median", 0.5), ("q75", 0.75), ("q90", 0.9))) + " FROM p WHERE n <= 252 GROUP BY forecast_id, asset, as_of, atr14",
)
def benchmark_registration(spark, sf_dir):
    """Benchmarks of each series' last day, of which one series is registered already."""
    parts = _parts(spark, sf_dir)
    forecast_id = F.concat_ws(":", F.lit("market"), "asset", "date")
    forecasts = written(parts["inference"].select(forecast_id.alias("forecast_id"), F.sha2(forecast_id, 256).alias("record_hash"), "asset", F.col("date").alias("as_of")))
    policy = prospective.with_policy_hash({"atr_scale": ATR_SCALE})
    return prospective.register(forecasts, parts["inference"], parts["resolved"], forecasts.where("asset = 'AF'"), policy).drop("policy_sha256")


@query("canonical_hashes", "SELECT event_id, sha256(replace(props, ' ', '')) AS canonical_sha256 FROM events")
def canonical_hashes(spark, sf_dir):
    """Hashes of the canonical forms of JSON texts."""
    return source.read(spark, sf_dir, "events").select("event_id", ledger.canonical_hash(F.col("props")).alias("canonical_sha256"))


# ---- texts of scores ----
_HEADLINE = " ".join(f"WHEN temperature >= {least} THEN '{text}'" for least, text in rules.HEADLINES)


@query(
    "score_texts",
    chain("score") + f"SELECT asset, date, CASE {_HEADLINE} ELSE '{rules.LOWEST_HEADLINE}' END AS headline, CASE WHEN trend >= 58 THEN 'up' WHEN trend <= 42 THEN 'down' ELSE 'flat' END AS trend_direction, CASE WHEN change1 IS NULL THEN '확인 중' ELSE (CASE WHEN change1 >= 0 THEN '+' ELSE '' END) || printf('%.2f', {h('change1', 2)}) || '%' END AS change_text FROM score",
)
def score_texts(spark, sf_dir):
    """Headline, direction and change of every scored bar as texts."""
    return score_rows(spark, sf_dir).select("asset", "date", rules.headline(F.col("temperature")).alias("headline"), rules.direction(F.col("trend")).alias("trend_direction"), scalar.percent_text(F.col("change1")).alias("change_text"))


# ---- checks ----
@query("truncation_check", "SELECT CAST(NULL AS VARCHAR) AS asset WHERE false")
def truncation_check(spark, sf_dir):
    """Features up to the middle of 1998 that change when later bars are cut off: none."""
    features = lambda b: indicators.with_features(indicators.with_indicators(b))
    return audit.truncation_change(features, source.daily_bars(spark, sf_dir), "1998-06-30", ["return1", "atr14", "rsi14", "return_z252", *indicators.TRAILING]).select("asset")
