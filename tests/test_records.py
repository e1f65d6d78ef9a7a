"""Segments of ledgers, snapshots and registrations against small cases."""

import datetime as dt
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from weftline.operators import prospective, rules, segments, snapshot

START = dt.date(2024, 1, 1)


def rows(spark, n=60):
    return spark.createDataFrame([(k, START + dt.timedelta(days=k % 5), f"v{k}") for k in range(n)], "id long, on date, v string")


def test_appends_read_only_the_partitions_they_touch(spark, tmp_path):
    path, df = str(tmp_path / "ledger"), rows(spark)
    segments.append(df.where("id < 30"), path, "id", F.col("on"), buckets=4)
    one_day = df.where("on = '2024-01-02'")
    seen = segments.append(one_day, path, "id", F.col("on"), buckets=4)
    assert {r.day for r in seen.select("day").distinct().collect()} == {dt.date(2024, 1, 2)}
    plan = seen._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "day" in plan.split("PartitionFilters: [")[1].split("]")[0]
    segments.append(one_day.unionByName(one_day), path, "id", F.col("on"), buckets=4)
    kept = spark.read.parquet(path)
    assert kept.count() == kept.select("id").distinct().count() == df.where("id < 30 or on = '2024-01-02'").count()
    assert segments.append(df.limit(0), path, "id", F.col("on")).count() == 0 and spark.read.parquet(path).count() == kept.count()


def test_seals_and_breaks(spark):
    df = rows(spark).withColumns({"day": F.col("on"), "bucket": (F.col("id") % 3).cast("int")})
    payload = F.col("v")
    seals = segments.sealed(df, "id", payload)
    got = {(r.bucket, r.day): r for r in seals.collect()}
    for b in range(3):
        head = "GENESIS"
        for d in range(5):
            mine = [k for k in range(60) if k % 3 == b and k % 5 == d]
            r = got[b, START + dt.timedelta(days=d)]
            digest = sha256("".join(sha256(f"v{k}".encode()).hexdigest() for k in mine).encode()).hexdigest()
            head = sha256(f"{head}|{digest}".encode()).hexdigest()
            assert (r.records, r.digest, r.head) == (len(mine), digest, head)
    say = lambda ledger, seals=seals: sorted((r.bucket, r.day.day, r.reason) for r in segments.broken(ledger, seals, "id", payload).collect())
    assert say(df) == say(df.repartition(5)) == []
    assert say(df.withColumn("v", F.when(F.col("id") == 7, "x").otherwise(F.col("v")))) == [(1, 3, "changed")]
    assert say(df.where("id <> 7")) == [(1, 3, "changed")] and say(df.where("not (bucket = 2 and day = '2024-01-05')")) == [(2, 5, "missing")]
    assert say(df.unionByName(df.limit(1).withColumns({"day": F.lit(dt.date(2024, 2, 1)), "bucket": F.lit(1)}))) == [(1, 1, "unsealed")]
    forged = seals.withColumn("head", F.when((F.col("bucket") == 0) & (F.col("day") == "2024-01-02"), F.lit("0")).otherwise(F.col("head")))
    assert say(df, forged) == [(0, 2, "head"), (0, 3, "head")]
    assert segments.broken(df.limit(0), seals.limit(0), "id", payload).count() == 0


def test_snapshots_become_visible_whole(spark, tmp_path):
    path = str(tmp_path / "snapshots")
    tables = {"a": rows(spark), "b": spark.range(3).toDF("n")}
    name = snapshot.build(spark, path, tables, {"mode": "official"})
    found, manifest = snapshot.open_snapshot(spark, path, name)
    assert {t: df.count() for t, df in found.items()} == {"a": 60, "b": 3} and manifest["facts"] == {"mode": "official"}
    assert snapshot.content(rows(spark).repartition(7)) == manifest["tables"]["a"]
    assert snapshot.content(tables["b"].unionByName(tables["b"]))["digest"] != snapshot.content(tables["b"])["digest"]

    class Broken(Exception):
        pass

    class Table:
        write = property(lambda self: (_ for _ in ()).throw(Broken()))

    with pytest.raises(Broken):
        snapshot.build(spark, path, {"a": rows(spark), "z": Table()})
    assert len(list((tmp_path / "snapshots" / "manifests").iterdir())) == 1  # what broke off is not visible
    with pytest.raises(ValueError, match="never finished"):
        snapshot.open_snapshot(spark, path, "other")
    spark.range(4).toDF("n").write.mode("overwrite").parquet(f"{path}/{name}/b")
    with pytest.raises(ValueError, match="table b"):
        snapshot.open_snapshot(spark, path, name)
    spark.createDataFrame([((tmp_path / "snapshots" / "manifests" / name).glob("part-*").__next__().read_text().replace('"rows":60', '"rows":61').strip(),)], "v string").coalesce(1).write.mode("overwrite").text(f"{path}/manifests/{name}")
    with pytest.raises(ValueError, match="hash"):
        snapshot.open_snapshot(spark, path, name)


def test_registration(spark):
    past = [(a, START + dt.timedelta(days=k), float(k)) for a, n in (("a", 300), ("b", 260), ("c", 100)) for k in range(n)]
    resolved = spark.createDataFrame(past, "asset string, date date, y double")
    at = {"a": 280, "b": 255, "c": 90}
    inference = spark.createDataFrame([(a, START + dt.timedelta(days=k), 2.0 if a != "d" else None) for a, k in at.items()], "asset string, date date, atr14 double")
    forecasts = inference.select(F.concat_ws(":", "asset", "date").alias("forecast_id"), F.lit("hash").alias("record_hash"), "asset", F.col("date").alias("as_of"))
    policy = prospective.with_policy_hash({"atr_scale": 0.5})
    none = forecasts.limit(0)
    with pytest.raises(ValueError, match="'c'"):
        prospective.register(forecasts, inference, resolved, none, policy)
    got = prospective.register(forecasts, inference, resolved, forecasts.where("asset in ('b', 'c')"), policy).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.asset, r.base_scaled, r.last_outcome, r.observations, r.median, r.policy_sha256, r.forecast_hash) == ("a", 1.0, 279.0, 252, 153.5, policy["policy_sha256"], "hash")
    assert (r.q25, r.q75, r.q90) == (90.75, 216.25, 253.9)
    late = forecasts.withColumn("as_of", F.date_add("as_of", 1))
    assert prospective.register(late, inference, resolved, none, policy).count() == 0  # not the day of the snapshot


def test_texts_at_their_bounds(spark):
    df = spark.createDataFrame([(x,) for x in (None, 33.9, 34.0, 42.0, 43.0, 44.0, 54.0, 57.9, 58.0, 64.0, 89.0, 90.0, 93.2, 100.0)], "x double")
    got = {r.x: (r.h, r.d, r.k) for r in df.select("x", rules.headline(F.col("x")).alias("h"), rules.direction(F.col("x")).alias("d"), rules.rank_label(F.col("x")).alias("k")).collect()}
    lines = [text for _, text in rules.HEADLINES]
    assert [got[x][0] for x in (64.0, 54.0, 44.0, 34.0, 33.9, None)] == [*lines, rules.LOWEST_HEADLINE, None]
    assert [got[x][1] for x in (58.0, 57.9, 43.0, 42.0)] == ["up", "flat", "flat", "down"]
    assert [got[x][2] for x in (89.0, 90.0, 93.2, 100.0)] == ["high", "top 10%", "top 7%", "top 1%"]
