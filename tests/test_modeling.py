"""Suites, frozen models, bootstraps, cohorts, trailing state, interval joins and score parity against small cases."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from weftline.operators import bootstrap, calibration, cohorts, comparison, frozen, joins, models, parity, suite
from weftline.operators import score as scores
from weftline.operators.indicators import with_indicators
from weftline.streaming import prediction

START = dt.date(2000, 1, 1)


def panel(seed=3, days=1100):
    rng = np.random.default_rng(seed)
    rows = []
    for asset, cluster, n in (("a1", "a", days), ("a2", "a", days // 2), ("b1", "b", days)):
        for i in range(n):
            x, z, w = (float(v) for v in rng.normal(size=3))
            y = math.exp(0.5 + 0.4 * x - 0.2 * z + float(rng.normal(0, 0.3)))
            rows.append((asset, cluster, START + dt.timedelta(days=i), x, z, w, i % 3 > 0, y, math.log(y), int(rng.random() < 1 / (1 + math.exp(1 - x))), int(rng.random() < 0.5)))
    return pd.DataFrame(rows, columns=["asset", "cluster", "date", "x", "z", "w", "full", "y", "log_range", "tail1", "up1"])


SPECS = [
    suite.Spec("range-two", "range", ("x", "z"), (0.0, 0.1, 10.0)),
    suite.Spec("range-full", "range", ("z", "x", "w"), (0.01,), "full"),
    suite.Spec("tail-one", "tail", ("x",), (0.001, 1.0)),
    suite.Spec("direction-two", "direction", ("x", "w"), (0.1,)),
]


def weights(df):
    clusters = df.groupby("cluster")["asset"].nunique()
    n = df.groupby("asset")["asset"].transform("count")
    return (1.0 / len(clusters) / df["cluster"].map(clusters) / n).to_numpy()


def brute_fit(df, spec, penalty):
    """The same model from weighted rows, with NumPy."""
    w = weights(df)
    x = df[list(spec.columns)].to_numpy()
    mean = w @ x
    spread = np.sqrt(w @ (x - mean) ** 2)
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    mask = np.diag([0.0, *[1.0] * x.shape[1]])
    y = df[suite.TASKS[spec.task]].to_numpy(dtype=float)
    if spec.task == "range":
        return np.linalg.solve(z.T @ (w[:, None] * z) + penalty * mask, z.T @ (w * y))
    beta = np.zeros(z.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve(z.T @ ((w * p * (1 - p))[:, None] * z) + penalty * mask, z.T @ (w * (p - y)) + penalty * mask @ beta)
    return beta


def test_suite_equals_single_fits(spark):
    df = panel()
    rows = calibration.yearly_folds(spark.createDataFrame(df)).repartition(5)
    known = rows.toPandas().merge(df[["asset", "date"]], on=["asset", "date"])
    fits = suite.fit(rows, SPECS, [2000, 2001, 2002])
    assert {(f.spec.name, f.fold, f.penalty) for f in fits} == {(s.name, fold, p) for s in SPECS for fold in (2001, 2002) for p in s.penalties}  # nothing is known before 2000
    for f in fits:
        learn = known[(known["known"] < f.fold) & (known[f.spec.only] if f.spec.only else True)]
        want = brute_fit(learn, f.spec, f.penalty)
        assert f.rows == len(learn)
        assert np.allclose([f.model.intercept, *f.model.coefficients], want, atol=1e-6), f
    got = {(r["name"], r["penalty"], r["fold"]): r["score"] for r in suite.fold_scores(rows, fits).collect()}
    assert len(got) == len(fits)
    for f in fits:
        own = known[(known["fold"] == f.fold) & known["settled"] & (known[f.spec.only] if f.spec.only else True)]
        z = np.column_stack([np.ones(len(own)), *((own[c] - f.model.scaling[c][0]) / f.model.scaling[c][1] for c in f.spec.columns)])
        raw = z @ [f.model.intercept, *f.model.coefficients]
        e = np.abs(own["y"] - np.exp(np.clip(raw, math.log(0.01), math.log(100)))) if f.spec.task == "range" else (own[suite.TASKS[f.spec.task]] - 1 / (1 + np.exp(-raw))) ** 2
        assert got[f.spec.name, f.penalty, f.fold] == pytest.approx(e.groupby(own["asset"]).mean().mean())


def test_suite_choice(spark):
    rows = calibration.yearly_folds(spark.createDataFrame(panel()))
    trained = suite.train(rows.where("fold < 2002"), SPECS, [2000, 2001], 2002)
    assert set(trained.final) == {s.name for s in SPECS} and all(f.fold == 2002 for f in trained.final.values())
    for s in SPECS:
        tried = [t for t in trained.tuning if t[0] == s.name]
        assert [t[1] for t in tried] == list(s.penalties) and [t[4] for t in tried].count(True) == 1
        assert min(tried, key=lambda t: t[2])[4] and trained.final[s.name].penalty == min(tried, key=lambda t: t[2])[1]
    shown = suite.predictions(rows, trained).where("fold = 2002")
    assert shown.where("`range-two` <= 0 or `tail-one` not between 0 and 1").count() == 0
    with pytest.raises(ValueError):
        suite.train(rows, SPECS, [1999], 2002)


def test_number_of_passes_does_not_grow_with_models(spark, monkeypatch):
    rows = calibration.yearly_folds(spark.createDataFrame(panel(days=800)))
    passes = []
    keep = suite._sums
    monkeypatch.setattr(suite, "_sums", lambda *a: (passes.append(1), keep(*a))[1])
    suite.fit(rows, SPECS[2:3], [2001])
    few = len(passes)
    suite.fit(rows, SPECS, [2001, 2002])
    assert len(passes) - few <= few + 2


def test_frozen_models(spark, tmp_path):
    model = models.LinearModel(["x"], {"x": (1.0, 2.0)}, [0.5], 0.25, 0.1)
    body = {"model_id": "m", "cutoff": "2000-02-01", "range": frozen.packed(model, "range"), "tail": frozen.packed(model, "tail"), "base_rate": 0.2}
    path = str(tmp_path / "model")
    made = frozen.freeze(spark, path, body)
    assert frozen.load(spark, path) == made and frozen.unpacked(made["range"]) == model
    assert frozen.freeze(spark, path, body | {"model_id": "other"}) == made  # stored once
    with pytest.raises(ValueError, match="ledger"):
        frozen.freeze(spark, path, body | {"model_id": "other"}, [spark.range(1)], replace=True)
    assert frozen.freeze(spark, path, body | {"model_id": "other"}, [spark.range(0)], replace=True)["model_id"] == "other"
    rows = spark.createDataFrame([("a", dt.date(2000, 1, 31), 3.0, 9.0), ("a", dt.date(2000, 2, 1), 3.0, 9.0), ("b", dt.date(2000, 2, 2), 1.0, 9.0)], "asset string, date date, x double, predicted double")
    got = {(r.asset, r.date.day): r.predicted for r in frozen.extend_tape(rows, rows.drop("predicted"), made).collect()}
    assert got == {("a", 31): 9.0, ("a", 1): pytest.approx(math.exp(0.75)), ("b", 2): pytest.approx(math.exp(0.25))}
    risk = frozen.forecasts(rows.drop("predicted"), made, F.lit(0.2)).where("asset = 'b'").first()
    assert risk.tail_risk == pytest.approx(1 / (1 + math.exp(-0.25)))
    file = next((tmp_path / "model").glob("part-*"))
    for text in (file.read_text().replace("0.25", "0.26"), file.read_text().replace('{"', '{ "', 1)):
        spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.mode("overwrite").text(str(tmp_path / "broken"))
        with pytest.raises(ValueError, match="hash"):
            frozen.load(spark, str(tmp_path / "broken"))
    with pytest.raises(ValueError, match="0 artefacts"):
        frozen.load(spark, str(tmp_path / "none"))


def test_block_sums_equal_drawn_rows():
    rng = np.random.default_rng(2)
    for n in (1, 3, 19, 20, 21, 40, 100):
        v = rng.normal(size=(n, 2))
        for block in (1, 7, 20):
            starts = rng.integers(0, n, -(-n // block))
            at = ((starts[:, None] + np.arange(block)) % n).ravel()[:n]
            if block <= n:
                assert np.allclose(bootstrap.block_sums(v, starts, block), v[at].sum(axis=0)), (n, block)


def test_bootstraps_of_ratios(spark):
    rng = np.random.default_rng(4)
    rows = [(a, START + dt.timedelta(days=k), float(rng.random() * 100), 1.0 + rank, int(rng.random() < 0.3), role) for a, role in (("a", "d"), ("b", "d"), ("c", "h")) for k in range(200) for rank in [0.0]]
    rows = [(a, d, r, 2.0 if r >= 90 else 1.0, int(r >= 90), role) for a, d, r, _, _, role in rows]
    df = spark.createDataFrame(rows, "asset string, date date, rank double, ratio double, event int, role string")
    got = {(r.role, r.measure): r for r in bootstrap.weather_interval(df, "rank", "ratio", "event", "asset", "date", samples=60, by=("role",)).collect()}
    assert set(got) == {(x, m) for x in "dh" for m in ("ratio", "event")} and all(r.mean == r.low == r.high == 1.0 and r.samples == 60 for r in got.values())
    calm = bootstrap.weather_interval(df.where("rank < 90"), "rank", "ratio", "event", "asset", "date", samples=10)
    assert calm.count() == 0  # no sample has a storm
    cover = df.withColumns({"y": F.col("rank"), "bound0": F.lit(10.0), "bound1": F.lit(25.0), "bound2": F.lit(75.0), "bound3": F.lit(90.0)})
    got = {r.measure: r for r in bootstrap.coverage_interval(cover, "y", "asset", "date", samples=200).collect()}
    share = np.mean([[10 <= r[2] <= 90 for r in rows if r[0] == a] for a in "abc"])
    assert abs(got["coverage80"].mean - share) < 0.02 and got["coverage80"].low < share < got["coverage80"].high
    again = {r.measure: r for r in bootstrap.coverage_interval(cover.repartition(7), "y", "asset", "date", samples=200).collect()}
    assert {m: (r.mean, r.low) for m, r in again.items()} == {m: (pytest.approx(r.mean), pytest.approx(r.low)) for m, r in got.items()}
    delta = bootstrap.error_delta(df.withColumns({"c": F.col("ratio"), "b": F.col("ratio") + 0.5}), "c", "b", "asset", "date", samples=30).first()
    assert (delta.mean, delta.low, delta.high) == (pytest.approx(-0.5),) * 3


def test_cohort_bundle_by_hand(spark):
    rows = [("d", "a", k, 2.0, 2.5, 3.0, 0.1 + 0.8 * (k % 2), 0.5, k % 2, 10.0 if k < 5 else 95.0, 1.0 if k < 5 else 3.0, int(k >= 5), 1.0, 1.5, 2.5, 3.0) for k in range(10)]
    rows += [("d", "b", k, 2.0, 2.0, 3.0, 0.5, 0.5, 0, None, None, None, 3.0, 3.0, 4.0, 5.0) for k in range(4)]
    df = spark.createDataFrame(rows, "role string, asset string, date int, y double, predicted double, baseline double, p double, base_rate double, tail1 int, rank double, over_median double, high_event int, bound0 double, bound1 double, bound2 double, bound3 double")
    r = cohorts.bundle(df, "role").first()
    assert (r.rows, r.assets, r.mae, r.mae_delta) == (14, 2, 0.25, -0.75)
    assert (r.coverage50, r.coverage80, r.width80, r.interval_pass, r.interval_error) == (0.5, 0.5, 2.0, 0.0, 0.15)
    assert (r.storm_ratio, r.storm_event, r.auc) == (2.0, 1.0, 1.0)
    assert (r.brier, r.brier_delta) == (0.13, -0.12)
    bounds = spark.createDataFrame([("d", -0.1, -0.05, 0.0, 0.1, 1.0, None)], "role string, mae_low double, mae_high double, brier_low double, brier_high double, ratio_low double, event_low double")
    gated = cohorts.with_intervals(cohorts.bundle(df, "role"), bounds, "role")
    rates = calibration.pass_rates(gated, cohorts.fold_conditions()).first()
    assert (rates.evaluations, rates.range_bound_below_zero, rates.weather_ratio_bound_above_zero, rates.weather_event_bound_above_zero, rates.tail_bound_below_zero) == (1, 1.0, 1.0, 0.0, 0.0)
    assert calibration.layer_decisions(gated, cohorts.layer_conditions()).first().asDict() == {"range": True, "interval": False, "weather": True, "tail": True, "overall": False}
    assert cohorts.bundle(df.limit(0), "role").count() == 0


def tape(days=400):
    rng = np.random.default_rng(8)
    return [(a, START + dt.timedelta(days=k), float(rng.random() + 0.5), float(rng.random() * 2), int(rng.random() < 0.1)) for a in "ab" for k in range(days)]


def test_stream_with_trailing_state_equals_the_batch(spark, tmp_path):
    """Three landings, a restart before each, and one landing repeated."""
    rows = tape()
    schema = "asset string, date date, predicted double, y double, event int"
    df = spark.createDataFrame(rows, schema)
    common = (0.2, 0.6, 1.4, 1.8)
    folder, mark, out = (str(tmp_path / n) for n in ("in", "mark", "out"))
    for a, b in ((0, 100), (100, 101), (50, 101), (101, 400)):
        df.where((F.datediff("date", F.lit(START)) >= a) & (F.datediff("date", F.lit(START)) < b)).repartition(3).write.mode("append").parquet(folder)
        made = prediction.stream_forecasts(spark.readStream.schema(schema).parquet(folder), common, 0.1)
        made.writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {(r.asset, r.date): r for r in spark.read.schema(prediction.OUTPUT).parquet(out).collect()}
    assert len(got) == spark.read.schema(prediction.OUTPUT).parquet(out).count() == len(rows)
    table = spark.createDataFrame([("all", 1, 0.2, 0.6, 1.0, 1.4, 1.8, 2.0)], "scope string, rows int, q0 double, q1 double, q2 double, q3 double, q4 double, q5 double")
    batch = comparison.interval_schemes(df.withColumn("cluster", F.lit("x")), table, "predicted", "y").where("scheme = 'shrunk252'")
    ranks = models.trailing_reference(df, "predicted", "y")
    priors = models.trailing_prior(df, "event", F.lit(0.1))
    for r in batch.collect():
        s = got[r.asset, r.date]
        assert s.residuals == r.residuals and [s[f"bound{k}"] for k in range(4)] == [pytest.approx(r[f"bound{k}"], abs=2e-6) for k in range(4)]
    for r in ranks.collect():
        assert got[r.asset, r.date].rank == (None if r.prediction_rank is None else pytest.approx(r.prediction_rank))
    for r in priors.collect():
        assert got[r.asset, r.date].prior == pytest.approx(r.prior, abs=1e-6)


def test_interval_join(spark):
    rng = np.random.default_rng(6)
    rows = [(a, START + dt.timedelta(days=int(d))) for a in "abc" for d in rng.integers(0, 900, 60)]
    bounds = [(a, k, START + dt.timedelta(days=int(lo)), START + dt.timedelta(days=int(lo + n))) for a in "ab" for k, (lo, n) in enumerate(zip(rng.integers(-50, 950, 40), rng.integers(0, 500, 40), strict=True))]
    bounds += [("a", 100, None, START + dt.timedelta(days=100)), ("b", 101, START + dt.timedelta(days=800), None), ("c", 102, None, None), ("c", 103, START, START)]
    df = spark.createDataFrame(rows, "asset string, date date")
    got = joins.interval_join(df, spark.createDataFrame(bounds, "asset string, k int, low date, high date"), width=90)
    want = sorted((a, d, k) for a, d in rows for b, k, lo, hi in bounds if a == b and (lo is None or lo <= d) and (hi is None or d < hi))
    assert sorted((r.asset, r.date, r.k) for r in got.collect()) == want
    assert joins.interval_join(df.limit(0), spark.createDataFrame(bounds, "asset string, k int, low date, high date")).count() == 0


def test_parity_of_short_and_flat_series(spark):
    rng = np.random.default_rng(9)
    rows = []
    for a, n in (("long", 150), ("flat", 40), ("edge", 30), ("short", 29)):
        close = 100.0
        for k in range(n):
            before, close = close, close if a == "flat" else close * float(np.exp(rng.normal(0, 0.02)))
            rows.append((a, START + dt.timedelta(days=k), before, max(before, close) + 0.5, min(before, close) - 0.5, close, float(rng.integers(0, 3)) if a != "flat" else 0.0))
    bars = spark.createDataFrame(rows, "asset string, date date, open double, high double, low double, close double, volume double")
    got = parity.score_parity(bars, scores.with_score(with_indicators(bars))).collect()
    assert sorted((r.asset, r.parity) for r in got) == [("edge", True), ("flat", True), ("flat", True), ("flat", True), ("long", True), ("long", True), ("long", True)]
    moved = scores.with_score(with_indicators(bars)).withColumn("rain", F.col("rain") + 1)
    assert not any(r.parity for r in parity.score_parity(bars, moved).collect())
