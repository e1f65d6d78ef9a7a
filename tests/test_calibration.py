"""Folds, calibrators, gates, contracts and scans against small cases by hand."""

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.operators import audit, calibration, models, prospective, rules
from weftline.sources import scans


def panel(spark, n=900):
    rng = np.random.default_rng(3)
    rows = []
    for asset, cluster in (("a1", "a"), ("a2", "a"), ("b1", "b")):
        for i in range(n if asset != "a2" else n // 2):
            x, z = float(rng.normal(2, 1)), float(rng.normal(-1, 2))
            rows.append((asset, cluster, date(2000, 1, 1) + timedelta(days=i), x, z, math.exp(0.3 * x - 0.1 * z + float(rng.normal(0, 0.2))), int(rng.random() < 1 / (1 + math.exp(-z)))))
    return spark.createDataFrame(rows, "asset string, cluster string, date date, x double, z double, y double, hit int")


def test_folds_know_only_past_outcomes(spark):
    folds = calibration.yearly_folds(panel(spark))
    year = folds.where("asset = 'a1' and fold = 2000").orderBy("date").collect()
    assert [r.known for r in year[-6:]] == [2000] + [2001] * 5
    assert [r.settled for r in year[:7]] == [False] * 5 + [True] * 2
    last = folds.where("asset = 'a1'").orderBy(F.desc("date")).limit(5).collect()
    assert all(r.known is None for r in last)
    audit_rows = {r.fold: r for r in calibration.fold_audit(folds).collect()}
    assert set(audit_rows) == {2001, 2002} and all(r.causal for r in audit_rows.values())
    assert audit_rows[2001].train_rows == 3 * (366 - 5)
    assert audit_rows[2001].last_learned == date(2000, 12, 26)


def test_ridge_of_each_fold_equals_the_weighted_fit(spark):
    folds = calibration.yearly_folds(panel(spark)).withColumn("target", F.ln("y")).cache()
    got = calibration.ridge_folds(folds, ["x", "z"], F.col("target"), 0.1)
    assert set(got) == {2001, 2002}
    for fold, model in got.items():
        rows = models.hierarchical_weights(folds.where(F.col("known") < fold), "cluster", "asset")
        want = models.ridge(rows, ["x", "z"], F.col("target"), 0.1)
        assert np.allclose(model.coefficients, want.coefficients, atol=1e-9) and math.isclose(model.intercept, want.intercept, abs_tol=1e-9)
    tape = calibration.ridge_tape(folds, got)
    assert tape.count() == folds.where("settled and fold > 2000").count() == tape.select("asset", "date").distinct().count()
    assert [n for n, _ in calibration.top_coefficients(got[2001], 1)] == ["x"]


def test_folds_without_past(spark):
    folds = calibration.yearly_folds(panel(spark, 100))
    assert calibration.ridge_folds(folds, ["x"], F.col("z"), 0.1) == {}
    assert calibration.ridge_tape(folds, {}).isEmpty()
    assert calibration.fold_audit(folds).isEmpty()


def test_calibrators(spark):
    rows = panel(spark).withColumns({"p": 1.0 / (1.0 + F.exp(-F.col("z") * 3.0)), "weight": F.lit(1.0)}).cache()  # three times too sure
    platt = calibration.fit_calibrator(rows, "platt", "p", "hit", 1e-6)
    slope = platt.coefficients[0] / platt.scaling["_logit"][1]
    assert 0.25 < slope < 0.42
    beta = calibration.fit_calibrator(rows, "beta", "p", "hit", 1e-6)
    assert calibration.never_falls(spark, platt) and calibration.never_falls(spark, beta)
    falling = models.LinearModel(platt.columns, platt.scaling, [-1.0], 0.0, 0.0)
    assert not calibration.never_falls(spark, falling)
    brier = calibration.calibrated(rows, platt, "p", "q").agg(F.avg((F.col("q") - F.col("hit")) ** 2), F.avg((F.col("p") - F.col("hit")) ** 2)).first()
    assert brier[0] < brier[1]


def test_record_fallbacks(spark):
    rows = spark.createDataFrame([("a", None, float("nan"), float("-inf"), -80.0), ("b", 0.0, 70.0, 0.5, -1.0)], "asset string, atr14 double, rsi14 double, return_z252 double, drawdown63 double")
    a, b = calibration.model_record(rows, "asset").orderBy("asset").collect()
    assert (a.log_atr, a.rsi_share, a.return_z, a.drawdown_atr) == (round(math.log(0.01), 6), 0.5, 0.0, -30.0)
    assert (b.log_atr, b.rsi_share, b.abs_return_z, b.drawdown_atr) == (round(math.log(0.01), 6), 0.7, 0.5, -30.0)
    assert (a.breadth_up_share, a.rain_p, a.log_proxy) == (0.5, 0.001, 0.0)


def test_gates_and_decisions(spark):
    rows = spark.createDataFrame([(-1.0, 1.0), (-1.0, None), (2.0, -1.0), (-1.0, -1.0)], "m double, b double")
    rates = calibration.pass_rates(rows, {"m": F.col("m") < 0, "b": F.col("b") < 0})
    assert calibration.decide(rates, {"m": 0.75, "b": 0.5}).first().asDict() == {"evaluations": 4, "m": 0.75, "b": 0.5, "passed": True}
    assert not calibration.decide(rates, {"b": 0.51}).first().passed
    assert not calibration.decide(calibration.pass_rates(rows.where("false"), {"m": F.col("m") < 0}), {"m": 0.0}).first().passed
    layers = {"m": F.col("m") < 3, "b": F.col("b") < 3}
    assert calibration.layer_decisions(rows, layers).first().asDict() == {"m": True, "b": False, "overall": False}
    assert not calibration.layer_decisions(rows.where("false"), layers).first().overall
    got = spark.createDataFrame([(-2.0, -1.0), (1.0, 2.0), (-1.0, 1.0), (-1.0, 0.0)], "lo double, hi double").select(calibration.deployment(F.col("lo"), F.col("hi")).alias("d"))
    assert [r.d for r in got.collect()] == ["deploy", "reject", "keep baseline", "keep baseline"]


def test_contract(spark):
    d = date(2024, 1, 9)
    inference = spark.createDataFrame(
        [("ok", d, True, d, d - timedelta(1), False), ("coin", d, True, d, None, False), ("late", d, False, d + timedelta(1), None, True), ("twice", d, False, None, None, False), ("twice", d, False, None, None, False), ("lost", d, False, None, None, False)],
        "asset string, date date, us_close boolean, context_last date, coin_last date, has_labels boolean",
    )
    sources = spark.createDataFrame([(a, d) for a in ("ok", "coin", "late", "twice")], "asset string, last_closed date")
    resolved = spark.createDataFrame([("ok", d - timedelta(1)), ("twice", d)], "asset string, date date")
    got = sorted((r.asset, r.reason) for r in prospective.contract_breaks(inference, sources, resolved).collect())
    assert got == [("coin", "coin context of the day"), ("late", "has labels"), ("late", "later context"), ("lost", "not the last close"), ("twice", "duplicate"), ("twice", "resolved overlaps")]


def test_policy_is_made_once(spark, tmp_path):
    path, body = str(tmp_path / "policy"), {"scale": 0.9, "checkpoints": [60, 120]}
    none, some = spark.range(0), spark.range(1)
    with pytest.raises(ValueError, match="after outcomes"):
        prospective.ensure_policy(spark, path, body, some)
    made = prospective.ensure_policy(spark, path, body, none)
    assert prospective.ensure_policy(spark, path, {"scale": 1.0}, some) == made
    changed = str(tmp_path / "changed")
    spark.createDataFrame([('{"scale": 2.0, "policy_sha256": "' + made["policy_sha256"] + '"}',)], "value string").write.text(changed)
    with pytest.raises(ValueError, match="hash"):
        prospective.ensure_policy(spark, changed, body, none)


def test_benchmarks_need_their_history(spark):
    rows = spark.createDataFrame([("a", i, float(i), 2.0) for i in range(6)], "asset string, date int, y double, b double")
    got = prospective.benchmarks(rows, "b", "y", 0.5, n=4).orderBy("date").collect()
    assert [(r.date, r.base_scaled, r.last_outcome, r.median) for r in got] == [(4, 1.0, 3.0, 1.5), (5, 1.0, 4.0, 2.5)]


def test_checks_find_faults(spark):
    rows = spark.createDataFrame([("a", 1, 10.0, 10.0, 1.0, 1.0, 50.0), ("a", 2, 11.0, 5.0, 1.0, float("nan"), 50.0), ("a", 3, 11.0, 0.0, 1.0, 1.0, 50.0), ("b", 1, 1.0, 0.0, 1.0, 1.0, 50.0), ("b", 1, 1.0, 0.0, 1.0, 1.0, 50.0)], "asset string, date int, close double, fwd_return1 double, fwd_return5 double, next_true_range double, temperature double")
    got = {r.asset: (r.chronological, r.aligned, r.finite) for r in audit.series_checks(rows).collect()}
    assert got == {"a": (True, False, False), "b": (False, True, True)}


def test_rules_of_views(spark):
    one = spark.range(1)
    with pytest.raises(Exception, match="outside of the split: 1999-06-01"):
        one.select(rules.time_bucket(F.lit("1999-06-01").cast("date"), "1996-12-31", "1997-01-01", "1998-12-31", "2000-01-01")).collect()
    text = lambda *v: list(one.select(*rules.situation_texts(*(F.lit(x).cast("double") for x in v)).values()).first())
    assert text(0.35, 0.35, 18, 0.25) == ["미국 증시 혼조", "달러 보합", "변동성 주의"]
    assert text(0.8, -0.05, 25, -0.3) == ["미국 증시 강세", "달러 약세", "변동성 경계"]
    assert text(None, 1, None, None) == ["미국 증시 확인 중", "달러 흐름 확인 중", "변동성 확인 중"]
    tone = lambda s, k=None: one.select(rules.station(F.lit(s).cast("string"), F.lit(k).cast("string")).alias("s")).first().s
    assert [tone(s).tone for s in ("^ks11", "7203.T", "VOD.L", "0700.HK", "SAP.DE", "^GDAXI", "AAPL")] == ["kr", "jp", "gb", "hk", "eu", "eu", "us"]
    assert tone("solusdt", "crypto").tone == "sol" and tone(None) is None and tone(None, "crypto").tone == "crypto"
    flat = spark.createDataFrame([("a", i, 10.0) for i in range(8)] + [("b", 1, 3.0)], "asset string, date int, close double")
    got = rules.pulse(flat).collect()
    assert len(got) == 5 and all((r.change, r.height, r.total) == (0.0, 0.0, 0.0) for r in got)


def test_scans(spark, tmp_path):
    pages = spark.createDataFrame([("a", 1, [1, 2]), ("a", 2, [3]), ("a", 3, []), ("b", 1, [5])], "k string, p int, r array<int>")
    assert sorted(r.row for r in scans.paged(pages, "k", "p", "r", F.col("row")).collect()) == [1, 2, 3, 5]
    stuck = pages.unionByName(spark.createDataFrame([("a", 4, [3])], pages.schema))
    with pytest.raises(Exception, match="a: pages do not advance"):
        scans.paged(stuck, "k", "p", "r", F.col("row")).collect()
    path = str(tmp_path / "json")
    spark.createDataFrame([('{"a": 1}',), ('{"a": "x"}',)], "value string").write.text(path)
    with pytest.raises(Exception, match="(?i)malformed"):
        scans.strict_json(spark, path, "a int").collect()
    got = scans.scorable(spark.range(1), ["y"]).first()
    assert (got.id, got.y) == (0, 0.0)
    with pytest.raises(ValueError, match="not one of"):
        scans.visible(spark.range(1), "other")


def test_patterns_of_words_and_groups(spark):
    one = spark.createDataFrame([("a gold-rush",), ("s&p falls",), ("said",), ("an ai",), ("xbz",), (None,)], "t string")
    with_rules = lambda *p: [r.c for r in one.select(rules.news_category(F.col("t"), rules=tuple((x, x) for x in p)).alias("c")).collect()]
    o = rules.OTHER
    assert with_rules("gold-rush|s&p") == ["gold-rush|s&p"] * 2 + [o] * 4
    assert with_rules(r"\bai\b|nothing") == [o, o, o, r"\bai\b|nothing", o, o]
    assert with_rules("x(a|b)z") == [o, o, o, o, "x(a|b)z", o]
    assert with_rules("x[a|b]z|fall") == [o, "x[a|b]z|fall", o, o, "x[a|b]z|fall", o]
