"""Small fixtures of series operators."""

import datetime as dt
import json
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import scalar
from weftline.operators import audit, bootstrap, comparison, indicators, joins, ledger, metrics, models, rules, score, trailing
from weftline.sources import bars as source
from weftline.sources import payloads, sinks

START = dt.date(2020, 1, 1)


def candles(spark, closes, asset="a", **more):
    rows = [(asset, START + dt.timedelta(days=k), float(c), float(c) + 1, float(c) - 1, float(c), 10.0) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, "asset string, date date, open double, high double, low double, close double, volume double")


def values(df, *columns):
    return [tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.orderBy("date").collect()]


def test_rounding_and_clamp(spark):
    df = spark.createDataFrame([(-2.5,), (-0.125,), (2.5,), (float("nan"),), (None,)], "x double")
    assert [r[0] for r in df.limit(3).select(scalar.half_up(F.col("x"))).collect()] == [-2.0, 0.0, 3.0]
    assert df.where("x = -0.125").select(scalar.half_up(F.col("x"), 2)).first()[0] == -0.12
    assert [r[0] for r in df.select(scalar.clamp(F.col("x"))).collect()] == [0.0, 0.0, 2.5, 0.0, None]
    h = 0
    for c in "Bars 가":
        h = (h * 31 + ord(c) + 2**31) % 2**32 - 2**31
    assert spark.range(1).select(scalar.text_hash(F.lit("Bars 가"))).first()[0] == abs(h)


def test_flat_series(spark):
    got = indicators.with_features(indicators.with_indicators(candles(spark, [100] * 300))).orderBy("date").collect()
    last = got[-1]
    assert last.rsi14 == 100.0 and last.change5 == 0.0 and last.realized_vol20 == 0.0 and last.return_z252 is None and last.green_run == 0
    assert got[13].rsi14 is None and got[14].rsi14 == 100.0 and got[19].volume_ratio20 is None and got[20].volume_ratio20 == 1.0
    assert got[251].close_rank252 is None and got[252].close_rank252 == 100.0


def test_rsi_by_hand(spark):
    closes = [100, 101, 103, 102, 104, 107, 106, 108, 109, 108, 107, 109, 111, 110, 112, 113]
    steps = np.diff(closes)[-14:]
    want = 100 - 100 / (1 + steps[steps >= 0].sum() / -steps[steps < 0].sum())
    assert values(indicators.with_indicators(candles(spark, closes)), "rsi14")[-1] == pytest.approx(want)


def test_labels_and_drawdown(spark):
    got = values(indicators.with_labels(candles(spark, [100, 110, 90, 100, 100, 120])), "fwd_return1", "fwd_drawdown3", "fwd_return5")
    assert got[0] == (10.0, -11.0, 20.0) and got[5] == (None, None, None)
    assert indicators.max_drawdown(candles(spark, [100, 120, 90, 130])).first().max_drawdown == -25.0


def test_features_do_not_look_ahead(spark):
    rng = np.random.default_rng(0)
    bars = candles(spark, 100 * np.exp(np.cumsum(rng.normal(0, 0.01, 320))))
    features = lambda b: indicators.with_features(indicators.with_indicators(b))
    after = str(START + dt.timedelta(days=290))
    columns = ["rsi14", "atr14", "atr_rank252", "return_q10_756"]
    assert audit.future_change(features, bars, after, columns).isEmpty()
    assert audit.truncation_change(features, bars, after, columns).isEmpty()
    assert not audit.future_change(indicators.with_labels, bars, after, ["fwd_return5"]).isEmpty()


def test_asof_forms(spark):
    left = spark.createDataFrame([(START + dt.timedelta(days=k),) for k in (0, 5, 6, 12, 400)], "date date")
    right = spark.createDataFrame([(START + dt.timedelta(days=k), k) for k in (5, 7, 13)], "date date, v int")
    assert values(joins.asof(left, right, "date", ["v"]), "v") == [None, 5, 5, 7, 13]
    assert values(joins.asof(left, right, "date", ["v"], strict=True), "v") == [None, None, 5, 7, 13]
    assert values(joins.asof(left, right, "date", ["v"], tolerance_days=4), "v") == [None, 5, 5, None, None]


def test_purge_and_embargo(spark):
    rows = candles(spark, range(1, 61)).select("asset", "date")
    got = joins.split_by_dates(rows, str(START + dt.timedelta(days=25)), str(START + dt.timedelta(days=45)))
    assert values(got, "bucket") == ["train"] * 20 + ["purged"] * 5 + ["embargoed"] * 5 + ["validation"] * 10 + ["purged"] * 5 + ["embargoed"] * 5 + ["sealed-test"] * 10


def test_rates_without_events(spark):
    df = spark.createDataFrame([("a", False, False)] * 3, "asset string, p boolean, a boolean")
    r = metrics.confusion_rates(df.groupBy("asset").agg(*metrics.confusion_counts(F.col("p"), F.col("a")))).first()
    assert r.precision is None and r.recall is None and r.f1 is None and r.lift is None and r.specificity == 1.0


def test_ranks_with_ties(spark):
    df = spark.createDataFrame([("a", x, y) for x, y in [(1.0, 2.0), (1.0, 1.0), (2.0, 3.0), (3.0, 3.0)]], "asset string, x double, y double")
    assert metrics.spearman(df, "x", "y", ["asset"]).first().spearman == pytest.approx(np.corrcoef([1.5, 1.5, 3, 4], [2, 1, 3.5, 3.5])[0, 1], abs=1e-6)
    auc = metrics.roc_auc(df.withColumn("t", (F.col("y") >= 3).cast("int")), "x", "t", ["asset"]).first().auc
    assert auc == 1.0


def test_fits_equal_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2)) * [2, 0.5] + [1, -1]
    y = np.exp(0.3 * x[:, 0] - x[:, 1] + rng.normal(0, 0.1, 400))
    t = (x[:, 0] + rng.normal(size=400) > 1).astype(int)
    df = spark.createDataFrame([(float(a), float(b), float(c), int(d), 1.0) for (a, b), c, d in zip(x, y, t, strict=True)], "a double, b double, y double, t int, weight double")
    z = np.c_[np.ones(400), (x - x.mean(0)) / x.std(0)]
    want = np.linalg.solve(z.T @ z / 400 + np.diag([0, 0.1, 0.1]), z.T @ np.log(y) / 400)
    model = models.ridge(df, ["a", "b"], F.ln("y"), 0.1)
    assert np.allclose([model.intercept, *model.coefficients], want)
    logit = models.logistic(df, ["a", "b"], "t", 0.01)
    beta = np.array([logit.intercept, *logit.coefficients])
    gradient = z.T @ (t - 1 / (1 + np.exp(-z @ beta))) / 400 - 0.01 * np.r_[0, beta[1:]]
    assert np.abs(gradient).max() < 1e-6


def test_weights_and_quantile(spark):
    rows = spark.createDataFrame([("c", "a", 1.0), ("c", "a", 2.0), ("c", "b", 3.0), ("d", "e", 4.0)], "cluster string, asset string, v double")
    w = models.hierarchical_weights(rows, "cluster", "asset")
    assert sorted((r.v, round(r.weight, 9)) for r in w.collect()) == [(1.0, 0.5), (2.0, 0.5), (3.0, 1.0), (4.0, 2.0)]
    q = models.weighted_quantile(w.withColumn("k", F.lit(1)), "v", "weight", [0.0, 0.5, 1.0], ["k"]).first()
    want = np.interp([0, 0.5, 1], [0.0625, 0.1875, 0.375, 0.75], [1, 2, 3, 4])
    assert [q.q0, q.q1, q.q2] == pytest.approx(want, abs=1e-6)


def test_bootstrap_is_seeded(spark):
    state, want = 5, []
    for _ in range(5000):
        state = (1664525 * state + 1013904223) % 2**32
        want.append(state / 2**32)
    assert np.array_equal(bootstrap.uniform(5, 5000), want)
    df = candles(spark, range(1, 101))
    a, b = (bootstrap.mean_interval(x, "close", "asset", "date", samples=200).first() for x in (df, df.repartition(3)))
    assert a == b and a.low < a["mean"] < a.high
    assert bootstrap.mean_interval(df.limit(1), "close", "asset", "date").first().low is None


def test_ledger(spark):
    rows = spark.createDataFrame([("a", k, f"p{k}") for k in range(5)] + [("b", 1, "x")], "asset string, n int, payload string")
    chained = ledger.chained(rows, "asset", ["n"], F.col("payload"))
    assert ledger.chain_breaks(chained, "asset", F.col("payload")).isEmpty()
    bad = chained.withColumn("payload", F.when((F.col("asset") == "a") & (F.col("n") == 1), "y").otherwise(F.col("payload")))
    assert [r.n for r in ledger.chain_breaks(bad, "asset", F.col("payload")).collect()] == [1]
    before, lines = ledger.GENESIS, []
    for k in range(3):
        record = {"n": k, "v": 0.1 * k, "previousHash": before}
        record["recordHash"] = before = ledger.value_hash(record)
        lines.append((k, json.dumps(record)))
    check = lambda x: ledger.verify_json_chain(spark.createDataFrame(x, "line int, value string")).first().valid
    assert check(lines) and not check([lines[0], (1, lines[1][1].replace("0.1", "0.2")), lines[2]])


def test_ledger_in_batches(spark):
    rows = spark.createDataFrame([(a, k, f"{a}{k}") for a in ("a", "b", "c") for k in range(7)], "asset string, n int, payload string").repartition(3)
    lines, want = [], {}
    for a in ("a", "b", "c"):
        own, before = ledger.GENESIS, ledger.GENESIS
        for k in range(7):
            previous, own = own, sha256(f"{own}|{sha256(f'{a}{k}'.encode()).hexdigest()}".encode()).hexdigest()
            want[a, k] = (previous, own)
            record = {"n": k, "previousHash": before}
            record["recordHash"] = before = ledger.value_hash(record)
            lines.append((a, k, json.dumps({**record, "n": 9} if (a, k) == ("b", 4) else record)))
    held = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        chained = ledger.chained(rows, "asset", ["n"], F.col("payload"))
        checked = ledger.verify_json_chain(spark.createDataFrame(lines, "a string, line int, value string").repartition(3), chain_col="a")
        assert {(r.asset, r.n): (r.previous_hash, r.record_hash) for r in chained.collect()} == want
        assert sorted(map(tuple, checked.collect())) == [("a", 7, True), ("b", 7, False), ("c", 7, True)]
        # no task holds a whole chain
        assert all("FlatMapGroupsInPandas" not in x._jdf.queryExecution().toString() for x in (chained, checked))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", held)


def test_settlement_and_orphans(spark):
    f = spark.createDataFrame([("f1", "a", START, 1.0, 0.5, 1.0, 0.4, 2.0), ("f2", "a", START + dt.timedelta(1), 1.0, 0.5, 1.0, 0.4, 2.0)], "forecast_id string, asset string, as_of date, predicted double, low50 double, high50 double, low80 double, high80 double")
    o = spark.createDataFrame([("a", START, 1.0)], "asset string, as_of date, actual double")
    s = ledger.settle(f, o)
    assert [(r.forecast_id, r.error, r.covered50) for r in s.collect()] == [("f1", 0.0, True)]
    assert [r.forecast_id for r in ledger.not_yet(f, s, "forecast_id").collect()] == ["f2"]
    hashes = spark.createDataFrame([("f1", "h"), ("f2", "g")], "forecast_id string, record_hash string")
    settled = spark.createDataFrame([("f1", "h"), ("f2", "x"), ("f3", "y")], "forecast_id string, forecast_hash string")
    assert sorted(r.forecast_id for r in ledger.orphans(settled, hashes).collect()) == ["f2", "f3"]


def test_stale_snapshots(spark):
    now = F.lit(dt.datetime(2024, 5, 10, 12)).cast("timestamp")
    day = lambda d: dt.date(2024, 5, d)
    df = lambda rows: spark.createDataFrame(rows, "asset string, calendar string, last_date date")
    reasons = lambda rows: [r.reason for r in ledger.stale(df(rows), now).orderBy("asset").collect()]
    assert reasons([("a", "US", day(9)), ("b", "US", day(9)), ("c", "24/7", day(9))]) == []
    assert reasons([("a", "US", day(9)), ("b", "US", day(8))]) == ["not synchronised"] * 2
    assert reasons([("a", "US", day(3))]) == ["stale"] and reasons([("a", "US", day(10))]) == ["not closed"] and reasons([("c", "24/7", day(8))]) == ["not yesterday"]


def test_payloads(spark):
    chart = {"chart": {"result": [{"timestamp": [86400, 172800], "indicators": {"quote": [{"open": [1, None], "high": [2, 2], "low": [1, 1], "close": [2, 2], "volume": [None, 5]}], "adjclose": [{"adjclose": [1, 1]}]}}]}}
    df = spark.createDataFrame([(json.dumps(chart),)], "j string")
    assert [(r.time, r.close, r.volume) for r in payloads.chart_candles(df, "j").collect()] == [(86_400_000, 2.0, 0.0)]
    assert payloads.chart_candles(df, "j", adjusted=True).first().close == 1.0
    news = {"news": [{"uuid": "u", "title": "t", "link": "l", "providerPublishTime": 1, "thumbnail": {"resolutions": [{"url": "s", "width": 10}, {"url": "b", "width": 300}]}}, {"uuid": "v", "title": "", "link": "l"}]}
    assert [(r.id, r.image) for r in payloads.news_items(spark.createDataFrame([(json.dumps(news),)], "j string"), "j").collect()] == [("u", "b")]
    hits = {"quotes": [{"symbol": "A", "quoteType": "EQUITY", "exchange": "NMS", "shortname": ""}, {"symbol": "^X", "quoteType": "INDEX", "exchange": "ZZZ"}, {"symbol": "B", "quoteType": "EQUITY", "exchange": "ZZZ"}]}
    got = payloads.search_hits(spark.createDataFrame([(json.dumps(hits),)], "j string"), "j", ["EQUITY", "INDEX"], ["NMS"])
    assert [(r.symbol, r.name, r.kind) for r in got.collect()] == [("A", "A", "stock"), ("^X", "^X", "index")]


def test_candle_validation_and_sink(spark, tmp_path):
    bars = candles(spark, range(2, 122)).withColumn("n", F.col("close").cast("int"))
    again = bars.limit(1).withColumns({"close": F.lit(2.5), "n": F.lit(999)})
    bad = bars.limit(1).withColumns({"high": F.lit(-1.0), "date": F.lit(dt.date(2019, 1, 1))})
    got = source.valid_candles(bars.unionByName(again).unionByName(bad), "n")
    assert got.count() == 120 and got.where("n = 999").count() == 1
    assert sinks.write_json_lines(bars, str(tmp_path / "x")).count() == 120
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_json_lines(bars, str(tmp_path / "x"))
    assert sinks.table_digest(bars).first() == sinks.table_digest(bars.repartition(5)).first()
    assert "| a |" in sinks.markdown(bars.select("asset").limit(1), "t")


def test_news_and_views(spark):
    items = spark.createDataFrame([(0, "x", 5, "Fed rate"), (1, "y", 9, "Bitcoin up"), (2, "x", 9, "oil"), (3, "z", 1, "nothing")], "n int, id string, time int, title string")
    top = rules.top_news(items, "id", "n", "time", limit=2).collect()
    assert [(r.id, r.n, r.place) for r in top] == [("x", 2, 0), ("y", 1, 1)]
    named = items.withColumn("category", rules.news_category(F.col("title")))
    assert [r.category for r in named.orderBy("n").collect()] == ["금리·연준", "가상자산", "원자재", rules.OTHER]
    assert rules.radar(named, "category").count() == 3
    t = spark.createDataFrame([(dt.datetime(2024, 1, 6, 3),), (dt.datetime(2024, 7, 8, 14),)], "ts timestamp")
    got = {(r.ts.month, r.city): r.status for r in rules.session_status(t, "ts").collect()}
    assert got[1, "Seoul"] == "weekend" and got[7, "New York"] == "open" and got[7, "Seoul"] == "after"
    card = rules.five_day_card(candles(spark, [100, 101, 102, 103, 104, 105, 110])).first()
    assert card.trend == "up" and card.up_days == 5 and card.days == 5


def test_score_bounds(spark):
    rng = np.random.default_rng(4)
    rows = score.with_score(indicators.with_indicators(candles(spark, 100 * np.exp(np.cumsum(rng.normal(0, 0.03, 120))))))
    assert rows.count() == 91
    assert rows.where("temperature < 0 or temperature > 100 or rain < 0 or rain > 100 or weather is null or wind is null").isEmpty()
    assert score.alerts(rows).select("date").distinct().count() == 91


def test_news_sees_tickers_and_whole_words(spark):
    items = spark.createDataFrame([(0, "He said so", None), (1, "AI leads", []), (2, None, ["BTC-USD"]), (3, None, None), (4, "Crypto and Fed", ["X"]), (5, "S&P rises", None)], "n int, title string, tickers array<string>")
    got = [r.c for r in items.select("n", rules.news_category(F.col("title"), F.col("tickers")).alias("c")).orderBy("n").collect()]
    assert got == [rules.OTHER, "기술·AI", "가상자산", rules.OTHER, "가상자산", "증시"]


def test_day_icon_bounds(spark):
    cases = [(-2.4, 0.0, 0), (-2.39, 0.0, 1), (-0.1, 4.5, 0), (0.0, 9.0, 4), (-1.1, 0.0, 1), (-0.01, 3.0, 1), (-1.09, 2.9, 5), (-0.25, 0.0, 4), (0.25, 0.0, 3), (0.249, 0.0, 4), (1.2, 0.0, 2), (1.19, 0.0, 3)]
    df = spark.createDataFrame([(float(c), float(w), k) for c, w, k in cases] + [(None, 1.0, -1)], "c double, w double, k int")
    for r in df.select("*", rules.day_icon(F.col("c"), F.col("w")).alias("i")).collect():
        assert r.i == (scalar.WEATHER[r.k] if r.k >= 0 else None), r


def test_alert_bounds(spark):
    rows = [("a", 1, 70, "보통", 71, 35, "live"), ("b", 1, 69, "강함", 72, 34, "mock"), ("c", 1, 0, "돌풍", 0, 50, "live"), ("a", 2, 0, "보통", 0, 50, "live"), ("b", 2, 69, "잔잔함", 71, 35, None)]
    df = spark.createDataFrame(rows, "asset string, date int, rain int, wind string, ultraviolet int, temperature int, status string")
    got = sorted(tuple(r) for r in score.alerts(df, status="status").collect())
    assert got == sorted([("a", 1, "rain", "주의보"), ("b", 1, "mock", "안내"), ("b", 1, "wind", "주의보"), ("b", 1, "ultraviolet", "주의보"), ("b", 1, "cold", "한숨"), ("c", 1, "wind", "경보"), ("전체", 2, "calm", "안내")])
    assert score.alerts(df.limit(0)).count() == 0


def test_checklist_bounds(spark):
    base = {"direction": "long", "entry": "100", "stop": "98", "target": "103", "leverage": "1", "size": "1000", "temperature": 10, "rain": 59, "ultraviolet": 69, "wind": "보통", "weather": "흐림"}
    cases = [
        ({}, True, "calm", []),
        ({"target": "102.9"}, True, "calm", ["reward below 1.5 risks"]),
        ({"leverage": "5"}, True, "calm", ["leverage from 5"]),
        ({"leverage": "10"}, True, "caution", ["leverage from 5", "leverage from 10"]),
        ({"stop": "30", "leverage": "1", "target": "400"}, True, "calm", []),
        ({"stop": "67.5", "leverage": "2", "target": "400"}, True, "calm", []),
        ({"stop": "67", "leverage": "2", "target": "400"}, True, "calm", ["stop near liquidation"]),
        ({"rain": 60, "ultraviolet": 70}, True, "caution", ["rain", "ultraviolet"]),
        ({"rain": 60, "ultraviolet": 70, "wind": "강함", "weather": "태풍경보", "leverage": "5"}, True, "danger", ["leverage from 5", "storm", "rain", "ultraviolet", "wind"]),
        ({"stop": "101"}, False, "danger", ["stop on the wrong side"]),
        ({"direction": "short", "stop": "102", "target": "97"}, True, "calm", []),
        ({"direction": "short"}, False, "danger", ["stop on the wrong side", "target on the wrong side"]),
        ({"entry": "-1", "rain": 99}, False, "danger", ["no entry"]),
        ({"entry": "x", "stop": None, "target": "Infinity"}, False, "danger", ["no entry", "no stop", "no target"]),
    ]
    df = spark.createDataFrame([tuple({**base, **c}.values()) + (k,) for k, (c, *_) in enumerate(cases)], ", ".join(f"{n} {'int' if n in ('temperature', 'rain', 'ultraviolet') else 'string'}" for n in base) + ", k int")
    got = {r.k: r for r in score.checklist(df).collect()}
    for k, (_, valid, tone, warnings) in enumerate(cases):
        assert (got[k].valid, got[k].tone, got[k].warnings) == (valid, tone, warnings), k
    assert (got[0].reward_risk, got[0].expected_profit, got[0].expected_loss, got[3].leveraged_loss) == (1.5, 30.0, 20.0, 200.0)
    assert got[12].reward_risk is None and got[12].expected_loss is None
    assert score.checklist(df.withColumn("size", F.lit(None).cast("string"))).where("expected_profit is not null or leveraged_loss is not null").isEmpty()


def test_briefing_bounds(spark):
    df = spark.createDataFrame([(0.35, 25.0, 1.0, 56.0), (0.36, 18.0, 1.1, 55.0), (-0.35, 17.9, -1.0, 40.0), (-0.36, 24.9, -1.1, 39.0), (None, None, None, None)], "e double, f double, c double, t double")
    got = [tuple(r) for r in df.select(*score.briefing(*(F.col(c) for c in "efct")).values()).collect()]
    n, p, c = "neutral", "positive", "caution"
    assert got == [(n, c, n, p), (p, n, p, n), (n, p, n, n), (c, n, c, c), (n, n, n, n)]


def test_audit_bounds(spark):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=k) for k in range(400)]
    bars = spark.createDataFrame([("a", d, 100.0 if k != 50 else 125.0, 0.0 if k < 4 else 1.0) for k, d in enumerate(days)], "asset string, date date, close double, volume double")
    got = audit.audit(bars, None, F.lit("2021-02-04").cast("date"), regimes=(("covid", "2020-02-01", "2020-12-31", 150), ("recent", "2024-01-01", "2026-12-31", 250))).first()
    assert (got.rows, got.expected, got.coverage, got.jumps, got.gate) == (400, 400, 100.0, 1, "pass") and got.issues == "info:jumps,info:regimes recent"
    late = audit.audit(bars, None, F.lit("2021-02-06").cast("date"), minimum_years=2, regimes=(), locked=True).first()
    assert late.issues == "error:history,error:stale,info:jumps,info:locked" and late.gate == "fail"
    gone = bars.where((F.col("date") < "2020-03-01") | (F.col("date") > "2020-03-20"))
    assert audit.audit(gone, bars, F.lit("2021-02-07").cast("date"), regimes=()).first().issues == "error:coverage,error:volume,error:gap,info:jumps"
    assert audit.audit(gone, bars, F.lit("2021-02-07").cast("date"), regimes=(), volume_expected=False).first().issues == "error:coverage,error:gap,info:jumps"


def test_comparison_by_hand(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0, 2.0), ("a", 3.0, 2.0, 5.0), ("b", 2.0, 2.0, 2.0), ("b", None, 1.0, 1.0)], "k string, y double, p double, b double")
    got = {r.k: r for r in comparison.compare(df, "p", "b", "y", "k").collect()}
    assert (got["a"].rows, got["a"].candidate_mae, got["a"].baseline_mae, got["a"].mae_improvement) == (2, 0.5, 1.5, 66.666667)
    assert (got["a"].candidate_r2, got["a"].baseline_r2, got["a"].skill) == (0.5, -1.5, 0.8)
    assert (got["b"].rows, got["b"].candidate_r2, got["b"].mae_improvement, got["b"].skill) == (1, None, None, None)
    assert comparison.compare(df.limit(0), "p", "b", "y").count() == 0


def test_storms_without_alerts(spark):
    df = spark.createDataFrame([(False, False), (False, True)], "s boolean, e boolean")
    got = comparison.storm_report(df, F.col("s"), F.col("e")).first()
    assert (got.tp, got.fn, got.tn, got.precision, got.precision_low, got.lift, got.recall, got.base_rate) == (0, 1, 1, None, None, None, 0.0, 0.5)


def test_schemes(spark):
    rows = [("a", k, 1.0, 1.0 + k % 5, "x") for k in range(80)] + [("b", k, 0.0, 0.2, "y") for k in range(90)] + [("c", 0, 2.0, 2.0, "z")]
    df = spark.createDataFrame(rows, "asset string, date int, p double, y double, cluster string")
    known = df.where("asset <> 'c'")
    table = models.conformal_quantiles(known, "p", "y")
    assert {r.scope: r.rows for r in table.collect()} == {"all": 170, "in x": 80, "in y": 90}
    got = comparison.interval_schemes(df, table, "p", "y")
    assert got.count() == 4 * 171 and set(got.columns) == {*df.columns, "scheme", "residuals", "bound0", "bound1", "bound2", "bound3"}
    early = got.where("asset = 'a' and date = 59").select("scheme", "bound0", "bound3").collect()
    at = {r.scheme: (r.bound0, r.bound3) for r in early}
    assert at["rolling252"] == at["shrunk252"] == at["global"] != at["cluster"]
    late = {r.scheme: r.bound3 for r in got.where("asset = 'a' and date = 79").collect()}
    assert late["rolling252"] == late["cluster"] == 5.0 < late["shrunk252"] < late["global"] == 20.0
    assert len({(r.bound0, r.bound3) for r in got.where("asset = 'c'").collect()}) == 1  # a cluster that was not known has the bounds of all
    chosen = comparison.scheme_metrics(got, "y")
    assert chosen.count() == 4 and chosen.where("chosen").count() == 1
    assert {r.pass_rate for r in comparison.pass_rate(got, "y", most=1.0).collect()} == {1.0}


def test_bounds_do_not_look_ahead(spark):
    """Later outcomes, those of the judged rows included, change no bound."""
    rng = np.random.default_rng(1)
    rows = [(a, dt.date(2000, 1, 1) + dt.timedelta(days=k), 1.0, float(rng.exponential()), a[0], "development" if a != "y1" else "holdout") for a in ("x1", "x2", "y1", "y2") for k in range(300)]
    df = spark.createDataFrame(rows, "asset string, date date, p double, y double, cluster string, role string")

    def bounds(rows):
        table = models.conformal_quantiles(models.known_before(rows, "2000-07-01"), "p", "y")
        judged = comparison.interval_schemes(rows, table, "p", "y").where("date >= '2000-07-01' and date <= '2000-09-01'")
        return sorted(tuple(r) for r in judged.select("asset", "date", "scheme", "bound0", "bound1", "bound2", "bound3").collect())

    plain = bounds(df)
    assert len(plain) == 4 * 4 * 63
    assert bounds(df.withColumn("y", F.when(F.col("date") >= "2000-09-01", F.col("y") * 9).otherwise(F.col("y")))) == plain
    held = F.when((F.col("role") == "holdout") & (F.col("date") < "2000-07-01"), F.col("y") * 9).otherwise(F.col("y"))
    other = [r for r in bounds(df.withColumn("y", held)) if r[2] in ("global", "cluster")]
    assert other == [r for r in plain if r[2] in ("global", "cluster")]  # what is held out calibrates nothing


def brute_quantile(pairs, q):
    pairs = sorted(pairs)
    v, w = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
    return float(np.interp(q, (np.cumsum(w) - w / 2) / w.sum(), v))


def test_weighted_quantiles(spark):
    rng = np.random.default_rng(7)
    groups = {
        "many": [(float(x), float(w)) for x, w in zip(rng.normal(size=5000).round(3), rng.random(5000) + 0.01, strict=True)],
        "ties": [(float(x), float(w)) for x, w in zip(rng.integers(0, 4, 300), rng.random(300) + 0.01, strict=True)],
        "one": [(2.5, 1.0)], "two": [(1.0, 1.0), (3.0, 9.0)], "same": [(4.0, 1.0)] * 7, "wide": [(1e9, 1.0), (-1e9, 1.0), (0.0, 100.0)],
    }
    rows = [(k, v, w) for k, pairs in groups.items() for v, w in pairs] + [("one", None, 1.0), ("two", 5.0, 0.0), ("gone", 1.0, None)]
    points = [0.0, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 1.0]
    got = {r.k: r for r in models.weighted_quantile(spark.createDataFrame(rows, "k string, v double, w double").repartition(7), "v", "w", points, ["k"], 9).collect()}
    assert set(got) == set(groups)
    for k, pairs in groups.items():
        assert got[k].rows == len(pairs)
        for i, q in enumerate(points):
            assert abs(got[k][f"q{i}"] - brute_quantile(pairs, q)) < 1e-6 * max(1.0, abs(got[k][f"q{i}"])), (k, q)
    assert models.weighted_quantile(spark.createDataFrame([], "k string, v double, w double"), "v", "w", points, ["k"]).count() == 0


def brute_trailing(values, n):
    """Rank and median among the n before, from lists."""
    out = []
    for i, x in enumerate(values):
        past = values[max(0, i - n) : i]
        rank = None if len(past) < n or None in past or x is None else 100.0 * sum(p <= x for p in past) / n
        known = [p for p in past if p is not None]
        out.append((rank, float(np.quantile(known, 0.3)) if len(known) >= 3 else None))
    return out


def test_trailing_in_chunks(spark):
    """Chunks change nothing, and a long series is cut into many."""
    rng = np.random.default_rng(5)
    series = {"a": [float(x) for x in rng.integers(0, 9, 400)], "b": [None if rng.random() < 0.05 else float(x) for x in rng.normal(size=333)], None: [1.0, 2.0], "c": [5.0]}
    rows = [(k, i, v) for k, values in series.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "asset string, date int, v double").withColumn("own", F.lit("x"))
    wanted = [trailing.Rank("rank", "v", "v", 20), trailing.Quantiles(("low",), "v", (0.3,), 31, 3)]
    for chunk in (1, 7, 64, 8192):
        got = {(r.asset, r.date): r for r in trailing.with_trailing(df, wanted, chunk=chunk).collect()}
        assert len(got) == len(rows) and got["a", 0].own == "x"
        for k, values in series.items():
            ranks, lows = brute_trailing(values, 20), brute_trailing(values, 31)
            for i in range(len(values)):
                r = got[k, i]
                assert r.rank == (None if ranks[i][0] is None else pytest.approx(ranks[i][0])) and r.low == (None if lows[i][1] is None else pytest.approx(lows[i][1])), (k, i, chunk)
    placed = trailing.with_trailing(spark.range(100_000).selectExpr("'a' as asset", "id as date", "id * 1.0 as v"), [trailing.Rank("rank", "v", "v")])
    assert placed.where("rank = 100").count() == 100_000 - 252
    assert trailing.with_trailing(df.limit(0), wanted).count() == 0
