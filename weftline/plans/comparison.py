"""Queries that compare forecasts, and of helpers of views and ledgers."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import scalar
from weftline.functions.scalar import half_up, weather_grade
from weftline.operators import audit, comparison, indicators, joins, ledger, models, rules
from weftline.operators.trailing import Rank, with_trailing
from weftline.plans.evaluation import _FORECASTS, _GRADES, _graded, settlements
from weftline.plans.reference_sql import chain
from weftline.plans.reference_sql import half_up as h
from weftline.plans.series import indicator_rows, observations, panel_rows, score_rows
from weftline.sources import bars as source
from weftline.sources import payloads

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def register(f):
        QUERIES[name] = f
        SQL[name] = sql
        return f

    return register


# forecasts of the next true range: 0.93 of the ATR against the ATR
_PAIR = {"e": f"SELECT asset, next_true_range AS y, {h('atr14 * 0.93e0', 6)} AS p, atr14 AS b FROM obs WHERE next_true_range IS NOT NULL AND atr14 IS NOT NULL"}
_ONE = "count(*) AS rows, " + ", ".join(f"avg(abs(y - {c})) AS {n}_mae, sqrt(avg((y - {c}) * (y - {c}))) AS {n}_rmse, 1.0 - sum((y - {c}) * (y - {c})) / (var_pop(y) * count(*)) AS {n}_r2" for n, c in (("candidate", "p"), ("baseline", "b")))
_MEASURES = [f"{n}_{m}" for n in ("candidate", "baseline") for m in ("mae", "rmse", "r2")]
_BETTER = ", ".join([*(f"{h(m, 6)} AS {m}" for m in _MEASURES), f"{h('100.0 * (baseline_mae - candidate_mae) / baseline_mae', 6)} AS mae_improvement", f"{h('100.0 * (baseline_rmse - candidate_rmse) / baseline_rmse', 6)} AS rmse_improvement", f"{h('candidate_r2 - baseline_r2', 6)} AS r2_delta", f"{h('1.0 - (candidate_rmse * candidate_rmse) / (baseline_rmse * baseline_rmse)', 6)} AS skill"])


def _pair(spark, sf_dir):
    rows = observations(spark, sf_dir)
    return rows.select("asset", F.col("next_true_range").alias("y"), half_up(F.col("atr14") * 0.93, 6).alias("p"), F.col("atr14").alias("b"))


@query("comparison_by_asset", chain("obs", more=_PAIR | {"m": f"SELECT asset, {_ONE} FROM e GROUP BY asset"}) + f"SELECT asset, rows, {_BETTER} FROM m")
def comparison_by_asset(spark, sf_dir):
    return comparison.compare(_pair(spark, sf_dir), "p", "b", "y", "asset")


@query("comparison_pooled", chain("obs", more=_PAIR | {"m": f"SELECT {_ONE} FROM e"}) + f"SELECT rows, {_BETTER} FROM m")
def comparison_pooled(spark, sf_dir):
    return comparison.compare(_pair(spark, sf_dir), "p", "b", "y")


@query("comparison_macro", chain("obs", more=_PAIR | {"m": f"SELECT asset, {_ONE} FROM e GROUP BY asset", "n": f"SELECT asset, {_BETTER} FROM m"}) + f"SELECT count(*) AS groups, {h('avg(mae_improvement)', 6)} AS mae_improvement, {h('avg(rmse_improvement)', 6)} AS rmse_improvement, {h('avg(skill)', 6)} AS skill FROM n")
def comparison_macro(spark, sf_dir):
    return comparison.macro(comparison_by_asset(spark, sf_dir), "mae_improvement", "rmse_improvement", "skill")


_HITS = _GRADES | {
    "a0": "SELECT asset, date, next_true_range AS y, list(next_true_range) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING) AS ys FROM panel",
    "a1": f"SELECT asset, date, y, {h('len(list_filter(ys, lambda x: x <= y)) * 100.0 / 252', 6)} AS ar FROM a0 WHERE len(ys) = 252",
    "a2": "SELECT w.grade AS grade, y, high_event, CASE w.grade WHEN 'calm' THEN 1 WHEN 'normal' THEN 2 WHEN 'rough' THEN 3 ELSE 4 END AS o, CASE WHEN ar < 25 THEN 1 WHEN ar < 75 THEN 2 WHEN ar < 90 THEN 3 ELSE 4 END AS ao FROM w JOIN a1 USING (asset, date)",
}


def _judged(spark, sf_dir):
    """Graded forecasts with the grade of what came, among the 252 values before it."""
    rows = _graded(spark, sf_dir)
    outcomes = panel_rows(spark, sf_dir).select("asset", "date", "next_true_range")
    panel = with_trailing(outcomes, [Rank("_rank", "next_true_range", "next_true_range")]).where("_rank is not null")
    rank = half_up(F.col("_rank"), 6)
    return rows.select("asset", "date", "grade", "high_event", "prior_median", "next_true_range").join(panel.select("asset", "date", weather_grade(rank).alias("actual_grade")), ["asset", "date"])


@query(
    "grade_hits",
    chain("panel", more=_HITS)
    + f"SELECT grade, count(*) AS rows, {h('avg(y)', 6)} AS mean_actual, {h('quantile_cont(y, 0.5)', 6)} AS median_actual, {h('avg(CAST(o = ao AS INT))', 6)} AS exact, {h('avg(CAST(abs(o - ao) <= 1 AS INT))', 6)} AS within_one, {h('avg(high_event)', 6)} AS event_rate, {h('count(*) / CAST((SELECT count(*) FROM a2) AS DOUBLE)', 6)} AS share FROM a2 GROUP BY grade",
)
def grade_hits(spark, sf_dir):
    return comparison.grade_hits(_judged(spark, sf_dir), "grade", "actual_grade", "next_true_range", "high_event")


_Z2 = "3.8414588206941245e0"


def _wilson(k: str, n: str, sign: str) -> str:
    p = f"(CAST({k} AS DOUBLE) / {n})"
    return f"CASE WHEN {n} > 0 THEN {h(f'({p} + {_Z2} / (2.0 * {n}) {sign} 1.959963984540054e0 * sqrt({p} * (1.0 - {p}) / {n} + {_Z2} / (4.0 * {n} * {n}))) / (1.0 + {_Z2} / {n})', 6)} END"


@query(
    "storm_report",
    chain("panel", more=_GRADES | {"c": "SELECT asset, count(*) AS rows, count_if(grade = 'storm' AND high_event = 1) AS tp, count_if(grade = 'storm' AND high_event = 0) AS fp, count_if(grade <> 'storm' AND high_event = 1) AS fn, count_if(grade <> 'storm' AND high_event = 0) AS tn FROM w GROUP BY asset", "d": "SELECT *, CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS p, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS r, CAST(tn AS DOUBLE) / nullif(tn + fp, 0) AS s, CAST(tp + fn AS DOUBLE) / rows AS base FROM c"})
    + f"""SELECT asset, rows, tp, fp, fn, tn, {h('p', 6)} AS "precision", {h('r', 6)} AS recall, {h('s', 6)} AS specificity, {h('base', 6)} AS base_rate, {_wilson('tp', '(tp + fp)', '-')} AS precision_low, {_wilson('tp', '(tp + fp)', '+')} AS precision_high, {_wilson('tp', '(tp + fn)', '-')} AS recall_low, {_wilson('tp', '(tp + fn)', '+')} AS recall_high, {h('2.0 * p * r / nullif(p + r, 0)', 6)} AS f1, {h('p / nullif(base, 0)', 6)} AS lift FROM d""",
)
def storm_report(spark, sf_dir):
    return comparison.storm_report(_graded(spark, sf_dir), F.col("grade") == "storm", F.col("high_event") == 1, "asset")



@query("pooled_weather", chain("obs") + f"SELECT weather, count(*) AS rows, {h('avg(fwd_return3)', 6)} AS mean FROM obs WHERE asset <> 'RF' GROUP BY weather")
def pooled_weather(spark, sf_dir):
    """All series but the risk proxy in one pool."""
    return observations(spark, sf_dir).where("asset <> 'RF'").groupBy("weather").agg(F.count("*").alias("rows"), half_up(F.avg("fwd_return3"), 6).alias("mean"))


@query("equal_weather", chain("obs", more={"g": "SELECT asset, weather, count(*) AS n, avg(fwd_return3) AS m FROM obs WHERE asset <> 'RF' GROUP BY ALL HAVING count(*) >= 20"}) + f"SELECT weather, count(*) AS series, CAST(sum(n) AS BIGINT) AS rows, {h('avg(m)', 6)} AS mean FROM g GROUP BY weather")
def equal_weather(spark, sf_dir):
    return comparison.equal_groups(observations(spark, sf_dir).where("asset <> 'RF'"), "weather", "fwd_return3")


@query("rows_for_keys", chain("ind") + "SELECT asset, date, close FROM ind WHERE EXISTS (SELECT 1 FROM orders WHERE CAST(o_orderdate AS DATE) = date)")
def rows_for_keys(spark, sf_dir):
    keys = source.read(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("date"))
    return comparison.within_keys(indicator_rows(spark, sf_dir), keys, "date").select("asset", "date", "close")


@query("adjusted_history", f"SELECT o_orderkey, {h('o_totalprice * (CASE WHEN o_orderkey % 3 = 0 THEN 1.0 ELSE 0.5 END)', 4)} AS close, 2e0 AS volume FROM orders")
def adjusted_history(spark, sf_dir):
    """Orders as chart payloads with an adjusted close of half the price, or none."""
    o = source.read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("p"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice") * 0.5).alias("adj"))
    quote = F.struct(*(F.array("p").alias(c) for c in ("open", "high", "low", "close")), F.array(F.lit(2.0)).alias("volume"))
    result = F.struct(F.array(F.lit(86400)).alias("timestamp"), F.struct(F.array(quote).alias("quote"), F.array(F.struct(F.array("adj").alias("adjclose"))).alias("adjclose")).alias("indicators"))
    text = F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart")))
    got = payloads.chart_candles(o.select("o_orderkey", text.alias("payload")), "payload", adjusted=True)
    return got.select("o_orderkey", half_up(F.col("close"), 4).alias("close"), "volume")


@query("news_payload", "SELECT CAST(doc_id AS VARCHAR) AS id, text AS title, CASE WHEN doc_id % 2 = 0 THEN 'wide' ELSE 'small' END AS image FROM documents WHERE coalesce(text, '') <> '' AND doc_id % 5 <> 0")
def news_payload(spark, sf_dir):
    """Documents as news payloads, some without a link; the image is the first of at least 300, else the first."""
    d = source.read(spark, sf_dir, "documents")
    image = lambda url, width: F.struct(F.lit(url).alias("url"), width.cast("int").alias("width"), F.lit(1).alias("height"))
    images = F.array(image("small", F.lit(100)), image("wide", F.when(F.col("doc_id") % 2 == 0, 300).otherwise(299)))
    item = F.struct(F.col("doc_id").cast("string").alias("uuid"), F.col("text").alias("title"), F.col("source").alias("publisher"), F.when(F.col("doc_id") % 5 != 0, "l").otherwise("").alias("link"), F.lit(1).alias("providerPublishTime"), F.struct(images.alias("resolutions")).alias("thumbnail"))
    got = payloads.news_items(d.select(F.to_json(F.struct(F.array(item).alias("news"))).alias("payload")), "payload")
    return got.select("id", "title", "image")


@query("symbol_search", "SELECT 'C' || c_custkey AS symbol, c_name AS name, CASE WHEN c_custkey % 4 = 0 THEN 'index' ELSE 'stock' END AS kind FROM customer WHERE c_custkey % 4 = 0 OR c_custkey % 4 = 1")
def symbol_search(spark, sf_dir):
    """Customers as quotes: indices, stocks on a wanted exchange, and others that go."""
    c = source.read(spark, sf_dir, "customer")
    rest = F.col("c_custkey") % 4
    quote = F.struct(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("symbol"), F.lit("").alias("shortname"), F.col("c_name").alias("longname"), F.when(rest == 0, "INDEX").when(rest == 3, "OPTION").otherwise("EQUITY").alias("quoteType"), F.when(rest == 2, "XXX").otherwise("NYQ").alias("exchange"))
    got = payloads.search_hits(c.select(F.to_json(F.struct(F.array(quote).alias("quotes"))).alias("payload")), "payload", ["INDEX", "EQUITY"], ["NYQ"])
    return got.select("symbol", "name", "kind")


@query("orphan_settlements", "SELECT l_orderkey AS forecast_id, CAST(sum(l_linenumber) AS BIGINT) AS forecast_hash FROM lineitem GROUP BY l_orderkey HAVING l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 7 <> 0) OR sum(l_linenumber) <> 6")
def orphan_settlements(spark, sf_dir):
    """Orders' lines as settlements: those without a forecast of their id and hash."""
    s = source.read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("forecast_id")).agg(F.sum("l_linenumber").alias("forecast_hash"))
    f = source.read(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0").select(F.col("o_orderkey").alias("forecast_id"), F.lit(6).cast("long").alias("record_hash"))
    return ledger.orphans(s, f).select("forecast_id", "forecast_hash")


@query("dedupe_either", "SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT' AND o_orderkey % 5 = 0) AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def dedupe_either(spark, sf_dir):
    """Customers that agree with an existing row in neither of two keys."""
    o = source.read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_orderkey % 5 = 0").select(F.col("o_custkey").alias("c_custkey"), F.lit(None).cast("int").alias("c_nationkey"))
    n = source.read(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.lit(None).cast("long").alias("c_custkey"), F.col("n_nationkey").alias("c_nationkey"))
    return joins.dedupe_either(source.read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), o.unionByName(n), "c_custkey", "c_nationkey")


@query(
    "forecast_labels",
    chain("panel", more=_GRADES)
    + f"SELECT asset, date, CASE WHEN rank >= 90 THEN 'top ' || CAST(greatest(1, ceil(100.0 - rank)) AS INT) || '%' WHEN rank >= 75 THEN 'high' WHEN rank < 25 THEN 'low' ELSE 'usual' END AS label, {h('greatest(atr14 * 1.6e0 * 1.12e0, atr14 * 1.25e0, 0.1e0)', 6)} AS band, CASE WHEN date_diff('day', date, DATE '2001-11-05') <= (CASE WHEN asset = 'AF' THEN 4 ELSE 1 END) THEN 'fresh' ELSE 'old' END AS age FROM w JOIN panel USING (asset, date)",
)
def forecast_labels(spark, sf_dir):
    age = F.datediff(F.lit("2001-11-05").cast("date"), F.col("date"))
    return _graded(spark, sf_dir).select("asset", "date", rules.rank_label(F.col("prediction_rank")).alias("label"), half_up(rules.band(F.col("atr14"), F.col("atr14") * 1.6), 6).alias("band"), rules.freshness(age, F.col("asset") == "AF").alias("age"))


@query(
    "shifted_probability",
    chain("panel", more={"p": "SELECT asset, date, greatest(0.02e0, least(0.98e0, rain / 100.0)) AS p, (coalesce(sum(tail1) OVER w, 0) + 10e0) / (count(tail1) OVER w + 100e0) AS prior FROM panel WINDOW w AS (PARTITION BY asset ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)"})
    + f"SELECT asset, date, {h('1.0 / (1.0 + exp(-(ln(p / (1.0 - p)) + 0.5e0 * (ln(prior / (1.0 - prior)) - ln(0.1e0 / 0.9e0)))))', 5)} AS p FROM p",
)
def shifted_probability(spark, sf_dir):
    rows = models.trailing_prior(panel_rows(spark, sf_dir, indicators.TAIL).withColumn("p", F.greatest(F.lit(0.02), F.least(F.lit(0.98), F.col("rain") / 100.0))), "tail1", F.lit(0.1))
    return rows.select("asset", "date", half_up(models.shifted_probability(F.col("p"), F.col("prior"), F.lit(0.1), 0.5), 5).alias("p"))


@query("panel_gates", chain("panel") + "SELECT bool_and(next_true_range >= 0) AS ranges, bool_and(temperature BETWEEN 0 AND 100) AS scores, bool_and(fwd_drawdown5 <= fwd_drawdown3) AS nested, bool_and(rsi14 < 50) AS calm, bool_and(next_true_range >= 0 AND temperature BETWEEN 0 AND 100 AND fwd_drawdown5 <= fwd_drawdown3 AND rsi14 < 50) AS passed FROM panel")
def panel_gates(spark, sf_dir):
    checks = {"ranges": F.col("next_true_range") >= 0, "scores": F.col("temperature").between(0, 100), "nested": F.col("fwd_drawdown5") <= F.col("fwd_drawdown3"), "calm": F.col("rsi14") < 50}
    return audit.gates(checks, panel_rows(spark, sf_dir))


@query(
    "stale_rows",
    "SELECT * FROM (SELECT c_custkey, CASE WHEN d > DATE '2024-01-10' THEN 'ahead' WHEN us AND lo <> hi THEN 'not synchronised' WHEN NOT us AND d <> DATE '2024-01-09' THEN 'not yesterday' END AS reason FROM (SELECT *, min(CASE WHEN us THEN d END) OVER () AS lo, max(CASE WHEN us THEN d END) OVER () AS hi FROM (SELECT c_custkey, c_custkey % 2 = 0 AS us, DATE '2024-01-10' - CAST(c_custkey % 4 AS INT) AS d FROM customer))) WHERE reason IS NOT NULL",
)
def stale_rows(spark, sf_dir):
    """Customers as snapshot rows of two calendars whose dates disagree."""
    c = source.read(spark, sf_dir, "customer")
    day = F.date_sub(F.lit("2024-01-10").cast("date"), (F.col("c_custkey") % 4).cast("int"))
    rows = c.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "US").otherwise("24/7").alias("calendar"), day.alias("last_date"))
    return ledger.stale(rows, F.lit("2024-01-10 23:00:00").cast("timestamp")).select("c_custkey", "reason")


@query("number_texts", "SELECT c_custkey, CASE WHEN abs(x) >= 1000 THEN format('{:,}', CAST(round_even(x, 0) AS BIGINT)) WHEN abs(x) >= 1 THEN printf('%.2f', x) ELSE printf('%.4f', x) END AS price FROM (SELECT c_custkey, floor(c_acctbal) + 0.25 AS x FROM customer)")
def number_texts(spark, sf_dir):
    x = F.floor("c_acctbal") + 0.25
    return source.read(spark, sf_dir, "customer").select("c_custkey", scalar.price_text(x.cast("double")).alias("price"))


@query("vix_against_market", chain("obs") + "SELECT s.date AS date, v.temperature AS temperature, v.rain AS rain, v.weather AS weather, s.fwd_return1 AS fwd_return1, s.next_true_range AS next_true_range FROM obs s JOIN obs v USING (date) WHERE s.asset = 'AF' AND v.asset = 'RF'")
def vix_against_market(spark, sf_dir):
    """The score of the risk proxy against the outcomes of the market."""
    rows = observations(spark, sf_dir).select("asset", "date", "temperature", "rain", "weather", "fwd_return1", "next_true_range")
    return comparison.with_other_score(rows, "AF", "RF", ["temperature", "rain", "weather"]).drop("asset")


@query("last_settlements", chain("ind", "lab", more=_FORECASTS) + "SELECT forecast_id, as_of, error FROM s ORDER BY as_of DESC, forecast_id LIMIT 30")
def last_settlements(spark, sf_dir):
    """The last 30 settlements, of equal dates the first by id."""
    return settlements(spark, sf_dir).orderBy(F.desc("as_of"), "forecast_id").limit(30).select("forecast_id", "as_of", "error")


@query("distinct_sets", chain("score") + "SELECT asset, count(DISTINCT date) AS dates, array_to_string(list_sort(list_distinct(list(weather))), ',') AS classes FROM score GROUP BY asset")
def distinct_sets(spark, sf_dir):
    return score_rows(spark, sf_dir).groupBy("asset").agg(F.count_distinct("date").alias("dates"), F.array_join(F.sort_array(F.collect_set("weather")), ",").alias("classes"))


@query("bounds_for_keys", chain("ind") + f"SELECT k.asset AS asset, k.date AS date, {h('atr14 * 1.6e0', 6)} AS high FROM (SELECT DISTINCT l_returnflag || l_linestatus AS asset, CAST(l_shipdate AS DATE) AS date FROM lineitem WHERE l_quantity >= 49) k LEFT JOIN ind ON ind.asset = k.asset AND ind.date = k.date")
def bounds_for_keys(spark, sf_dir):
    """Bounds of the days with a large trade."""
    bounds = indicator_rows(spark, sf_dir).select("asset", "date", half_up(F.col("atr14") * 1.6, 6).alias("high"))
    large = source.read(spark, sf_dir, "lineitem").where("l_quantity >= 49").select(F.concat("l_returnflag", "l_linestatus").alias("asset"), F.to_date("l_shipdate").alias("date"))
    return comparison.subset_bounds(bounds, large, "asset", "date")
