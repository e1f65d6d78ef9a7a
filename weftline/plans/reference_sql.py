"""SQL of the shared steps, for queries that hold the Spark plans against another engine."""

from __future__ import annotations


def half_up(x: str, digits: int = 0) -> str:
    scale = f"1e{digits}"
    return f"(floor(({x}) * {scale} + 0.5) / {scale})"


def growth(now: str, before: str) -> str:
    return f"(CASE WHEN {before} = 0 THEN 0.0 ELSE ({now} / {before} - 1.0) * 100.0 END)"


def clamp(x: str) -> str:
    return f"least(100e0, greatest(0e0, {x}))"


W = "PARTITION BY asset ORDER BY date"


def frame(n: int, last: str = "CURRENT ROW") -> str:
    return f"({W} ROWS BETWEEN {n} PRECEDING AND {last})"


PAST = "1 PRECEDING"
WIND = "CASE WHEN {0} IS NULL THEN '보통' WHEN {0} < 0.55 THEN '잔잔함' WHEN {0} < 1.25 THEN '보통' WHEN {0} < 2.3 THEN '강함' ELSE '돌풍' END"
DUST = "CASE WHEN {0} IS NULL THEN '보통' WHEN {0} < 0.45 THEN '나쁨' WHEN {0} < 0.85 THEN '보통' ELSE '좋음' END"
WEATHER = "CASE WHEN rain >= 78 OR wind = '돌풍' THEN '태풍경보' WHEN rain >= 62 OR wind = '강함' THEN '소나기' WHEN temperature >= 82 THEN '쾌청' WHEN temperature >= 66 THEN '맑음' WHEN temperature >= 48 THEN '구름 조금' ELSE '흐림' END"


def _rank(value: str, history: str) -> str:
    return f"CASE WHEN {value} IS NOT NULL AND len(list_filter({history}, lambda x: x IS NOT NULL)) = 252 THEN {half_up(f'len(list_filter({history}, lambda x: x <= {value})) * 100.0 / 252', 6)} END"


def _confusion(names: bool = True) -> str:
    n = "(tp + fp + fn + tn)"
    d = lambda a, b: f"CASE WHEN ({b}) = 0 THEN NULL ELSE CAST({a} AS DOUBLE) / ({b}) END"
    return f"""{d('tp', 'tp + fp')} AS "precision", {d('tp', 'tp + fn')} AS recall, {d('tn', 'tn + fp')} AS specificity,
      {d('tp + fn', n)} AS base_rate, {d('tp + tn', n)} AS accuracy, {d('tp + fp', n)} AS coverage"""


CONFUSION = _confusion()

_SMA = ", ".join(f"CASE WHEN bar_no >= {n} THEN {half_up(f'avg(close) OVER {frame(n - 1)}', 9)} END AS sma{n}" for n in (5, 20, 50, 200))
_CHANGE = ", ".join(f"CASE WHEN close <> 0 AND lag(close, {n}) OVER ({W}) <> 0 THEN {half_up(f'((close - lag(close, {n}) OVER ({W})) / lag(close, {n}) OVER ({W})) * 100.0', 9)} END AS change{n}" for n in (1, 4, 5, 20, 24))
_RETURN = ", ".join(f"{half_up(growth('close', f'lag(close, {n}) OVER ({W})'), 9)} AS return{n}" for n in (1, 5, 20))
_GAP = ", ".join(f"CASE WHEN sma{n} <> 0 THEN {half_up(growth('close', f'sma{n}'), 9)} END AS sma_gap{n}" for n in (5, 20, 50, 200))
_LISTS = ", ".join(f"list({half_up(c, 6)}) OVER {frame(252, PAST)} AS l_{c}" for c in ("atr14", "realized_vol20", "volume_ratio20", "sma_gap20"))
_ROUNDED = ("return1", "return5", "return20", "sma_gap5", "sma_gap20", "sma_gap50", "sma_gap200", "realized_vol20", "downside_vol20", "drawdown63")
_HEAT = "(CASE WHEN rsi14 > 72 THEN (rsi14 - 72.0) * 0.7 ELSE 0.0 END) + greatest(0e0, c4 - 1.2) * 2.0 + greatest(0e0, green_run - 4.0) * 1.2"
_RISK = "greatest(0e0, coalesce(atr14, 0.0) - 2.25) * 3.0 + (CASE WHEN conflict THEN 5.0 ELSE 0.0 END)"
_PARTS = "part_trend + part_momentum + part_volatility + part_activity + part_risk"

CTES: dict[str, str] = {
    "bars": f"""SELECT asset, date, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, sum(v) AS volume FROM (
        SELECT l_returnflag || l_linestatus AS asset, CAST(l_shipdate AS DATE) AS date, {half_up('l_extendedprice / l_quantity', 6)} AS p,
          row(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k, CAST(l_quantity AS DOUBLE) AS v FROM lineitem) GROUP BY asset, date""",
    "hourly": f"""SELECT asset, hour, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, sum(1e0) AS volume FROM (
        SELECT event_type AS asset, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hour, {half_up('value', 6)} AS p, row(ts, event_id) AS k FROM events) GROUP BY asset, hour""",
    "market": f"""SELECT date, arg_min(p, k) AS open, max(p) AS high, min(p) AS low, arg_max(p, k) AS close, sum(1e0) AS volume FROM (
        SELECT CAST(o_orderdate AS DATE) AS date, {half_up('o_totalprice', 6)} AS p, o_orderkey AS k FROM orders) GROUP BY date""",
    "ind0": f"SELECT *, row_number() OVER ({W}) AS bar_no, lag(close) OVER ({W}) AS prev_close FROM bars",
    "ind1": "SELECT *, close - prev_close AS step, greatest(high - low, abs(high - prev_close), abs(low - prev_close)) AS true_range, CASE WHEN close <= open THEN bar_no END AS red FROM ind0",
    "ind2": f"""SELECT *, {half_up(f'sum(CASE WHEN step >= 0 THEN step ELSE 0.0 END) OVER {frame(13)}', 9)} AS gains,
        {half_up(f'sum(CASE WHEN step < 0 THEN -step ELSE 0.0 END) OVER {frame(13)}', 9)} AS losses, avg(volume) OVER {frame(20, PAST)} AS before FROM ind1""",
    "ind": f"""SELECT *, {_SMA}, {_CHANGE},
        CASE WHEN bar_no >= 15 THEN {half_up('CASE WHEN losses = 0 THEN 100e0 ELSE 100.0 - 100.0 / (1.0 + gains / losses) END', 9)} END AS rsi14,
        CASE WHEN bar_no >= 15 AND close <> 0 THEN {half_up(f'avg(true_range) OVER {frame(13)} / close * 100.0', 9)} END AS atr14,
        CASE WHEN bar_no >= 21 AND before > 0 THEN {half_up('volume / before', 9)} END AS volume_ratio20,
        least(8, bar_no - coalesce(max(red) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)) AS green_run FROM ind2""",
    "feat1": f"SELECT *, {_RETURN}, {_GAP}, close / prev_close - 1.0 AS r, least(close / prev_close - 1.0, 0e0) AS d FROM ind",
    "feat2": f"""SELECT *, CASE WHEN bar_no >= 21 THEN {half_up(f'stddev_samp(r) OVER {frame(19)} * sqrt(252e0) * 100.0', 9)} END AS realized_vol20,
        CASE WHEN bar_no >= 21 THEN {half_up(f'stddev_samp(d) OVER {frame(19)} * sqrt(252e0) * 100.0', 9)} END AS downside_vol20,
        CASE WHEN bar_no >= 63 THEN {half_up(growth('close', f'(max(close) OVER {frame(62)})'), 9)} END AS drawdown63 FROM feat1""",
    "feat3": f"""SELECT *, {_LISTS}, list(close) OVER {frame(252, PAST)} AS l_close, avg({half_up('return1', 6)}) OVER {frame(252, PAST)} AS m,
        stddev_samp({half_up('return1', 6)}) OVER {frame(252, PAST)} AS s, count(return1) OVER {frame(252, PAST)} AS k,
        {half_up(f'quantile_cont({half_up("return1", 6)}, 0.1) OVER {frame(756, PAST)}', 8)} AS return_q10_756 FROM feat2""",
    "feat": f"""SELECT * REPLACE ({', '.join(f'{half_up(c, 6)} AS {c}' for c in _ROUNDED)}), {_rank('atr14', 'l_atr14')} AS atr_rank252, {_rank('realized_vol20', 'l_realized_vol20')} AS vol_rank252,
        {_rank('volume_ratio20', 'l_volume_ratio20')} AS volume_rank252, {_rank('sma_gap20', 'l_sma_gap20')} AS gap_rank252, {_rank('close', 'l_close')} AS close_rank252,
        CASE WHEN k = 252 AND s > 0 THEN {half_up('(return1 - m) / s', 6)} END AS return_z252 FROM feat3""",
    "score0": """SELECT *, coalesce(change4, 0.0) AS c4, coalesce(change24, 0.0) AS c24, coalesce(change5, 0.0) AS c5, coalesce(change20, 0.0) AS c20,
        CASE WHEN sma5 <> 0 AND sma20 <> 0 THEN (sma5 - sma20) / sma20 * 100.0 ELSE 0.0 END AS g FROM ind WHERE bar_no >= 30""",
    "score1": f"""SELECT *, {half_up(clamp('50.0 + c5 * 3.8 + c20 * 1.15 + g * 2.8 + c24 * 0.9'), 8)} AS trend,
        {half_up('CASE WHEN rsi14 IS NULL THEN ' + clamp('50.0 + c24 * 4.0') + ' ELSE ' + clamp('50.0 + (rsi14 - 50.0) * 1.35 + c24 * 2.5') + ' END', 8)} AS momentum,
        {half_up(clamp('78.0 - greatest(0e0, coalesce(atr14, 1.5) - 1.5) * 17.0 - greatest(0e0, coalesce(atr14, 0.75) - 0.8) * 12.0'), 8)} AS volatility,
        {half_up('CASE WHEN volume_ratio20 IS NULL THEN 55e0 ELSE ' + clamp('52.0 + log2(greatest(0.08, volume_ratio20)) * 24.0') + ' END', 8)} AS activity,
        sign(c24) * sign(c5) < 0 AS conflict FROM score0""",
    "score2": f"""SELECT *, {half_up('(trend - 50.0) * 0.35', 1)} AS part_trend, {half_up('(momentum - 50.0) * 0.2', 1)} AS part_momentum, {half_up('(volatility - 50.0) * 0.2', 1)} AS part_volatility,
        {half_up('(activity - 50.0) * 0.15', 1)} AS part_activity, {half_up('-' + half_up(f'(({_HEAT}) + ({_RISK})) * 0.45', 8), 1)} AS part_risk FROM score1""",
    "score3": f"""SELECT *, {half_up(clamp('50.0 + ' + half_up(_PARTS, 6)))} AS temperature,
        {half_up(half_up(clamp('22.0 + greatest(0e0, 55.0 - volatility) * 0.65 + greatest(0e0, abs(c4) - 0.6) * 7.0 + (CASE WHEN conflict THEN 15.0 ELSE 0.0 END) + (CASE WHEN activity < 38 THEN 10.0 ELSE 0.0 END) + (CASE WHEN rsi14 > 76 OR rsi14 < 28 THEN 10.0 ELSE 0.0 END)'), 6))} AS rain,
        {half_up(half_up(clamp('15.0 + greatest(0e0, coalesce(rsi14, 50.0) - 58.0) * 2.0 + greatest(0e0, c4) * 10.0 + green_run * 4.0'), 6))} AS ultraviolet,
        {WIND.format('atr14')} AS wind, {DUST.format('volume_ratio20')} AS dust FROM score2""",
    "score": f"""SELECT * REPLACE ({', '.join(f'{half_up(c)} AS {c}' for c in ('trend', 'momentum', 'volatility', 'activity'))}), {WEATHER} AS weather,
        {clamp('55.0 + (CASE WHEN bar_no >= 60 THEN 15.0 ELSE 0.0 END) + (CASE WHEN bar_no >= 20 THEN 25.0 ELSE 0.0 END) + (CASE WHEN prev_close IS NOT NULL THEN 5.0 ELSE 0.0 END)')} AS confidence FROM score3""",
    "lab": f"""SELECT asset, date, bars.close AS label_close, {', '.join(f'{half_up(growth(f"lead(close, {n}) OVER ({W})", "close"), 6)} AS fwd_return{n}' for n in (1, 3, 5))},
        {', '.join(f'CASE WHEN lead(close, {n}) OVER ({W}) IS NOT NULL THEN {half_up(growth(f"(min(low) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING))", "close"), 6)} END AS fwd_drawdown{n}' for n in (3, 5))},
        {half_up(f'(lead(high) OVER ({W}) - lead(low) OVER ({W})) / close * 100.0', 6)} AS next_range,
        CASE WHEN lead(high) OVER ({W}) IS NOT NULL THEN {half_up(f'greatest(lead(high) OVER ({W}) - lead(low) OVER ({W}), abs(lead(high) OVER ({W}) - close), abs(lead(low) OVER ({W}) - close)) / close * 100.0', 6)} END AS next_true_range FROM bars""",
    "obs": """SELECT score.*, lab.* EXCLUDE (asset, date, label_close) FROM score JOIN lab USING (asset, date) WHERE fwd_return5 IS NOT NULL""",
    "panel": """SELECT feat.*, lab.* EXCLUDE (asset, date, label_close), score.temperature, score.rain, score.ultraviolet, score.weather, score.wind,
        CAST(fwd_return1 > 0 AS INT) AS up1, CAST(fwd_return3 > 0 AS INT) AS up3, CAST(fwd_return5 > 0 AS INT) AS up5,
        CAST(fwd_return1 <= -1 AS INT) AS drop1, CAST(fwd_return1 <= -2 AS INT) AS drop2, CAST(fwd_return1 <= -3 AS INT) AS drop3,
        CAST(fwd_return1 <= return_q10_756 AS INT) AS tail1, CAST(fwd_drawdown3 <= -feat.atr14 AS INT) AS correction3, CAST(fwd_drawdown5 <= -feat.atr14 AS INT) AS correction5
        FROM feat JOIN lab USING (asset, date) JOIN score USING (asset, date)
        WHERE feat.bar_no > 300 AND fwd_return5 IS NOT NULL AND return_z252 IS NOT NULL AND atr_rank252 IS NOT NULL AND vol_rank252 IS NOT NULL AND volume_rank252 IS NOT NULL AND gap_rank252 IS NOT NULL
          AND return1 IS NOT NULL AND return5 IS NOT NULL AND return20 IS NOT NULL AND sma_gap20 IS NOT NULL AND sma_gap200 IS NOT NULL AND feat.rsi14 IS NOT NULL AND feat.atr14 IS NOT NULL AND realized_vol20 IS NOT NULL
          AND downside_vol20 IS NOT NULL AND drawdown63 IS NOT NULL AND feat.volume_ratio20 IS NOT NULL AND return_q10_756 IS NOT NULL""",
}
NEEDS = {
    "bars": [], "hourly": [], "market": [], "ind0": ["bars"], "ind1": ["ind0"], "ind2": ["ind1"], "ind": ["ind2"], "feat1": ["ind"], "feat2": ["feat1"], "feat3": ["feat2"], "feat": ["feat3"],
    "score0": ["ind"], "score1": ["score0"], "score2": ["score1"], "score3": ["score2"], "score": ["score3"], "lab": ["bars"], "obs": ["score", "lab"], "panel": ["feat", "lab", "score"],
}


def chain(*names: str, more: dict[str, str] | None = None) -> str:
    """WITH clause of the named steps and all that they need, then more."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS[name]:
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    parts = [f"{n} AS MATERIALIZED ({CTES[n]})" for n in order] + [f"{n} AS ({s})" for n, s in (more or {}).items()]
    return "WITH " + ",\n".join(parts) + "\n"
