"""Queries of conformal quantiles before a cutoff, and of intervals that are judged from it on."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions.scalar import half_up
from weftline.functions.shared import written
from weftline.operators import comparison, metrics, models
from weftline.plans.calibration import _TAPE, tape
from weftline.plans.reference_sql import chain
from weftline.plans.reference_sql import half_up as h

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


#: Forecasts from here on are judged; what was known before calibrates them. One series is held out of all learning.
CUTOFF, HELD_OUT = "2000-01-01", "RO"
LEVELS = models.LEVELS
_BEFORE = f"date < DATE '{CUTOFF}' AND asset <> '{HELD_OUT}'"
_RATIO = h("y / greatest(p, 0.01e0)", 8)


def quantile_steps(rows: str, excluded: bool = False) -> dict[str, str]:
    """Weighted quantiles of q by scope over a query of asset, cluster and q: midpoints of cumulated weights, interpolated."""
    scopes = ["SELECT 'all' AS scope, q, weight FROM qw", "SELECT 'in ' || cluster AS scope, q, weight FROM qw"]
    if excluded:
        scopes.append("SELECT 'not ' || c.cluster AS scope, q, weight FROM qw JOIN (SELECT DISTINCT cluster FROM qw) c ON c.cluster <> qw.cluster")
    point = lambda p: f"coalesce(max(CASE WHEN m <= {p} AND nm > {p} THEN v + (nv - v) * (({p} - m) / (nm - m)) WHEN m <= {p} AND nm IS NULL THEN v END), max(CASE WHEN fm > {p} THEN fv END))"
    over = "OVER (PARTITION BY scope ORDER BY q, weight)"
    return {
        "q0": rows,
        "qw": "SELECT q0.*, 1e0 / a.n / b.n AS weight FROM q0 JOIN (SELECT cluster, count(DISTINCT asset) AS n FROM q0 GROUP BY cluster) a USING (cluster) JOIN (SELECT asset, count(*) AS n FROM q0 GROUP BY asset) b USING (asset)",
        "qs": " UNION ALL ".join(scopes),
        "qm": "SELECT scope, q, weight, (sum(weight) OVER (PARTITION BY scope ORDER BY q, weight ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - weight / 2.0) / sum(weight) OVER (PARTITION BY scope) AS m FROM qs",
        "qn": f"SELECT scope, q AS v, m, lead(q) {over} AS nv, lead(m) {over} AS nm, first_value(q) {over} AS fv, first_value(m) {over} AS fm FROM qm",
        "qt": "SELECT scope, count(*) AS rows, " + ", ".join(f"{h(point(p), 6)} AS q{k}" for k, p in enumerate(LEVELS)) + " FROM qn GROUP BY scope",
    }


def _levels(prefix: str = "") -> str:
    return ", ".join(f"{h(f'{prefix}q{k}', 4)} AS q{k}" for k in range(len(LEVELS)))


def role_tape(spark, sf_dir):
    """The tape with each row's role, written once: calibration and bounds both read it."""
    role = F.when(F.col("asset") == HELD_OUT, "holdout").otherwise("development")
    return written(tape(spark, sf_dir).select("asset", "date", "fold", "cluster", "predicted", "y", "atr14", "tail1", "base_rate", role.alias("role")))


def cluster_names(rows) -> list[str]:
    """The clusters of a policy; a handful."""
    return sorted(r[0] for r in rows.select("cluster").distinct().collect() if r[0])


_KNOWN = quantile_steps(f"SELECT asset, cluster, {_RATIO} AS q FROM t WHERE {_BEFORE}", excluded=True)


@query("cutoff_quantiles", chain("panel", more=_TAPE | _KNOWN) + f"SELECT scope, rows, {_levels()} FROM qt")
def cutoff_quantiles(spark, sf_dir):
    """Quantiles of outcome over prediction of development rows before the cutoff: of all, of each cluster, and of all but each."""
    known = written(models.known_before(role_tape(spark, sf_dir), CUTOFF))
    got = models.conformal_quantiles(known, "predicted", "y", excluded=cluster_names(known))
    return got.select("scope", "rows", *(half_up(F.col(f"q{k}"), 4).alias(f"q{k}") for k in range(len(LEVELS))))


@query("tape_quantiles", chain("panel", more=_TAPE | quantile_steps(f"SELECT asset, cluster, {_RATIO} AS q FROM t", excluded=True)) + "SELECT substr(scope, 5) AS excluded, " + ", ".join(f"{h(c, 4)} AS q{k}" for k, c in enumerate(("q0", "q1", "q3", "q4"))) + " FROM qt WHERE scope LIKE 'not %'")
def tape_quantiles(spark, sf_dir):
    """Quantiles of outcome over prediction on the whole tape, with each cluster left out in turn."""
    rows = role_tape(spark, sf_dir)
    got = models.conformal_quantiles(rows, "predicted", "y", excluded=cluster_names(rows)).where(F.startswith("scope", F.lit("not ")))
    return got.select(F.substring("scope", 5, 1 << 30).alias("excluded"), *(half_up(F.col(c), 4).alias(f"q{k}") for k, c in enumerate(("q0", "q1", "q3", "q4"))))


# ---- bounds from the cutoff on ----
_BACK = "(PARTITION BY asset ORDER BY date ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)"
_BOUNDS = _TAPE | quantile_steps(f"SELECT asset, cluster, {_RATIO} AS q FROM t WHERE {_BEFORE}") | {
    "b0": f"SELECT *, {_RATIO} AS q FROM t",
    "b1": f"SELECT *, count(q) OVER {_BACK} AS residuals, " + ", ".join(f"{h(f'quantile_cont(q, {p}) OVER {_BACK}', 10)} AS o{k}" for k, p in enumerate(comparison.POINTS)) + " FROM b0",
    "b2": f"""SELECT b1.*, CASE WHEN residuals >= 60 THEN residuals / (residuals + 100e0) END AS share, {', '.join(f'g.{c} AS g{k}, coalesce(c.{c}, g.{c}) AS c{k}' for k, c in enumerate(comparison.POINTS.values()))}
        FROM b1 JOIN qt g ON g.scope = 'all' LEFT JOIN qt c ON c.scope = 'in ' || b1.cluster WHERE b1.date >= DATE '{CUTOFF}'""",
}
_SCHEME = {
    "global": "g{0}",
    "cluster": "c{0}",
    "rolling252": "(CASE WHEN share IS NULL THEN g{0} ELSE o{0} END)",
    "shrunk252": "(CASE WHEN share IS NULL THEN g{0} ELSE share * o{0} + (1.0 - share) * g{0} END)",
}
_BOUNDS |= {"bz": " UNION ALL ".join(f"SELECT '{name}' AS scheme, asset, date, fold, cluster, residuals, y, p, " + ", ".join(f"{h(q.format(k) + ' * p', 6)} AS bound{k}" for k in range(4)) + " FROM b2" for name, q in _SCHEME.items())}
_COVERAGE = "avg(CAST(y BETWEEN bound1 AND bound2 AS INT)) AS c5, avg(bound2 - bound1) AS w5, avg(CAST(y BETWEEN bound0 AND bound3 AS INT)) AS c8, avg(bound3 - bound0) AS w8"
_ERROR = "((abs(c5 - 0.5e0) + abs(c8 - 0.8e0)) / 2e0)"
_BY_ASSET = {"ba": f"SELECT scheme, asset, count(*) AS n, {_COVERAGE} FROM bz GROUP BY scheme, asset"}
_BY_SCHEME = _BY_ASSET | {"bs": f"SELECT scheme, count(*) AS series, {h('avg(c5)', 6)} AS coverage50, {h('avg(w5)', 6)} AS width50, {h('avg(c8)', 6)} AS coverage80, {h('avg(w8)', 6)} AS width80, {h('(abs(avg(c5) - 0.5e0) + abs(avg(c8) - 0.8e0)) / 2e0', 6)} AS error FROM ba GROUP BY scheme"}


def judged_bounds(rows):
    """Bounds of all schemes for the tape's rows from the cutoff on, with quantiles from rows before it."""
    table = models.conformal_quantiles(models.known_before(rows, CUTOFF), "predicted", "y")
    return comparison.interval_schemes(rows, table, "predicted", "y").where(F.col("date") >= F.lit(CUTOFF).cast("date"))


def _bounds(spark, sf_dir):
    return judged_bounds(role_tape(spark, sf_dir))


@query("trailing_intervals", chain("panel", more=_BOUNDS) + "SELECT asset, date, residuals, " + ", ".join(f"{h(f'bound{k}', 4)} AS bound{k}" for k in range(4)) + " FROM bz WHERE scheme = 'shrunk252'")
def trailing_intervals(spark, sf_dir):
    """Bounds blended from a series' own trailing ratios and the ones known before the cutoff."""
    return _bounds(spark, sf_dir).where("scheme = 'shrunk252'").select("asset", "date", "residuals", *(half_up(F.col(f"bound{k}"), 4).alias(f"bound{k}") for k in range(4)))


_Z = 1.959963984540054
_WILSON = f"(c8 + {_Z * _Z!r}e0 / (2.0 * n)) / (1.0 + {_Z * _Z!r}e0 / n)"
_HALF = f"{_Z!r}e0 * sqrt(c8 * (1.0 - c8) / n + {_Z * _Z!r}e0 / (4.0 * n * n)) / (1.0 + {_Z * _Z!r}e0 / n)"


@query(
    "interval_coverage",
    chain("panel", more=_BOUNDS | _BY_ASSET)
    + f"SELECT asset, CAST(n AS BIGINT) AS n, {h('c8', 6)} AS coverage, {h(_WILSON + ' - ' + _HALF, 6)} AS wilson_low, {h(_WILSON + ' + ' + _HALF, 6)} AS wilson_high, {h('w8', 6)} AS width, {h('abs(c8 - 0.8e0)', 6)} AS coverage_error FROM ba WHERE scheme = 'shrunk252'",
)
def interval_coverage(spark, sf_dir):
    return metrics.interval_coverage(_bounds(spark, sf_dir).where("scheme = 'shrunk252'"), "bound0", "bound3", "y", "asset", 0.8)


@query("interval_schemes", chain("panel", more=_BOUNDS | _BY_SCHEME) + "SELECT *, scheme = (SELECT scheme FROM bs WHERE error <= (SELECT min(error) FROM bs) + 0.005 ORDER BY width80, scheme LIMIT 1) AS chosen FROM bs")
def interval_schemes(spark, sf_dir):
    return comparison.scheme_metrics(_bounds(spark, sf_dir), "y")


@query("interval_pass_rates", chain("panel", more=_BOUNDS | _BY_ASSET) + f"SELECT scheme, count(*) AS series, {h(f'avg(CAST({h(_ERROR, 9)} <= 0.1 AS INT))', 6)} AS pass_rate FROM ba GROUP BY scheme")
def interval_pass_rates(spark, sf_dir):
    """Share of series, for each scheme, whose mean coverage error is at most a tenth."""
    return comparison.pass_rate(_bounds(spark, sf_dir), "y")


@query(
    "interval_slices",
    chain("panel", more=_BOUNDS | {"bg": f"SELECT scheme, coalesce(asset, 'all') AS asset, coalesce(fold, 0) AS fold, count(*) AS rows, {_COVERAGE} FROM bz GROUP BY GROUPING SETS ((scheme, asset), (scheme, fold), (scheme, asset, fold))"})
    + f"SELECT scheme, asset, fold, rows, {h('c5', 6)} AS coverage50, {h('w5', 6)} AS width50, {h('c8', 6)} AS coverage80, {h('w8', 6)} AS width80, {h(_ERROR, 6)} AS error FROM bg",
)
def interval_slices(spark, sf_dir):
    """Coverage of every scheme by series, by year, and by both: one expansion of the rows."""
    sets = F.array(F.struct("asset", F.lit(0).alias("fold")), F.struct(F.lit("all").alias("asset"), F.col("fold")), F.struct("asset", "fold"))
    rows = _bounds(spark, sf_dir).withColumn("_at", F.explode(sets))
    each = rows.select("scheme", "_at.asset", "_at.fold", "y", *(f"bound{k}" for k in range(4)))
    return metrics.rounded(comparison.series_coverage(each, "y", "scheme", "asset", "fold"))
