"""Data-quality audits of series, redundancy of pairs, invariants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scalar import half_up


#: Date ranges of market regimes and the rows that cover them.
REGIMES = (
    ("dotcom", "2000-01-01", "2003-12-31", 250),
    ("gfc", "2007-07-01", "2009-06-30", 200),
    ("euro", "2011-05-01", "2011-12-31", 100),
    ("covid", "2020-02-01", "2020-12-31", 150),
    ("inflation", "2022-01-01", "2022-12-31", 180),
    ("recent", "2024-01-01", "2026-12-31", 250),
)


def audit(
    bars: DataFrame, calendar: DataFrame | None, as_of: Column, minimum_years: float = 1.0, volume_expected: bool = True, locked: bool = False,
    regimes: tuple = REGIMES, key: str = "asset", time: str = "date",
) -> DataFrame:
    """One row per series: rows, expected rows, coverage (at most 100), years, zero volumes, unchanged closes (of all changes), jumps, longest gap, staleness, issues (severity:code) and gate.

    Expected rows are the dates of ``calendar`` within the series' range; without
    a calendar the series trades every day, which also narrows the bounds of gaps
    and staleness. Errors: rows below 200 (330) a year of minimum_years, coverage
    below 97, over 1% zero volumes where volume is expected, gaps over 10 (2)
    days, older than 4 (1) days. Moves of 25% and more, regimes that are not
    covered and locked series are information. The gate is fail with an error,
    review with a warning, else pass.
    """
    daily = calendar is None
    w = Window.partitionBy(key).orderBy(time)
    before = F.lag("close").over(w)
    move = half_up(F.abs(F.try_divide("close", before) - 1.0) * 100.0, 9)
    rows = bars.select(key, time, "volume", (F.col("close") == before).alias("same"), (move >= 25.0).alias("jump"), F.datediff(time, F.lag(time).over(w)).alias("gap"))
    day = F.col(time)
    got = rows.groupBy(key).agg(
        F.count("*").alias("rows"),
        F.min(time).alias("first_date"),
        F.max(time).alias("last_date"),
        half_up(F.avg(F.when(F.col("volume") <= 0, 100.0).otherwise(0.0)), 6).alias("zero_volume"),
        half_up(F.count_if("same") * 100.0 / F.greatest(F.lit(1), F.count("*") - 1), 6).alias("unchanged"),
        F.count_if("jump").alias("jumps"),
        F.coalesce(F.max("gap"), F.lit(0)).cast("int").alias("max_gap"),
        *(F.count_if((day >= F.lit(a).cast("date")) & (day <= F.lit(b).cast("date"))).alias(f"_in_{name}") for name, a, b, _ in regimes),
    )
    if daily:
        expected = got.select(key, (F.datediff("last_date", "first_date") + 1).cast("long").alias("expected"))
    else:
        days = calendar.select(F.col(time).alias("_d")).distinct()
        ends = days.groupBy(F.lit(1).alias("_one")).agg(F.sort_array(F.collect_list("_d")).alias("_days"))  # a calendar has few thousand days
        inside = F.filter("_days", lambda d: (d >= F.col("first_date")) & (d <= F.col("last_date")))
        expected = got.select(key, "first_date", "last_date").crossJoin(F.broadcast(ends)).select(key, F.size(inside).cast("long").alias("expected"))
    out = got.join(expected, key, "left").withColumns(
        {
            "coverage": half_up(F.least(F.lit(100.0), F.try_divide(F.col("rows") * 100.0, F.col("expected"))), 6),
            "years": half_up(F.datediff("last_date", "first_date") / 365.25, 6),
            "stale_days": F.datediff(as_of, F.col("last_date")),
        }
    )
    issue = lambda when, name: F.when(when, F.lit(name))
    uncovered = F.array_compact(F.array(*(issue(F.col(f"_in_{name}") < least, name) for name, _, _, least in regimes)))
    issues = F.array_compact(
        F.array(
            issue(F.col("rows") < minimum_years * (330 if daily else 200), "error:history"),
            issue(F.col("coverage") < 97, "error:coverage"),
            issue(F.lit(volume_expected) & (F.col("zero_volume") > 1), "error:volume"),
            issue(F.col("max_gap") > (2 if daily else 10), "error:gap"),
            issue(F.col("stale_days") > (1 if daily else 4), "error:stale"),
            issue(F.col("jumps") > 0, "info:jumps"),
            F.when(F.size(uncovered) > 0, F.concat(F.lit("info:regimes "), F.array_join(uncovered, " "))),
            issue(F.lit(locked), "info:locked"),
        )
    )
    has = lambda severity: F.exists(issues, lambda x: x.startswith(severity))
    return out.withColumns({"issues": F.array_join(issues, ","), "gate": F.when(has("error"), "fail").when(has("warning"), "review").otherwise("pass")}).drop(*(f"_in_{name}" for name, *_ in regimes))


def regime_counts(bars: DataFrame, regimes: list[tuple[str, str, str]], key: str = "asset", time: str = "date") -> DataFrame:
    """Rows of each series within each date range; ranges may overlap, empty ones count 0."""
    day = F.col(time)
    return bars.groupBy(key).agg(*(F.count_if((day >= F.lit(a).cast("date")) & (day <= F.lit(b).cast("date"))).alias(name) for name, a, b in regimes))


def redundant_pairs(returns: DataFrame, value: str, key: str = "asset", time: str = "date", least_days: int = 252, least: float = 0.92, same: float = 0.98) -> DataFrame:
    """Unordered pairs of series with their common days and correlation, and whether they are redundant or the same.

    Pairs meet by an equi-join on the date; the correlation comes from sums.
    """
    a = returns.where(F.col(value).isNotNull()).select(time, F.col(key).alias("left"), F.col(value).alias("x"))
    b = a.select(time, F.col("left").alias("right"), F.col("x").alias("y"))
    got = a.join(b, time).where("left < right").groupBy("left", "right").agg(F.count("*").alias("days"), F.corr("x", "y").alias("c"))
    out = got.select("left", "right", "days", half_up(F.when((F.col("days") >= 3) & ~F.isnan("c"), F.col("c")), 6).alias("correlation"))
    level = F.when((F.col("days") < least_days) | F.col("correlation").isNull() | (F.col("correlation") < least), "distinct").when(F.col("correlation") >= same, "same").otherwise("redundant")
    return out.withColumn("level", level)


def missing_counts(rows: DataFrame, columns: list[str], key: str = "asset") -> DataFrame:
    """Rows and nulls of each column by series."""
    return rows.groupBy(key).agg(F.count("*").alias("rows"), *(F.count_if(F.col(c).isNull()).alias(f"no_{c}") for c in columns))


def gates(checks: dict[str, Column], rows: DataFrame) -> DataFrame:
    """One row: whether each check holds for all rows, and passed if all do."""
    out = rows.agg(*(F.coalesce(F.bool_and(c), F.lit(True)).alias(k) for k, c in checks.items()))
    held = F.lit(True)
    for k in checks:
        held &= F.col(k)
    return out.withColumn("passed", held)


def future_change(features: Callable[[DataFrame], DataFrame], bars: DataFrame, after: str, columns: list[str], key: str = "asset", time: str = "date") -> DataFrame:
    """Rows up to a date whose features differ once later bars are multiplied: empty if features don't look ahead."""
    later = F.col(time) > F.lit(after).cast("date")
    changed = bars.withColumns({c: F.when(later, F.col(c) * 3.0).otherwise(F.col(c)) for c in ("open", "high", "low", "close", "volume")})
    upto = lambda df: features(df).where(F.col(time) <= F.lit(after).cast("date")).select(key, time, *columns)
    return upto(bars).exceptAll(upto(changed))


def truncation_change(features: Callable[[DataFrame], DataFrame], bars: DataFrame, after: str, columns: list[str], key: str = "asset", time: str = "date") -> DataFrame:
    """Rows up to a date whose features differ once later bars are cut off."""
    past = F.col(time) <= F.lit(after).cast("date")
    return features(bars).where(past).select(key, time, *columns).exceptAll(features(bars.where(past)).select(key, time, *columns))


def series_checks(rows: DataFrame, key: str = "asset", time: str = "date", close: str = "close", change: str = "fwd_return1", finite: tuple[str, ...] = ("fwd_return5", "next_true_range"), score: str = "temperature") -> DataFrame:
    """Per series: rows, whether dates rise strictly, the outcome is the change to the next row, and values are finite and scores within 0 and 100."""
    w = Window.partitionBy(key).orderBy(time)
    before, after = F.lag(time).over(w), F.lead(close).over(w)
    later = before.isNull() | (F.col(time) > before)
    aligned = after.isNull() | (F.abs(F.col(change) - (after / F.col(close) - 1.0) * 100.0) < 1e-5)
    good = F.col(score).between(0, 100)
    for c in finite:
        good = good & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    held = rows.select(key, later.alias("_l"), aligned.alias("_a"), good.alias("_g"))
    every = lambda c: F.bool_and(F.coalesce(F.col(c), F.lit(False)))
    return held.groupBy(key).agg(F.count("*").alias("rows"), every("_l").alias("chronological"), every("_a").alias("aligned"), every("_g").alias("finite"))


def split_protocol(rows: DataFrame, purged: int = 10, embargoed: int = 10, key: str = "asset", time: str = "date") -> DataFrame:
    """Per series of rows with bucket: whether both borders have their purged and embargoed rows and train, validation and sealed test follow each other; a missing part fails."""
    of = lambda b: F.when(F.col("bucket") == b, F.col(time))
    got = rows.groupBy(key).agg(
        (F.count_if(F.col("bucket") == "purged") == purged).alias("purged"),
        (F.count_if(F.col("bucket") == "embargoed") == embargoed).alias("embargoed"),
        F.coalesce(F.max(of("train")) < F.min(of("validation")), F.lit(False)).alias("train_first"),
        F.coalesce(F.max(of("validation")) < F.min(of("sealed-test")), F.lit(False)).alias("test_last"),
    )
    return got.withColumn("passed", F.col("purged") & F.col("embargoed") & F.col("train_first") & F.col("test_last"))
