"""As-of joins, breadth, excess returns and split assignment of series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scalar import growth, half_up


def asof(left: DataFrame, right: DataFrame, time: str, values: list[str], by: list[str] | None = None, strict: bool = False, tolerance_days: int | None = None) -> DataFrame:
    """left with the values (and as_of, the time) of the latest right row at or before its time; before it only, if strict.

    Both sides are united and ordered once within each value of by, so there is
    no range join. A right row older than tolerance_days counts as none. Without
    by all rows are one series; left rows are then cut by year first, and each
    year is given the last right row before it, so that no task holds a whole series.
    """
    keys = by or []
    held = [c for c in left.columns if c not in {*values, "as_of"}]
    rights = right.select(*keys, F.col(time).alias("_t"), F.struct(F.col(time).alias("as_of"), *values).alias("_v"), F.lit(1 if strict else 0).alias("_side"))
    lefts = left.select(*held).withColumns({"_t": F.col(time), "_row": F.struct(*held), "_side": F.lit(0 if strict else 1)})
    kind = rights.schema["_v"].dataType
    cut = keys
    if not keys:
        rights = rights.withColumn("_cut", F.year("_t"))
        lefts = lefts.withColumn("_cut", F.year("_t"))
        years = lefts.select("_cut").distinct()
        carried = years.join(rights.groupBy(F.col("_cut").alias("_old")).agg(F.max_by("_v", "_t").alias("_v"), F.max("_t").alias("_t")), F.col("_old") < F.col("_cut")).groupBy("_cut").agg(F.max_by("_v", "_t").alias("_v"), F.max("_t").alias("_t"))
        rights = rights.unionByName(carried.withColumn("_side", F.lit(-1)))
        cut = ["_cut"]
    both = lefts.select(*cut, "_t", "_side", "_row", F.lit(None).cast(kind).alias("_v")).unionByName(rights.select(*cut, "_t", "_side", F.lit(None).cast(lefts.schema["_row"].dataType).alias("_row"), "_v"))
    w = Window.partitionBy(*cut).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_row is not null")
    if tolerance_days is not None:
        found = found.withColumn("_v", F.when(F.datediff(F.col(f"_row.{time}"), F.col("_v.as_of")) <= tolerance_days, F.col("_v")))
    return found.select("_row.*", "_v.*")


def breadth(targets: DataFrame, members: DataFrame, time: str = "date", member: str = "member", tolerance_days: int = 4, least: int = 8) -> DataFrame:
    """For each target date the number of members with a row of at most tolerance_days before, and the shares that rose and stand above their mean; null below ``least`` members."""
    pairs = targets.select(time).distinct().join(members.select(member).distinct())
    recent = asof(pairs, members, time, ["return1", "sma_gap20"], by=[member], tolerance_days=tolerance_days).where("as_of is not null")
    share = lambda c: half_up(F.avg(F.when(F.coalesce(F.col(c), F.lit(0.0)) > 0, 100.0).otherwise(0.0)), 6)
    out = recent.groupBy(time).agg(F.count("*").alias("members"), share("return1").alias("up_share"), share("sma_gap20").alias("above_share"))
    return targets.select(time).distinct().join(out, time, "left").select(time, F.coalesce("members", F.lit(0)).alias("members"), *(F.when(F.col("members") >= least, F.col(c)).alias(c) for c in ("up_share", "above_share")))


def excess_returns(bars: DataFrame, market: DataFrame, horizons: tuple[int, ...] = (1, 3, 5), key: str = "asset", time: str = "date") -> DataFrame:
    """Forward returns less those of the market, horizons counted in rows of each series; null without a market bar on the date."""
    own, all_ = Window.partitionBy(key).orderBy(time), Window.partitionBy(F.lit(1)).orderBy(time)
    a = bars.select(key, time, *(growth(F.lead("close", h).over(own), F.col("close")).alias(f"_a{h}") for h in horizons))
    m = market.select(time, *(growth(F.lead("close", h).over(all_), F.col("close")).alias(f"_m{h}") for h in horizons))
    return a.join(m, time, "left").select(key, time, *(half_up(F.col(f"_a{h}") - F.col(f"_m{h}"), 6).alias(f"excess{h}") for h in horizons))


def dedupe_either(candidates: DataFrame, existing: DataFrame, first: str, second: str) -> DataFrame:
    """Candidates of which neither key is an existing row's; as two anti joins, so each is an equi-join."""
    return candidates.join(existing.select(first).distinct(), first, "left_anti").join(existing.select(second).distinct(), second, "left_anti")


def split_by_fraction(rows: DataFrame, train: float = 0.6, validation: float = 0.2, key: str = "asset", time: str = "date") -> DataFrame:
    """rows with split: the first floor(n * train) of each series, then validation up to floor(n * (train + validation)), then test."""
    w = Window.partitionBy(key)
    at, n = F.row_number().over(w.orderBy(time)) - 1, F.count("*").over(w)
    return rows.withColumn("split", F.when(at < F.floor(n * F.lit(train)), "train").when(at < F.floor(n * F.lit(train + validation)), "validation").otherwise("test"))


def split_by_dates(rows: DataFrame, validation_start: str, test_start: str, purge: int = 5, embargo: int = 5, key: str = "asset", time: str = "date") -> DataFrame:
    """rows with bucket: train, validation and sealed-test by date; the last ``purge`` rows before a border are purged, the first ``embargo`` after it embargoed."""
    day = F.col(time)
    first = F.when(day < F.lit(validation_start).cast("date"), "train").when(day < F.lit(test_start).cast("date"), "validation").otherwise("sealed-test")
    w = Window.partitionBy(key, "_b")
    out = rows.withColumn("_b", first).withColumns({"_up": F.row_number().over(w.orderBy(time)), "_down": F.row_number().over(w.orderBy(F.desc(time)))})
    purged = F.col("_b").isin("train", "validation") & (F.col("_down") <= purge)
    held = F.col("_b").isin("validation", "sealed-test") & (F.col("_up") <= embargo)
    # in a short bucket the embargo comes first
    bucket: Column = F.when(held, "embargoed").when(purged, "purged").otherwise(F.col("_b"))
    return out.withColumn("bucket", bucket).drop("_b", "_up", "_down")


def interval_join(rows: DataFrame, bounds: DataFrame, time: str = "date", low: str = "low", high: str = "high", by: tuple[str, ...] = ("asset",), width: int = 365) -> DataFrame:
    """Rows with the columns of each of their key's bounds whose [low, high) holds their date.

    Bounds are cut into buckets of ``width`` days, rows stand in one: an equi-join on
    key and bucket, confirmed afterwards, so a key with many bounds is no cross join.
    A null low or high is open: it reaches to the rows' first or last date. Rows
    that no bound holds are left out; rows that several hold are repeated.
    """
    bucket = lambda day: F.floor(F.unix_date(day) / width)
    ends = rows.agg(F.min(F.col(time).cast("date")).alias("_first"), F.max(F.col(time).cast("date")).alias("_last"))
    day = lambda c: F.col(c).cast("date")
    held = bounds.crossJoin(F.broadcast(ends))  # ends has one row
    held = held.withColumns({"_from": F.greatest(F.coalesce(day(low), F.col("_first")), F.col("_first")), "_to": F.least(F.coalesce(day(high), F.date_add("_last", 1)), F.date_add("_last", 1))}).where("_from < _to")
    cut = held.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_from")), bucket(F.date_sub("_to", 1))))).drop("_first", "_last")
    met = rows.withColumn("_bucket", bucket(day(time))).join(cut, [*by, "_bucket"])
    return met.where((day(time) >= F.col("_from")) & (day(time) < F.col("_to"))).drop("_bucket", "_from", "_to")


def fraction_bounds(rows: DataFrame, parts: dict[str, float], key: str = "asset", time: str = "date") -> DataFrame:
    """key, split, low, high: each series' own bounds, where its first share of rows up to each part's end lies; the first is open below, the last above."""
    w = Window.partitionBy(key)
    placed = rows.select(key, time, (F.row_number().over(w.orderBy(time)) - 1).alias("_at"), F.count("*").over(w).alias("_n"))
    names, ends = list(parts), list(parts.values())
    border = lambda share: F.min(F.when(F.col("_at") >= F.floor(F.col("_n") * F.lit(share)), F.col(time)))
    found = placed.groupBy(key).agg(*(border(e).alias(f"_b{k}") for k, e in enumerate(ends[:-1])))
    none = F.lit(None).cast(rows.schema[time].dataType)
    each = [F.struct(F.lit(n).alias("split"), (F.col(f"_b{k - 1}") if k else none).alias("low"), (F.col(f"_b{k}") if k < len(ends) - 1 else none).alias("high")) for k, n in enumerate(names)]
    return found.select(key, F.inline(F.array(*each)))


def fold_rows(rows: DataFrame, train_end: str, valid_start: str, valid_end: str, purge: int = 5, key: str = "asset", time: str = "date") -> DataFrame:
    """Rows of one walk-forward fold with part (train or validation); purge rows go at the end of train and the start of validation."""
    day = F.col(time)
    part = F.when(day <= F.lit(train_end).cast("date"), "train").when((day >= F.lit(valid_start).cast("date")) & (day <= F.lit(valid_end).cast("date")), "validation")
    w = Window.partitionBy(key, "part")
    out = rows.withColumn("part", part).where("part is not null").withColumns({"_up": F.row_number().over(w.orderBy(time)), "_down": F.row_number().over(w.orderBy(F.desc(time)))})
    return out.where(F.when(F.col("part") == "train", F.col("_down") > purge).otherwise(F.col("_up") > purge)).drop("_up", "_down")
