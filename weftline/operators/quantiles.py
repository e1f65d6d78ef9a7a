"""Weighted quantiles by ranges of values: totals of every range first, then only the ranges that hold a point.

Rows of a key are never brought together: equal values are summed before and
after a shuffle, ranges have borders from a mergeable sketch of all values, and
what is windowed is a key's totals (RANGES rows at most) or one range of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.scalar import half_up

#: Ranges of values; a range holds about this share of all different values.
RANGES = 64


def _range_of(value: Column, borders: list[float]) -> Column:
    return F.size(F.filter(F.array(*(F.lit(b) for b in borders)), lambda b: b <= value)) if borders else F.lit(0)


def weighted_quantile(rows: DataFrame, value: str, weight: str, points: list[float], keys: list[str], digits: int = 6) -> DataFrame:
    """keys, rows, and quantiles q0, q1, ...: interpolated between the midpoints of cumulated weights by value, the ends held.

    Null values and weights, and weights of 0 or less, are left out; equal values are
    ordered by weight. A key without rows is missing.
    """
    held = rows.where(F.col(value).isNotNull() & (F.col(weight) > 0))
    # rows of equal value make a flat piece, from half of the first one's weight to half of the last one's
    ties = held.groupBy(*keys, F.col(value).alias("_v")).agg(F.sum(weight).alias("_w"), F.min(weight).alias("_low"), F.max(weight).alias("_high"), F.count("*").alias("_n"))
    found = ties.agg(F.percentile_approx("_v", [(k + 1) / RANGES for k in range(RANGES - 1)], 4096)).first()[0]
    placed = ties.withColumn("_range", _range_of(F.col("_v"), sorted(set(found or []))))
    totals = placed.groupBy(*keys, "_range").agg(F.sum("_w").alias("_in"), F.sum("_n").alias("_rows"))
    per_key = Window.partitionBy(*keys)
    upto = per_key.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({"_before": F.coalesce(F.sum("_in").over(upto), F.lit(0.0)), "_all": F.sum("_in").over(per_key), "rows": F.sum("_rows").over(per_key), "_nth": F.row_number().over(per_key.orderBy("_range")), "_last": F.count("*").over(per_key)})
    # the point lies in the range up to which the weights first reach it, or between it and one beside
    at = totals.withColumn("_k", F.explode(F.array(*(F.lit(k) for k in range(len(points))))))
    goal = F.element_at(F.array(*(F.lit(float(p)) for p in points)), F.col("_k") + 1)
    inside = (F.col("_before") < goal * F.col("_all")) & (F.col("_before") + F.col("_in") >= goal * F.col("_all"))
    edge = ((goal <= 0) & (F.col("_nth") == 1)) | (((goal >= 1) | (F.col("_before") + F.col("_in") < goal * F.col("_all"))) & (F.col("_nth") == F.col("_last")))
    held_at = at.where(inside | edge).groupBy(*keys, "_k").agg(F.min("_nth").alias("_from"), F.max("_nth").alias("_to"))
    near = totals.join(held_at, keys).where((F.col("_nth") >= F.col("_from") - 1) & (F.col("_nth") <= F.col("_to") + 1))
    needed = near.groupBy(*keys, "_range").agg(F.collect_list("_k").alias("_ks"), F.first("_before").alias("_before"), F.first("_all").alias("_all"), F.first("rows").alias("rows"))  # at most a number for each point
    own = Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    some = placed.join(needed, [*keys, "_range"]).withColumn("_start", F.col("_before") + F.coalesce(F.sum("_w").over(own), F.lit(0.0)))
    left, right = (F.col("_start") + F.col("_low") / 2.0) / F.col("_all"), (F.col("_start") + F.col("_w") - F.col("_high") / 2.0) / F.col("_all")
    each = some.select(*keys, "rows", F.explode("_ks").alias("_k"), "_v", left.alias("_left"), right.alias("_right"))
    below = F.max(F.when(F.col("_left") <= goal, F.struct(F.least("_right", goal).alias("m"), F.col("_v").alias("v"))))
    above = F.min(F.when(F.col("_right") > goal, F.struct(F.greatest("_left", goal).alias("m"), F.col("_v").alias("v"))))
    met = each.groupBy(*keys, "rows", "_k").agg(below.alias("b"), above.alias("a"))
    share = F.try_divide(goal - F.col("b.m"), F.col("a.m") - F.col("b.m"))
    q = F.when(F.col("b").isNull(), F.col("a.v")).when(F.col("a").isNull() | (F.col("b.v") == F.col("a.v")) | share.isNull(), F.col("b.v")).otherwise(F.col("b.v") + (F.col("a.v") - F.col("b.v")) * share)
    return met.groupBy(*keys, "rows").agg(*(half_up(F.max(F.when(F.col("_k") == k, q)), digits).alias(f"q{k}") for k in range(len(points))))
