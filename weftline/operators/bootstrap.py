"""Seeded resampling: i.i.d. and block bootstraps, random baselines.

Samples are spread over tasks: a group's values are one array (a series of one
asset), which goes with each chunk of CHUNK samples to a row of its own; a task
draws one sample after another, so it holds no more than a few arrays of that
length. Sample statistics are put together by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MASK = np.uint64(0xFFFFFFFF)
#: Samples drawn from one row.
CHUNK = 25
#: Multiplier and increment of the generator.
MULTIPLY, ADD = 1664525, 1013904223


def text_seed(text: str, base: int) -> int:
    """32-bit seed of a text."""
    h = base & 0xFFFFFFFF
    for c in text:
        h = ((h ^ ord(c)) * 2654435761) & 0xFFFFFFFF
    return h or 1


def uniform(seed: int, n: int) -> np.ndarray:
    """n numbers of the linear congruential generator 1664525 x + 1013904223 modulo 2**32, by jumps in blocks."""
    size = 4096
    a, c = np.ones(size, dtype=np.uint64), np.zeros(size, dtype=np.uint64)
    mul, add = 1, 0
    for k in range(size):
        mul, add = mul * MULTIPLY & 0xFFFFFFFF, (add * MULTIPLY + ADD) & 0xFFFFFFFF
        a[k], c[k] = mul, add
    out, state = [], np.uint64(seed & 0xFFFFFFFF)
    for _ in range(0, n, size):
        block = (a * state + c) & MASK
        out.append(block)
        state = block[-1]
    return (np.concatenate(out)[:n] if out else np.empty(0)) / 2.0**32


def jump(seed: int, steps: int) -> int:
    """State of the generator after some steps, by repeated squaring."""
    mul, add, by_mul, by_add = 1, 0, MULTIPLY, ADD
    while steps:
        if steps & 1:
            mul, add = mul * by_mul & 0xFFFFFFFF, (add * by_mul + by_add) & 0xFFFFFFFF
        by_mul, by_add = by_mul * by_mul & 0xFFFFFFFF, (by_add * by_mul + by_add) & 0xFFFFFFFF
        steps >>= 1
    return (mul * (seed & 0xFFFFFFFF) + add) & 0xFFFFFFFF


def _series(rows: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """key, v: the columns of each series as structs in order."""
    held = F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), *(F.col(c).alias(f"v{k}") for k, c in enumerate(columns)))))
    return rows.groupBy(key).agg(F.transform(held, lambda x: F.struct(*(x[f"v{k}"].cast("double").alias(f"v{k}") for k in range(len(columns))))).alias("v"))


def _chunks(series: DataFrame, samples: int) -> DataFrame:
    """series with first, the first sample of each chunk, dealt over tasks."""
    return series.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(samples - 1), F.lit(CHUNK)))).repartition(*series.columns[:1], "first")


def mean_interval(rows: DataFrame, value: str, key: str, order: str, samples: int = 500, seed: int = 20260619, share: float = 0.95) -> DataFrame:
    """key, n, mean, low, high: percentile interval of the mean of resampled values, drawn in the order of ``order``; no interval below two values."""
    series = _series(rows.where(F.col(value).isNotNull()), key, order, value)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, held, first in zip(batch[key], batch["v"], batch["first"], strict=True):
                v = np.array([x["v0"] for x in held], dtype=float)
                n = len(v)
                state = jump(text_seed(str(name), seed), first * n)
                for _ in range(first, min(first + CHUNK, samples)):
                    out.append((name, float(v[(uniform(state, n) * n).astype(np.int64)].mean())))
                    state = jump(state, n)
            yield pd.DataFrame(out, columns=[key, "drawn"])

    drawn = _chunks(series.where(F.size("v") > 1), samples).mapInPandas(draw, f"{key} string, drawn double")
    ends = drawn.groupBy(key).agg(F.percentile("drawn", (1 - share) / 2).alias("low"), F.percentile("drawn", (1 + share) / 2).alias("high"))
    means = rows.where(F.col(value).isNotNull()).groupBy(F.col(key).cast("string").alias(key)).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return means.join(ends, key, "left")


def block_sums(values: np.ndarray, starts: np.ndarray, block: int) -> np.ndarray:
    """Sums of each column of values (n, c) over circular blocks from starts, of which only n places count: whole blocks and the beginning of the last.

    By differences of prefix sums over the doubled series, so a sample costs n / block.
    """
    n = len(values)
    upto = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(np.concatenate([values, values[: min(block, n)]]), axis=0)])
    whole = n // block
    out = (upto[starts[:whole] + block] - upto[starts[:whole]]).sum(axis=0) if whole and block <= n else np.zeros(values.shape[1])
    rest = n - whole * block if block <= n else n
    return out + (upto[starts[whole] + rest] - upto[starts[whole]] if rest else 0.0)


def block_samples(rows: DataFrame, columns: list[str], key: str, order: str, samples: int = 300, block: int = 20, seed: int = 7, by: tuple[str, ...] = ()) -> DataFrame:
    """by, key, sample, n, sums (an array, one for each column): sums over circular blocks drawn within each series, its own for every sample.

    Statistics of a sample, ratios of several sums too, are made from these by Spark.
    Null values count as 0. ``by`` cuts rows into cohorts, in each of which a series
    is drawn on its own. A series is one row of a few doubles for each of its rows.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    named = rows.withColumn("_series", F.concat_ws("\x1f", *(text(c) for c in (*by, key))))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, held, first in zip(batch["_series"], batch["v"], batch["first"], strict=True):
                v = np.nan_to_num(np.array([[x[f"v{k}"] for k in range(len(columns))] for x in held], dtype=float))
                n, out = len(v), []
                for k in range(first, min(first + CHUNK, samples)):
                    starts = np.random.default_rng([seed, text_seed(str(name), seed), k]).integers(0, n, -(-n // block))
                    out.append((name, k, n, block_sums(v, starts, block).tolist()))
                yield pd.DataFrame(out, columns=["_series", "sample", "n", "sums"])

    drawn = _chunks(_series(named, "_series", order, *columns), samples).mapInPandas(draw, "_series string, sample long, n long, sums array<double>")
    parts = F.split("_series", "\x1f")
    return drawn.select(*(F.get(parts, F.lit(k)).alias(c) for k, c in enumerate((*by, key))), "sample", "n", "sums")


def _interval(each: DataFrame, *names: str, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per cohort and name: measure, samples, mean, low, high (95%) of the samples' values; samples without a value are left out."""
    long = each.select(*by, F.inline(F.array(*(F.struct(F.lit(n).alias("measure"), F.col(n).alias("d")) for n in names)))).where("d is not null")
    return long.groupBy(*by, "measure").agg(F.count("*").alias("samples"), F.avg("d").alias("mean"), F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"))


def block_delta(rows: DataFrame, better: str, worse: str, key: str, order: str, samples: int = 300, block: int = 20, seed: int = 7) -> DataFrame:
    """Mean and 95% interval of the relative improvement 1 - mean(better) / mean(worse), means of series' means over circular blocks drawn within each series."""
    drawn = block_samples(rows, [better, worse], key, order, samples, block, seed)
    mean = lambda k: F.avg(F.get("sums", F.lit(k)) / F.col("n"))
    each = drawn.groupBy("sample").agg((1.0 - F.try_divide(mean(0), mean(1))).alias("d"))
    return each.agg(F.count("*").alias("samples"), F.avg("d").alias("improvement"), F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"))


def error_delta(rows: DataFrame, candidate: str, baseline: str, key: str, order: str, samples: int = 300, block: int = 20, seed: int = 7, by: tuple[str, ...] = ()) -> DataFrame:
    """measure ``delta``: mean and 95% interval of candidate less baseline errors, series alike."""
    drawn = block_samples(rows, [candidate, baseline], key, order, samples, block, seed, by)
    mean = lambda k: F.get("sums", F.lit(k)) / F.col("n")
    return _interval(drawn.groupBy(*by, "sample").agg(F.avg(mean(0) - mean(1)).alias("delta")), "delta", by=by)


def coverage_interval(bounds: DataFrame, actual: str, key: str, order: str, samples: int = 300, block: int = 20, seed: int = 7, by: tuple[str, ...] = ()) -> DataFrame:
    """measures coverage50 and coverage80: mean and 95% interval of the coverage of the inner and outer bounds, series alike."""
    inside = lambda a, b: F.col(actual).between(F.col(a), F.col(b)).cast("int")
    rows = bounds.select(*by, key, order, inside("bound1", "bound2").alias("_50"), inside("bound0", "bound3").alias("_80"))
    drawn = block_samples(rows, ["_50", "_80"], key, order, samples, block, seed, by)
    mean = lambda k: F.avg(F.get("sums", F.lit(k)) / F.col("n"))
    return _interval(drawn.groupBy(*by, "sample").agg(mean(0).alias("coverage50"), mean(1).alias("coverage80")), "coverage50", "coverage80", by=by)


def weather_interval(rows: DataFrame, rank: str, ratio: str, event: str, key: str, order: str, samples: int = 300, block: int = 20, seed: int = 7, by: tuple[str, ...] = (), quiet: float = 25.0, storm: float = 90.0) -> DataFrame:
    """measures ratio and event: mean and 95% interval of storm less quiet, series alike.

    In a sample only series count that have both a quiet row (rank below ``quiet``) and a storm (``storm`` or above).
    """
    calm, rough = F.col(rank) < quiet, F.col(rank) >= storm
    parts = {"_q": calm.cast("int"), "_s": rough.cast("int")}
    for name, c in (("r", ratio), ("e", event)):
        parts |= {f"_q{name}": F.when(calm, F.col(c)).otherwise(0.0), f"_s{name}": F.when(rough, F.col(c)).otherwise(0.0)}
    names = ["_q", "_s", "_qr", "_sr", "_qe", "_se"]
    drawn = block_samples(rows.select(*by, key, order, *(x.alias(n) for n, x in parts.items())), names, key, order, samples, block, seed, by)
    at = {n: F.get("sums", F.lit(k)) for k, n in enumerate(names)}
    both = drawn.where((at["_q"] > 0) & (at["_s"] > 0))
    delta = lambda x: F.avg(at[f"_s{x}"] / at["_s"] - at[f"_q{x}"] / at["_q"])
    return _interval(both.groupBy(*by, "sample").agg(delta("r").alias("ratio"), delta("e").alias("event")), "ratio", "event", by=by)


def random_direction(rows: DataFrame, value: str, key: str, order: str, runs: int = 200, seed: int = 20260619) -> DataFrame:
    """key, accuracy, coverage and mean value of fair coin directions, averaged over seeded runs."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, held, first in zip(batch[key], batch["v"], batch["first"], strict=True):
                v = np.array([x["v0"] for x in held], dtype=float)
                for r in range(first, min(first + CHUNK, runs)):
                    bull = uniform(seed + r * 7919, len(v)) >= 0.5
                    out.append((name, float((bull == (v > 0)).mean()), float(bull.mean()), float(v[bull].sum() / max(1, bull.sum()))))
            yield pd.DataFrame(out, columns=[key, "accuracy", "coverage", "mean_value"])

    drawn = _chunks(_series(rows.where(F.col(value).isNotNull()), key, order, value), runs).mapInPandas(draw, f"{key} string, accuracy double, coverage double, mean_value double")
    return drawn.groupBy(key).agg(*(F.avg(c).alias(c) for c in ("accuracy", "coverage", "mean_value")))
