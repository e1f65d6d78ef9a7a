"""Mixing of sources to target weights by Sainte-Lague apportionment of equal-token blocks.

The size of the mix and the targets of sources come from their weights; a
target never exceeds ``repeat`` times its source. Blocks of ``block`` words are
allocated to sources by the highest quotients target / (2k + 1), and each
source's blocks to areas of at most ``area`` shards and theirs to the shards, by
their sizes in the same way. A shard is a
bounded number of documents in a seeded order, read as one stream of words: its
quota is taken as whole passes over the stream and a seeded choice of blocks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)


def targets(sizes: list[float], weights: list[float], total: float, repeat: float) -> list[float]:
    """Shares of total by weight; none above repeat * size, the excess is shared anew by weight."""
    open_, out = set(range(len(sizes))), [0.0] * len(sizes)
    left = min(total, repeat * sum(sizes))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if weights[i] * unit >= repeat * sizes[i]]
        if not over:
            for i in open_:
                out[i] = weights[i] * unit
            break
        for i in over:
            out[i] = repeat * sizes[i]
            left -= out[i]
            open_.remove(i)
    return out


def sainte_lague(votes: list[float], seats: int, most: list[int] | None = None) -> list[int]:
    """Seats by highest quotients votes / (2k + 1); ties go to the earlier party, no party gets more than its most."""
    n = len(votes)
    cap = most or [seats] * n
    seats = min(seats, sum(c for c, v in zip(cap, votes, strict=True) if v > 0))
    if seats <= 0:
        return [0] * n
    lo, hi = 0.0, max(votes) * 2 + 1  # price of a seat: votes / price, rounded, seats are sold
    for _ in range(200):
        price = (lo + hi) / 2
        if price in (lo, hi):
            break
        sold = sum(min(c, int(v / price + 0.5)) for v, c in zip(votes, cap, strict=True))
        lo, hi = (price, hi) if sold > seats else (lo, price)
    got = [min(c, int(v / hi + 0.5)) for v, c in zip(votes, cap, strict=True)]
    queue = [(-v / (2 * g + 1), i) for i, (v, g, c) in enumerate(zip(votes, got, cap, strict=True)) if g < c and v > 0]
    heapq.heapify(queue)
    for _ in range(seats - sum(got)):
        _, i = heapq.heappop(queue)
        got[i] += 1
        if got[i] < cap[i]:
            heapq.heappush(queue, (-votes[i] / (2 * got[i] + 1), i))
    return got


def _strides(shard: np.ndarray, blocks: np.ndarray, seed: int) -> tuple[list[int], list[int]]:
    """For each shard a seeded a and c so that i -> (a * i + c) mod blocks is a permutation."""
    a_out, c_out = [], []
    for s, n in zip(shard.tolist(), blocks.tolist(), strict=True):
        rng = np.random.default_rng([seed, s])
        n = max(1, int(n))
        a = int(rng.integers(1, n + 1))
        while gcd(a, n) != 1:
            a = a % n + 1
        a_out.append(a)
        c_out.append(int(rng.integers(0, n)))
    return a_out, c_out


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    size_factor: float = 1.5,
    repeat: int = 2,
    block: int = 32,
    shard_words: int = 1_000_000,
    area: int = 4096,
    max_sources: int = 100_000,
    seed: int = 17,
    text_col: str = "text",
    source_col: str = "source",
    doc_col: str = "doc_id",
) -> DataFrame:
    """One row per row of docs: doc_id, source, size, source_size, target, taken, plus the spans of words taken.

    size: words of the text, 0 for a null text. Sources in code-point order,
    null last, get the weights in turn. taken: words of the document in the mix,
    at most repeat * size. passes: whole passes; spans: the ranges of words
    [start, end) taken once more. Documents without words are taken 0 times.
    Reruns over the same rows agree; repeated rows share one place in the seeded
    order and are each counted. Texts of any length are counted whole. Over max_sources distinct sources is an error,
    as weights are given source by source and the table of sources is held on
    the driver. An empty table gives no rows.
    """
    rows = docs.select(
        F.col(doc_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(F.lit(seed), F.col(doc_col), F.length(text_col)).alias("_order"),
    )
    rows = Scratch(rows.sparkSession).write(rows)
    found = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    found.sort(key=lambda r: (r.source is None, (r.source or "").encode("utf-8")))
    sizes = [int(r["size"]) for r in found]
    goal = targets([float(x) for x in sizes], [weights[i % len(weights)] for i in range(len(found))], size_factor * sum(sizes), repeat)
    quota = sainte_lague(goal, round(sum(goal) / block), [-(-repeat * x // block) for x in sizes])
    shards = [max(1, -(-x // shard_words)) for x in sizes]
    plan = docs.sparkSession.createDataFrame(
        pd.DataFrame(
            {
                "source": pd.Series([r.source for r in found], dtype=object),
                "source_no": np.arange(len(found), dtype=np.int64),
                "source_size": np.array(sizes, dtype=np.int64),
                "target": np.array(goal, dtype=np.float64),
                "quota": np.array(quota, dtype=np.int64),
                "shards": np.array(shards, dtype=np.int64),
            }
        ),
        "source string, source_no long, source_size long, target double, quota long, shards long",
    )
    placed = rows.join(F.broadcast(plan), rows["source"].eqNullSafe(plan["source"])).select("doc_id", rows["source"], "size", "_order", "source_no", "source_size", "target", "quota", (F.pmod(F.xxhash64(F.lit(seed + 1), "_order"), F.col("shards"))).alias("shard"))

    def divide(groups: Iterator[pd.DataFrame] | pd.DataFrame) -> pd.DataFrame:
        g = groups.sort_values("shard")
        size = g["shard_size"].to_numpy()
        got = sainte_lague([float(x) for x in size], int(g["quota"].iloc[0]), [-(-repeat * int(x) // block) for x in size])
        want = np.minimum(np.array(got, dtype=np.int64) * block, repeat * size)
        passes = np.where(size > 0, want // np.maximum(size, 1), 0)
        rest = np.where(passes >= repeat, 0, want - passes * size)
        blocks = -(-size // block)
        a, c = _strides(g["shard"].to_numpy() + g["source_no"].iloc[0] * area, blocks, seed)
        return pd.DataFrame({"source_no": g["source_no"], "shard": g["shard"], "passes": passes, "blocks": blocks, "chosen": np.minimum(blocks, (rest + block // 2) // block), "a": a, "c": c})

    def share(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("area")
        got = sainte_lague([float(x) for x in g["size"]], int(g["quota"].iloc[0]), [int(x) for x in g["most"]])
        return pd.DataFrame({"source_no": g["source_no"], "area": g["area"], "quota": np.array(got, dtype=np.int64)})

    sized = placed.groupBy("source_no", "shard", "quota").agg(F.sum("size").alias("shard_size")).withColumn("area", F.floor(F.col("shard") / area))
    # a source's quota goes to areas of shards first, so that no group is unbounded
    most = F.sum(F.ceil(repeat * F.col("shard_size") / block)).alias("most")
    areas = sized.groupBy("source_no", "area", "quota").agg(F.sum("shard_size").alias("size"), most)
    areas = areas.groupBy("source_no").applyInPandas(share, "source_no long, area long, quota long")
    sized = sized.drop("quota").join(areas, ["source_no", "area"])
    quotas = sized.groupBy("source_no", "area").applyInPandas(divide, "source_no long, shard long, passes long, blocks long, chosen long, a long, c long")
    stream = Window.partitionBy("source_no", "shard").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = placed.withColumn("stop", F.sum("size").over(stream)).withColumn("start", F.col("stop") - F.col("size"))
    joined = numbered.join(quotas, ["source_no", "shard"])
    numbers = F.when((F.col("size") > 0) & (F.col("chosen") > 0) & (F.col("passes") < repeat), F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))).otherwise(F.array().cast("array<bigint>"))
    taken_blocks = F.filter(numbers, lambda i: F.pmod(F.col("a") * i + F.col("c"), F.col("blocks")) < F.col("chosen"))
    spans = F.transform(
        taken_blocks,
        lambda i: F.struct((F.greatest(i * block, F.col("start")) - F.col("start")).alias("start"), (F.least((i + 1) * block, F.col("stop")) - F.col("start")).alias("end")),
    )
    return (
        joined.withColumn("spans", spans)
        .withColumn("taken", F.col("passes") * F.col("size") + F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]))
        .select("doc_id", "source", "size", "source_size", "target", "taken", "passes", "spans")
    )
