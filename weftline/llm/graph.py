"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import HEAVY, Scratch, join_facts


def _star(edges: DataFrame, large: bool, spread=None) -> DataFrame:
    """One large or small star over edges (a, b) with a > b: neighbours are linked to the least neighbour."""
    seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = seen.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("a", "m"))
    met = spread(seen, least) if spread else seen.join(least, "a")
    if large:
        linked = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        linked = met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return linked.where("a <> b").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, owner: Scratch | None = None) -> DataFrame:
    """node, component (its least node) for every node of a link; self links and nulls link nothing.

    Each round is written to the shared folder, which cuts the lineage. Rounds
    grow with the logarithm of the longest chain of links; an error is raised if
    max_rounds do not suffice. The table that the result reads passes to owner,
    if one is given, which then removes it.
    """
    scratch = Scratch(edges.sparkSession)
    kept = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    now = scratch.write(kept.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    mark = None
    for _ in range(max_rounds):
        ends = now.select("a", F.xxhash64("a", "b").alias("h")).unionByName(now.select(F.col("b").alias("a"), F.lit(0).cast("long").alias("h")))
        ends = ends.groupBy("a").agg(F.count("*").alias("n"), F.bit_xor("h").alias("h")).agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.bit_xor("h").alias("h"))
        before, mark = mark, ends.first()
        if before == mark or not mark.n:
            break
        if mark.most > HEAVY:  # large stars have a hub: neither star gives a node more links

            def spread(seen: DataFrame, least: DataFrame, total: int = mark.n) -> DataFrame:
                return join_facts(seen, scratch.write(least), "a", "n", total)

            middle = scratch.write(_star(now, True, spread))
            now = scratch.write(_star(middle, False, spread), now, middle)
        else:
            now = scratch.write(_star(_star(now, True), False), now)
    else:
        raise RuntimeError(f"components are unfinished after {max_rounds} rounds")
    scratch.keep(now)
    if owner:
        owner.paths |= scratch.paths
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
