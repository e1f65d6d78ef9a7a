"""Embedding near-duplicates by an exact metric range join.

Unit vectors with a cosine of at least c lie within e = sqrt(2 - 2c) of each
other. Pivots, a bounded seeded choice of the vectors, cut the space into cells
of the nearest pivot. By the triangle inequality a vector of cell i can have a
partner in cell j only if it lies within e of the border of the two, that is if
d(x, j)**2 - d(x, i)**2 <= 2 e d(i, j); it is copied to such cells j < i. Each
cell then joins its own vectors with all it holds, on its own, in blocks of
bounded size.

Equal vectors are one class with a count, known by 128 bits, and are joined once. Of the links found
in a block only a spanning forest is passed on, as counts and components need no
more; links are counted where they are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, join_facts
from weftline.llm.graph import connected_components


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Unit rows in double precision of a list column whose lists have one length."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    rows = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # against overflow of the squares
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _assigner(shared, reach: float):
    """Vectors with their own cell (own) and the lower cells that need a copy."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.array(batch.column("dim"))
            for dim in np.unique(dims).tolist():
                some = batch.filter(pa.array(dims == dim))
                pivots, apart = shared.value[dim]
                square = 2.0 - 2.0 * (_matrix(some.column("embedding")) @ pivots.T)
                own = square.argmin(axis=1)
                near = square - square[np.arange(len(own)), own][:, None] <= 2.0 * reach * apart[own] + 1e-9
                near &= np.arange(len(pivots))[None, :] < own[:, None]
                row, cell = np.nonzero(near)
                at = np.concatenate((np.arange(len(own)), row))
                yield pa.RecordBatch.from_arrays(
                    [*some.take(pa.array(at)).columns, pa.array(np.concatenate((own, cell)), pa.int32()), pa.array(np.concatenate((np.ones(len(own), bool), np.zeros(len(row), bool))))],
                    names=[*some.schema.names, "cell", "own"],
                )

    return assign


def _joiner(cosine: float, step: int = 512):
    """Links of one block: counts (a, null, n) and a spanning forest (a, b, 0)."""

    def join(block: pa.Table) -> pa.Table:
        core = block.filter(block["core"])
        other = block.filter(pa.compute.invert(block["core"]))
        out_a, out_b, out_n = [], [], []
        if len(core) and len(other):
            x, y = _matrix(core["embedding"]), _matrix(other["embedding"])
            id_x, id_y = (np.array(t["cid"]) for t in (core, other))
            n_x, n_y = (np.array(t["n"]) for t in (core, other))
            own = np.array(other["own"])
            sum_x, sum_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
            root: dict[int, int] = {}

            def find(v: int) -> int:
                while (up := root.setdefault(v, v)) != v:
                    root[v] = root[up]
                    v = root[v]
                return v

            for first in range(0, len(x), step):
                i, j = np.nonzero(x[first : first + step] @ y.T >= cosine)
                i += first
                keep = id_x[i] != id_y[j]
                i, j = i[keep], j[keep]
                np.add.at(sum_x, i, n_y[j])
                copied = ~own[j]
                np.add.at(sum_y, j[copied], n_x[i[copied]])
                for a, b in zip(id_x[i].tolist(), id_y[j].tolist(), strict=True):
                    if (p := find(a)) != (q := find(b)):
                        root[p] = q
                        out_a.append(a)
                        out_b.append(b)
                        out_n.append(0)
            for ids, sums in ((id_x, sum_x), (id_y, sum_y)):
                for k in np.flatnonzero(sums).tolist():
                    out_a.append(int(ids[k]))
                    out_b.append(None)
                    out_n.append(int(sums[k]))
        return pa.table([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64()), pa.array(out_n, pa.int64())], names=["a", "b", "n"])

    return join


def near_vectors(vectors: DataFrame, vec_col: str = "vec_id", embedding_col: str = "embedding", cosine: float = 0.95, max_pivots: int = 1024, block: int | None = None, block_numbers: int = 1 << 19, seed: int = 5) -> DataFrame:
    """One row per row of vectors: vec_id, n_links, component_id, kept.

    n_links: other rows linked directly, copies included. component_id: the
    smallest vec_id that links reach (nulls are passed over). kept: vec_id =
    component_id. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing, nor do vectors of different lengths. Repeated
    rows are copies and link. An empty table gives no rows. Other columns are not read,
    whatever their names; null vec_ids stay. A list of any length is read whole. A block holds
    ``block`` vectors a side, by default block_numbers / length, so that long
    vectors need no more memory; a cell is about one block while max_pivots last.
    """
    kind = vectors.select(embedding_col).schema[0].dataType.simpleString()
    kind = kind if kind == "array<float>" else "array<double>"  # floats are sent as they are, cosines are of doubles
    e = F.col("embedding")
    sound = F.coalesce((F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(vec_col).alias("vec_id"), F.col(embedding_col).cast(kind).alias("embedding")).withColumn("key", F.when(sound, F.struct(F.xxhash64("embedding").alias("h"), F.xxhash64(F.lit(1), "embedding").alias("g"))))
    scratch = Scratch(vectors.sparkSession)
    # a class's number is only a name: it is drawn once and written
    classes = scratch.write(rows.where("key is not null").groupBy("key").agg(F.first("embedding").alias("embedding"), F.count("*").alias("n"), F.min("vec_id").alias("least")).withColumns({"dim": F.size("embedding"), "cid": F.monotonically_increasing_id()}))
    pivots = {}
    sizes_of = {}
    for r in classes.groupBy("dim").count().collect():
        sizes_of[r["dim"]] = block or max(16, block_numbers // r["dim"])
        k = min(max_pivots, max(1, -(-r["count"] // sizes_of[r["dim"]])))
        chosen = classes.where(F.col("dim") == r["dim"]).orderBy(F.xxhash64(F.lit(seed), "key.h"), "key").limit(k).select("embedding").toArrow()
        p = _matrix(chosen["embedding"])
        pivots[r["dim"]] = p, np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (p @ p.T)))
    spark = vectors.sparkSession
    shared = spark.sparkContext.broadcast(pivots)
    schema = f"cid long, embedding {kind}, n long, dim int"
    placed = scratch.write(classes.select("cid", "embedding", "n", "dim").mapInArrow(_assigner(shared, (2.0 - 2.0 * cosine) ** 0.5), f"{schema}, cell int, own boolean"))
    limit = F.lit(1)
    for dim, size in sizes_of.items():
        limit = F.when(F.col("dim") == dim, size).otherwise(limit)
    sizes = placed.groupBy("dim", "cell").agg(F.count_if("own").alias("cores"), F.count("*").alias("others")).withColumns({c: F.ceil(F.col(c) / limit).cast("int") for c in ("cores", "others")})
    dealt = placed.join(F.broadcast(sizes), ["dim", "cell"])  # as many rows as pivots
    mine = lambda k, c: F.pmod(F.xxhash64(F.lit(k), "cid"), F.greatest(F.lit(1), F.col(c))).cast("int")
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    held = ["dim", "cell", "cid", "embedding", "n", "own"]
    cores = dealt.where("own").select(*held, mine(seed, "cores").alias("i"), all_of("others").alias("j"), F.lit(True).alias("core"))
    others = dealt.where("cores > 0").select(*held, all_of("cores").alias("i"), mine(seed + 1, "others").alias("j"), F.lit(False).alias("core"))
    found = scratch.write(cores.unionByName(others).groupBy("dim", "cell", "i", "j").applyInArrow(_joiner(cosine), "a long, b long, n long"))

    scratch.keep(found, classes)
    linked = connected_components(found.where("b is not null"), owner=scratch)
    counts = found.where("b is null").groupBy("a").agg(F.sum("n").alias("links")).withColumnRenamed("a", "cid")
    parts = classes.select("key", "cid", "n", "least").join(linked.withColumnRenamed("node", "cid"), "cid", "left").join(counts, "cid", "left")
    parts = parts.select("key", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "least", F.coalesce("component", "cid").alias("part"))
    parts = scratch.write(parts)
    least = parts.groupBy("part").agg(F.min("least").alias("component_id"), F.count("*").alias("classes"))
    # a component or class that holds a large share of all rows meets its facts in a broadcast
    least = scratch.write(least)
    named = scratch.write(join_facts(parts, least, "part", "classes", classes.count()).select("key", "n", "n_links", "component_id"))
    scratch.keep(named)
    alone = rows.where("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    members = rows.where("key is not null").select("vec_id", "key")
    grouped = join_facts(members, named, "key", "n", named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]).select("vec_id", "n_links", "component_id")
    return grouped.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
