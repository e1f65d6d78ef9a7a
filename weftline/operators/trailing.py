"""Ranks and quantiles among the rows before each row, for series of any length.

A series is cut into chunks of CHUNK rows; each chunk is read with as many rows
before it as its windows reach back, so chunks are tasks of their own and one
long series is spread over all cores. Within a chunk ranks are counted over
sliding views and quantiles are read from a sorted window into which each row is
inserted and from which the oldest is removed. A task holds one chunk.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Rows of a series in one chunk.
CHUNK = 8192
#: Rows compared with their windows at once.
_ROWS = 1024


@dataclass(frozen=True)
class Rank:
    """Share in percent of ``history`` in the n rows before that is at most ``value``; null if value or one of the n is null."""

    name: str
    value: str
    history: str
    n: int = 252


@dataclass(frozen=True)
class Quantiles:
    """Quantiles of ``value`` over the non-null ones of up to n rows before, interpolated between neighbours; null of fewer than ``least``."""

    names: tuple[str, ...]
    value: str
    points: tuple[float, ...]
    n: int = 252
    least: int = 1


def ranks(value: np.ndarray, history: np.ndarray, n: int) -> np.ndarray:
    """Of each value the share in percent of the n histories before it that is at most it; NaN without n of them or with a NaN among them."""
    out = np.full(len(value), np.nan)
    if len(value) <= n:
        return out
    windows = np.lib.stride_tricks.sliding_window_view(history, n)
    bad = np.concatenate([[0], np.cumsum(np.isnan(history))])
    for first in range(n, len(value), _ROWS):
        last = min(first + _ROWS, len(value))
        out[first:last] = (windows[first - n : last - n] <= value[first:last, None]).sum(axis=1) * 100.0 / n
    at = np.arange(n, len(value))
    out[at[(bad[at] - bad[at - n] > 0) | np.isnan(value[at])]] = np.nan
    return out


def quantiles(values: np.ndarray, n: int, points: tuple[float, ...], least: int) -> np.ndarray:
    """Of each row the quantiles of the non-NaN values among up to n rows before it, a column for each point; NaN of fewer than least."""
    out = np.full((len(values), len(points)), np.nan)
    listed, window = values.tolist(), []
    for i, x in enumerate(listed):
        k = len(window)
        if k >= max(least, 1):
            for c, q in enumerate(points):
                at = (k - 1) * q
                low = int(at)
                first = window[low]
                out[i, c] = first if low == at else first + (window[low + 1] - first) * (at - low)
        if x == x:
            insort(window, x)
        if i >= n and listed[i - n] == listed[i - n]:
            del window[bisect_left(window, listed[i - n])]
    return out


def _groups(batches: Iterator[pa.RecordBatch], columns: list[int]) -> Iterator[pa.Table]:
    """Sorted batches cut where the values of columns change."""
    held: list[pa.RecordBatch] = []
    mark = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            code = batch.column(c).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            change[1:] |= code[1:] != code[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            now = tuple(batch.column(c)[a].as_py() for c in columns)
            if held and now != mark:
                yield pa.Table.from_batches(held)
                held = []
            mark = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def with_trailing(rows: DataFrame, wanted: list[Rank | Quantiles], key: str = "asset", time: str = "date", number: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """rows with a double column for each name wanted.

    ``number`` is the column that numbers the rows of a series from 1 by time; it is
    counted if not given (rows of equal time are then in any order). Series of a null
    key are one. NaN counts as null. An empty list changes nothing.
    """
    if not wanted:
        return rows
    reach = max(w.n for w in wanted)
    names = [n for w in wanted for n in ((w.name,) if isinstance(w, Rank) else w.names)]
    numbered = rows.withColumn("_at", (F.col(number).cast("long") if number else F.row_number().over(Window.partitionBy(key).orderBy(time))) - 1)
    first = F.floor(F.col("_at") / chunk)
    # a row stands in its own chunk and in those whose windows reach back to it
    placed = numbered.withColumns({"_chunk": F.explode(F.sequence(first, F.floor((F.col("_at") + reach) / chunk))), "_own": first})
    placed = placed.withColumn("_own", F.col("_own") == F.col("_chunk"))
    kept = rows.columns
    schema = StructType([*rows.schema.fields, *(StructField(n, DoubleType()) for n in names)])
    at = {c: i for i, c in enumerate(placed.columns)}
    cuts, own = [at[key], at["_chunk"]], at["_own"]

    def column(table: pa.Table, name: str) -> np.ndarray:
        return table.column(at[name]).cast(pa.float64()).to_numpy()

    def stated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, cuts):
            mine = table.column(own).to_numpy()
            found = []
            for w in wanted:
                if isinstance(w, Rank):
                    found.append(ranks(column(table, w.value), column(table, w.history), w.n))
                else:
                    found += list(quantiles(column(table, w.value), w.n, w.points, w.least).T)
            if mine.any():
                arrays = [table.column(at[c]).combine_chunks().filter(pa.array(mine)) for c in kept]
                yield pa.RecordBatch.from_arrays([*arrays, *(pa.array(x[mine], pa.float64(), from_pandas=True) for x in found)], [*kept, *names])

    return placed.repartition(key, "_chunk").sortWithinPartitions(key, "_chunk", "_at").mapInArrow(stated, schema)
