"""Histories landed as pages, read by following each series' cursor: a Python data source.

A page is what a provider gave for one cursor: a JSON array of rows, each an array
that begins with the time. Pages lie under ``<path>/series=<name>/cursor=<number>/``.
``land_pages`` writes such a folder with Spark; ``PagedHistory`` reads it, one task
for each series, as every cursor comes from the page before it.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StringType, StructType

FORMAT = "paged_history"
DAY_MS = 24 * 60 * 60 * 1000
PAGE_ROWS = 1000
#: How Spark names the folder of a null series.
NULL_SERIES = "__HIVE_DEFAULT_PARTITION__"


def land_pages(rows: DataFrame, path: str, series: str, time: str, values: list[str], start: int, size: int = PAGE_ROWS, step: int = DAY_MS) -> None:
    """Write rows as pages of size rows, a page's cursor being start or the last time of the page before plus step.

    Times are whole numbers, values are written as texts, as such providers do.
    Rows of one series and time come in the order of their values. An existing
    folder is an error.
    """
    texts = [F.col(c).cast("string") for c in values]
    order = Window.partitionBy("series").orderBy("t", "row")
    row = F.to_json(F.array(F.col(time).cast("long").cast("string"), *texts), {"ignoreNullFields": "false"})
    numbered = rows.select(F.col(series).cast("string").alias("series"), F.col(time).cast("long").alias("t"), row.alias("row"))
    numbered = numbered.withColumns({"n": F.row_number().over(order) - 1, "before": F.lag("t").over(order)})
    pages = numbered.groupBy("series", F.floor(F.col("n") / size).alias("page")).agg(
        F.min_by("before", "n").alias("before"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "row"))), lambda r: r["row"]), ",").alias("body"),
    )
    cursor = F.coalesce(F.col("before") + step, F.lit(start).cast("long"))
    pages.select("series", cursor.alias("cursor"), F.concat(F.lit("["), "body", F.lit("]")).alias("value")).write.partitionBy("series", "cursor").text(path)


class SeriesPages(InputPartition):
    """The pages of one series: its name and its folder."""

    def __init__(self, name: str | None, folder: str):
        super().__init__(None)
        self.name, self.folder = name, folder


class PagedReader(DataSourceReader):
    """Follows the cursors of each series and holds one page at a time."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        path = options.get("path")
        if not path:
            raise ValueError(f"{FORMAT} needs a path")
        kinds = [f.dataType for f in schema.fields]
        if len(kinds) < 2 or kinds[0] != StringType() or kinds[1] != LongType() or any(k not in (StringType(), LongType(), DoubleType()) for k in kinds[2:]):
            raise ValueError(f"{FORMAT} reads a string, the series, a long, the time, and then strings, longs and doubles")
        self.path, self.kinds = path, kinds
        self.names = [f.name for f in schema.fields]
        self.start, self.end = int(options.get("start", "0")), int(options.get("end", str(2**62)))
        self.size, self.step = int(options.get("size", str(PAGE_ROWS))), int(options.get("step", str(DAY_MS)))
        if self.size < 1:
            raise ValueError("a page has at least one row")

    def _at(self) -> tuple[fs.FileSystem, str]:
        if "://" in self.path or self.path.startswith("file:"):
            return fs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + self.path.removeprefix("file:"))
        return fs.LocalFileSystem(), self.path

    def partitions(self) -> list[InputPartition]:
        store, folder = self._at()
        found = [x for x in store.get_file_info(fs.FileSelector(folder)) if x.type == fs.FileType.Directory and x.base_name.startswith("series=")]
        names = {x.path: unquote(x.base_name.removeprefix("series=")) for x in found}
        return [SeriesPages(None if name == NULL_SERIES else name, path) for path, name in sorted(names.items())]

    def _page(self, store: fs.FileSystem, folder: str, cursor: int) -> list[list]:
        """Rows of the page of a cursor; a cursor without a page has none."""
        files = store.get_file_info(fs.FileSelector(f"{folder}/cursor={cursor}", allow_not_found=True))
        rows: list[list] = []
        for file in sorted((f for f in files if f.is_file and f.base_name[0] not in "._"), key=lambda f: f.path):
            with store.open_input_stream(file.path) as stream:
                for line in stream.read().decode("utf-8").splitlines():
                    rows += json.loads(line) if line.strip() else []
        return rows

    def _batch(self, name: str | None, rows: list[list]) -> pa.RecordBatch:
        columns = [pa.array([name] * len(rows), pa.string()), pa.array([int(r[0]) for r in rows], pa.int64())]
        for k, kind in enumerate(self.kinds[2:], 1):
            cells = [r[k] if k < len(r) else None for r in rows]
            to, as_type = {StringType(): (_text, pa.string()), LongType(): (_whole, pa.int64()), DoubleType(): (_number, pa.float64())}[kind]
            columns.append(pa.array([to(c) for c in cells], as_type))
        return pa.RecordBatch.from_arrays(columns, names=self.names)

    def read(self, partition: InputPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark passes where there are no partitions
            return
        store, _ = self._at()
        cursor = self.start
        while cursor <= self.end:
            rows = self._page(store, partition.folder, cursor)
            if not rows:
                return
            following = int(rows[-1][0]) + self.step
            yield self._batch(partition.name, [r for r in rows if self.start <= int(r[0]) <= self.end])
            if following <= cursor:
                raise ValueError(f"{partition.name}: pages do not advance beyond {cursor}")
            if len(rows) < self.size:
                return
            cursor = following


class PagedHistory(DataSource):
    """Data source ``paged_history``.

    Options: path; start, the first cursor (0), and end, the last time wanted, both
    inclusive; size, the rows of a full page (1000); step, what is added to a page's
    last time to get the next cursor (a day in milliseconds). The schema is the
    caller's: the series (string), the time (long), then strings, longs or doubles.

    A series ends at a cursor without a page or with an empty one, and after a page
    of fewer than size rows. A page whose last time does not lead beyond its cursor
    is an error. A cell that is missing or cannot be read as its type is null; rows
    out of start and end are left out; repeated rows stay. A folder without series
    gives no rows. Reading again, as after a lost executor, gives the same rows.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "series string, time long, open double, high double, low double, close double, volume double"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(schema, dict(self.options))


def paged_history(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
    """Rows of a folder of pages; options as for the data source."""
    spark.dataSource.register(PagedHistory)
    reader = spark.read.format(FORMAT).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def day_ms(day: Column) -> Column:
    """Midnight of a date in UTC as milliseconds, whatever the session's time zone."""
    return F.datediff(day, F.lit("1970-01-01").cast("date")).cast("long") * DAY_MS


def ms_day(time: Column) -> Column:
    """Date in UTC of milliseconds."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(time / DAY_MS).cast("int"))


def _text(cell) -> str | None:
    return None if cell is None else cell if isinstance(cell, str) else json.dumps(cell)


def _number(cell) -> float | None:
    try:
        found = float(cell)
    except (TypeError, ValueError):
        return None
    return found if math.isfinite(found) else None


def _whole(cell) -> int | None:
    try:
        return int(cell)
    except (TypeError, ValueError):
        return None
