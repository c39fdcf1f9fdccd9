"""The slice drop as a data source: one zipped file for every quarter of an hour, streamed or read over a range.

A stream's offset is {"next": the boundary after the last slice, "missing": boundaries in the lookback that have no file
yet}, both from the clock and the store alone. A batch reads the slices between two offsets that have a file and the late
ones that have come since, so each slice is read once however late it is inside the lookback, and nothing is read
twice. Every slice is a partition of its own.
"""

from __future__ import annotations

import datetime as dt
import io
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: A slice's own row has a status and its number of lines; the rows of its lines have a value.
SCHEMA = "slice timestamp, status string, lines long, value string"
#: What an unreadable archive raises: a broken container, broken deflate data, encryption, an unknown method.
BROKEN = (zipfile.BadZipFile, zlib.error, EOFError, RuntimeError, NotImplementedError, ValueError, IndexError, OverflowError)
_BATCH = 8192


def first_member(content: bytes) -> list[str] | None:
    """The lines of an archive's first member, cut where Spark's text reader cuts; None if it cannot be read."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            return [x.decode("utf-8", "replace") for x in archive.read(archive.namelist()[0]).splitlines()]
    except BROKEN:
        return None


def _seconds(text: str) -> int:
    at = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    return int((at if at.tzinfo else at.replace(tzinfo=dt.timezone.utc)).timestamp())


class Drop:
    """Where slices lie and which of them are due. Options: path, name (a strftime pattern), minutes between slices, lag in
    minutes behind a boundary, lookback in minutes for late files, now (for replays; else the clock)."""

    def __init__(self, options: dict):
        self.store, self.path = fs.FileSystem.from_uri(str(options["path"]))
        self.name = options.get("name", "%Y%m%d%H%M%S.gkg.csv.zip")
        self.step = 60 * int(options.get("minutes", 15))
        self.lag, self.lookback = 60 * int(options.get("lag", 7)), 60 * int(options.get("lookback", 75))
        self.now = _seconds(options["now"]) if options.get("now") else None

    def due(self) -> int:
        """The boundary after the last slice that counts as published."""
        now = dt.datetime.now(dt.timezone.utc).timestamp() if self.now is None else self.now
        return int(now - self.lag) // self.step * self.step + self.step

    def up(self, seconds: int) -> int:
        return -(-seconds // self.step) * self.step

    def file(self, at: int) -> str:
        return f"{self.path.rstrip('/')}/{dt.datetime.fromtimestamp(at, dt.timezone.utc).strftime(self.name)}"

    def absent(self, slices: list[int]) -> list[int]:
        found = self.store.get_file_info([self.file(x) for x in slices]) if slices else []
        return [x for x, info in zip(slices, found) if info.type == fs.FileType.NotFound]

    def read(self, at: int) -> Iterator[pa.RecordBatch]:
        """A slice's own row and its lines; what has no file is missing, what cannot be unzipped is corrupt."""
        try:
            with self.store.open_input_stream(self.file(at)) as f:
                lines = first_member(f.read())
            status = "corrupt" if lines is None else "read"
        except FileNotFoundError:
            lines, status = None, "missing"
        yield self._rows(at, [status], [len(lines or ())], [None])
        for k in range(0, len(lines or ()), _BATCH):
            part = lines[k : k + _BATCH]
            yield self._rows(at, [None] * len(part), [None] * len(part), part)

    @staticmethod
    def _rows(at: int, status: list, lines: list, values: list) -> pa.RecordBatch:
        times = pa.array([at * 1_000_000] * len(values), pa.timestamp("us", "UTC"))
        columns = [times, pa.array(status, pa.string()), pa.array(lines, pa.int64()), pa.array(values, pa.string())]
        return pa.RecordBatch.from_arrays(columns, names=["slice", "status", "lines", "value"])


class Slice(InputPartition):
    def __init__(self, at: int):
        self.at = at


class SliceReader(DataSourceReader):
    """Slices from `first` to `last`, both included."""

    def __init__(self, options: dict):
        self.drop = Drop(options)
        self.first, self.last = _seconds(options["first"]), _seconds(options["last"])

    def partitions(self) -> list[Slice]:
        return [Slice(x) for x in range(self.drop.up(self.first), self.last + 1, self.drop.step)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return self.drop.read(partition.at)


class SliceStreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.drop = Drop(options)
        first = options.get("first")
        self.first = self.drop.up(_seconds(first)) if first else None

    def initialOffset(self) -> dict:
        first = self.drop.due() - self.drop.lookback // self.drop.step * self.drop.step if self.first is None else self.first
        return {"next": first, "missing": []}

    def latestOffset(self) -> dict:
        due, step = self.drop.due(), self.drop.step
        if self.first is not None and due <= self.first:
            return {"next": self.first, "missing": []}
        back = self.drop.up(due - step - self.drop.lookback)
        recent = list(range(back if self.first is None else max(back, self.first), due, step))
        return {"next": due, "missing": self.drop.absent(recent)}

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        """New slices with a file or too old to wait for, and late ones that came or that nobody waits for any more."""
        waiting = set(end["missing"])
        late = [x for x in start["missing"] if x not in waiting]
        return [Slice(x) for x in [*late, *range(start["next"], end["next"], self.drop.step)] if x not in waiting]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        return self.drop.read(partition.at)


class SliceDrop(DataSource):
    """Format "slices"; spark.dataSource.register(SliceDrop) makes it known.

    A slice's lines and one row of its own: read, with its number of lines; missing, when it has no file and the lookback has
    passed over it; or corrupt. A range read takes every slice of the range at once. A stream begins at `first`, or a lookback
    ago. A slice that comes after its lookback was reported missing and is left to a range read.
    """

    @classmethod
    def name(cls) -> str:
        return "slices"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SliceReader:
        return SliceReader(self.options)

    def streamReader(self, schema) -> SliceStreamReader:
        return SliceStreamReader(self.options)


def counters(rows: DataFrame) -> DataFrame:
    """One row of rows(status, lines, ...): slices attempted, read, missing and corrupt, and lines seen."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    return rows.agg(
        F.count("status").alias("attempted"), is_("read").alias("fetched"), is_("missing").alias("missing"),
        is_("corrupt").alias("errored"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"),
    )
