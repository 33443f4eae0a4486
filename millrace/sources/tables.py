"""A table source for user code: exported log lines as a format of Spark's own readers, in batches and as a stream."""

from __future__ import annotations

import csv
import io
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import BooleanType, StringType, StructField, StructType, TimestampNTZType

#: Name of the format, and the columns that a line can have.
FORMAT = "log_lines"
TEXTS = ("level", "service", "task_id", "pipeline_id", "node_id", "message")
COLUMNS = StructType(
    [StructField("timestamp", TimestampNTZType()), *[StructField(n, StringType()) for n in TEXTS], StructField("malformed", BooleanType())]
)
#: Bytes of a partition unless the option ``rangeBytes`` says otherwise, and rows of an Arrow batch.
RANGE_BYTES, BATCH_ROWS = 32 << 20, 8192
#: Age in seconds from which the stream takes a file, unless the option ``settleSeconds`` says otherwise.
SETTLE_SECONDS = 2.0


@dataclass
class FileRange(InputPartition):
    """The lines of a file that begin in ``start`` .. ``end`` - 1."""

    path: str
    start: int
    end: int


def _system(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" in folder:
        return fs.FileSystem.from_uri(folder)
    return fs.LocalFileSystem(), folder.removeprefix("file:")


def _files(folder: str) -> list[fs.FileInfo]:
    """Files below a folder by age, then path; hidden and unfinished ones are passed over."""
    system, root = _system(folder)
    infos = system.get_file_info(fs.FileSelector(root, recursive=True))
    below = [f for f in infos if f.is_file and not any(p.startswith(("_", ".")) for p in f.path[len(root) :].strip("/").split("/"))]
    return sorted(below, key=lambda f: (f.mtime_ns, f.path))


def ranges(files: list[fs.FileInfo], size: int) -> list[FileRange]:
    return [FileRange(f.path, at, min(at + size, f.size)) for f in files for at in range(0, f.size, size)]


def _lines(system: fs.FileSystem, part: FileRange) -> Iterator[bytes]:
    """Lines that begin in the range: from the first line feed at or after the byte before it."""
    with io.BufferedReader(system.open_input_file(part.path), 1 << 20) as file:
        at = max(part.start - 1, 0)
        file.seek(at)
        if part.start:
            at += len(file.readline())
        while at < part.end:
            line = file.readline()
            if not line:
                return
            at += len(line)
            yield line.rstrip(b"\n")


def _stamp(text: str | None) -> datetime | None:
    stamp = datetime.fromisoformat(text) if text else None
    return stamp.astimezone(UTC).replace(tzinfo=None) if stamp and stamp.tzinfo else stamp


def _fields(line: bytes, form: str, names: list[str]) -> dict | None:
    """The fields of a line by name, nothing for the heading of a csv file. A line that is no entry is the message of
    a malformed one."""
    text = line.decode("utf-8", "replace")
    try:
        if form == "csv":
            if text == ",".join(names):
                return None
            values = {n: v or None for n, v in zip(names, next(csv.reader([text], strict=True)), strict=True)}
        else:
            values = json.loads(text)
        return {**values, "timestamp": _stamp(values.get("timestamp")), "malformed": False}
    except (ValueError, TypeError, AttributeError, StopIteration, csv.Error):
        return {"message": text, "malformed": True}


def _cell(value, kind: pa.DataType):
    return value if value is None or isinstance(value, str) or not pa.types.is_string(kind) else json.dumps(value, ensure_ascii=False)


class _Lines:
    """What both readers share: the columns asked for, and a range of lines as Arrow batches of these columns only."""

    def __init__(self, options: dict, schema: StructType):
        self.folder, self.form = options["path"], options.get("lines", "json")
        if self.form not in ("json", "csv"):
            raise ValueError(f"unknown form of lines {self.form!r}")
        self.size = int(options.get("rangeBytes", RANGE_BYTES))
        self.wanted = schema.fieldNames()
        unknown = [f.name for f in schema if f not in COLUMNS.fields]
        if unknown:
            raise ValueError(f"a log line has no column {', '.join(unknown)}")
        self.names = ["timestamp", *TEXTS]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(n, {"timestamp": pa.timestamp("us"), "malformed": pa.bool_()}.get(n, pa.string())) for n in self.wanted])

        def batch(rows: list[dict]) -> pa.RecordBatch:
            columns = [pa.array([_cell(r.get(f.name), f.type) for r in rows], f.type) for f in kinds]
            return pa.RecordBatch.from_arrays(columns, schema=kinds)

        entries = (_fields(line, self.form, self.names) for line in _lines(_system(self.folder)[0], partition))
        entries = (entry for entry in entries if entry is not None)
        while rows := list(islice(entries, BATCH_ROWS)):
            yield batch(rows)


class LogLineReader(_Lines, DataSourceReader):
    def partitions(self) -> list[FileRange]:
        return ranges(_files(self.folder), self.size) or [FileRange("", 0, 0)]

    def read(self, partition: FileRange) -> Iterator[pa.RecordBatch]:
        if partition.path:
            yield from super().read(partition)


class LogLineStream(_Lines, DataSourceStreamReader):
    """New files by age, then path. The offset is the youngest file taken; files are never changed and stay."""

    def __init__(self, options: dict, schema: StructType):
        super().__init__(options, schema)
        self.settle = float(options.get("settleSeconds", SETTLE_SECONDS))

    def initialOffset(self) -> dict:
        return {"at": 0, "path": ""}

    def latestOffset(self) -> dict:
        before = time.time_ns() - int(self.settle * 1e9)
        files = [f for f in _files(self.folder) if f.mtime_ns <= before]
        return {"at": files[-1].mtime_ns, "path": files[-1].path} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[FileRange]:
        low, high = ((o["at"], o["path"]) for o in (start, end))
        return ranges([f for f in _files(self.folder) if low < (f.mtime_ns, f.path) <= high], self.size)


class LogLines(DataSource):
    """Entries that ``sinks.export_logs`` or ``sinks.log_lines`` wrote, as ``json`` or headless ``csv`` (option ``lines``).

    Every file is cut into ranges of ``rangeBytes``, one partition each; a line belongs to the range it begins in. Only
    the columns of the schema given to the reader are made. A line that is no entry is a row with ``malformed`` and the
    line as its message; fields that a line lacks are null, other values than texts are JSON; a folder without files
    gives no rows. A line must not hold a line feed. Files are opened by pyarrow: paths of folders that all executors
    see, or addresses that pyarrow knows.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> StructType:
        return COLUMNS

    def reader(self, schema: StructType) -> LogLineReader:
        return LogLineReader(self.options, schema)

    def streamReader(self, schema: StructType) -> LogLineStream:
        return LogLineStream(self.options, schema)


def register(spark: SparkSession) -> None:
    """Make ``spark.read.format("log_lines")`` and its stream known to the session."""
    spark.dataSource.register(LogLines)
