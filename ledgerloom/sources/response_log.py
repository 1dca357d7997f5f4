"""A log of responses as a stream: format ``response_log``.

A log is a folder with one subfolder a segment, numbered from 1 without gaps.  A segment
holds JSON lines of :data:`ledgerloom.schemas.RESPONSE`, and counts once it has
Spark's ``_SUCCESS`` mark; it never changes after.  So an offset is the number of the
last segment taken, and reading between two offsets again gives the same rows.

Options: ``path``; ``from_segment``, after which a new stream begins (0); ``split_bytes``, how much a
partition reads, about.  Files are opened by Arrow's file systems, so the
folder may be on a shared disk or in a store that these know.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ledgerloom.schemas import RESPONSE

SPLIT_BYTES = 32 << 20
_DIGITS = 9


def segment_path(folder: str, number: int) -> str:
    return f"{folder.rstrip('/')}/{number:0{_DIGITS}}"


def _open(folder: str):
    """The file system of a folder and its path there."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)


def last_segment(folder: str, after: int = 0) -> int:
    """The last of the committed segments that follow ``after`` without a gap."""
    from pyarrow.fs import FileType

    system, path = _open(folder)
    while system.get_file_info(f"{segment_path(path, after + 1)}/_SUCCESS").type == FileType.File:
        after += 1
    return after


def push(responses: DataFrame, folder: str) -> int:
    """Append ``responses`` as one segment and return its number. A log has one writer at a time."""
    number = last_segment(folder) + 1
    responses.write.mode("overwrite").json(segment_path(folder, number))  # what a failed writer left goes
    return number


@dataclass
class _Files(InputPartition):
    paths: list[str] = field(default_factory=list)


def _split(folder: str, start: int, end: int, limit: int) -> list[_Files]:
    """Files of the segments after ``start`` up to ``end``, in partitions of about ``limit`` bytes."""
    from pyarrow.fs import FileSelector, FileType

    system, path = _open(folder)
    parts, held = [], limit
    for number in range(start + 1, end + 1):
        for info in sorted(system.get_file_info(FileSelector(segment_path(path, number))), key=lambda i: i.path):
            if info.type != FileType.File or info.base_name.startswith(("_", ".")) or not info.size:
                continue
            if held >= limit:
                parts.append(_Files())
                held = 0
            parts[-1].paths.append(info.path)
            held += info.size
    return parts


def _rows(folder: str, partition: _Files) -> Iterator[tuple]:
    system, _ = _open(folder)
    names = RESPONSE.names
    for path in partition.paths:
        compression = "detect" if path.endswith((".gz", ".zst", ".bz2")) else None
        with system.open_input_stream(path, compression=compression) as stream:
            rest = b""
            while block := stream.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    if line.strip():
                        found = json.loads(line)
                        yield tuple(found.get(c) for c in names)
            if rest.strip():
                found = json.loads(rest)
                yield tuple(found.get(c) for c in names)


@dataclass
class LogReader(DataSourceReader):
    """All committed segments, once."""

    options: dict[str, str]

    def partitions(self) -> Sequence[InputPartition]:
        return _split(self.options["path"], 0, last_segment(self.options["path"]), int(self.options.get("split_bytes", SPLIT_BYTES))) or [_Files()]

    def read(self, partition: _Files) -> Iterator[tuple]:
        return _rows(self.options["path"], partition)


@dataclass
class LogStreamReader(DataSourceStreamReader):
    """Offsets are ``{"segment": n}``: all up to the n-th segment. ``at`` only saves looking from the first one each time."""

    options: dict[str, str]
    at: int = 0

    def initialOffset(self) -> dict:  # noqa: N802  Spark's name
        return {"segment": int(self.options.get("from_segment", 0))}

    def latestOffset(self) -> dict:  # noqa: N802
        self.at = last_segment(self.options["path"], max(self.at, self.initialOffset()["segment"]))
        return {"segment": self.at}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return _split(self.options["path"], start["segment"], end["segment"], int(self.options.get("split_bytes", SPLIT_BYTES)))

    def read(self, partition: _Files) -> Iterator[tuple]:
        return _rows(self.options["path"], partition)


class ResponseLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "response_log"

    def schema(self) -> StructType:
        return RESPONSE

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(dict(self.options))

    def streamReader(self, schema: StructType) -> LogStreamReader:  # noqa: N802
        return LogStreamReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ResponseLog)


def read_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The responses of a log as they are pushed."""
    register(spark)
    return spark.readStream.format("response_log").option("path", folder).load()
