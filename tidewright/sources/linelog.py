"""A growing log of lines as a streaming source with offsets and replay.

A log is a folder of segments, in order of their paths below it; only the last one grows, and a new one has a later path. An offset is the last segment and how many bytes of it are taken,
whatever the number of segments, and always stands after a whole line. The lines between two offsets are the same however often they are read, so a stream that starts again
from its checkpoint loses and repeats none. A batch is planned as ranges of bytes: a task reads the lines that begin in its range.

Columns are segment, at (the byte where the line begins) and value (without its line end; bytes that aren't UTF-8 become U+FFFD). Empty lines are lines. The last line of a segment that another
follows needs no line end. Files whose name begins with _ or . are no segments. The folder must be one that driver and executors share, by a path or URI that Arrow's file systems open.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

SCHEMA = "segment string, at long, value string"
#: Bytes of a task, and of a read.
RANGE, PIECE = 32 << 20, 1 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    where, base = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return where, base.rstrip("/")


def segments(path: str) -> list[tuple[str, int]]:
    """Paths below the folder and sizes, in order."""
    where, base = opened(path)
    found = where.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True))
    return sorted((f.path[len(base) + 1 :], f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "_.")


def whole_lines(path: str, segment: str, size: int) -> int:
    """Bytes of a segment up to its last line end."""
    where, base = opened(path)
    with where.open_input_file(f"{base}/{segment}") as f:
        while size > 0:
            begin = max(0, size - PIECE)
            f.seek(begin)
            last = f.read(size - begin).rfind(b"\n")
            if last >= 0:
                return begin + last + 1
            size = begin
    return 0


class Range(InputPartition):
    def __init__(self, segment: str, begin: int, end: int):
        self.segment, self.begin, self.end = segment, begin, end


def lines(path: str, part: Range) -> Iterator[tuple[int, bytes]]:
    """The lines that begin in a range, and where."""
    where, base = opened(path)
    with where.open_input_file(f"{base}/{part.segment}") as f:
        at = max(0, part.begin - 1)  # a line begins in the range if one ends just before it
        f.seek(at)
        held, skip = b"", part.begin > 0
        while at < part.end or skip:
            piece = f.read(PIECE)
            own = (held + piece).split(b"\n")
            held = own.pop() if piece else b""
            for line in own:
                if skip:
                    skip = False
                elif at >= part.end or not piece and not line:
                    return
                else:
                    yield at, line
                at += len(line) + 1
            if not piece:
                return


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.range = options["path"], int(options.get("rangeBytes", RANGE))

    def initialOffset(self) -> dict:
        return {"segment": "", "at": 0}

    def latestOffset(self) -> dict:
        found = segments(self.path)
        return {"segment": found[-1][0], "at": whole_lines(self.path, *found[-1])} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        out = []
        for name, size in segments(self.path):
            if start["segment"] <= name <= end["segment"]:
                begin = start["at"] if name == start["segment"] else 0
                stop = end["at"] if name == end["segment"] else size
                out += [Range(name, k, min(k + self.range, stop)) for k in range(begin, stop, self.range)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str]] = []

        def batch() -> pa.RecordBatch:
            at, text = zip(*held, strict=True)
            out = pa.RecordBatch.from_arrays([pa.array([partition.segment] * len(held)), pa.array(at, pa.int64()), pa.array(text, pa.string())], ["segment", "at", "value"])
            held.clear()
            return out

        for at, line in lines(self.path, partition):
            held.append((at, line.decode("utf-8", "replace")))
            if len(held) >= 10_000:
                yield batch()
        if held:
            yield batch()

    def commit(self, end: dict) -> None:
        pass


class LineLog(DataSource):
    """spark.readStream.format("linelog").option("path", ...), once registered."""

    @classmethod
    def name(cls) -> str:
        return "linelog"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> LogReader:
        return LogReader(self.options)


def stream(spark: SparkSession, path: str, range_bytes: int = RANGE) -> DataFrame:
    """The log's lines as a stream."""
    spark.dataSource.register(LineLog)
    return spark.readStream.format("linelog").option("path", path).option("rangeBytes", str(range_bytes)).load()
