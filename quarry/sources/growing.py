"""A streaming source of files that grow by lines: transcripts while their sessions run.

Spark's own file source knows a file by its path and never reads it again. This one keeps for each file how
many bytes of whole lines have been read, so a trigger reads what was appended since, and nothing else:

* The newest offset is, for each file, where its last whole line ends and a checksum of the bytes before
  that. A line that is still being written waits for its end of line.
* What lies between two offsets is cut into ranges of at most ``rangeBytes``, which executors read. A
  range has the lines that begin in it, so a line may go on beyond its end.
* A file that is shorter than what was read, or whose bytes there have another checksum, was written
  anew and is read from its begin; ``fresh`` marks such ranges, and those of new files.

Offsets are in the checkpoint, so a query that stops in a batch reads the same ranges when it starts
again. An offset takes some hundred bytes a file, on the driver. A file that is gone keeps its rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, fresh boolean, first bigint, n bigint, value string"
RANGE_BYTES, BATCH_BYTES, BLOCK = 64 << 20, 4 << 20, 1 << 16
#: Bytes before the end of what was read, by which a file is known to be the same.
TAIL = 64


@dataclass
class Range(InputPartition):
    path: str
    first: int
    end: int
    fresh: bool


def tail_sum(file: pa.NativeFile, end: int) -> int:
    """Checksum of the first and the last bytes of the first ``end``."""
    n = min(TAIL, end)
    file.seek(0)
    head = file.read(n)
    file.seek(end - n)
    return zlib.crc32(head + file.read(n))


def whole_lines(file: pa.NativeFile, size: int) -> int:
    """Where the last whole line of a file of ``size`` bytes ends, read from behind."""
    end = size
    while end > 0:
        first = max(0, end - BLOCK)
        file.seek(first)
        found = file.read(end - first).rfind(b"\n")
        if found >= 0:
            return first + found + 1
        end = first
    return 0


def lines_of(file: pa.NativeFile, first: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(number, line) of the lines that begin in [first, end); a range that does not begin a file's part
    begins in the midst of a line or right behind one, which the byte before it tells."""
    at = max(0, first - 1)
    file.seek(at)
    rest, n, begun = b"", 0, first == 0
    while at < end or rest:
        more = file.read(BLOCK)
        pieces = (rest + more).split(b"\n")
        rest = pieces.pop()
        for piece in pieces:
            if begun:
                if at >= end:
                    return
                yield n, piece
                n += 1
            begun = True
            at += len(piece) + 1
        if not more:
            return


class Reader(DataSourceStreamReader):
    def __init__(self, folder: str, suffix: str, range_bytes: int) -> None:
        self.folder, self.suffix, self.range_bytes = folder, suffix, range_bytes

    def _files(self) -> tuple[fs.FileSystem, str]:
        if "://" not in self.folder and not self.folder.startswith("file:"):
            return fs.LocalFileSystem(), self.folder
        return fs.FileSystem.from_uri(self.folder)

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        system, base = self._files()
        seen = {}
        for info in system.get_file_info(fs.FileSelector(base, recursive=True)):
            if info.type == fs.FileType.File and info.path.endswith(self.suffix) and info.size:
                with system.open_input_file(info.path) as file:
                    end = whole_lines(file, info.size)
                    if end:
                        seen[info.path] = {"end": end, "sum": tail_sum(file, end)}
        return {"files": dict(sorted(seen.items()))}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        system, _ = self._files()
        out = []
        for path, now in end["files"].items():
            before = start["files"].get(path)
            if before == now:
                continue
            first = 0
            if before and before["end"] <= now["end"]:
                with system.open_input_file(path) as file:
                    first = before["end"] if tail_sum(file, before["end"]) == before["sum"] else 0
            cuts = [*range(first, now["end"], self.range_bytes), now["end"]]
            out += [Range(path, a, b, first == 0) for a, b in zip(cuts, cuts[1:])]
        return out

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        system, _ = self._files()
        names = ["path", "fresh", "first", "n", "value"]

        def batch(rows: list[tuple[int, str]]) -> pa.RecordBatch:
            k = len(rows)
            columns = [[part.path] * k, [part.fresh] * k, [part.first] * k, [n for n, _ in rows], [v for _, v in rows]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string()))], names=names)

        with system.open_input_file(part.path) as file:
            rows, size = [], 0
            for n, line in lines_of(file, part.first, part.end):
                rows.append((n, line.decode("utf-8", "replace")))
                size += len(line)
                if size >= BATCH_BYTES:
                    yield batch(rows)
                    rows, size = [], 0
            if rows:
                yield batch(rows)


class GrowingLines(DataSource):
    """Format ``growing_lines``: options ``path``, ``suffix`` (.jsonl) and ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str | StructType:
        return SCHEMA

    def streamReader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"], self.options.get("suffix", ".jsonl"), int(self.options.get("rangebytes", RANGE_BYTES)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GrowingLines)
