"""A store that grows, as a streaming source whose offsets are bytes: lines keep their order, and a torn line waits for its end."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that one task reads, lines of a batch, and bytes read at once.
RANGE, LINES, BLOCK = 1 << 26, 10_000, 1 << 20
#: Bits of ord below the number of a line's file.
_FILE = 40
_SCHEMA = pa.schema([("line", pa.string()), ("ord", pa.int64())])


@dataclass
class Span(InputPartition):
    """Bytes first to last of a file; lines are complete up to `end`, and those that begin in the span are its own."""

    path: str
    number: int
    begin: int
    first: int
    last: int
    end: int


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """Any store that pyarrow reads; a plain path is local."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def complete_bytes(system: fs.FileSystem, path: str, size: int) -> int:
    """Bytes up to the last line end; what follows is a torn line."""
    with system.open_input_file(path) as f:
        while size > 0:
            start = max(0, size - BLOCK)
            f.seek(start)
            at = f.read(size - start).rfind(b"\n")
            if at >= 0:
                return start + at + 1
            size = start
    return 0


def lines_of(span: Span) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the lines that begin in a span; a block is held at a time, and a line."""
    system, path = opened(span.path)
    with system.open_input_file(path) as f:
        at = span.first
        if at > span.begin:  # the line that holds the byte before belongs to the span before
            at -= 1
            f.seek(at)
            while b"\n" not in (block := f.read(min(BLOCK, span.end - at))):
                at += len(block)
                if not block:
                    return
            at += block.index(b"\n") + 1
        f.seek(at)
        rest = b""
        while at < span.last:
            while b"\n" not in rest:
                block = f.read(min(BLOCK, span.end - at - len(rest)))
                if not block:
                    return
                rest += block
            whole, _, left = rest.rpartition(b"\n")
            for line in whole.split(b"\n"):
                if at >= span.last:
                    return
                yield at, line
                at += len(line) + 1
            rest = left


class _Reader(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"files": {}}

    def latestOffset(self) -> dict:
        system, path = opened(self.path)
        info = system.get_file_info(path)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, allow_not_found=True))
        files = sorted((f for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._"), key=lambda f: f.base_name)
        return {"files": {f.base_name: complete_bytes(system, f.path, f.size) for f in files}}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        known, now = start["files"], end["files"]
        names = sorted(now)
        late = [n for n in names if n not in known and known and n < max(known)]
        shrunk = [n for n in known if now.get(n, 0) < known[n]]
        if late or shrunk:
            raise ValueError(f"a store only grows: files {late} come before files that were read, {shrunk} lost lines")
        root = self.path if names != [self.path.rstrip("/").rpartition("/")[2]] else self.path.rstrip("/").rpartition("/")[0]
        out = []
        for number, name in enumerate(names):
            begin, stop = known.get(name, 0), now[name]
            out += [Span(f"{root.rstrip('/')}/{name}", number, begin, at, min(at + RANGE, stop), stop) for at in range(begin, stop, RANGE)]
        return out

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        lines, ords = [], []
        for at, line in lines_of(partition):
            lines.append(line.decode("utf-8", "replace"))
            ords.append((partition.number << _FILE) + at)
            if len(lines) == LINES:
                yield pa.RecordBatch.from_arrays([pa.array(lines), pa.array(ords)], schema=_SCHEMA)
                lines, ords = [], []
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array(lines), pa.array(ords)], schema=_SCHEMA)


class StoreTail(DataSource):
    """line, and ord: its file's number, in order of names, and its first byte there."""

    @classmethod
    def name(cls) -> str:
        return "keyloom_tail"

    def schema(self) -> str:
        return "line string, ord long"

    def streamReader(self, schema) -> _Reader:
        return _Reader(self.options["path"])


def tail_lines(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the complete lines (line, ord) of a file, or of a folder's files, whose names sort in the order in which they are begun.

    A batch plans ranges of RANGE bytes of what was added since the last one; a last line without its end is read when it has one. Files that begin before others
    that were read, and files that got shorter, are errors.
    """
    spark.dataSource.register(StoreTail)
    return spark.readStream.format("keyloom_tail").load(path)
