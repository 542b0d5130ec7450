"""Streaming source: whole new lines of growing files, each exactly once, with rotation noticed.

An offset holds, for each file, the place up to which lines were taken and a checksum of the file's first bytes. A
file that shrank, or that begins otherwise than it did, is another one and is read from its start. A line counts once
its newline is there. What is new is cut into byte ranges, so a large file is read by many tasks. Spark's checkpoint
keeps the offsets: a batch that is run again reads the same ranges, unless its file is gone by then.

Options: path (a file, a folder or a glob in its last part), skipExisting (begin at the end of what is there),
partitionBytes, and fileBytes, the most of a file that one batch takes after the first (0: all).
"""

from __future__ import annotations

import fnmatch
import posixpath
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: First bytes of a file that tell whether it is the same file.
HEAD = 256
CHUNK = 1 << 20
ROWS = 10_000


class Part(InputPartition):
    """Lines of a file that begin in [low, high); begin is where the range's first line begins."""

    def __init__(self, file: str, begin: int, low: int, high: int):
        self.file, self.begin, self.low, self.high = file, begin, low, high


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def found(path: str) -> dict[str, int]:
    """The files of a path and their sizes."""
    where, top = opened(path)
    scheme = path[: len(path) - len(top)] if path.endswith(top) else ""
    folder, last = posixpath.split(top.rstrip("/"))
    info = where.get_file_info(top)
    if info.type == fs.FileType.File:
        return {scheme + top: info.size}
    pattern = "*"
    if info.type == fs.FileType.NotFound:
        top, pattern = folder, last
    inside = where.get_file_info(fs.FileSelector(top, allow_not_found=True))
    return {scheme + f.path: f.size for f in inside if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, pattern)}


def head(file: str, n: int) -> int | None:
    """Checksum of the first n bytes; None if the file has fewer, or is gone."""
    where, at = opened(file)
    try:
        with where.open_input_file(at) as f:
            data = f.read(n)
    except FileNotFoundError:
        return None
    return zlib.crc32(data) if len(data) == n else None


def last_line_end(file: str, low: int, high: int) -> int:
    """The place after the last newline in [low, high), or low."""
    where, at = opened(file)
    try:
        with where.open_input_file(at) as f:
            while high > low:
                start = max(low, high - CHUNK)
                f.seek(start)
                if (k := f.read(high - start).rfind(b"\n")) >= 0:
                    return start + k + 1
                high = start
    except FileNotFoundError:
        pass
    return low


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"]
        self.skip = options.get("skipexisting", "false").lower() == "true"
        self.part_bytes = int(options.get("partitionbytes", 16 << 20))
        self.file_bytes = int(options.get("filebytes", 0))
        self.last: dict[str, dict] | None = None

    def place(self, file: str, at: int) -> dict:
        n = min(HEAD, at)
        return {"at": at, "n": n, "head": head(file, n)}

    def initialOffset(self) -> dict:
        self.last = {f: self.place(f, last_line_end(f, 0, size)) for f, size in found(self.path).items()} if self.skip else {}
        return self.last

    def latestOffset(self) -> dict:
        out = {}
        for file, size in found(self.path).items():
            before = (self.last or {}).get(file)
            low = before["at"] if before and same(file, before) and before["at"] <= size else 0
            high = min(size, low + self.file_bytes) if self.file_bytes and self.last is not None else size
            end = last_line_end(file, low, high)
            if end == low and high < size:  # one line longer than a batch may take
                end = last_line_end(file, low, size)
            out[file] = self.place(file, end)
        self.last = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Part]:
        parts = []
        for file, to in sorted(end.items()):
            before = start.get(file)
            if not same(file, to):
                continue  # it was rotated since this batch was planned: its lines are gone
            begin = before["at"] if before and before["at"] <= to["at"] and same(file, before) else 0
            parts += [Part(file, begin, low, min(to["at"], low + self.part_bytes)) for low in range(begin, to["at"], self.part_bytes)]
        return parts

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        where, at = opened(part.file)
        with where.open_input_file(at) as raw:
            raw.seek(max(part.begin, part.low - 1))
            place, rest = raw.tell(), b""
            if part.low > part.begin:  # the line that holds the byte before low is another part's
                while (k := rest.find(b"\n")) < 0:
                    if not (more := raw.read(CHUNK)):
                        return
                    place, rest = (place, rest + more) if more.find(b"\n") >= 0 else (place + len(rest) + len(more), b"")
                place, rest = place + k + 1, rest[k + 1 :]
            places, lines, cut = [], [], 0
            while place < part.high:
                k = rest.find(b"\n", cut)
                if k < 0:
                    if not (more := raw.read(CHUNK)):
                        break
                    rest, cut = rest[cut:] + more, 0
                    continue
                places.append(place)
                lines.append(rest[cut:k].decode("utf-8", "ignore").rstrip("\r"))
                place, cut = place + k + 1 - cut, k + 1
                if len(lines) == ROWS:
                    yield batch(part.file, places, lines)
                    places, lines = [], []
            if lines:
                yield batch(part.file, places, lines)

    def commit(self, end: dict) -> None:
        pass


def same(file: str, before: dict) -> bool:
    """Whether a file still begins as it did."""
    return head(file, before["n"]) == before["head"]


def batch(file: str, places: list[int], lines: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file] * len(lines)), pa.array(places, pa.int64()), pa.array(lines, pa.string())], ["file", "place", "line"])


class Tail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "file string, place long, line string"

    def streamReader(self, schema: object) -> TailReader:
        return TailReader({k.lower(): v for k, v in self.options.items()})


def tail(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """A stream of (file, place, line); place is the byte at which the line begins."""
    spark.dataSource.register(Tail)
    return spark.readStream.format("tail").options(path=path, **options).load()
