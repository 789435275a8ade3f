"""SRC14 and SRC15: log files that grow, as a Python data source by byte offset.

As a stream each whole line comes once, also across restarts: an offset is the end of the last whole line of each file, and Spark
keeps offsets in the query's checkpoint. A line without its end waits for it. A file that got shorter has begun anew and is
read from its start; new files are. Large ranges are cut into pieces of PIECE_BYTES, which tasks read on their own. As a batch
the source reads whole files, or with the option ``tail`` their last lines, from the end backwards, so a tail costs what it shows.

path is a file, a folder or a pattern of a file system that pyarrow opens (local, hdfs, s3, gcs), reachable from driver and
executors alike. Lines are UTF-8 with errors replaced, without their line feed and a carriage return before it. An empty file has no lines.
"""

from __future__ import annotations

import fnmatch
import json
import posixpath
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

PIECE_BYTES = 32 << 20
_STEP = 1 << 16
_SCHEMA = "path string, at long, line string"


def _listed(path: str) -> dict[str, int]:
    """Size of each file by its path."""
    from pyarrow import fs

    # A pattern is matched in its last part only.
    folder, last = posixpath.split(path.rstrip("/"))
    system, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:") or "/")
    whole = posixpath.join(base, last)
    info = system.get_file_info(whole) if not any(c in last for c in "*?[") else None
    if info is not None and info.type == fs.FileType.File:
        return {whole: info.size}
    inside = whole if info is not None else base
    found = system.get_file_info(fs.FileSelector(inside, allow_not_found=True))
    keep = (lambda n: fnmatch.fnmatch(n, last)) if info is None else (lambda n: n[:1] not in "._")
    return {f.path: f.size for f in found if f.type == fs.FileType.File and keep(f.base_name)}


def _opened(path: str, like: str):
    from pyarrow import fs

    system = fs.FileSystem.from_uri(like)[0] if "://" in like else fs.LocalFileSystem()
    return system.open_input_file(path)


def _whole_lines_end(path: str, like: str, start: int, size: int) -> int:
    """Behind the last line feed in start .. size; start where there is none."""
    with _opened(path, like) as f:
        hi = size
        while hi > start:
            lo = max(start, hi - _STEP)
            f.seek(lo)
            at = f.read(hi - lo).rfind(b"\n")
            if at >= 0:
                return lo + at + 1
            hi = lo
    return start


class _Piece(InputPartition):
    """Lines that begin in lo .. hi of a file, of which all lie before end."""

    def __init__(self, path: str, lo: int, hi: int, first: bool):
        self.path, self.lo, self.hi, self.first = path, lo, hi, first


def _pieces(path: str, start: int, end: int) -> list[_Piece]:
    return [_Piece(path, lo, min(lo + PIECE_BYTES, end), lo == start) for lo in range(start, end, PIECE_BYTES)]


def _lines(piece: _Piece, like: str, torn: bool) -> Iterator[tuple[str, int, str]]:
    """The lines of a piece; torn: a last line without an end counts."""
    with _opened(piece.path, like) as f:
        at = piece.lo
        f.seek(at if piece.first else at - 1)
        held, skip = b"", not piece.first  # what stands before the first line feed belongs to the piece before
        if skip:
            at -= 1
        while at < piece.hi or held:
            block = f.read(_STEP)
            if not block:
                if held and torn and not skip:
                    yield piece.path, at, _text(held)
                return
            held += block
            lines = held.split(b"\n")
            held = lines.pop()
            for line in lines:
                if not skip:
                    if at >= piece.hi:
                        return
                    yield piece.path, at, _text(line)
                skip, at = False, at + len(line) + 1
            if at >= piece.hi:
                return


def _text(line: bytes) -> str:
    return line.removesuffix(b"\r").decode("utf-8", "replace")


class _Stream(DataSourceStreamReader):
    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        # Each file's end is sought from its size back to the last line feed, as a rule a line away.
        return {"files": json.dumps({f: _whole_lines_end(f, self.path, 0, size) for f, size in sorted(_listed(self.path).items())})}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        before, out = json.loads(start["files"]), []
        for f, hi in json.loads(end["files"]).items():
            lo = before.get(f, 0)
            out += _pieces(f, 0 if hi < lo else lo, hi)
        return out

    def read(self, partition: _Piece) -> Iterator[tuple]:
        return _lines(partition, self.path, torn=False)


class _Whole(DataSourceReader):
    def __init__(self, path: str, tail: int | None):
        self.path, self.tail = path, tail

    def partitions(self) -> list[InputPartition]:
        found = sorted(_listed(self.path).items())
        if self.tail is None:
            return [p for f, size in found for p in _pieces(f, 0, size)]
        return [_Piece(f, 0, size, True) for f, size in found]

    def read(self, partition: _Piece | None) -> Iterator[tuple]:
        if partition is None:  # what Spark reads where there is no piece
            return
        if self.tail is None:
            yield from _lines(partition, self.path, torn=True)
            return
        if self.tail <= 0:
            return
        with _opened(partition.path, self.path) as f:
            blocks, feeds, lo = [], 0, partition.hi
            while lo > 0 and feeds <= self.tail:
                step = min(_STEP, lo)
                lo -= step
                f.seek(lo)
                blocks.append(f.read(step))
                feeds += blocks[-1].count(b"\n")
        held = b"".join(reversed(blocks))
        lines = held.split(b"\n")
        if lines[-1] == b"":
            lines.pop()
        at = partition.hi - sum(len(x) + 1 for x in lines[-self.tail :]) + (0 if held.endswith(b"\n") else 1)
        for line in lines[-self.tail :]:
            yield partition.path, at, _text(line)
            at += len(line) + 1


class LogLines(DataSource):
    """format("log_lines"): path, byte at which the line begins, line."""

    @classmethod
    def name(cls) -> str:
        return "log_lines"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> DataSourceReader:
        tail = self.options.get("tail")
        return _Whole(self.options["path"], None if tail is None else int(tail))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"])


def log_stream(spark: SparkSession, path: str) -> DataFrame:
    """SRC15: a stream of (path, at, line): whole lines as they are appended."""
    spark.dataSource.register(LogLines)
    return spark.readStream.format("log_lines").option("path", path).load()


def file_tail(spark: SparkSession, path: str, n: int = 60) -> DataFrame:
    """SRC14: the last n lines of each file, read from its end."""
    spark.dataSource.register(LogLines)
    return spark.read.format("log_lines").option("path", path).option("tail", str(n)).load()
