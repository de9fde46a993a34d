"""A data source of MP4 and MOV files' headers, read by ranges.

`spark.read.format("movie_headers").load(pattern)` after `register(spark)`
gives (path, length, created, bytes_read), a partition for some FILES files.  Of each file only the
headers of its boxes are read, eight or sixteen bytes each, on the way to the
movie header; the pictures in between are skipped by a seek, so the cost is a
few small reads whatever the file's size is.  `created` is null where a file is no
movie, is cut off, or was never stamped.

Files are opened by pyarrow's file systems (local, HDFS, S3, GCS); a pattern's
wildcards are those of a shell, a folder stands for all files below it.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Files of a partition at most.
FILES = 64
_START = datetime(1904, 1, 1)


def header_time(f, length: int) -> tuple[int | None, int]:
    """(seconds since 1904 of the movie header, bytes read) of an open file; None if there is none or it is 0."""
    spent = 0

    def take(at: int, n: int) -> bytes:
        nonlocal spent
        f.seek(at)
        got = f.read(n)
        spent += len(got)
        return got

    def find(at: int, end: int, name: bytes) -> tuple[int, int] | None:
        while at + 8 <= end:
            head = take(at, 8)
            if len(head) < 8:
                return None
            size, kind, first = int.from_bytes(head[:4], "big"), head[4:], 8
            if size == 1:
                size, first = int.from_bytes(take(at + 8, 8), "big"), 16
            elif size == 0:
                size = end - at
            if size < first:
                return None
            if kind == name:
                return at + first, min(end, at + size)
            at += size
        return None

    movie = find(0, length, b"moov")
    header = find(*movie, b"mvhd") if movie else None
    if not header or header[1] - header[0] < 12:
        return None, spent
    body = take(header[0], 12)
    return int.from_bytes(body[4:12] if body[0] == 1 else body[4:8], "big") or None, spent


def _base(pattern: str) -> str:
    """The folder of a pattern before its first wildcard."""
    for k, part in enumerate(parts := pattern.split("/")):
        if any(c in part for c in "*?["):
            return "/".join(parts[:k]) or "/"
    return pattern


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class HeaderReader(DataSourceReader):
    def __init__(self, pattern: str):
        self.pattern = pattern

    def partitions(self) -> list[_Files]:
        from pyarrow import fs

        there, base = fs.FileSystem.from_uri(_base(self.pattern)) if "://" in self.pattern or self.pattern.startswith("file:") else (fs.LocalFileSystem(), _base(self.pattern))
        info = there.get_file_info(base)
        if info.type == fs.FileType.File:
            found = [info]
        else:
            found = [x for x in there.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True)) if x.type == fs.FileType.File]
        rest = self.pattern[len(_base(self.pattern)) :].strip("/").split("/")
        fits = lambda path: rest == [""] or (len(tail := path[len(base) :].strip("/").split("/")) == len(rest) and all(map(fnmatch.fnmatchcase, tail, rest)))
        files = sorted((x.path, x.size) for x in found if fits(x.path))
        return [_Files(files[k : k + FILES]) for k in range(0, len(files), FILES)]

    def read(self, partition: _Files | None) -> Iterator[tuple]:
        from pyarrow import fs

        uri = "://" in self.pattern
        there = fs.FileSystem.from_uri(_base(self.pattern))[0] if uri else fs.LocalFileSystem()
        scheme = self.pattern.split("://")[0] + "://" if uri and not self.pattern.startswith("file:") else "file:"
        for path, length in partition.files if partition else ():
            with there.open_input_file(path) as f:
                seconds, spent = header_time(f, length)
            try:
                created = _START + timedelta(seconds=seconds) if seconds else None
            except OverflowError:
                created = None
            yield scheme + path, length, created, spent


class MovieHeaders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "movie_headers"

    def schema(self) -> str:
        return "path string, length long, created timestamp_ntz, bytes_read long"

    def reader(self, schema) -> HeaderReader:
        return HeaderReader(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes the format known to a session."""
    spark.dataSource.register(MovieHeaders)
