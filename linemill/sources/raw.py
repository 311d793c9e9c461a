"""Byte-exact lines: a Python data source over files of any store that pyarrow opens (local paths, file, hdfs, s3, gs, abfs).

A partition is a range of a file; it has the lines that begin in it. Lines end with CR, LF or CRLF; nothing is decoded,
unpacked or passed over. Blank lines are lines, a last line needs no end. Work is linear in the bytes whatever a line's length,
and of a line no more than `longest` + 1 bytes are held where that is set.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT = 64 << 20
_READ = 1 << 20


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


_END = re.compile(rb"\r\n|\r|\n")


def opened(path: str):
    """The file system of a path, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def range_lines(path: str, start: int, end: int, longest: int = 0):
    """Lists of the lines that begin in [start, end). longest: 0, or lines come cut to longest + 1 bytes."""
    store, name = opened(path)
    most = longest + 1 if longest else None
    with store.open_input_file(name) as f:
        at = max(0, start - 1)
        f.seek(at)
        inside = start > 0  # up to the first end, the line belongs to the range before
        line_at, held, size = at, [], 0  # where the unfinished line begins, and its first bytes

        def more(piece: bytes) -> None:
            nonlocal size
            if not inside and line_at < end:
                piece = piece if most is None else piece[: max(0, most - size)]
                if piece:
                    held.append(piece)
                    size += len(piece)

        while line_at < end or inside:
            data = f.read(_READ)
            if data.endswith(b"\r"):
                data += f.read(1)  # not between CR and LF
            if not data:
                if at > line_at and not inside and line_at < end:
                    yield [b"".join(held)]
                return
            out, begin = [], 0
            for found in _END.finditer(data):
                more(data[begin : found.start()])
                if inside:
                    inside = False
                elif line_at < end:
                    out.append(b"".join(held))
                begin = found.end()
                line_at, held, size = at + begin, [], 0
                if line_at >= end:
                    break
            else:
                more(data[begin:])
            if out:
                yield out
            at += len(data)


class Reader(DataSourceReader):
    def __init__(self, paths: list[str], split: int, longest: int):
        self.paths, self.split, self.longest = paths, split, longest

    def partitions(self):
        sizes = ((p, opened(p)) for p in self.paths)
        return [Range(p, a, min(a + self.split, size)) for p, (store, name) in sizes for size in [store.get_file_info(name).size or 0] for a in range(0, size, self.split)] or [Range("", 0, 0)]

    def read(self, part: Range):
        if part.path:
            for lines in range_lines(part.path, part.start, part.end, self.longest):
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()), pa.array([part.path] * len(lines))], ["line", "path"])


class RawLines(DataSource):
    @classmethod
    def name(cls):
        return "raw_lines"

    def schema(self):
        return "line binary, path string"

    def reader(self, schema):
        return Reader([p for p in self.options["paths"].split("\n") if p], int(self.options.get("split", SPLIT)), int(self.options.get("longest", 0)))
