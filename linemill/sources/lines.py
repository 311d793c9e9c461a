"""Lines from files and text columns: DataFrames with a binary column `line`."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _remote(spark: SparkSession, path: str) -> list[str]:
    """All files at or below a path of any file system that Spark knows; a missing one gives nothing."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(p):
        return []
    found, out = fs.listFiles(p, True), []
    while found.hasNext():
        out.append(found.next().getPath().toString())
    return sorted(out)


def _checksum(folder: str, name: str, names: set[str]) -> bool:
    """Whether it is the checksum file that Hadoop's local file system leaves beside a file that it writes."""
    if not (name.startswith(".") and name.endswith(".crc") and name[1:-4] in names):
        return False
    with open(os.path.join(folder, name), "rb") as f:
        return f.read(4) == b"crc\0"


def has_scheme(path: str) -> bool:
    """Whether a path names its file system: file:/x as well as file:///x; a single letter is no scheme."""
    return re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", path) is not None


def gather(paths: Iterable[str], excluded_endings: Iterable[str] = (), spark: SparkSession | None = None) -> list[str]:
    """Paths to files: a folder gives all below it but Hadoop's checksums of them, a missing path nothing; endings compare without case.

    Paths with a scheme (hdfs://host/x, or as Hadoop writes them file:/x) are listed by the session; without one they pass through, and Spark lists them.
    """
    endings, out = tuple(e.lower() for e in excluded_endings), []
    for path in paths:
        if has_scheme(path):
            out += _remote(spark, path) if spark else [path]
        elif os.path.isfile(path):
            out.append(path)
        else:
            out += sorted(os.path.join(d, f) for d, _, names in os.walk(path) for there in [set(names)] for f in names if not _checksum(d, f, there))
    return [p for p in out if not (endings and p.lower().endswith(endings))]


def empty_lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "line binary, path string")


def read_lines(spark: SparkSession, paths: Iterable[str], excluded_endings: Iterable[str] = (), exact: bool = False, longest: int | None = None) -> DataFrame:
    """line and path of every line of the files; CR, LF and CRLF end lines.

    exact: every byte of every file, through the data source in raw.py; else Spark's text source, which
    drops a leading UTF-8 byte-order mark, unpacks .gz and passes over names that begin with _ or a dot.
    Files that are named twice are read twice. longest: bytes of a line that matter; of longer ones the exact source may return the first longest + 1 only.
    """
    files = gather(paths, excluded_endings, spark if exact else None)
    if not files:
        return empty_lines(spark)
    if exact:
        from .raw import RawLines

        spark.dataSource.register(RawLines)
        out = None
        for part in _without_repeats(files):
            got = spark.read.format("raw_lines").option("paths", "\n".join(part)).option("longest", str(longest or 0)).load()
            out = got if out is None else out.unionByName(got)
        return out
    text = spark.read.option("recursiveFileLookup", True).text(files)
    return text.select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_path").alias("path"))


def _without_repeats(files: list[str]) -> list[list[str]]:
    """Lists without repeated names that together hold every name as often as files does."""
    out: list[list[str]] = []
    for f in files:
        next((x for x in out if f not in x), out.append([]) or out[-1]).append(f)
    return [x for x in out if x]


def column_lines(df: DataFrame, text: str | Column, *keep: str) -> DataFrame:
    """The lines of a text column (runs of line ends count as one), with the columns to keep."""
    col = F.col(text) if isinstance(text, str) else text
    return df.select(*keep, F.explode(F.split(col, r"[\r\n]+")).alias("text")).select(*keep, F.encode("text", "UTF-8").alias("line"))


def union_lines(*parts: DataFrame) -> DataFrame:
    out = parts[0].select("line")
    for p in parts[1:]:
        out = out.unionByName(p.select("line"))
    return out
