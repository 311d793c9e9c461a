"""Writing lines: many ordered parts, or one file."""

from __future__ import annotations

import uuid

from pyspark.errors import UnsupportedOperationException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordering import in_blocks, order_keys
from ..storage import delete


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_parts(lines: DataFrame, folder: str, order: str = "dictionary", copies: str | None = None) -> None:
    """Parts in name order are the lines in order; bytes are written as they are, each line with LF.

    copies: a column that says how often a row's line is written. Copies go to the ranges in blocks, so those of a frequent line can be in many parts.
    """
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = order_keys(order)
    if copies:
        keys = [*keys, F.col("_block")]
        lines = in_blocks(lines.select("line", copies), copies)
    lines = lines.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    if copies:
        lines = lines.select("line", F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))))
    lines.select(F.col("line").cast("string").alias("value")).write.mode("overwrite").text(folder)


def _joined(spark: SparkSession, fs, target, parts: list) -> None:
    """Parts one behind the other: by the file system itself where it can do that, else through the driver's streams."""
    fs.create(target).close()
    many = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Path, len(parts))
    for i, p in enumerate(parts):
        many[i] = p
    try:
        fs.concat(target, many)
        return
    except UnsupportedOperationException:  # most file systems cannot
        pass
    out = fs.create(target, True)
    try:
        for p in parts:
            with_ = fs.open(p)
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(with_, out, 1 << 20, False)
            finally:
                with_.close()
    finally:
        out.close()


def _without_checksum(spark: SparkSession, path: str) -> None:
    """A local file system leaves one beside each file that it writes."""
    delete(spark, path.rpartition("/")[0] + "/." + path.rpartition("/")[2] + ".crc")


def write_groups(lines: DataFrame, by: str, folder: str) -> None:
    """One file for each value of a column, <folder>/<column>=<value>.txt, of the lines in any order. Values are text that file names can have.

    The tasks write the lines where they are, so a frequent value is no task of its own; its parts become one file as in write_file.
    """
    spark, parts = lines.sparkSession, f"{folder}.parts-{uuid.uuid4().hex}"
    try:
        lines.select(by, F.col("line").cast("string").alias("value")).write.partitionBy(by).text(parts)
        fs, root = _fs(spark, parts)
        fs.mkdirs(_fs(spark, folder)[1])  # without lines, the folder is empty
        for group in sorted(s.getPath().getName() for s in fs.listStatus(root) if s.isDirectory()):
            found = sorted((s.getPath().getName(), s.getPath()) for s in fs.listStatus(_fs(spark, f"{parts}/{group}")[1]))
            path = f"{folder}/{group}.txt"
            _joined(spark, fs, _fs(spark, path)[1], [p for name, p in found if name.startswith("part-")])
            _without_checksum(spark, path)
            delete(spark, f"{parts}/{group}")
    finally:
        delete(spark, parts)


def write_file(lines: DataFrame, path: str, order: str = "dictionary", copies: str | None = None) -> bool:
    """One ordered file. What was there goes first; without lines there is no file, and False.

    Sorting and writing are parallel. The parts become one file by the file system's concat; where it has none (a local
    disk, an object store), the driver appends their bytes.
    """
    spark = lines.sparkSession
    folder = f"{path}.parts-{uuid.uuid4().hex}"
    try:
        write_parts(lines, folder, order, copies)
        fs, target = _fs(spark, path)
        fs.delete(target, True)
        found = sorted((s.getPath().getName(), s.getPath(), s.getLen()) for s in fs.listStatus(_fs(spark, folder)[1]))
        found = [p for name, p, size in found if name.startswith("part-") and size]
        if found:
            _joined(spark, fs, target, found)
    finally:
        delete(spark, folder)
    _without_checksum(spark, path)
    return bool(found)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, target = _fs(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    _without_checksum(spark, path)
