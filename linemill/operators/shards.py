"""Prefix statistics, and shards packed in chunks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import shard_key


def shard_histogram(lines: DataFrame, depth: int = 1) -> DataFrame:
    """lines and bytes (with line ends) for each prefix of `depth` bytes; `!` where a line is shorter."""
    keys = F.concat(*[shard_key(F.col("line"), k) for k in range(1, depth + 1)])
    keys = F.regexp_replace(keys, "!+$", "!")
    return lines.groupBy(keys.alias("shard")).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.octet_length("line").cast("long") + 1).alias("bytes"))


def chunk_plan(shards: DataFrame, max_bytes: int, max_lines: int = 2**31 - 1) -> DataFrame:
    """Adds chunk, from 0: shards in order share a chunk until their bytes or lines would pass a maximum.

    A fold over one row for each prefix, in order and in one task, which holds three numbers; the rows are prefixes, however many lines they have.
    """

    def fold(batches):
        chunk = held_bytes = held_lines = 0
        for b in batches:
            out = []
            for lines, size in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if held_lines and (held_bytes + size > max_bytes or held_lines + lines > max_lines):
                    chunk, held_bytes, held_lines = chunk + 1, 0, 0
                held_bytes, held_lines = held_bytes + size, held_lines + lines
                out.append(chunk)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], ["shard", "lines", "bytes", "chunk"])

    rows = shards.select("shard", F.col("lines").cast("long").alias("lines"), F.col("bytes").cast("long").alias("bytes"))
    return rows.repartition(1).sortWithinPartitions("shard").mapInArrow(fold, "shard string, lines long, bytes long, chunk int")
