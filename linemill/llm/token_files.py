"""Token-id output: documents as rANS-coded id shards, and their reader.

File format: a folder with `freqs` (Parquet: id, freq; one table for all shards) and `shards` (Parquet
container: store-independent, committed task by task). A row of `shards` is a segment: whole documents in
order (doc_id, n_tokens each), `first` = ids of this shard before it, and the ids in independent rANS
blocks with their own checkpoints and CRCs (rans.py). Shards ascend with doc_id, segments within a shard too.

Rows: a null text counts as empty and still has its end id; a null doc_id comes first; equal doc_ids go by
text and repeated rows are documents of their own; a text of any length is one segment at most, held by its task; an empty table gives empty files. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import rans
from .bpe import encoder
from .common import blank, dropped, mapped, saved, shipped

_RAW = "shard int, seg int, first long, doc_ids array<bigint>, doc_tokens array<bigint>, ids binary"
_SHARDS = "shard int, seg int, first long, n_tokens long, doc_ids array<bigint>, doc_tokens array<bigint>, blocks array<binary>"
BITS = 20


def _segments(path: str, end_id: int, target: int):
    """Tokenises a partition in its order and cuts it in segments of whole documents, about `target` ids each."""

    def run(batches):
        from pyspark import TaskContext

        enc = encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()
        shard, seg, first = TaskContext.get().partitionId(), 0, 0
        docs, counts, parts, held = [], [], [], 0

        def out():
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "seg": pa.array([seg], pa.int32()), "first": pa.array([first], pa.int64()), "doc_ids": pa.array([docs], pa.list_(pa.int64())), "doc_tokens": pa.array([counts], pa.list_(pa.int64())), "ids": pa.array([b"".join(parts)], pa.binary())})

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = enc.encode(text)
                n = len(ids) // enc.dtype.itemsize + 1
                docs.append(doc)
                counts.append(n)
                parts += (ids, end)
                held += n
                if held >= target:
                    yield out()
                    first, seg = first + held, seg + 1
                    docs, counts, parts, held = [], [], [], 0
        if docs:
            yield out()

    return run


def _histogram(dtype: str, size: int):
    """Counts of ids in a partition, one row for each id that occurs."""

    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for ids in b.column(0):
                total += np.bincount(np.frombuffer(ids.as_buffer(), dtype), minlength=size)
        seen = np.flatnonzero(total)
        if len(seen):
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["id", "n"])

    return run


_TABLES: dict[bytes, rans.Table] = {}


def _table(freq: bytes) -> rans.Table:
    key = zlib.crc32(freq).to_bytes(4, "little") + freq[-64:]
    if key not in _TABLES:
        _TABLES.clear()
        _TABLES[key] = rans.Table(np.frombuffer(freq, "<i8"), BITS)
    return _TABLES[key]


def _encoded(dtype: str, freq):
    def run(batches):
        table = _table(freq.value)
        for b in batches:
            blocks, n_tokens = [], []
            for ids in b.column("ids"):
                got = np.frombuffer(ids.as_buffer(), dtype)
                blocks.append([rans.encode(got[a : a + rans.BLOCK], table) for a in range(0, len(got), rans.BLOCK)])
                n_tokens.append(len(got))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("shard", "seg", "first")), pa.array(n_tokens, pa.int64()), b.column("doc_ids"), b.column("doc_tokens"), pa.array(blocks, pa.list_(pa.binary()))], ["shard", "seg", "first", "n_tokens", "doc_ids", "doc_tokens", "blocks"])

    return run


def _decoded(freq, with_ids: bool):
    def run(batches):
        table = _table(freq.value)
        for b in batches:
            for row in range(b.num_rows):
                ids = np.concatenate([rans.decode(x.as_py(), table) for x in b.column("blocks")[row].values] or [np.zeros(0, np.uint32)]).astype("<u4")
                docs, counts = b.column("doc_ids")[row].as_py(), np.array(b.column("doc_tokens")[row].as_py(), np.int64)
                ends = np.cumsum(counts)
                raw = memoryview(ids.tobytes())
                spans = [raw[4 * (e - n) : 4 * e] for e, n in zip(ends.tolist(), counts.tolist())]
                n = len(docs)
                cols = [pa.array(docs, pa.int64()), pa.array([b.column("shard")[row].as_py()] * n, pa.int32()), pa.array(b.column("first")[row].as_py() + ends - counts, pa.int64()), pa.array(counts, pa.int64()), pa.array([zlib.crc32(s) for s in spans], pa.int64())]
                names = ["doc_id", "shard", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array([np.frombuffer(s, "<u4") for s in spans], pa.list_(pa.uint32())).cast(pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    return run


def write_tokens(docs: DataFrame, out: str, vocabulary: str, end_id: int = 0, segment: int = 1 << 18) -> str:
    """Encodes doc_id and text of docs into the folder `out`, in ascending doc_id order.

    One range exchange of the texts; everything behind it works partition by partition. The ids are kept
    once in the shared folder, since the table of frequencies needs them all before the first is coded;
    counts come to the driver as one number for each id of the vocabulary, whatever the input's size.
    """
    spark = docs.sparkSession
    enc = encoder(vocabulary)
    dtype, size = enc.dtype.str, max(enc.size, end_id + 1)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), blank().alias("text"))
    # the text's beginning spreads rows of null or equal doc_id, and is short enough for the sample that the range exchange draws
    ordered = ordered.repartitionByRange("doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    raw = saved(mapped(ordered, _segments(vocabulary, end_id, segment), _RAW), "ids")
    got = mapped(raw.select("ids"), _histogram(dtype, size), "id int, n long", 16).groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size, np.int64)
    counts[got["id"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    freq = rans.normalised(counts, BITS).astype("<i8")
    seen = np.flatnonzero(freq)
    spark.createDataFrame([(int(i), int(freq[i])) for i in seen], "id int, freq long").coalesce(1).write.mode("overwrite").parquet(f"{out}/freqs")
    shared = spark.sparkContext.broadcast(freq.tobytes())
    mapped(raw, _encoded(dtype, shared), _SHARDS, 16).write.mode("overwrite").option("compression", "uncompressed").parquet(f"{out}/shards")
    dropped(raw)
    return out


def _shared(spark: SparkSession, path: str):
    """The table of frequencies, broadcast (a number for each id of the vocabulary), and the ids before each shard (a row for each)."""
    table = spark.read.parquet(f"{path}/freqs").toPandas()
    freq = np.zeros(int(table["id"].max()) + 1 if len(table) else 1, "<i8")
    freq[table["id"].to_numpy(np.int64)] = table["freq"].to_numpy(np.int64)
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    starts = spark.read.parquet(f"{path}/shards").groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return spark.sparkContext.broadcast(freq.tobytes()), starts


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids; from the files alone."""
    shipped(spark)
    shared, starts = _shared(spark, path)
    shards = spark.read.parquet(f"{path}/shards")
    docs = mapped(shards, _decoded(shared, with_ids), "doc_id long, shard int, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids, 16)
    out = docs.join(F.broadcast(starts), "shard")
    return out.select("doc_id", (F.col("start") + F.col("before")).alias("start"), *[c for c in docs.columns if c not in ("doc_id", "shard", "start")])


def _ranges(freq, first: int, last: int):
    def run(batches):
        table = _table(freq.value)
        for b in batches:
            for at, blocks in zip(b.column("at").to_pylist(), b.column("blocks").to_pylist()):
                for k, block in enumerate(blocks):
                    start = at + k * rans.BLOCK
                    got = rans.decode_range(block, table, max(0, first - start), max(0, last - start))
                    if len(got):
                        yield pa.RecordBatch.from_arrays([pa.array([max(start, first)], pa.int64()), pa.array([got], pa.list_(pa.uint32())).cast(pa.list_(pa.int32()))], ["start", "ids"])

    return run


def read_ids(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """start and ids of the stream of all ids from `first` to `last` (behind), in pieces: from the blocks that hold them, and in these from the checkpoints around them."""
    shipped(spark)
    shared, before = _shared(spark, path)
    shards = spark.read.parquet(f"{path}/shards").join(F.broadcast(before), "shard").withColumn("at", F.col("first") + F.col("before"))
    near = shards.filter((F.col("at") < last) & (F.col("at") + F.col("n_tokens") > first)).select("at", "blocks")
    return mapped(near, _ranges(shared, first, last), "start long, ids array<int>", 16)
