"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over successive words that looks at some of them and ignores the others, so a hit survives
substitutions at the ignored places. All seeds of the benchmark are hashed; every document position is hashed
under each mask and joined with them. A hit fixes a diagonal (document place minus item place); on it the item is laid over the
document and the longest segment with at least `similarity` (0.8) equal words is taken. It counts from
`min_words` equal words, or from all words of a shorter item.

The benchmark is the broadcast side: its size is measured first, and it goes out in blocks of at most about `block_words` words,
each against all documents, so memory is bounded whatever its size.

Rows: null or blank texts and items match nothing; null or equal ids are rows of their own and carry their id into the result, repeated rows too;
a text of any length is hashed whole; of segments of equal length the first counts; an item of fewer words than the shortest mask is sought as a
whole; empty tables give no rows; other columns are ignored, and decontaminated() returns them as they are.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HASHES, all_of, blank, hidden, mapped, mixed, only, words_of

#: Places looked at (1) and ignored (0), in words.
MASKS = ("111101111", "11011011", "1101011")
HITS = "row long, item_id long, doc_start long, item_start long, length long, matches long"
_K = np.uint64(0x9E3779B97F4A7C15)


def seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """The hash of every place under a mask."""
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(mask), np.uint64)
    for i, bit in enumerate(mask):
        if bit == "1":
            out = (out ^ (out >> np.uint64(29))) * _K + h[i : i + n]
    return mixed(out)


def longest_alike(equal: np.ndarray, similarity: float) -> tuple[int, int, int]:
    """Start, length and equal words of the longest segment with at least that share of equal words; the first of equals.

    It begins and ends with equal words. Linear: starts can only be new minima of the running sum.
    """
    good = round((1 - similarity) * 1000)
    total = np.concatenate([[0], np.cumsum(np.where(equal, good, good - 1000))]).tolist()
    lows = [0]
    for i, x in enumerate(total):
        if x < total[lows[-1]]:
            lows.append(i)
    start = length = 0
    for end in range(len(total) - 1, 0, -1):
        while lows and total[lows[-1]] <= total[end]:
            low = lows.pop()
            if end - low >= length and end > low:
                start, length = low, end - low
        if not lows:
            break
    where = np.flatnonzero(equal[start : start + length])
    if not len(where):
        return 0, 0, 0
    return start + int(where[0]), int(where[-1] - where[0]) + 1, len(where)


class Index:
    """Sorted seed hashes of a block of items, each with its item and place."""

    def __init__(self, items: list[tuple[int | None, bytes]]):
        self.items = [(i, HASHES.of(words_of(t))) for i, t in items]
        shortest = min(map(len, MASKS))
        self.by_mask = {}
        for mask in (*MASKS, *sorted({"1" * len(h) for _, h in self.items if 0 < len(h) < shortest})):
            keys, who, place = [], [], []
            for k, (_, h) in enumerate(self.items):
                if len(mask) < shortest and len(h) != len(mask):
                    continue
                got = seeds(h, mask)
                keys.append(got)
                who.append(np.full(len(got), k))
                place.append(np.arange(len(got)))
            if keys and sum(map(len, keys)):
                keys, who, place = map(np.concatenate, (keys, who, place))
                order = np.argsort(keys, kind="stable")
                near = np.zeros(1 << 20, bool)
                near[keys >> np.uint64(44)] = True
                self.by_mask[mask] = keys[order], who[order], place[order], near

    def hits(self, h: np.ndarray, min_words: int, similarity: float):
        """Overlaps of a document with items: item, place in the document, place in the item, length, equal words."""
        lines = set()
        for mask, (keys, who, place, near) in self.by_mask.items():
            got = seeds(h, mask)
            at = np.flatnonzero(near[got >> np.uint64(44)])
            if not len(at):
                continue
            lo, hi = np.searchsorted(keys, got[at], "left"), np.searchsorted(keys, got[at], "right")
            n = hi - lo
            if n.any():
                k = np.arange(n.sum()) + np.repeat(lo - np.cumsum(n) + n, n)
                lines.update(zip(who[k].tolist(), (np.repeat(at, n) - place[k]).tolist()))
        out = set()
        for k, shift in sorted(lines):
            item = self.items[k][1]
            a, b = max(0, -shift), min(len(item), len(h) - shift)
            start, n, equal = longest_alike(h[a + shift : b + shift] == item[a:b], similarity)
            if equal >= min(min_words, len(item)):
                out.add((k, a + start + shift, a + start, n, equal))
        return sorted(out)


def _matched(items, min_words: int, similarity: float):
    def run(batches):
        only(HASHES)
        index = Index(items.value)
        for b in batches:
            out = []
            for row, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
                out += [(row, index.items[k][0], *rest) for k, *rest in index.hits(HASHES.of(words_of(t)), min_words, similarity)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["doc_id", "item_id", "doc_start", "item_start", "length", "matches"])

    return run


def benchmark_overlaps(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, similarity: float = 0.8, block_words: int = 300_000) -> DataFrame:
    """doc_id, item_id, doc_start, item_start, length, matches (in words): one row for each overlap found."""
    spark = docs.sparkSession
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), blank().alias("text")).withColumn("words", F.size(F.split("text", r"\s+")).cast("long"))
    total = tests.agg(F.sum("words")).first()[0] or 0
    blocks = max(1, math.ceil(total / block_words))
    tests = tests.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    texts, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), blank().alias("text")), None
    for k in range(blocks):
        rows = sorted(((r[0], r[1].encode()) for r in tests.filter(F.col("block") == k).select("item_id", "text").collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        found = mapped(texts, _matched(spark.sparkContext.broadcast(rows), min_words, similarity), HITS.replace("row ", "doc_id "))
        out = found if out is None else out.union(found)
    return out


def _clean(items, min_words: int, similarity: float):
    def run(batches):
        only(HASHES)
        index = Index(items.value)
        for b in batches:
            ok = [not index.hits(HASHES.of(words_of(t)), min_words, similarity) for t in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(b.columns[:-1], b.schema.names[:-1]).filter(pa.array(ok))

    return run


def decontaminated(docs: DataFrame, benchmark: DataFrame, min_words: int = 13, similarity: float = 0.8, block_words: int = 300_000) -> DataFrame:
    """The documents without an overlap, all their columns; one pass over them for each block of the benchmark."""
    spark = docs.sparkSession
    tests = benchmark.select(F.col("item_id").cast("long").alias("item_id"), blank().alias("text"))
    total = tests.agg(F.sum(F.size(F.split("text", r"\s+")).cast("long"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_words))
    for k in range(blocks):
        rows = [(r[0], r[1].encode()) for r in tests.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()]
        docs = mapped(docs.select(*all_of(docs), blank().alias(hidden(docs, "text_"))), _clean(spark.sparkContext.broadcast(rows), min_words, similarity), docs.schema)
    return docs
