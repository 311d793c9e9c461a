"""Lexical retrieval packing: windows filled with BM25 neighbours of their seed document.

Documents are tokenised once into a table in the shared folder. Corpus statistics (documents with each
id, documents, ids) cover all of it and have the vocabulary's size. The index is sharded: each shard of about
`shard_tokens` ids has its own postings over token ids and is packed by itself, so memory does not grow with
the corpus and no document is in two shards. Documents are dealt to shards by what they say: a document's signature is its `KEYS` weightiest
ids, heaviest first (BM25's term weight, with an id's place in the vocabulary for its rarity: byte-pair ids are numbered by merges, common ones
first, so a signature needs no second pass), and shards are ranges of signatures. So copies and alike documents of the whole
corpus, wherever they lie in it, are neighbours in a shard; equal signatures go by a hash, so any number of copies spreads over shards. In a shard the first unused document seeds a window; the unused
document that scores highest for the seed, by all of the seed's terms, comes next, until the window is full. What the last one has left
over seeds the next window. Where no unused neighbour shares a term, the first unused document follows.
A shard's last ids go to windows of powers of two, so nothing is padded.

Rows: a null text counts as empty and is its end id alone; null or equal doc_ids are documents of their own, and so are repeated rows; a text
of any length is cut into as many windows as it takes; of equal scores the first in the shard's order wins; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .common import blank, mapped, only, saved, shuffle_parts

K1, B = 1.2, 0.75
CHUNK = 1 << 20
#: A term that one in so many documents of a shard, or more, holds has a row of weights of all unused documents; such rows have so many numbers at most.
COMMON, ROWS = 16, 1 << 20
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


#: Ids in a document's signature, and the ids that a document usually has.
KEYS, USUAL = 4, 600


def signature(ids: np.ndarray, rarity: np.ndarray) -> list[int]:
    """The weightiest ids of a document; of equal weights the smaller id first."""
    return _weightiest(*distinct(ids), len(ids), rarity)


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with counts, in less time: the stable sort of 16-bit ids is by their digits."""
    ids = np.sort(ids, kind="stable")
    if not len(ids):
        return ids, np.zeros(0, np.int64)
    new = np.empty(len(ids), bool)
    new[0] = True
    np.not_equal(ids[1:], ids[:-1], out=new[1:])
    at = np.flatnonzero(new)
    n = np.empty_like(at)
    np.subtract(at[1:], at[:-1], out=n[:-1])
    n[-1] = len(ids) - at[-1]
    return ids[at], n


def _weightiest(term: np.ndarray, tf: np.ndarray, n: int, rarity: np.ndarray) -> list[int]:
    weight = rarity[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * n / USUAL))
    return term[np.argsort(-weight, kind="stable")[:KEYS]].tolist()


def rarities(size: int) -> np.ndarray:
    """Of a vocabulary in the order of its merges."""
    return np.log1p(np.arange(size) / 50) ** 2


TOKENISED = "doc_id long, key array<int>, crc long, ids binary, seen array<int>, docs array<bigint>"


def _tokenised(path: str, end_id: int, size: int):
    """Rows of documents, and one behind them with the statistics of the task's: the ids seen, and how many documents hold each; id -1: documents, id -2: ids."""

    def run(batches):
        enc = encoder(path)
        end, rarity = np.array([end_id], enc.dtype).tobytes(), rarities(size)
        df, n, total = np.zeros(size, np.int64), 0, 0

        def rows(doc_id, keys, crc, ids, seen, docs):
            return pa.RecordBatch.from_arrays([doc_id, pa.array(keys, pa.list_(pa.int32())), pa.array(crc, pa.int64()), pa.array(ids, pa.binary()), pa.array(seen, pa.list_(pa.int32())), pa.array(docs, pa.list_(pa.int64()))], ["doc_id", "key", "crc", "ids", "seen", "docs"])

        for b in batches:
            ids, keys = [enc.encode(x) for x in b.column(1).to_pylist()], []
            for x in ids:
                got = np.frombuffer(x, enc.dtype)
                term, tf = distinct(got)
                keys.append(_weightiest(term, tf, len(got), rarity))
                had = df[end_id]
                df[term] += 1
                df[end_id] = had + 1
                n, total = n + 1, total + len(got) + 1
            none = [None] * len(ids)
            ids = [x + end for x in ids]
            yield rows(b.column(0), keys, [zlib.crc32(x) for x in ids], ids, none, none)
        if n:
            seen = np.flatnonzero(df)
            yield rows(pa.array([None], pa.int64()), [None], [None], [None], [np.concatenate([[-1, -2], seen])], [np.concatenate([[n, total], df[seen]])])

    return run


class Shard:
    """Postings of some documents: for a document, how well each other one matches its terms."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float, terms: int | None = None):
        self.n, self.terms = len(docs), terms
        lens = np.array([len(d) for d in docs], np.int64)
        keys = np.repeat(np.arange(self.n, dtype=np.int64), lens) * len(idf) + np.concatenate(docs)
        keys, tf = np.unique(keys, return_counts=True)
        doc, term = keys // len(idf), keys % len(idf)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lens[doc] / mean))
        self.first = np.searchsorted(doc, np.arange(self.n + 1))
        self.term, self.weight = term, weight
        order = np.argsort(term, kind="stable")
        self.post_doc, self.post_weight = doc[order], weight[order]
        self.size = len(idf)
        self._ends(term)

    def _ends(self, term: np.ndarray) -> None:
        n = np.bincount(term, minlength=self.size)
        self.post_end, self.post_n = np.cumsum(n), n
        self.held = np.flatnonzero(np.bincount(self.post_doc, minlength=self.n))  # the columns of the rows
        place = np.zeros(self.n, np.int64)
        place[self.held] = np.arange(len(self.held))
        many = np.flatnonzero(n * COMMON >= max(len(self.held), 1))
        many = many[np.argsort(-n[many], kind="stable")[: ROWS // max(len(self.held), 1)]]
        self.row = np.full(self.size, -1)
        self.row[many] = np.arange(len(many))
        self.rows = np.zeros((len(many), len(self.held)))
        for row, end, k in zip(self.rows, self.post_end[many].tolist(), n[many].tolist()):
            row[place[self.post_doc[end - k : end]]] = self.post_weight[end - k : end]

    def keep(self, unused: np.ndarray) -> None:
        """Drops the postings of documents that are used."""
        on = unused[self.post_doc]
        term = np.repeat(np.arange(self.size), self.post_n)[on]
        self.post_doc, self.post_weight = self.post_doc[on], self.post_weight[on]
        self._ends(term)

    def scores(self, d: int) -> np.ndarray:
        """Of all documents with postings, by all of d's terms (or its `terms` weightiest)."""
        a, b = self.first[d], self.first[d + 1]
        term, weight = self.term[a:b], self.weight[a:b]
        held = self.post_n[term] > 0
        term, weight = term[held], weight[held]
        if self.terms is not None and len(term) > self.terms:
            term = term[np.argpartition(-weight, self.terms)[: self.terms]]
        row = self.row[term]
        out = np.zeros(self.n)
        out[self.held] = np.add.reduce(self.rows[row[row >= 0]], axis=0)  # in the order of terms for every document, so equal ones have equal scores
        term = term[row < 0]
        size = np.cumsum(self.post_n[term])
        i = 0
        while i < len(term):  # so many postings at once, to bound memory
            j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + CHUNK, "right")))
            n = self.post_n[term[i:j]]
            at = np.arange(n.sum()) + np.repeat(self.post_end[term[i:j]] - np.cumsum(n), n)
            out += np.bincount(self.post_doc[at], self.post_weight[at], self.n)
            i = j
        return out


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int, terms: int | None = None) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length); each is `window` long or, at the end, a power of two."""
    shard, unused, nxt = Shard(docs, idf, mean, terms), np.ones(len(docs), bool), 0
    held = len(docs)
    out, pieces, room = [], [], window
    scores = None
    while True:
        while nxt < len(docs) and not unused[nxt]:
            nxt += 1
        if nxt == len(docs):
            break
        if pieces:
            if scores is None:
                left = int(unused.sum())
                if left < 0.8 * held:
                    shard.keep(unused)
                    held = left
                scores = shard.scores(pieces[0][0])
                scores[~unused] = 0
            d = int(np.argmax(scores))
            d = d if scores[d] > 0 else nxt
        else:
            d = nxt
        unused[d] = False
        if scores is not None:
            scores[d] = 0
        start, n = 0, len(docs[d])
        while n - start >= room:
            pieces.append((d, start, room))
            start += room
            out.append(pieces)
            pieces, room, scores = [], window, None
        if start < n:
            pieces.append((d, start, n - start))
            room -= n - start
    rest = window - room
    while rest:
        size, seq, held = 1 << (rest.bit_length() - 1), [], 0
        while held < size:
            d, start, n = pieces[0]
            take = min(n, size - held)
            seq.append((d, start, take))
            held += take
            pieces[0] = (d, start + take, n - take)
            if take == n:
                pieces.pop(0)
        out.append(seq)
        rest -= size
    return out


def _packed(dtype: str, shared, window: int, shard_tokens: int):
    def run(batches):
        from pyspark import TaskContext

        only()
        idf, mean = shared.value
        seq_id = TaskContext.get().partitionId() << 32
        names, docs, held = [], [], 0

        def out():
            nonlocal seq_id
            cols = [[] for _ in range(7)]
            for seq in pack_shard(docs, idf, mean, window):
                at = 0
                for d, start, n in seq:
                    for col, v in zip(cols, (names[d], start, n, docs[d][start : start + n].astype("<u4").tobytes(), len(docs[d]), seq_id, at)):
                        col.append(v)
                    at += n
                seq_id += 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                names.append(doc)
                docs.append(np.frombuffer(ids, dtype))
                held += len(docs[-1])
                if held >= shard_tokens:
                    yield out()
                    names, docs, held = [], [], 0
        if docs:
            yield out()

    return run


def packed(docs: DataFrame, vocabulary: str, end_id: int = 0, window: int = 1024, shard_tokens: int = 1 << 20) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    enc = encoder(vocabulary)
    dtype, size = enc.dtype.str, max(enc.size, end_id + 1)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), blank().alias("text"))
    table = saved(mapped(texts, _tokenised(vocabulary, end_id, size), TOKENISED, 500), "packing")
    counts = table.filter("seen is not null").select(F.explode(F.arrays_zip("seen", "docs")).alias("c"))
    got = counts.groupBy(F.col("c.seen").alias("id")).agg(F.sum("c.docs").alias("n")).toPandas()
    stats = dict(zip(got["id"].tolist(), got["n"].tolist()))
    n, total = stats.pop(-1, 0), stats.pop(-2, 0)
    df = np.zeros(size)
    df[list(stats)] = list(stats.values())
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float64)
    shared = spark.sparkContext.broadcast((idf, total / max(n, 1)))
    at = [*[F.get("key", F.lit(i)) for i in range(KEYS)], F.xxhash64("doc_id", "crc")]
    dealt = table.filter("seen is null").select("doc_id", "key", "crc", "ids").repartitionByRange(shuffle_parts(spark), *at).sortWithinPartitions(*at, "doc_id")
    return mapped(dealt.select("doc_id", "ids"), _packed(dtype, shared, window, shard_tokens), PIECES)
