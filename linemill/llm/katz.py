"""Katz backoff trigram model, counted, normalised and evaluated in partitioned tables.

Tokens are lower-cased (A-Z) words between ASCII white space, and one end behind each text. The probability of a token behind
its two predecessors comes from the highest order whose context the learning texts have:

* an n-gram that they have: its Good-Turing discounted count over the context's count;
* another: the context's backoff weight times the next lower order's probability, recursively. The weight is
  (1 - mass of the context's n-grams) / (1 - their mass in the lower order), so a context's probabilities sum to 1 exactly;
* unigrams: discounted counts; what the discounts leave is the probability of the one unknown word.

A context all of whose n-grams are too frequent for a discount has its count raised by one, so that it has some mass left.
A text's first token has its unigram's probability, its second one its bigram's.

A few rows of packed arrays move instead of one row a token. Texts become batches of about `batch_bytes`, written once, in
buckets by batch. For each order, a batch sends its distinct n-grams with their counts to ranges of contexts (one compressed packet for each
range that it has something for); a range adds up counts over the corpus, keeps them as its part of the model, and answers
each packet: counts, and for contexts with an unseen n-gram what their weight is made of. Answers meet batches by a join that moves answers only.
There is a range for about `range_tokens` tokens, at least as many as shuffle partitions, so neither a packet's size nor a range's memory changes with the
corpus. A context with more than 1/(2 * ranges) of all tokens is spread over all ranges by n-gram: they return partial sums, one row each.
Words are told apart by 64-bit hashes, contexts and n-grams by 64-bit hashes within their range.

Rows: a null text is empty (its end is scored); a null doc_id is scored, not learned from; repeated rows and rows of equal doc_id count as often
as they occur; a text of any length is one piece of one batch, held whole by its task; no learning rows: every token is unknown and has probability 1; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank, bucketed, mapped, mixed, saved, shuffle_parts

BATCH, RANGE = 8 << 20, 2 << 20
K = 5
END = b" "  # no word
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SALTS = {2: np.uint64(0x2545F4914F6CDD1D), 3: np.uint64(0x5851F42D4C957F2D)}
_COMPRESS, _EXPAND = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays to one string: kinds and lengths, then all byte planes compressed together. Unsigned 64-bit arrays may come back narrower."""
    head, planes = [len(arrays).to_bytes(1, "little")], []
    for a in arrays:
        if a.dtype == np.uint64 and (not len(a) or a.max() < 1 << 32):
            a = a.astype(np.uint32)
        head.append(a.dtype.str.encode().ljust(4) + len(a).to_bytes(8, "little"))
        planes.append(np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T).tobytes())
    return b"".join(head) + _COMPRESS.compress(b"".join(planes))


def unpack(data: bytes) -> list[np.ndarray]:
    kinds = [(np.dtype(data[i : i + 4].decode().strip()), int.from_bytes(data[i + 4 : i + 12], "little")) for i in range(1, 1 + 12 * data[0], 12)]
    size = sum(k.itemsize * n for k, n in kinds)
    planes = np.frombuffer(_EXPAND.decompress(data[1 + 12 * data[0] :], max_output_size=size + 1), np.uint8)
    out, at = [], 0
    for kind, n in kinds:
        part = planes[at : at + n * kind.itemsize].reshape(kind.itemsize, n)
        out.append(np.ascontiguousarray(part.T).reshape(-1).view(kind) if n else np.zeros(0, kind))
        at += n * kind.itemsize
    return out


def once(a: np.ndarray) -> np.ndarray:
    """Positive numbers, with zeros for those that are the same as the one before: these pack best. filled() undoes it."""
    out = a.copy()
    out[1:][a[1:] == a[:-1]] = 0
    return out


def filled(a: np.ndarray) -> np.ndarray:
    return a[np.maximum.accumulate(np.where(a > 0, np.arange(len(a)), 0))]


def discounts(n: list[int], k: int = K) -> np.ndarray:
    """Good-Turing discounts d[r] of counts r = 0..k+1 (d[k+1], for all beyond, is 1); n[r-1]: how many things have count r.

    Katz's formula; where it leaves (0, 1) on these counts, absolute discounting by n1 / (n1 + 2 n2), 0.5 without such counts.
    """
    d = np.ones(k + 2)
    with np.errstate(all="ignore"):
        n = np.array(n, float)
        a = (k + 1) * n[k] / n[0]
        r = np.arange(1, k + 1)
        d[1 : k + 1] = ((r + 1) * n[1 : k + 1] / n[:k] / r - a) / (1 - a)
    if not (np.isfinite(d).all() and (d[1 : k + 1] > 0).all() and (d[1 : k + 1] < 1).all()):
        cut = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        d[1 : k + 1] = (r - cut) / r
    d[0] = 0
    return d


class Unigrams:
    def __init__(self, total: int, n: list[int]):
        self.total, self.d = total, discounts(n)
        lost = sum((1 - self.d[r]) * r * n[r - 1] for r in range(1, K + 1))
        self.scale = 1.0
        if total and lost <= 0:  # nothing discounted: room for one more
            self.scale, lost = total / (total + 1), total / (total + 1)
        self.unknown = lost / total if total else 1.0

    def p(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.d[np.minimum(count, K + 1)] * count * self.scale / max(self.total, 1), self.unknown)


def left_over(d: np.ndarray, few: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Mass that contexts' n-grams leave. few: contexts x K, how many of their n-grams have count 1..K; total: the contexts' counts."""
    spare = ~few.any(1)
    r = np.arange(1, K + 1)
    return (few @ ((1 - d[1 : K + 1]) * r) + spare) / (total + spare)


def _row(kind: int, part: int, batch: int, payload: bytes | None, stats=None):
    cols = [pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([batch], pa.int64()), pa.array([payload], pa.binary()), pa.array([stats], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(cols, ["kind", "part", "batch", "payload", "stats"])


_ROW = "kind int, part int, batch long, payload binary, stats array<bigint>"


def placed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: hashes of their words, one for each distinct word, frequent ones first; tokens as places in these; tokens of each text. Arrow splits and tells apart."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = words.values.dictionary_encode()
    place, vocab = coded.indices.to_numpy(), coded.dictionary.cast(pa.binary()).to_pylist()
    doc = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
    if b"" in vocab:  # before or behind white space at a text's edge
        real = place != vocab.index(b"")
        place, doc = place[real], doc[real]
    at = np.full(len(place) + len(texts), len(vocab), np.uint32)
    at[np.arange(len(place)) + doc] = place
    order = np.argsort(-np.bincount(at, minlength=len(vocab) + 1), kind="stable")
    rank = np.empty(len(order), np.uint32)
    rank[order] = np.arange(len(order))
    hashes = np.frombuffer(b"".join(map(xxhash.xxh64_digest, [*vocab, END])), ">u8").astype(np.uint64)
    return hashes[order], rank[at], np.bincount(doc, minlength=len(texts)) + 1


def _batches(limit: int):
    """Texts to batches of about `limit` bytes."""

    def run(batches):
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def out():
            ids, learn, texts = (pa.concat_arrays([b.column(k) for b in held]) for k in range(3))
            vocab, at, lens = placed(texts)
            named = np.asarray(ids.is_valid(), np.uint8)
            payload = pack(vocab, at, lens.astype(np.uint64), ids.fill_null(0).to_numpy(), named, np.asarray(learn, np.uint8))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([payload], pa.binary())], ["batch", "tokens", "texts"])

        for b in batches:
            sizes, start = pc.binary_length(b.column(2)).to_numpy().astype(np.int64) + 8, 0
            for end, n in enumerate(sizes.tolist(), 1):
                size += n
                if size >= limit:
                    held.append(b.slice(start, end - start))
                    yield out()
                    number, held, size, start = number + 1, [], 0, end
            if start < b.num_rows:
                held.append(b.slice(start))
        if held:
            yield out()

    return run


class Grams:
    """The distinct n-grams among codes, each with its learning count, one of its places, and for each place its n-gram; order sorts the places."""

    def __init__(self, code: np.ndarray, learn: np.ndarray):
        self.order = order = np.argsort(code)
        code = code[order]
        start = np.flatnonzero(np.concatenate([[len(code) > 0], code[1:] != code[:-1]])[: len(code)])
        self.code, self.first = code[start], order[start]
        self.n = np.add.reduceat(learn[order], start) if len(start) else np.zeros(0, np.int64)
        self.of = np.empty(len(code), np.int32 if len(code) < 1 << 31 else np.int64)
        self.of[order] = np.repeat(np.arange(len(start), dtype=self.of.dtype), np.diff(np.append(start, len(code))))


class Sent:
    """n-grams in the order of their packets: by range, then code; runs share range and context."""

    def __init__(self, part: np.ndarray, ctx: np.ndarray, parts: int):
        self.order = np.argsort(part.astype(np.uint16 if parts < 1 << 16 else np.uint32), kind="stable")
        part, ctx = part[self.order], ctx[self.order]
        self.run = np.flatnonzero(np.concatenate([[len(part) > 0], (part[1:] != part[:-1]) | (ctx[1:] != ctx[:-1])])[: len(part)])
        self.runs = np.diff(np.append(self.run, len(part)))
        self.part_of_run = part[self.run]
        self.parts = np.unique(self.part_of_run)

    def packets(self):
        """Each range with its slices of runs and of n-grams."""
        lo, hi = np.searchsorted(self.part_of_run, self.parts, "left"), np.searchsorted(self.part_of_run, self.parts, "right")
        ends = np.append(self.run, len(self.order))
        for p, a, b in zip(self.parts.tolist(), lo.tolist(), hi.tolist()):
            yield p, slice(a, b), slice(int(ends[a]), int(ends[b]))


class Batch:
    """A batch as it meets the answers of the ranges, order after order."""

    def __init__(self, payload: bytes, answers: list[dict], model: "Model"):
        self.model, self.parts = model, model.parts
        self.vocab, at, lens, self.ids, self.named, self.learn = unpack(payload)
        self.vocab, self.at, self.lens = self.vocab.astype(np.uint64), at.astype(np.int64), lens.astype(np.int64)
        self.answers = {n: [unpack(a["payload"]) for a in sorted((a for a in answers if a["order"] == n), key=lambda a: a["part"])] for n in (1, 2, 3)}
        self.doc = np.repeat(np.arange(len(self.lens)), self.lens)
        place = np.arange(len(self.at)) - np.repeat(np.cumsum(self.lens) - self.lens, self.lens)
        self.later = {2: place >= 1, 3: place >= 2}
        self.bits = np.uint64(max(1, len(self.vocab).bit_length()))

    def word_packets(self):
        order = np.argsort(self.vocab)
        count = np.bincount(self.at, self.learn[self.doc], len(self.vocab)).astype(np.uint32)
        step = (1 << 64) // self.parts + 1
        cut = [0, *np.searchsorted(self.vocab[order], np.array([p * step for p in range(1, self.parts)], np.uint64)).tolist(), len(order)]
        for p in range(self.parts):
            if cut[p] < cut[p + 1]:
                yield p, order[cut[p] : cut[p + 1]], count

    def words(self):
        """Each word's count and number (0: not in the learning texts)."""
        order = np.argsort(self.vocab)
        self.count, self.number = np.zeros(len(self.vocab) + 1, np.int64), np.zeros(len(self.vocab) + 1, np.uint64)
        for into, k in ((self.count, 0), (self.number, 1)):
            into[order] = np.concatenate([a[k] for a in self.answers[1]])
        self.number[self.count == 0] = 0

    def bigrams(self):
        """Pairs whose first word is known; unknown words are one word."""
        self.words()
        self.i2 = np.flatnonzero(self.later[2])
        self.i2 = self.i2[self.count[self.at[self.i2 - 1]] > 0]
        self.known = np.where(self.count[self.at] > 0, self.at, len(self.vocab)).astype(np.uint64)
        u, v = self.known[self.i2 - 1], self.known[self.i2]
        self.g2 = g = Grams((u << self.bits) | v, self.learn[self.doc[self.i2]])
        u, v = (g.code >> self.bits).astype(np.int64), (g.code & ((np.uint64(1) << self.bits) - np.uint64(1))).astype(np.int64)
        key = mixed(self.number[u] ^ _SALTS[2])
        hot = self.count[u] >= self.model.hot
        part = np.where(hot, mixed(key + self.number[v] * _ODD), key) % np.uint64(self.parts)
        self.s2 = Sent(part, u, self.parts)
        self.u2, self.v2, self.key2, self.hot2 = u, v, key, hot

    def bigram_packets(self):
        s, g = self.s2, self.g2
        r = s.order[s.run]
        arrays = (self.number[self.u2[r]], s.runs.astype(np.uint32), self.hot2[r].astype(np.uint8)), (self.number[self.v2[s.order]], self.count[self.v2[s.order]].astype(np.uint32), g.n[s.order].astype(np.uint32))
        for p, a, b in s.packets():
            yield p, pack(*(x[a] for x in arrays[0]), *(x[b] for x in arrays[1]))

    def _answered(self, n: int, s: Sent, key: np.ndarray, hot: np.ndarray):
        """Counts of n-grams, which n-grams' contexts have their count raised, and of the unseen ones: who, few and low of their contexts."""
        count, raised, asked, few, low = [], [], [], [], []
        for (_, a, _), (c, one, run, f, l) in zip(s.packets(), self.answers[n], strict=True):
            for into, x in ((count, c), (raised, one), (asked, a.start + run.astype(np.int64)), (few, f.reshape(-1, K)), (low, l)):
                into.append(x)
        if not count:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, K)), np.zeros(0)
        count, raised, asked, few, low = map(np.concatenate, (count, raised, asked, few, low))
        unseen = np.flatnonzero(count == 0)
        i = np.searchsorted(asked, np.searchsorted(s.run, unseen, "right") - 1)
        who, out, spare = s.order[unseen], np.empty(len(count), np.int64), np.zeros(len(count), np.int64)
        out[s.order] = count
        if raised.any():
            spare[s.order] = np.repeat(raised, s.runs)
        cold = ~hot[who]
        few_of, low_of = np.zeros((len(who), K)), np.zeros(len(who))
        few_of[cold], low_of[cold] = few[i[cold]], low[i[cold]]
        if hot.any():
            keys, f, l = self.model.spread[n]
            at = np.searchsorted(keys, key[hot])
            spare[hot] = ~f[at].any(1)
            at = np.searchsorted(keys, key[who[~cold]])
            few_of[~cold], low_of[~cold] = f[at], l[at]
        return out, spare, who, few_of, low_of

    def trigrams(self):
        """Triples whose first two words are a bigram of the learning texts."""
        self.bigrams()
        self.c2, self.spare2, *self.unseen2 = self._answered(2, self.s2, self.key2, self.hot2)
        self.g2_at = np.full(len(self.at), -1)
        self.g2_at[self.i2] = self.g2.of
        self.c2_at = np.append(self.c2, 0)[self.g2_at]  # 0 where there is no bigram
        i = np.flatnonzero(self.later[3])
        self.i3 = i = i[self.c2_at[i - 1] > 0]
        pair, bits = self.g2_at[i - 1].astype(np.uint64), self.bits
        self.g3 = g = Grams((pair << bits) | self.known[i], self.learn[self.doc[i]])
        self.ctx3, w = (g.code >> bits).astype(np.int64), (g.code & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        key = mixed(mixed(self.number[self.u2[self.ctx3]] ^ _SALTS[3]) + self.number[self.v2[self.ctx3]] * _ODD)
        hot = self.c2[self.ctx3] >= self.model.hot
        home = np.where(self.hot2[self.ctx3], key, self.key2[self.ctx3])
        part = np.where(hot, mixed(key + self.number[w] * _ODD), home) % np.uint64(self.parts)
        self.s3 = Sent(part, self.ctx3, self.parts)
        self.w3, self.key3, self.hot3 = w, key, hot

    def trigram_packets(self):
        s, g = self.s3, self.g3
        r = s.order[s.run]
        pair = self.ctx3[r]
        below = self.c2_at[self.i3[g.first]]
        arrays = (self.number[self.u2[pair]], self.number[self.v2[pair]], s.runs.astype(np.uint32), self.hot3[r].astype(np.uint8)), (self.number[self.w3[s.order]], below[s.order].astype(np.uint32), g.n[s.order].astype(np.uint32))
        for p, a, b in s.packets():
            yield p, pack(once(arrays[0][0][a]), *(x[a] for x in arrays[0][1:]), *(x[b] for x in arrays[1]))

    def scored(self):
        """doc_id, tokens, known tokens, base score and score of each text."""
        self.trigrams()
        m = self.model
        p1 = m.uni.p(self.count)[self.at]
        with np.errstate(divide="ignore", invalid="ignore"):
            p2 = m.d2[np.minimum(self.c2, K + 1)] * self.c2 / (self.count[self.u2] + self.spare2)
            who, few, low = self.unseen2
            p2[who] = left_over(m.d2, few, self.count[self.u2[who]]) / (1 - low) * m.uni.p(self.count[self.v2[who]])
            p = p1
            p[self.i2] = p2[self.g2.of]
            c3, spare3, who, few, low = self._answered(3, self.s3, self.key3, self.hot3)
            p3 = m.d3[np.minimum(c3, K + 1)] * c3 / (self.c2[self.ctx3] + spare3)
            at = self.i3[self.g3.first[who]]  # the lower order's context is the middle word: its count and spare
            middle = self.count[self.at[at - 1]] + self.spare2[self.g2_at[at]]
            p3[who] = left_over(m.d3, few, self.c2[self.ctx3[who]]) / (1 - low / middle) * p[at]
            p[self.i3] = p3[self.g3.of]
        n = len(self.lens)
        base = np.log10((self.count[:-1] + 0.1) / (m.uni.total + 0.1 * (m.types + 1)))[self.at]
        sums = [np.bincount(self.doc, x, n) for x in ((self.count[self.at] > 0).astype(float), base, np.log10(p))]
        cols = [pa.array(self.ids, mask=self.named == 0), pa.array(self.lens), pa.array(sums[0].astype(np.int64)), pa.array(sums[1]), pa.array(sums[2])]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "n_known", "base_score", "score"])


class Model:
    """What all batches need of the corpus; spread: by order, keys, few and low of the spread contexts."""

    def __init__(self, parts: int):
        self.parts, self.spread = parts, {}


def _requests(order: int, model: Model):
    """A batch, with its answers so far -> packets for the ranges."""

    def run(rows):
        for b in rows:
            for texts, answers, number in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                batch = Batch(texts, answers or [], model)
                if order == 1:
                    for p, i, count in batch.word_packets():
                        yield _row(0, p, number, pack(batch.vocab[i], count[i]))
                    continue
                batch.bigrams() if order == 2 else batch.trigrams()
                for p, payload in batch.bigram_packets() if order == 2 else batch.trigram_packets():
                    yield _row(0, p, number, payload)

    return run


def _groups(batches):
    """part, batch, payload rows in the order of part -> part and its rows."""
    key, rows = None, []
    for b in batches:
        for k, *row in zip(*(c.to_pylist() for c in b.columns)):
            if rows and k != key:
                yield key, rows
                rows = []
            key = k
            rows.append(row)
    if rows:
        yield key, rows


def _counted_words(parts: int):
    """Kinds: 1 answers, 2 statistics (tokens, types, counts of counts), 3 the model's unigrams. Frequent words get small numbers."""

    def run(batches):
        for part, rows in _groups(batches):
            asked = [unpack(r[1]) for r in rows]
            words, back = np.unique(np.concatenate([a[0] for a in asked]).astype(np.uint64), return_inverse=True)
            count = np.bincount(back, np.concatenate([a[1] for a in asked]), len(words)).astype(np.int64)
            order = np.argsort(-count, kind="stable")
            number = np.empty(len(words), np.uint64)
            number[order] = 1 + part + np.arange(len(words), dtype=np.uint64) * np.uint64(parts)
            at = 0
            for (batch, _), (w, _) in zip(rows, asked):
                i = back[at : at + len(w)]
                at += len(w)
                yield _row(1, part, batch, pack(count[i].astype(np.uint32 if count.max() < 1 << 32 else np.int64), number[i]))
            r = np.bincount(np.minimum(count, K + 2), minlength=K + 3)
            yield _row(2, part, -1, None, [int(count.sum()), int((count > 0).sum()), *map(int, r[1 : K + 2])])
            seen = order[count[order] > 0]
            yield _row(3, part, -1, pack(words[seen], count[seen].astype(np.uint64)))

    return run


def _counted(n: int, lower):
    """Kinds: 1 answers, 2 counts of counts, 3 the model's n-grams, 4 a spread context's partial sums. lower: count below -> mass below."""

    def run(batches):
        for part, rows in _groups(batches):
            asked = [unpack(r.pop()) for r in rows]
            sizes = [(len(a[n - 1]), len(a[n + 1])) for a in asked]
            heads = [np.concatenate([a[k] for a in asked]) for k in range(n - 1)]
            heads[0] = filled(heads[0])
            runs, hot, word, below, learned = (np.concatenate([a[k] for a in asked]) for k in range(n - 1, n + 4))
            runs = runs.astype(np.int64)
            del asked
            key = mixed(heads[0].astype(np.uint64) ^ _SALTS[n])
            if n == 3:
                key = mixed(key + heads[1].astype(np.uint64) * _ODD)
            g = Grams(mixed(np.repeat(key, runs) + word.astype(np.uint64) * _ODD), learned)
            del learned
            count = g.n.astype(np.int64)
            first = np.cumsum(runs) - runs
            run_of = (np.searchsorted(first, g.first, "right") - 1).astype(np.int32)
            own = Grams(key[run_of], np.zeros(len(count), np.uint8))
            some = (count > 0) & (count <= K)
            few = np.bincount(own.of[some] * np.int64(K) + count[some] - 1, minlength=K * len(own.code)).reshape(-1, K)
            low = np.bincount(own.of, np.where(count > 0, lower(below[g.first].astype(np.int64)), 0.0), len(own.code))
            spare = ~few.any(1)
            ctx_of_run = own.of[g.of[first]]
            unseen = np.maximum.reduceat((count == 0)[g.of], first)
            a = i = 0
            for (batch,), (k, m) in zip(rows, sizes):
                c = ctx_of_run[a : a + k]
                ask = np.flatnonzero(unseen[a : a + k] & (hot[a : a + k] == 0))
                yield _row(1, part, batch, pack(count[g.of[i : i + m]].astype(np.uint32), (spare[c] & (hot[a : a + k] == 0)).astype(np.uint8), ask.astype(np.uint32), few[c[ask]].astype(np.uint32).ravel(), low[c[ask]]))
                a, i = a + k, i + m
            yield _row(2, part, -1, None, [int(x) for x in np.bincount(np.minimum(count, K + 2), minlength=K + 3)[1 : K + 2]])
            spread = np.unique(ctx_of_run[hot > 0])
            if len(spread):
                yield _row(4, part, -1, pack(own.code[spread], few[spread].astype(np.uint32).ravel(), low[spread]))
            order = own.order[count[own.order] > 0]  # by context; contexts then by the numbers of their words, which packs best
            c = own.of[order]
            start = np.flatnonzero(np.concatenate([[len(c) > 0], c[1:] != c[:-1]])[: len(c)])
            head, size = run_of[order[start]], np.diff(np.append(start, len(c)))
            by = np.lexsort([h[head] for h in heads[::-1]]) if max(h.max(initial=0) for h in heads) >= 1 << 32 else np.argsort(sum(h[head].astype(np.uint64) << np.uint64(32 * (n - 2 - k)) for k, h in enumerate(heads)))
            order = order[np.repeat(start[by] - (np.cumsum(size[by]) - size[by]), size[by]) + np.arange(len(order))]
            head = head[by]
            yield _row(3, part, -1, pack(once(heads[0][head]), *(h[head] for h in heads[1:]), size[by].astype(np.uint32), word[g.first[order]], count[order].astype(np.uint32)))

    return run


def _scored(shared):
    def run(rows):
        for b in rows:
            for texts, answers in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield Batch(texts, answers or [], shared.value).scored()

    return run


def _stats(table: DataFrame, n: int) -> list[int]:
    got = table.filter("kind = 2").agg(*[F.sum(F.get("stats", F.lit(i))) for i in range(n)]).first()
    return [int(x or 0) for x in got]


def _spread(table: DataFrame):
    """Keys, few and low of the spread contexts: fewer than 2 * ranges, from one row of each range."""
    total: dict[int, list] = {}
    for r in table.filter("kind = 4").orderBy("part").select("payload").toLocalIterator():
        keys, few, low = unpack(r[0])
        for k, f, l in zip(keys.tolist(), few.reshape(-1, K), low.tolist()):
            had = total.setdefault(k, [np.zeros(K), 0.0])
            had[0], had[1] = had[0] + f, had[1] + l
    keys = sorted(total)
    return np.array(keys, np.uint64), np.array([total[k][0] for k in keys]).reshape(-1, K), np.array([total[k][1] for k in keys])


def katz_scores(docs: DataFrame, learn_from, batch_bytes: int = BATCH, range_tokens: int = RANGE) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every text; the model learns where learn_from (on doc_id) holds.

    The result's `tables` are the model: unigrams, bigrams and trigrams, as packed rows by part (kind 3 of _counted_words and _counted; the first array by once()).
    """
    spark = docs.sparkSession
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(learn_from, F.lit(False)).alias("learn"), blank().alias("text"))
    buckets = shuffle_parts(spark)
    texts = bucketed(mapped(base, _batches(batch_bytes), "batch long, tokens long, texts binary", 500), "texts", buckets, "batch")
    tokens = texts.agg(F.sum("tokens")).first()[0] or 0
    model = Model(max(buckets, -(-tokens // range_tokens)))

    def met(*answers: DataFrame) -> DataFrame:
        """Batches with all answers so far."""
        if not answers:
            return texts.select("texts", F.lit(None).cast("array<struct<order:int,part:int,payload:binary>>").alias("answers"), "batch")
        every = None
        for n, a in enumerate(answers, 1):
            a = a.filter("kind = 1").select("batch", F.struct(F.lit(n).alias("order"), "part", "payload").alias("answer"))
            every = a if every is None else every.unionByName(a)
        every = every.groupBy("batch").agg(F.collect_list("answer").alias("answers"))
        return texts.hint("merge").join(every, "batch", "left").select("texts", "answers", "batch")

    def counted(order: int, fn, *answers: DataFrame) -> DataFrame:
        asked = mapped(met(*answers), _requests(order, model), _ROW, 1).select("part", "batch", "payload")
        asked = asked.repartitionById(model.parts, F.col("part")).sortWithinPartitions("part", "batch")
        return saved(mapped(asked, fn, _ROW, 64), f"order-{order}", "uncompressed")

    a1 = counted(1, _counted_words(model.parts))
    total, model.types, *n = _stats(a1, K + 3)
    model.uni, model.hot = Unigrams(total, n), max(total / (2 * model.parts), 1)
    a2 = counted(2, _counted(2, model.uni.p), a1)
    model.d2, model.spread[2] = discounts(_stats(a2, K + 1)), _spread(a2)
    d2 = model.d2
    a3 = counted(3, _counted(3, lambda c: d2[np.minimum(c, K + 1)] * c), a1, a2)
    model.d3, model.spread[3] = discounts(_stats(a3, K + 1)), _spread(a3)
    out = mapped(met(a1, a2, a3), _scored(spark.sparkContext.broadcast(model)), "doc_id long, n_tokens long, n_known long, base_score double, score double", 1)
    out = out.select("doc_id", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")
    out.tables = {"unigrams": a1.filter("kind = 3"), "bigrams": a2.filter("kind = 3"), "trigrams": a3.filter("kind = 3")}
    return out
