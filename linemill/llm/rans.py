"""Static range asymmetric numeral system for token ids.

One table of frequencies, normalised to 2**bits, codes every block. A block holds up to BLOCK ids,
dealt to LANES interleaved coder states: id i belongs to lane i % LANES, so a step codes one id of each
lane and numpy does a step at once. States are 64-bit and give off 32-bit words. A block can be
decoded alone, or from any of its checkpoints (states, place in the words and a CRC-32 of the ids up to the next one, every CHECK steps),
which reads only the words behind it. A CRC-32 of the words and one of the ids guard the whole.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK, LANES, CHECK = 1 << 17, 1024, 64
MAGIC = b"LMRA"
_HEAD = struct.Struct("<4sHHIIIII")  # magic, version, checkpoint steps, ids, lanes, words, crc of words, crc of ids
_LOW = np.uint64(1 << 31)
_32, _MASK32 = np.uint64(32), np.uint64(0xFFFFFFFF)


def normalised(counts: np.ndarray, bits: int = 20) -> np.ndarray:
    """Counts to frequencies that sum to 2**bits; each id that occurs gets 1 at least. Largest remainders first, ties to smaller ids."""
    counts = np.asarray(counts, np.int64)
    total, room = int(counts.sum()), 1 << bits
    seen = counts > 0
    if not total:
        return np.zeros(len(counts), np.int64)
    if seen.sum() > room:
        raise ValueError("more distinct ids than slots")
    freq = np.where(seen, np.maximum(1, counts * room // total), 0)
    gap = room - int(freq.sum())
    if gap > 0:
        order = np.argsort(-(counts * room % total), kind="stable")
        order = order[seen[order]]
        freq[order] += gap // len(order)
        freq[order[: gap % len(order)]] += 1
    while gap < 0:
        order = np.argsort(-freq, kind="stable")[: max(1, min(-gap, int((freq > 1).sum())))]
        cut = np.minimum(freq[order] - 1, max(1, -gap // len(order)))
        cut = np.where(np.cumsum(cut) <= -gap, cut, np.maximum(0, -gap - (np.cumsum(cut) - cut)))
        freq[order] -= cut
        gap = room - int(freq.sum())
    return freq


class Table:
    def __init__(self, freq: np.ndarray, bits: int):
        self.bits, self.n = np.uint64(bits), len(freq)
        self.mask = np.uint64((1 << bits) - 1)
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self.limit = self.freq << np.uint64(63 - bits)  # a state from here on gives off a word first
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)


def encode(ids: np.ndarray, table: Table) -> bytes:
    """One block."""
    n = len(ids)
    lanes = max(1, min(LANES, n))
    steps = -(-n // lanes)
    x = np.full(lanes, _LOW, np.uint64)
    out, points = [], []
    f_all, s_all, l_all = table.freq[ids], table.start[ids], table.limit[ids]
    if n and not f_all.all():
        raise ValueError("an id without a frequency")
    for t in range(steps - 1, -1, -1):
        a, b = t * lanes, min(n, (t + 1) * lanes)
        f, y = f_all[a:b], x[: b - a]
        full = y >= l_all[a:b]
        words = y[full]
        out.append((words & _MASK32).astype("<u4"))
        y = np.where(full, y >> _32, y)
        q = y // f
        x[: b - a] = (q << table.bits) + (y - q * f) + s_all[a:b]
        if t % CHECK == 0:
            points.append((len(out), x.copy()))
    sizes = np.cumsum([0, *(len(w) for w in out)])
    words = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
    data = words.tobytes()
    head = _HEAD.pack(MAGIC, 2, CHECK, n, lanes, len(words), zlib.crc32(data), zlib.crc32(np.asarray(ids, "<u4").tobytes()))
    own, span = np.asarray(ids, "<u4"), CHECK * lanes
    crcs = [zlib.crc32(own[i : i + span].tobytes()) for i in range(0, n, span)]
    return head + b"".join(struct.pack("<II", len(words) - int(sizes[k]), crc) + p.astype("<u8").tobytes() for (k, p), crc in zip(points[::-1], crcs)) + data


def _run(x, words, at, t0, t1, n, lanes, table, out):
    for t in range(t0, t1):
        a, b = t * lanes, min(n, (t + 1) * lanes)
        y = x[: b - a]
        slot = y & table.mask
        got = table.slots[slot]
        out[a:b] = got
        y = table.freq[got] * (y >> table.bits) + slot - table.start[got]
        low = y < _LOW
        k = int(np.count_nonzero(low))
        if k:
            y[low] = (y[low] << _32) | words[at : at + k]
            at += k
        x[: b - a] = y
    return at


def decode(block: bytes, table: Table, part: int | None = None) -> np.ndarray:
    """All ids of a block, or those from checkpoint `part` to the next. ValueError where a checksum does not fit."""
    magic, version, check, n, lanes, n_words, crc_w, crc_i = _HEAD.unpack_from(block)
    if magic != MAGIC or version != 2:
        raise ValueError("not a block")
    steps = -(-n // lanes)
    n_points = -(-steps // check)
    size = 8 + 8 * lanes
    base = _HEAD.size + n_points * size
    data = memoryview(block)[base : base + 4 * n_words]
    if part is None and zlib.crc32(data) != crc_w:
        raise ValueError("words do not fit their checksum")
    out = np.empty(n, np.uint32)
    k = 0 if part is None else part
    if n_points:
        at, crc = struct.unpack_from("<II", block, _HEAD.size + k * size)
        words = np.frombuffer(data[4 * at :], "<u4").astype(np.uint64) if part is None else np.frombuffer(data[4 * at : 4 * (at + check * lanes)], "<u4").astype(np.uint64)
        x = np.frombuffer(block, "<u8", lanes, _HEAD.size + k * size + 8).astype(np.uint64)
        end = steps if part is None else min(steps, (part + 1) * check)
        try:
            _run(x, words, 0, k * check, end, n, lanes, table, out)
        except (IndexError, ValueError) as e:  # more words asked for than there are
            raise ValueError("words do not fit their checksum") from e
        if part is not None:
            got = out[k * check * lanes : min(n, end * lanes)]
            if zlib.crc32(got.astype("<u4").tobytes()) != crc:
                raise ValueError("ids do not fit their checksum")
            return got
    if zlib.crc32(out.astype("<u4").tobytes()) != crc_i:
        raise ValueError("ids do not fit their checksum")
    return out


def decode_range(block: bytes, table: Table, first: int, last: int) -> np.ndarray:
    """Ids first to last (behind) of a block, from the checkpoints around them only."""
    _, _, check, n, lanes, *_ = _HEAD.unpack_from(block)
    span, last = check * lanes, min(last, n)
    if first >= last:
        return np.zeros(0, np.uint32)
    parts = range(first // span, (last - 1) // span + 1)
    return np.concatenate([decode(block, table, k) for k in parts])[first - parts[0] * span : last - parts[0] * span]
