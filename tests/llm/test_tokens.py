import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from linemill.llm import rans
from linemill.llm.bpe import Encoder
from linemill.llm.common import table_path
from linemill.llm.packing import pack_shard, packed
from linemill.llm.token_files import read_ids, read_tokens, write_tokens

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    return Tokenizer.from_file(VOCABULARY)


@pytest.fixture(scope="module")
def cached():
    return Encoder(VOCABULARY, limit=50)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["the", "Ünï", "don't", " ", "  ", "\n", "\t", ",", "###", "<|endoftext|>", "12a", "日本", "'S", " ", "\x1c", "a_b", "ab.cd\nef"]) | st.text(max_size=4), max_size=12), st.booleans())
def test_cache_gives_the_library_ids(plain, cached, parts, spaced):
    text = (" " if spaced else "").join(parts)
    assert np.frombuffer(cached.encode(text), cached.dtype).tolist() == plain.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [0, 1, 2, 1023, 1024, 1025, 66_000, 200_000])
def test_rans_round_trip(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.zipf(1.3, n), 5000).astype(np.uint32)
    freq = rans.normalised(np.bincount(ids, minlength=5001), 16)
    assert freq.sum() == (1 << 16 if n else 0)
    table = rans.Table(freq, 16)
    for a in range(0, n, rans.BLOCK):
        part = ids[a : a + rans.BLOCK]
        block = rans.encode(part, table)
        assert (rans.decode(block, table) == part).all()
        steps = -(-len(part) // min(rans.LANES, len(part)))
        pieces = [rans.decode(block, table, k) for k in range(-(-steps // rans.CHECK))]
        assert (np.concatenate(pieces) == part).all()


def test_rans_ranges_and_their_guards():
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.zipf(1.3, rans.BLOCK), 5000).astype(np.uint32)
    table = rans.Table(rans.normalised(np.bincount(ids, minlength=5001), 16), 16)
    block = rans.encode(ids, table)
    for a, b in ((0, 1), (70_000, 70_010), (65_000, 131_072), (5, 5), (131_000, 200_000)):
        assert (rans.decode_range(block, table, a, b) == ids[a:b]).all()
    broken = bytearray(block)
    broken[-3] ^= 1  # the last part's words only
    assert (rans.decode(bytes(broken), table, 0) == ids[: rans.CHECK * rans.LANES]).all()
    with pytest.raises(ValueError):
        rans.decode(bytes(broken), table, 1)


def test_ids_of_a_range(spark, odd):
    out = write_tokens(odd, table_path(spark, "t"), VOCABULARY, segment=100)
    every = np.concatenate([list(r["ids"]) for r in read_tokens(spark, out).orderBy("start").collect()])
    for a, b in ((0, 3), (40, 900), (len(every) - 2, len(every) + 9), (7, 7)):
        got = sorted((r["start"], r["ids"]) for r in read_ids(spark, out, a, b).collect())
        assert sum((x for _, x in got), []) == every[a:b].tolist() and (not got or got[0][0] == a)


def test_rans_guards():
    ids = np.arange(5000, dtype=np.uint32) % 7
    table = rans.Table(rans.normalised(np.bincount(ids), 12), 12)
    block = bytearray(rans.encode(ids, table))
    block[-3] ^= 1
    with pytest.raises(ValueError):
        rans.decode(bytes(block), table)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=300))
def test_frequencies_sum(counts):
    freq = rans.normalised(np.array(counts), 10)
    assert freq.sum() == (1024 if any(counts) else 0)
    assert all((f > 0) == (c > 0) for f, c in zip(freq, counts))


def test_files(spark, odd, plain):
    out = write_tokens(odd, table_path(spark, "t"), VOCABULARY, segment=100)
    got = read_tokens(spark, out).toPandas()
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    at = 0
    got = got.sort_values("start").reset_index(drop=True)
    for (doc, text), r in zip(rows, got.itertuples()):
        ids = plain.encode(text, add_special_tokens=False).ids + [0]
        assert (r.start, r.n_tokens, list(r.ids)) == (at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        assert (doc is None) == (r.doc_id != r.doc_id) and (doc is None or doc == r.doc_id)
        at += len(ids)
    assert len(got) == len(rows)


def test_no_files(spark, none):
    assert read_tokens(spark, write_tokens(none, table_path(spark, "t"), VOCABULARY)).count() == 0
    assert packed(none, VOCABULARY).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 90), min_size=1, max_size=30), st.sampled_from([8, 32, 64]))
def test_packing_is_whole(lens, window):
    rng = np.random.default_rng(sum(lens))
    docs = [rng.integers(0, 20, n).astype(np.uint16) for n in lens]
    seqs = pack_shard(docs, np.ones(20), 10.0, window, 8)
    seen = {d: np.zeros(n, int) for d, n in enumerate(lens)}
    for seq in seqs:
        total = sum(n for _, _, n in seq)
        assert total == window or (total < window and total & (total - 1) == 0)
        for d, a, n in seq:
            seen[d][a : a + n] += 1
    assert all((x == 1).all() for x in seen.values())


def test_neighbour_is_chosen():
    rng = np.random.default_rng(0)
    docs = [np.full(10, i % 3, np.uint16) for i in range(9)] + [rng.integers(3, 20, 10).astype(np.uint16)]
    first = pack_shard(docs, np.ones(20), 10.0, 30, 8)[0]
    assert {d % 3 for d, _, _ in first} == {0}


def test_packed_rows(spark, odd, plain):
    got = packed(odd, VOCABULARY, window=64, shard_tokens=500).toPandas()
    assert got["length"].sum() == sum(len(plain.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in odd.collect())
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert (seq["offset"].to_numpy() == np.concatenate([[0], seq["length"].cumsum()[:-1]])).all()
        assert all(len(i) == 4 * n for i, n in zip(seq["ids"], seq["length"]))


def plain_packing(docs, idf, mean, window):
    """The packing rule by plain loops: a window's seed, then the unused document of the largest BM25 score for it."""
    from collections import Counter

    tf = [Counter(d.tolist()) for d in docs]

    def score(seed, d):
        return sum(w(d, t) for t in tf[seed] if t in tf[d])

    def w(d, t):
        return idf[t] * tf[d][t] * 2.2 / (tf[d][t] + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean))

    unused, order, room, seed = list(range(len(docs))), [], window, None
    while unused:
        d = unused[0]
        if seed is not None:
            best = max(score(seed, x) for x in unused)
            if best > 0:
                d = next(x for x in unused if score(seed, x) > best - 1e-9)
        unused.remove(d)
        order.append(d)
        n = len(docs[d])
        seed = d if seed is None else seed
        if n >= room:
            rest = (n - room) % window
            room, seed = (window - rest, d) if rest else (window, None)
        else:
            room -= n
    return order


@pytest.mark.parametrize("seed", range(12))
def test_choices_are_the_best_scores(seed):
    rng = np.random.default_rng(seed)
    docs = [rng.integers(0, 30, rng.integers(1, 25)).astype(np.uint16) for _ in range(25)]
    idf, mean = rng.random(30) + 0.1, 12.0
    got = list(dict.fromkeys(d for s in pack_shard(docs, idf, mean, 32) for d, _, _ in s))
    want = plain_packing(docs, idf, mean, 32)
    whole = sum(len(d) for d in docs) // 32 * 32  # what comes behind is dealt to windows of powers of two
    at = 0
    for a, b in zip(got, want):
        if at >= whole:
            break
        assert a == b
        at += len(docs[a])


def test_packed_digest(spark, odd, plain):
    """Every column of every piece, from the texts by the plain library."""
    from linemill.llm.queries import packed_digest

    docs = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    ids = {r["doc_id"]: np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4") for r in docs.collect()}
    got = packed_digest(packed(docs, VOCABULARY, window=64, shard_tokens=500)).toPandas()
    assert set(got["doc_id"]) == set(ids)
    for doc, pieces in got.groupby("doc_id"):
        at = 0
        for r in pieces.sort_values("start").itertuples():
            assert (r.start, r.doc_tokens) == (at, len(ids[doc])) and r.ids_crc32 == zlib.crc32(ids[doc][at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids[doc])


def test_alike_documents_meet_wherever_they_lie(spark):
    """Pairs of alike documents, far apart in the table, of a corpus of many shards: most share a window."""
    rng = np.random.default_rng(0)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for k in range(300):
        text = rng.choice(words, 60).tolist()
        rows += [(k, " ".join(text)), (1000 + k, " ".join([*text[:57], "other", "words", "here"]))]
    docs = spark.createDataFrame(sorted(rows), "doc_id long, text string").repartition(4, "doc_id")
    got = packed(docs, VOCABULARY, window=512, shard_tokens=4000).toPandas()
    where = got.groupby("doc_id")["sequence_id"].agg(set)
    assert sum(bool(where[k] & where[1000 + k]) for k in range(300)) > 200
