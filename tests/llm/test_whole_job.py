"""What was cut once: each of these failed on the version before."""

import random
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from linemill.llm.near import similar
from linemill.llm import packing
from linemill.llm.bpe import Encoder
from linemill.llm.packing import Shard, pack_shard
from linemill.llm.quality import DIMS, fit_scorer, quality
from linemill.llm.queries import op2_katz_backoff, vocabulary
from linemill.llm.vectors import neighbours
from test_models import katz_checked

SF = "/root/testdata/sf0.01"


def nearest(x, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    return [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:k]


def test_neighbours_with_more_lists_than_the_beam(spark):
    x = np.random.default_rng(1).normal(size=(4000, 64))
    x /= np.sqrt((x * x).sum(1))[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = neighbours(df, F.col("vec_id") % 100 == 0, list_rows=20).toPandas()
    found = sum(len(set(g["vec_id"]) & set(nearest(x, q))) for q, g in got.groupby("query_id"))
    assert found / 400 >= 0.95


def test_neighbour_by_all_terms_of_the_seed():
    idf = np.append(np.full(64, 1.01), np.ones(36))
    docs = [np.arange(100), *(np.array([i]) for i in range(64)), np.arange(64, 100)]
    first = pack_shard([d.astype(np.uint16) for d in docs], idf, 10.0, 136)[0]
    assert [d for d, _, _ in first] == [0, 65]


def test_katz_keeps_ngrams_seen_once(spark, tmp_path):
    rng = random.Random(5)
    docs = [(i, " ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(1, 60)))) for i in range(200)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    learns = lambda i: zlib.crc32(str(i).encode()) % 10 != 0
    got = {r["doc_id"]: r for r in op2_katz_backoff(spark, str(tmp_path)).collect()}
    assert sum(r["held_out"] for r in got.values()) == sum(not learns(i) for i, _ in docs)
    katz_checked(docs, [[*t.split(), None] for _, t in docs], got, learns)


def test_quality_with_large_copy_groups(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")
    rows, sample = 3000, 400
    slot = F.pmod(F.xxhash64("text"), F.lit(1 << 20))
    first = docs.filter(slot <= int(1.4 * sample / rows * (1 << 20))).orderBy(F.xxhash64("text")).first()["text"]
    copies = spark.range(rows - docs.count()).select((F.col("id") + 10_000_000).alias("doc_id"), F.lit(first).alias("text"))
    got = quality(docs.unionByName(copies), sample_rows=sample).join(labels, "doc_id").toPandas()
    assert got[got.quality == 1].keep.mean() > 0.95 and got[got.quality == 0].keep.mean() < 0.6


def test_scorer_is_fitted_in_bounded_memory():
    """The fit of 2,000,000 features takes a few times their own 16 MB, and has the weights of the plain form."""
    rng = np.random.default_rng(2)
    ids = [np.sort(rng.choice(5000, 1000, replace=False)).astype(np.int32) for _ in range(2000)]
    x, y = [rng.random(1000, np.float32) for _ in ids], rng.random(2000)
    tracemalloc.start()
    got = fit_scorer(ids, x, y, rounds=5)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 50e6
    a = np.zeros((2000, 5001))
    for row, i, z in zip(a, ids, x):
        row[i], row[-1] = z, 1
    w, s = np.zeros(5001), np.full(5001, 1e-8)
    for _ in range(5):
        g = a.T @ (1 / (1 + np.exp(-a @ w)) - y) / 2000 + 1e-6 * np.append(w[:-1], 0)
        s += g * g
        w -= 0.5 * g / np.sqrt(s)
    assert np.abs(got[[*range(5000), DIMS]] - w).max() < 1e-9 and not got[5000:DIMS].any()


@pytest.mark.parametrize("kind", ["<u2", "<u4"])
def test_distinct_ids_with_counts(kind):
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 50, 5000):
        for top in (1, 7, 50_000):
            x = rng.integers(0, top, n).astype(kind)
            for got, want in zip(packing.distinct(x), np.unique(x, return_counts=True)):
                assert got.tolist() == want.tolist()


def test_neighbours_of_small_groups_far_away(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 8))
    x[:4] = 1000 + 0.01 * x[:4]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1, (v + 0.001).tolist()) for v in x[:4]] + [(1, (v + 0.01 * j).tolist()) for v in x[:1] for j in range(1, 15)]
    got = neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") < 4, list_rows=16)
    assert {r["query_id"]: r["count"] for r in got.groupBy("query_id").count().collect()} == dict.fromkeys(range(4), 10)


def test_one_vector_far_from_all(spark):
    x = np.random.default_rng(4).normal(size=(3000, 16))
    x[0] = 1000
    df = spark.createDataFrame([(i, v.tolist(), "x", 1.0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, lists string, score double")
    got = neighbours(df, F.col("vec_id") % 100 == 0, list_rows=32)
    assert {r["query_id"]: r["count"] for r in got.groupBy("query_id").count().collect()} == dict.fromkeys(range(0, 3000, 100), 10)
    for r in got.filter("query_id = 0").collect():
        assert r["score"] == pytest.approx(np.sqrt(((x[0] - x[r["vec_id"]]) ** 2).sum()), rel=1e-12)


@pytest.mark.parametrize("own", [True, False])
@pytest.mark.parametrize("common", [30, 150])
def test_a_tile_of_many_near_copies_is_compared_in_bounded_memory(own, common):
    rng, n = np.random.default_rng(6), 800
    base = rng.integers(0, 1 << 62, common).astype(np.uint64)
    pairs_only = rng.integers(0, 1 << 62, 5000).astype(np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, common - int(rng.integers(0, 6)), False), rng.choice(pairs_only, 4)])) for _ in range(2 * n)]
    left, right = (sets[:n], None) if own else (sets[:n], sets[n:])
    tracemalloc.start()
    i, j = similar(left, right, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6
    rows = [set(x.tolist()) for x in sets]
    other = rows[:n] if own else rows[n:]
    some = range(0, n, 40)
    want = {(a, b) for a in some for b in range(a + 1 if own else 0, n) if len(rows[a] & other[b]) / len(rows[a] | other[b]) >= 0.8}
    assert {(a, b) for a, b in zip(i.tolist(), j.tolist()) if a in some} == want and want


def test_a_word_goes_through_the_library_once(monkeypatch):
    """Whatever signs follow it; texts of lines need no call for a whole text."""
    enc, seen = Encoder(vocabulary()), []
    letters, whole = enc._letters, enc.whole
    monkeypatch.setattr(enc, "_letters", lambda word, lead: seen.append((word, lead)) or letters(word, lead))
    text = "Foo bar. bar, bar\nFoo. bar; bar!\nbar?"
    got = enc.encode(text)
    assert sorted(seen) == [("Foo", ""), ("bar", ""), ("bar", "Ġ")]
    monkeypatch.setattr(enc, "whole", lambda _: pytest.fail("not known"))
    assert enc.encode(text) == got == whole(text)


@pytest.mark.parametrize("common,rows", [(1, 0), (4, 1 << 20), (10**9, 1 << 20), (10**9, 90)])
def test_scores_by_rows_of_weights_and_by_postings(monkeypatch, common, rows):
    monkeypatch.setattr(packing, "COMMON", common)
    monkeypatch.setattr(packing, "ROWS", rows)
    rng = np.random.default_rng(8)
    docs = [np.minimum(rng.zipf(1.5, int(rng.integers(1, 60))), 99).astype(np.uint16) for _ in range(30)]
    docs += docs[:5]
    idf, mean = rng.random(100) + 0.1, 30.0
    shard = Shard(docs, idf, mean)
    unused = np.ones(len(docs), bool)
    for gone in (range(0), range(3, 20)):
        unused[list(gone)] = False
        shard.keep(unused)
        for d in (0, 25):
            tf = [{t: int((x == t).sum()) for t in set(docs[d].tolist())} for x in docs]
            want = [sum(idf[t] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(x) / mean)) for t, n in f.items()) if u else 0 for x, f, u in zip(docs, tf, unused)]
            got = shard.scores(d)
            assert got == pytest.approx(want, rel=1e-12)
            assert all(got[i] == got[30 + i] for i in range(5) if unused[i])
