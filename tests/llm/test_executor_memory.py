"""What executors hold and start for the stages of the pipeline: each of these failed on the version before."""

import numpy as np
import pyarrow as pa
import pytest

from linemill import storage
from linemill.llm import bpe, common, graph, line_dedup, near, packing, quality
from linemill.llm.queries import vocabulary


def test_a_worker_holds_the_cache_of_one_stage():
    texts = pa.array(["some words of a text", "and some of another one"])
    two = lambda: [pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([3, 4]), texts], ["doc_id", "text_key", "text"])]
    full = lambda: [len(c) > 0 for c in (quality._FEATURES, common.HASHES, bpe._ENCODERS)]
    list(quality._sampled([pa.RecordBatch.from_arrays([texts, pa.array([0.0, 1.0])], ["text", "label"])]))
    assert full() == [True, False, False]
    list(near._signed(5, 2, 2)(two()))
    assert full() == [False, True, False]
    list(packing._tokenised(vocabulary(), 0, 1 << 16)([b.select(["doc_id", "text"]) for b in two()]))
    assert full() == [False, False, True]
    list(near._sets(5)([pa.RecordBatch.from_arrays([texts], ["text"])]))
    assert full() == [False, True, False]
    list(near._tiles(0.8)([]))
    assert full() == [False, False, False]


@pytest.fixture
def many_parts(spark):
    """As many shuffle partitions as a large table has, and none of them joined."""
    own = {"spark.sql.shuffle.partitions": "72", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.fixture
def files(monkeypatch):
    """name: files of each table of that name that components() and later_lines() write."""
    out: dict[str, list[int]] = {}

    def saved(df, name, *a, **k):
        table = storage.saved(df, name, *a, **k)
        out.setdefault(name, []).append(len(table.inputFiles()))
        return table

    for module in (graph, line_dedup):
        monkeypatch.setattr(module, "saved", saved)
    return out


def test_small_tables_of_components_are_few_files(many_parts, files):
    rng = np.random.default_rng(3)
    ends = [(int(g * 100 + i), int(g * 100 + rng.integers(0, i))) for g in range(20) for i in range(1, 60)]
    got = graph.components(many_parts.createDataFrame(ends, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(g * 100 + i, g * 100) for g in range(20) for i in range(60)]
    assert len(files["edges"]) > 3 and max(files["edges"][1:] + files["least"]) == 1


def test_small_tables_of_line_runs_are_few_files(many_parts, files):
    rng = np.random.default_rng(4)
    lines = [" ".join(f"w{x}" for x in rng.integers(0, 1000, 9)) for _ in range(400)]
    texts = [(i, "\n".join(lines[a : a + 40])) for i, a in enumerate(rng.integers(0, 360, 60).tolist())]
    later = line_dedup.later_lines(many_parts.createDataFrame(texts, "doc_id long, text string"))
    got = {r["doc1"]: sorted(r["places"]) for r in later.collect()}
    runs, plain = {}, {i: set() for i, _ in texts}
    for i, text in texts:  # 50 words are six lines of nine
        own = text.split("\n")
        for a in range(len(own) - 5):
            if runs.setdefault(tuple(own[a : a + 6]), (i, a)) != (i, a):
                plain[i].update(range(a, a + 6))
    assert got == {i: sorted(p) for i, p in plain.items() if p}
    assert len(files["rank"]) > 1 and max(n for name in ("often", "rank", "pairs", "order", "found", "first", "gone") for n in files[name]) == 1
