import random

import pytest
from oracle import check
from pyspark.sql import functions as F

from linemill.llm import queries
from linemill.llm.common import HASHES
from linemill.llm.decontamination import MASKS, Index, benchmark_overlaps, decontaminated, longest_alike
from linemill.llm.graph import components
from linemill.llm.line_dedup import line_deduplicated
from linemill.llm.near import bands_for, near_duplicates, one_of_each

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    check(spark, SF, queries.QUERIES[name], queries.ORACLE_SQL[name])


def removed(docs, words):
    """By brute force: a line goes if a run with enough words holds it and occurs earlier."""
    lines = [(d, i, x) for d, (_, t) in enumerate(docs) for i, x in enumerate(t.split("\n")) if x.split()]
    runs, gone = {}, set()
    for d in range(len(docs)):
        own = [x for x in lines if x[0] == d]
        for a in range(len(own)):
            for b in range(a + 1, len(own) + 1):
                run = tuple(x[2] for x in own[a:b])
                if sum(len(x.split()) for x in run) >= words:
                    if run in runs:
                        gone.update((x[0], x[1]) for x in own[a:b])
                    runs.setdefault(run, (d, a))
    return ["\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, (_, t) in enumerate(docs)]


@pytest.mark.parametrize("seed", range(3))
def test_line_runs(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b b", "c c c", "", "d d d d", "e e"]
    docs = [(i, "\n".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 9)))) for i in range(25)]
    got = {r["doc_id"]: r["text"] for r in line_deduplicated(spark.createDataFrame(docs, "doc_id long, text string"), 5).collect()}
    assert [got[i] for i, _ in docs] == removed(docs, 5)


def test_line_runs_odd(spark, odd, none):
    out = line_deduplicated(odd, 3)
    assert out.count() == odd.count() and set(odd.columns) < set(out.columns)
    assert out.filter("text is null").count() == 1
    assert line_deduplicated(none).count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    root = list(range(200))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_components_of_large_hashes(spark):
    """So many edges that the sum of their hashes is beyond 64 bits."""
    n = 400_000
    edges = spark.range(n).select((F.col("id") * 2).alias("a"), (F.col("id") * 2 + 1).alias("b"))
    assert edges.agg(F.sum(F.abs(F.xxhash64("a", "b")).cast("decimal(38,0)"))).first()[0] > 2**63
    got = components(edges)
    assert got.agg(F.count(F.lit(1)), F.count_distinct("root")).first()[:] == (2 * n, n)


def test_classes_without_ids(spark):
    """Null and repeated doc_ids do not join classes."""
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(30))
    rows = [(None, text(k) + e) for k in range(4) for e in ("", " more")] + [(7, text(k)) for k in (8, 8, 9, 9)]
    left = one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(left) == 6


def test_line_runs_of_repeated_rows(spark):
    run = "\n".join(f"a{i} b c" for i in range(5))
    rows = [(None, run), (None, run), (1, "x\n" + run), (1, "x\n" + run), (1, run + "\ny"), (2, None), (2, "")]
    out = line_deduplicated(spark.createDataFrame(rows, "doc_id long, text string"), 12).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in out) == sorted([(False, 0, run)] * 2 + [(True, 1, "x")] * 2 + [(True, 1, "y")] + [(True, 2, "")] * 2)


def jaccard_classes(docs, threshold=0.8):
    sets = []
    for _, t in docs:
        w = (t or "").lower().split()
        n = min(5, len(w))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set())
    root, links = list(range(len(docs))), [0] * len(docs)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {docs[i][0]: (docs[find(i)][0], links[i]) for i in range(len(docs))}


@pytest.mark.parametrize("nodes", [1500, 4])
def test_near_duplicates(spark, nodes):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randint(3, 120))] for _ in range(12)]
    docs = []
    for i in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 6])):
            w[rng.randrange(len(w))] = f"n{rng.randrange(9)}"
        docs.append((i, " ".join(w)))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), block_nodes=nodes).collect()}
    assert got == jaccard_classes(docs)
    left = sorted(r["doc_id"] for r in one_of_each(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert left == sorted({c for c, _ in got.values()})


def test_near_odd(spark, odd, none):
    out = near_duplicates(odd)
    assert out.count() == odd.count()
    assert near_duplicates(none).count() == 0
    kept = one_of_each(odd)
    assert kept.columns == odd.columns
    texts = [r["text"] for r in kept.collect()]
    assert texts.count("same text here for all of us") == 1 and texts.count("two words") == 1 and None in texts
    assert one_of_each(none).count() == 0


def test_bands():
    b = bands_for(0.8, 0.9999, 6)
    assert 1 - (1 - 0.8**6) ** b >= 0.9999 > 1 - (1 - 0.8**6) ** (b - 1)


def test_overlaps(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10_000)}"
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 15, 20, 40, 60])]
    docs, want = [], set()
    for i in range(60):
        w = [word() for _ in range(rng.randint(0, 80))]
        if i % 3 == 0:
            k, text = rng.choice(items)
            copy = text.split()
            if i % 2 and len(copy) > 10:
                for j in range(4, len(copy), 6):
                    copy[j] = word()
            at = rng.randint(0, len(w))
            w[at:at] = [x.upper() for x in copy]
            want.add((i, k))
        docs.append((i, " ".join(w)))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for words in (300_000, 50):
        assert {(r["doc_id"], r["item_id"]) for r in benchmark_overlaps(d, b, block_words=words).collect()} == want
        assert {r["doc_id"] for r in decontaminated(d, b, block_words=words).collect()} == {i for i, _ in docs} - {i for i, _ in want}


@pytest.mark.parametrize("seed", range(40))
def test_segment(seed):
    import numpy as np

    equal = np.random.default_rng(seed).random(25) < 0.75
    start, n, same = longest_alike(equal, 0.8)
    fine = [(b - a) for a in range(25) for b in range(a + 1, 26) if 5 * equal[a:b].sum() >= 4 * (b - a) and equal[a] and equal[b - 1]]
    assert same == equal[start : start + n].sum() and (5 * same >= 4 * n or not n)
    assert n >= max(fine, default=0) - 25 // 5 and (n > 0) == bool(fine)


def plain_overlaps(doc, items, min_words):
    """Every item on every diagonal that some mask hits: the longest part, first of equals, with 80 % equal words, trimmed to equal ends."""
    out = set()
    for k, item in enumerate(items):
        for shift in range(-len(item) + 1, len(doc)):
            same = {j: doc[j + shift] == item[j] for j in range(len(item)) if 0 <= j + shift < len(doc)}
            masks = MASKS if len(item) >= min(map(len, MASKS)) else ("1" * len(item),)
            if not any(all(same.get(j + i) for i, b in enumerate(m) if b == "1") and j in same and j + len(m) - 1 in same for m in masks for j in range(len(item) - len(m) + 1)):
                continue
            ends = sorted(same)
            a0, b0 = ends[0], ends[-1] + 1
            size, start = max((b - a, -a) for a in range(a0, b0) for b in range(a + 1, b0 + 1) if 5 * sum(same[j] for j in range(a, b)) >= 4 * (b - a))
            hit = [j for j in range(-start, -start + size) if same[j]]
            if len(hit) >= min(min_words, len(item)):
                out.add((k, hit[0] + shift, hit[0], hit[-1] - hit[0] + 1, len(hit)))
    return sorted(out)


@pytest.mark.parametrize("seed", range(12))
def test_overlaps_on_all_diagonals(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abc").encode()  # noqa: E731  few words: many chance hits
    items = [[word() for _ in range(rng.choice([2, 6, 9, 14, 22]))] for _ in range(4)]
    doc = [word() for _ in range(15)] + [w if rng.random() < 0.85 else word() for w in rng.choice(items)] + [word() for _ in range(10)]
    index = Index([(i, b" ".join(x)) for i, x in enumerate(items)])
    assert index.hits(HASHES.of(doc), 8, 0.8) == plain_overlaps(doc, items, 8)


def test_overlaps_odd(spark, odd, none):
    items = spark.createDataFrame([(None, "same text here for all"), (1, None), (2, ""), (2, "a b c")], "item_id long, text string")
    assert benchmark_overlaps(odd, items).count() == 3
    assert decontaminated(odd, items).columns == odd.columns
    assert benchmark_overlaps(none, items).count() == 0
    assert decontaminated(odd, items.limit(0)).count() == odd.count()
