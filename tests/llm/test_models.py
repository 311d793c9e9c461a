import collections
import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from linemill.llm import katz
from linemill.llm.katz import discounts, katz_scores, pack, unpack
from linemill.llm.quality import WeakLabels, quality
from linemill.llm.tool_calls import TURN_SCHEMAS, from_turns, levels, linked
from linemill.llm.toxicity import maximal_segments, toxicity
from linemill.llm.vectors import neighbours

SF = "/root/testdata/sf0.01"


def test_pack():
    arrays = [np.arange(10, dtype=np.uint32), np.zeros(0, np.int64), np.array([1.5, -2])]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, unpack(pack(*arrays))))


def katz_model(train):
    """Probabilities of an independent, plain version: counts of n-grams, and p(history, word) by recursion."""
    counts = [collections.Counter(tuple(t[i : i + n]) for t in train for i in range(len(t) - n + 1)) for n in (1, 2, 3)]
    total = sum(counts[0].values())
    d1, d2, d3 = (discounts([sum(v == r for v in c.values()) for r in range(1, 7)]) for c in counts)
    lost = 1 - sum(d1[min(v, 6)] * v for v in counts[0].values()) / total
    p1 = lambda w: d1[min(counts[0][w,], 6)] * counts[0][w,] / total if (w,) in counts[0] else lost
    tables = {1: p1}

    def order(n, d):
        behind = collections.defaultdict(dict)
        for gram, k in counts[n - 1].items():
            behind[gram[:-1]][gram[-1]] = k
        below, mass, weight = tables[n - 1], {}, {}
        for h, found in behind.items():
            size = sum(found.values()) + all(k > 5 for k in found.values())
            mass[h] = {w: d[min(k, 6)] * k / size for w, k in found.items()}
            weight[h] = (1 - sum(mass[h].values())) / (1 - sum(below(*h[1:], w) for w in found))
        tables[n] = lambda *g: mass[g[:-1]][g[-1]] if g[-1] in mass.get(g[:-1], ()) else weight.get(g[:-1], 1) * below(*g[1:])
        return weight

    order(2, d2)
    weights = order(3, d3)
    return counts, total, lambda t: sum(math.log10(tables[min(i, 2) + 1](*t[max(0, i - 2) : i + 1])) for i in range(len(t))), tables, weights, lost


def katz_checked(docs, tokens, got, learns):
    counts, n, score, *rest = katz_model([t for (i, _), t in zip(docs, tokens) if learns(i)])
    c = counts[0]
    for (i, _), t in zip(docs, tokens):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(t), sum(c[w,] > 0 for w in t), n)
        assert r["score"] == pytest.approx(score(t), abs=1e-9)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w,] + 0.1) / (n + 0.1 * (len(c) + 1))) for w in t), abs=1e-9)
    return counts, n, score, *rest


@pytest.mark.parametrize("batch, span", [(katz.BATCH, katz.RANGE), (700, 200)])
def test_katz(spark, batch, span):
    """With many batches and ranges too, where some contexts are spread."""
    rng = random.Random(2)
    words = [f"W{int(rng.paretovariate(0.8))}" for _ in range(3000)]
    docs = [(i, " ".join(words[rng.randrange(2900) :][: rng.randint(0, 60)])) for i in range(150)] + [(None, "w1 w2")]
    docs += [(1000 + i, "often the same words here " * 7) for i in range(8)]
    tokens = [[*t.lower().split(), None] for _, t in docs]
    got = {r["doc_id"]: r for r in katz_scores(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id") % 7 != 0, batch, span).collect()}
    counts, _, _, tables, weights, lost = katz_checked(docs, tokens, got, lambda i: i is not None and i % 7)
    for h in list(weights)[:20]:
        assert sum(tables[3](*h, w) for (w,) in counts[0]) + weights[h] * tables[2](h[1], "no word") == pytest.approx(1)


def test_katz_tables(spark):
    """The stored tables hold every n-gram of the learning texts with its count."""
    docs = [(i, t) for i, t in enumerate(["a b c a b d", "a b c", "", "d", "a b c d a"])]
    out = katz_scores(spark.createDataFrame(docs, "doc_id long, text string"), F.lit(True))
    counts = katz_model([[*t.split(), None] for _, t in docs])[0]
    for n, name in enumerate(("unigrams", "bigrams", "trigrams")):
        got = sorted(int(c) for r in out.tables[name].collect() for c in unpack(r["payload"])[-1])
        assert got == sorted(counts[n].values())


def test_katz_odd(spark, odd, none):
    assert katz_scores(odd, F.col("doc_id") > 4).count() == odd.count()
    assert katz_scores(none, F.col("doc_id") > 4).count() == 0
    assert {r["score"] for r in katz_scores(odd, F.col("doc_id") < -1).collect()} == {0.0}


def test_katz_over_shuffled_rows(spark):
    """Batches are written once, so rows whose order changes from run to run do no harm."""
    docs = spark.range(500).select((F.col("id") % 97).alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit("w"), (F.col("id") * k % 13).cast("string")) for k in range(1, 9)]).alias("text"))
    got = katz_scores(docs.repartition(5, F.rand()), F.col("doc_id") % 3 != 0)
    assert got.count() == 500 and got.filter("score >= 0 or score is null").count() == 0


def brute_segments(s):
    """All maximal segments by their definition: every proper part sums to less, and no longer segment has that."""
    total = np.concatenate([[0], np.cumsum(s)])
    fine = [(a, b) for a in range(len(s)) for b in range(a + 1, len(s) + 1) if all(total[k] > total[a] for k in range(a + 1, b + 1)) and all(total[k] < total[b] for k in range(a, b))]
    return [(a, b) for a, b in fine if not any((x, y) != (a, b) and x <= a and b <= y for x, y in fine)]


@pytest.mark.parametrize("seed", range(30))
def test_segments(seed):
    s = np.random.default_rng(seed).integers(-4, 5, 14).astype(float)
    assert [(a, b) for a, b, _ in maximal_segments(s)] == brute_segments(s)


def test_toxicity_of_plain_counts(spark):
    """Passages, values and scores against plain counts of words and stems, brute-force segments, and the fitted maps."""
    rng = random.Random(9)
    words = ["calm", "river", "stone", "table", "green", "walks", "often", "paper", "light", "house"]
    docs, labels = [], []
    for i in range(500):
        text = [rng.choice(words) for _ in range(rng.randint(0, 25))]
        if i % 4 == 0:
            at = rng.randint(0, len(text))
            text[at:at] = [rng.choice(["Vile!", "nasty", "filthy"]) for _ in range(rng.randint(2, 5))]
        docs.append((i, " ".join(text)))
        labels.append((i, 1, int(i % 4 == 0)))
    d, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    learn = F.col("doc_id") % 5 != 0
    slots = {r[0]: r[1] for r in d.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(3))).collect()}
    n, tox = collections.Counter(), collections.Counter()
    keys = lambda w: (("w", w.lower().strip("!")), ("s", w.lower().strip("!")[:5]))
    for (i, t), (_, _, y) in zip(docs, labels):
        if i % 5 and slots[i] < 2:
            for w in t.split():
                n.update(keys(w))
                tox.update({k: y for k in keys(w)})
    rate = (sum(v for k, v in tox.items() if k[0] == "s") + 1) / (sum(v for k, v in n.items() if k[0] == "s") + 2)
    seen = lambda c, k: c[k] if k[0] == "s" or n[k] >= 1 else 0

    def value(w):
        word, stem = keys(w)
        theta = (tox[stem] + 10 * rate) / (n[stem] + 10)
        theta = (seen(tox, word) + 10 * theta) / (seen(n, word) + 10)
        return math.log(theta / (1 - theta)) - math.log(rate / (1 - rate)) - 1

    got = {r["doc_id"]: r for r in toxicity(d, lab, learn).collect()}
    for i, t in docs:
        s = [value(w) for w in t.split()]
        r = got[i]
        assert [(p["start"], p["end"]) for p in r["passages"]] == brute_segments(s)
        for p in r["passages"]:
            assert p["sum"] == pytest.approx(sum(s[p["start"] : p["end"]]), abs=1e-4)
    # one line: value = lambda * sum - ln(K * n); the score grows with the largest value
    same = [(r["n_tokens"], p["sum"], p["value"]) for r in got.values() for p in r["passages"]]
    (n1, s1, v1), (n2, s2, v2) = same[0], max(same, key=lambda x: abs(x[1] - same[0][1]))
    lam = (v1 + math.log(n1) - v2 - math.log(n2)) / (s1 - s2)
    assert all(v == pytest.approx(lam * s - math.log(k) + v1 + math.log(n1) - lam * s1, abs=1e-3) for k, s, v in same)
    held = [(got[i]["score"] >= 0.5) == bool(y) for i, _, y in labels if i % 5 == 0]
    assert sum(held) / len(held) > 0.95


def test_toxicity(spark, odd, none):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    got = toxicity(docs, labels, fold != 0).filter(fold == 0).join(labels, "doc_id").toPandas()
    assert ((got["score"] >= 0.5).astype(int) == got["toxic"]).mean() > 0.9
    assert toxicity(odd, labels, fold != 0).count() == odd.count()
    assert toxicity(none, labels, fold != 0).count() == 0
    assert {r["score"] for r in toxicity(odd, labels.limit(0), fold != 0).collect()} == {0.0}


def plain_em(rows, start, rounds=500, alarms=0.002):
    """Votes of documents (1 good, 0 bad, -1 none) to each document's probability of good, by loops over documents."""
    n, k = len(rows), len(rows[0])
    good = [0.05 if any(r[j] == 0 for j in range(k) if start[j]) else 0.97 for r in rows]
    for _ in range(rounds):
        prior, share = min(0.98, max(0.02, sum(good) / n)), []
        for j in range(k):
            per = []
            for weight in ([1 - g for g in good], good):
                bad, fine = (sum(w for w, r in zip(weight, rows) if r[j] == v) for v in (0, 1))
                extra = n if weight is good and start[j] else 0
                per.append(min(1 - 1e-4, max(1e-4, (bad + (0.01 if weight is good else 0.5) + alarms * extra) / (bad + fine + 1 + extra))))
            share.append(per)
        new = []
        for r in rows:
            p = [1 - prior, prior]
            for j, v in enumerate(r):
                for y in (0, 1):
                    p[y] *= share[j][y] if v == 0 else 1 - share[j][y] if v == 1 else 1
            new.append(p[1] / sum(p))
        moved, good = max(abs(a - b) for a, b in zip(new, good)), new
        if moved < 1e-6:
            break
    return good


@pytest.mark.parametrize("seed", range(4))
def test_posteriors_are_those_of_plain_em(seed):
    rng = random.Random(seed)
    truth = [rng.random() < 0.8 for _ in range(120)]
    rows = [tuple(-1 if rng.random() < 0.3 else int(t if rng.random() < a else not t) for a in (0.95, 0.8, 0.75, 0.9)) for t in truth]
    start = [True, False, True, False]
    patterns, n = np.unique(np.array(rows), axis=0, return_counts=True)
    model = WeakLabels(patterns, n, np.array(start))
    assert np.allclose(model.posterior(np.array(rows)), plain_em(rows, start), atol=1e-4)


def test_weak_labels():
    rng = np.random.default_rng(0)
    y = rng.random(20_000) < 0.8
    votes = np.stack([np.where(rng.random(len(y)) < 0.6, np.where(rng.random(len(y)) < a, y, ~y), -1) for a in (0.95, 0.8, 0.7, 0.9)], 1).astype(int)
    votes[:, 0] = np.where(~y & (rng.random(len(y)) < 0.5), 0, 1)  # a detector: finds half of the bad, no good one
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    model = WeakLabels(patterns, n, np.array([True, False, False, False]))
    assert abs(model.prior - 0.8) < 0.08
    share = (model.posterior(votes) > 0.5) == y
    assert share.mean() > 0.88


def test_quality(spark, odd, none):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = quality(docs).join(labels, "doc_id").toPandas()
    assert got[got.quality == 1].keep.mean() > 0.97 and got[got.quality == 0].keep.mean() < 0.4
    out = quality(odd)
    assert out.count() == odd.count() and dict(out.dtypes)["score"] == "double"
    assert not out.filter("text is null").first()["keep"]
    assert quality(none).count() == 0


def test_levels(spark):
    deps = {"a": [], "b": ["a"], "c": ["a", "b"], "d": ["c"], "x": ["y"], "y": ["x"], "z": ["x", "a"]}
    got = {r["call_id"]: r["level"] for r in levels(spark.createDataFrame(list(deps.items()), "call_id string, depends_on array<string>")).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3, "x": None, "y": None, "z": None}
    chain = [(f"n{i}", [f"n{i - 1}"] if i else []) for i in range(40)] + [("p", ["q"]), ("q", ["p"])]
    got = {r["call_id"]: r["level"] for r in levels(spark.createDataFrame(chain, "call_id string, depends_on array<string>")).collect()}
    assert got == {f"n{i}": i for i in range(40)} | {"p": None, "q": None}


def test_linked(spark):
    schemas = {"add": {"x": {"type": "integer", "required": True, "max": 9}, "note": {"type": "string"}}}
    calls = [("1", 1, 0, "add", '{"note": "ü\\"", "x" : 3}', []), ("2", 1, 1, "add", '{"x":"3"}', ["1"]), ("3", 1, 2, "sub", "{}", ["9"]), ("4", 1, 3, "add", "[1", None), ("5", 1, 4, "add", '{"x":10,"y":1}', ["2", "1"]), ("5", 1, 5, "add", '{"x":1}', []), (None, 1, 6, "add", "{}", []), ("6", 1, 7, "add", None, [])]
    results = [("1", 1, "r"), ("1", 0, "first"), ("2", 0, None), ("3", 0, "x"), ("4", 0, "x"), ("5", 0, "x"), ("8", 0, "nobody's")]
    out = linked(spark.createDataFrame(calls, "call_id string, conv_id long, seq long, name string, arguments string, depends_on array<string>"), spark.createDataFrame(results, "call_id string, seq long, content string"), schemas)
    got = {r["call_id"]: r for r in out.collect()}
    assert got["1"]["json"] == '{"arguments":{"note":"ü\\"","x":3},"depends_on":[],"errors":["duplicate_result"],"id":"1","level":0,"name":"add","result":"first","valid":false}'
    assert got["2"]["errors"] == ["type:x"] and got["2"]["level"] == 1
    assert got["3"]["errors"] == ["missing_dependency", "unknown_tool"]
    assert got["4"]["errors"] == ["invalid_arguments"]
    assert got["5"]["errors"] == ["duplicate_call", "range:x", "unexpected:y"] and got["5"]["level"] == 2
    assert "invalid_arguments" in got["6"]["errors"] and "missing_result" in got["6"]["errors"]
    assert all(json.loads(r["json"])["id"] == k for k, r in got.items()) and len(got) == 6
    assert linked(spark.createDataFrame(calls, out_schema := "call_id string, conv_id long, seq long, name string, arguments string, depends_on array<string>").limit(0), spark.createDataFrame(results, "call_id string, seq long, content string"), schemas).count() == 0 and out_schema


def test_neighbours(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(12, 8))[rng.integers(0, 12, 1500)] + 0.2 * rng.normal(size=(1500, 8))
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    bad = [(9000, None), (9100, [0.0] * 8), (9200, [float("nan")] * 8), (9300, [1.0, None] + [0.0] * 6), (9400, [1.0]), (None, [1.0] * 8), (5, rows[5][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = neighbours(df, F.col("vec_id") % 100 == 0, list_rows=64).toPandas()
    found = 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 11)) and np.allclose(d[g["vec_id"]], g["score"], atol=1e-12)
        found += len(set(order) & set(g["vec_id"]))
        if q == 100:
            assert list(g["vec_id"]) == list(range(101, 111))
    assert set(got["query_id"]) == set(range(0, 1500, 100)) and found / 150 >= 0.9
    assert neighbours(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0
    few = neighbours(spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>"), F.col("vec_id") == 0)
    assert [r["rank"] for r in few.orderBy("rank").collect()] == [1, 2, 3]


def test_turns_odd(spark):
    """Null ids, turns and roles, repeated turns, long texts and clashing columns."""
    long = "x" * 200_000
    rows = [(1, 0, "user", "hi", "a"), (1, 1, "assistant", long, "a"), (1, 2, "user", long, "b"), (1, 2, "user", long, "b"), (1, 3, "assistant", None, "c"), (None, 0, "user", "x", "d"), (2, None, "user", "x", "d"), (2, 0, None, "x", "d"), (3, 0, "user", None, None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, result string").withColumn("call_id", F.lit(5)).withColumn("level", F.lit("z"))
    got = {r["call_id"]: r for r in linked(*from_turns(turns), TURN_SCHEMAS).collect()}
    assert set(got) == {"1:0", "1:2", "3:0"}
    assert json.loads(got["1:0"]["json"])["result"] == long and got["1:0"]["level"] == 0
    assert got["1:2"]["errors"] == ["duplicate_call", "range:chars"] and json.loads(got["1:2"]["json"])["result"] == "" and got["1:2"]["level"] == 1
    assert got["3:0"]["errors"] == ["missing_result", "range:text"]
    assert linked(*from_turns(turns.limit(0)), TURN_SCHEMAS).count() == 0
