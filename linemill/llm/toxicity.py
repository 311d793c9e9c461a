"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme values.

A token's log-odds compare how often it occurs in toxic and in other documents of the learning rows, with Dirichlet
priors in two steps: a word is drawn towards its stem (its first letters), a stem towards the overall rate, each by
`strength` prior counts, so that a rare word says little by itself. Words and stems are hashed to
tables of fixed size. Log-odds less a drift are token scores with a negative mean; all maximal-scoring segments of a text
are found in one pass (Ruzzo and Tompa). Their sums are normalised as extreme values are (lambda * sum - ln(K * tokens)); the
segments with a positive value are the significant passages, and a logistic map of the largest and the total gives the score.

Learning rows divide by a hash of doc_id: two in three count tokens, the third fits lambda, K and the map, so these
see texts whose tokens were not counted.

Rows: a null or empty text has no tokens and gets the score of a text without a passage; a null doc_id is scored, not
learned from; repeated rows count as often as they occur; a text of any length is scanned whole; of segments that tie, the definition of maximal ones
leaves no choice; of several labels for a doc_id the largest holds; empty
tables, or no learning row with both labels, give every text the score 0; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blank, mapped, saved

WORDS, STEMS = 1 << 21, 1 << 19


class _Buckets(dict):
    """token -> places of its word and stem in one table (words first), as bytes."""

    def __missing__(self, token: bytes) -> bytes:
        if len(self) >= 400_000:
            self.clear()
        word = token.decode("utf-8", "replace").lower()
        a, b = 0, len(word)
        while a < b and not word[a].isalnum():
            a += 1
        while a < b and not word[b - 1].isalnum():
            b -= 1
        word = word[a:b] or word
        ids = (xxhash.xxh32_intdigest(word) % WORDS, WORDS + xxhash.xxh32_intdigest(word[:5], 5) % STEMS)
        got = self[token] = np.array(ids, "<u4").tobytes()
        return got


_BUCKETS = _Buckets()


def buckets(text: bytes) -> np.ndarray:
    """tokens x 2: word and stem."""
    return np.frombuffer(b"".join(map(_BUCKETS.__getitem__, text.split())), "<u4").reshape(-1, 2)


def _counted(batches):
    n, tox = np.zeros(WORDS + STEMS, np.int64), np.zeros(WORDS + STEMS, np.int64)
    for b in batches:
        for text, label in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist()):
            at = buckets(text).ravel()
            np.add.at(n, at, 1)
            if label:
                np.add.at(tox, at, 1)
    seen = np.flatnonzero(n)
    for i in range(0, len(seen), 200_000):
        s = seen[i : i + 200_000]
        yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(n[s]), pa.array(tox[s])], ["bucket", "n", "tox"])


def token_scores(at: np.ndarray, table: tuple, strength: float) -> np.ndarray:
    """Log-odds of tokens (words and stems as places) over the overall rate: words drawn to stems, stems to the rate."""
    n, tox, rate = table
    theta = (tox[at[:, 1]] + strength * rate) / (n[at[:, 1]] + strength)
    theta = (tox[at[:, 0]] + strength * theta) / (n[at[:, 0]] + strength)
    return np.log(theta / (1 - theta)) - np.log(rate / (1 - rate))


def maximal_segments(score: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, sum), in order; linear in the tokens."""
    total = np.concatenate([[0.0], np.cumsum(score)])
    out: list[list] = []  # start, end, sum before, sum behind
    for i in np.flatnonzero(score > 0).tolist():
        new = [i, i + 1, total[i], total[i + 1]]
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= new[2]:
                j = out[j][4]
            if j < 0 or out[j][3] >= new[3]:
                out.append([*new, j])
                break
            new[0], new[2] = out[j][0], out[j][2]
            del out[j:]
    return [(a, b, r - l) for a, b, l, r, _ in out]


def _passages(shared, strength: float, drift: float):
    def run(batches):
        table = shared.value
        for b in batches:
            n, found = [], []
            for text in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist():
                at = buckets(text)
                n.append(len(at))
                found.append([{"start": x, "end": y, "sum": z} for x, y, z in maximal_segments(token_scores(at, table, strength) - drift)] if len(at) else [])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("sum", pa.float64())]))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64()), pa.array(found, kind)], [*b.schema.names[:-1], "n_tokens", "passages"])

    return run


def extreme_value_fit(largest: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """lambda and ln K of the largest segment sums of clean texts of n tokens, by moments."""
    if len(n) < 10:
        return 1.0, 0.0
    lam, ln = 1.0, np.log(np.maximum(n, 1))
    for _ in range(50):
        new = np.clip(np.pi / (np.sqrt(6) * max(np.std(largest - ln / lam), 1e-3)), 0.05, 5)
        lam = 0.5 * (lam + new)
    return float(lam), float(np.mean(lam * largest - ln) - np.euler_gamma)


def fit_logistic(x: np.ndarray, y: np.ndarray, shrink: float = 1.0) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + shrink * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (p - y) + shrink * w)
        w -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxicity(docs: DataFrame, labels: DataFrame, learn_from, strength: float = 10.0, drift: float = 1.0, fit_rows: int = 20_000) -> DataFrame:
    """doc_id, n_tokens, passages (start, end in tokens, sum, and value: lambda * sum - ln(K * n_tokens)), score.

    learn_from: condition on doc_id; labels of other rows are not read. Counts cover all learning rows of two of three
    slices; fit_rows bounds the rows of the third slice that fit lambda, K and the logistic map.
    """
    spark = docs.sparkSession
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic is not null").filter(learn_from).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    slice_ = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), blank().alias("text"))
    counting = base.filter(learn_from).filter(slice_ < 2).join(marks.filter(slice_ < 2).hint("merge"), "doc_id").select("text", "toxic")
    counts = mapped(counting, _counted, "bucket int, n long, tox long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("tox").alias("tox")).toPandas()
    n, tox = np.zeros(WORDS + STEMS, np.float32), np.zeros(WORDS + STEMS, np.float32)
    n[counts["bucket"]], tox[counts["bucket"]] = counts["n"], counts["tox"]
    rate = float((tox[WORDS:].sum(dtype=np.float64) + 1) / (n[WORDS:].sum(dtype=np.float64) + 2))
    shared = spark.sparkContext.broadcast((n, tox, rate))
    found = saved(mapped(base, _passages(shared, strength, drift), "doc_id long, n_tokens long, passages array<struct<start:int,end:int,sum:double>>"), "passages")
    largest = F.coalesce(F.array_max(F.transform("passages", lambda p: p["sum"])), F.lit(0.0))
    third = found.filter(learn_from).filter(slice_ == 2).join(marks.filter(slice_ == 2).hint("merge"), "doc_id").select("n_tokens", largest.alias("m"), F.transform("passages", lambda p: p["sum"]).alias("sums"), "toxic", F.xxhash64("doc_id").alias("h")).orderBy("h", "n_tokens", "m").limit(fit_rows).toPandas()
    y = third["toxic"].to_numpy(int)
    if not len(y) or not counts["tox"].sum() or y.min() == y.max():
        return found.select("doc_id", "n_tokens", F.transform("passages", lambda p: F.struct(p["start"], p["end"], p["sum"], F.lit(0.0).alias("value"))).alias("passages"), F.lit(0.0).alias("score"))
    length = third["n_tokens"].to_numpy(float)
    lam, ln_k = extreme_value_fit(third["m"].to_numpy(float)[y == 0], length[y == 0])
    best = lam * third["m"].to_numpy(float) - ln_k - np.log(np.maximum(length, 1))
    every = np.array([sum(max(0.0, lam * z - ln_k - np.log(max(t, 1))) for z in zs) for zs, t in zip(third["sums"], length)])
    shape = lambda a, b: np.column_stack([np.clip(a, -20, 50), np.log1p(b)])
    w = fit_logistic(shape(best, every), y)
    level = F.log(F.greatest("n_tokens", F.lit(1))) + F.lit(ln_k)
    value = lambda z: F.lit(lam) * z - level
    top = F.least(F.greatest(value(largest), F.lit(-20.0)), F.lit(50.0))
    total = F.aggregate("passages", F.lit(0.0), lambda acc, p: acc + F.greatest(value(p["sum"]), F.lit(0.0)))
    score = 1 / (1 + F.exp(-(F.lit(float(w[0])) + F.lit(float(w[1])) * top + F.lit(float(w[2])) * F.log1p(total))))
    return found.select("doc_id", "n_tokens", F.transform("passages", lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), p["sum"].alias("sum"), value(p["sum"]).alias("value"))).alias("passages"), score.alias("score"))
