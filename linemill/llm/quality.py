"""Quality classifier: heuristic labellers, a weak-label model by EM, and a hashed linear scorer.

Each labeller votes good (1), bad (0) or abstains (-1) from whole texts, as Spark expressions. EM sees only
how often each pattern of votes occurs (at most 3**labellers rows, counted over all documents) and estimates the share of
good documents and, for each labeller, its votes on good and on bad ones. The posterior of a pattern labels the
fitting sample for a logistic scorer over hashed words and word shapes; the scorer rates every document.

Rows: a null text counts as empty and is rejected (score 0); null or equal doc_ids and repeated rows are rated row by row, equal texts alike;
texts of any length are read whole; a score of exactly the limit is kept; an empty table gives no rows; all columns of the input are kept, but those that
quality() names its results by (rated() and good_documents() keep these too).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import all_of, blank, hidden, kept, mapped, only

DIMS = 1 << 18
#: Frequent function words of the four languages (fixed values).
STOPWORDS = ["the", "of", "and", "to", "in", "is", "that", "der", "die", "und", "das", "den", "von", "ist", "le", "la", "les", "et", "des", "de", "que", "el", "los", "en", "y", "un", "una", "une", "ein", "eine"]


def voted(texts: DataFrame) -> DataFrame:
    """text (not null) with a column for each heuristic's vote. Arrays are columns of a projection of their own, so each is made once."""
    at = texts.select("text", F.split(F.trim("text"), r"\s+").alias("words"), F.split("text", "\n").alias("lines"))
    share = lambda signs: (F.length("text") - F.length(F.translate("text", signs, ""))) / F.greatest(F.length("text"), F.lit(1))
    at = at.select(
        "text",
        F.length("text").alias("chars"),
        F.size("words").alias("n"),
        F.size("lines").alias("rows"),
        F.size(F.array_distinct("lines")).alias("own_rows"),
        F.size(F.array_distinct("words")).alias("own_words"),
        F.size(F.array_intersect(F.split(F.lower("text"), r"\s+"), F.array(*map(F.lit, STOPWORDS)))).alias("known"),
        F.size(F.filter(F.zip_with("words", F.slice("words", F.lit(2), F.size("words")), lambda a, b: a == b), lambda x: x)).alias("echo"),
        share("#$%&*@^~<>{}[]\\=+").alias("signs"),
        share("|").alias("bars"),
        share("!").alias("marks"),
        share(".?").alias("stops"),
        share("ABCDEFGHIJKLMNOPQRSTUVWXYZÀÂÄÇÈÉÊËÍÎÑÓÔÖÙÛÜ").alias("upper"),
    )
    return at.select("text", *[v.alias(f"vote_{k}") for k, v in _votes().items()])


def _votes() -> dict[str, Column]:
    chars, n, rows, own_rows, own_words, known, echo, signs, bars, marks, stops, upper = map(F.col, ("chars", "n", "rows", "own_rows", "own_words", "known", "echo", "signs", "bars", "marks", "stops", "upper"))
    vote = lambda bad, good: F.when(bad, 0).when(good, 1).otherwise(-1)
    long = n > 20
    return {
        "signs": vote(signs > 0.02, long & (signs < 0.005)),
        "bars": vote(bars > 0.01, long & (bars == 0)),
        "capitals": vote(long & (upper > 0.3), long & (upper < 0.15)),
        "marks": vote(marks > 0.02, long & (marks == 0)),
        "sentences": vote(long & (stops < 0.001), long & (stops > 0.004) & (stops < 0.06)),
        "stopwords": vote(long & (known < 2), known >= 4),
        "word_length": vote(long & ((chars / n > 16) | (chars / n < 2.5)), long & (chars / n > 4) & (chars / n < 10)),
        "repeats": vote((rows > 3) & (own_rows < 0.6 * rows), (rows > 3) & (own_rows > 0.95 * rows)),
        "echo": vote(long & (echo > 0.05 * n), long & (echo < 0.01 * n)),
        "variety": vote(long & (own_words < 0.2 * n), long & (own_words > 0.4 * n)),
    }


#: Labellers whose vote for bad starts EM: they look for something that good documents seldom have.
DETECTORS = ("signs", "bars", "capitals", "marks", "repeats", "echo", "variety")


class WeakLabels:
    """Two classes, conditionally independent votes; EM on counts of vote patterns. Abstentions say nothing.

    Both error rates of every labeller are estimated. A detector's share of bad votes on good documents has a Beta prior with mean
    `alarms`, worth `weight` votes for each document: the maximum is a posteriori, and data move it as far as they say.
    """

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, start: np.ndarray, rounds: int = 500, alarms: float = 0.002, weight: float = 1.0):
        c = counts.astype(float)
        believed = np.where(start, weight * c.sum(), 0.0)
        post = np.where((patterns[:, start] == 0).any(1), 0.05, 0.97)
        for _ in range(rounds):
            self.prior = float(np.clip((post * c).sum() / max(c.sum(), 1e-9), 0.02, 0.98))
            self.bad_votes = np.empty((2, patterns.shape[1]))  # share of bad among votes on bad (0) and on good documents (1)
            for y, w in ((1, post * c), (0, (1 - post) * c)):
                bad, good = ((patterns == v) * w[:, None] for v in (0, 1))
                more = believed if y else 0.0
                self.bad_votes[y] = (bad.sum(0) + (0.5 if y == 0 else 0.01) + alarms * more) / (bad.sum(0) + good.sum(0) + 1 + more)
            new = self.posterior(patterns)
            done = len(new) == 0 or np.abs(new - post).max() < 1e-6
            post = new
            if done:
                break

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of good."""
        p = np.clip(self.bad_votes, 1e-4, 1 - 1e-4)
        bad, good = (np.log(self.prior if y else 1 - self.prior) + np.where(patterns == 0, np.log(p[y]), np.where(patterns == 1, np.log(1 - p[y]), 0)).sum(1) for y in (0, 1))
        return 1 / (1 + np.exp(np.clip(bad - good, -500, 500)))


class _Features(dict):
    """word -> two hashed features (the lower-cased word, its shape) as bytes."""

    _LETTERS = bytes(65 if 65 <= b <= 90 else 97 if 97 <= b <= 122 or b >= 128 else 48 if 48 <= b <= 57 else b for b in range(256))

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= 400_000:
            self.clear()
        shape, last = bytearray(), -1
        for b in word[:200].translate(self._LETTERS):
            if b != last:
                shape.append(b)
            last = b
        ids = (xxhash.xxh32_intdigest(word.lower()) % (DIMS - 1), xxhash.xxh32_intdigest(bytes(shape), 7) % (DIMS - 1))
        got = self[word] = np.array(ids, "<u4").tobytes()
        return got


_FEATURES = kept(_Features())


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of a whole text, scaled to length 1, and the share of words equal to the one before."""
    every = np.frombuffer(b"".join(map(_FEATURES.__getitem__, text.split())), "<u4")
    ids, n = np.unique(every, return_counts=True)
    x = np.log1p(n)
    x = x / max(np.sqrt((x * x).sum()), 1e-9)
    words = every[::2]
    return (np.append(ids, DIMS - 1), np.append(x, np.count_nonzero(words[1:] == words[:-1]) / len(words))) if len(words) else (ids, x)


def _sampled(batches):
    only(_FEATURES)
    for b in batches:
        both = [features(t) for t in b.column(0).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([i.astype(np.int32) for i, _ in both], pa.list_(pa.int32())), pa.array([x.astype(np.float32) for _, x in both], pa.list_(pa.float32())), b.column(1)], ["ids", "x", "label"])


#: Features of the sample that a step of the fit works on at once, to bound the driver's memory.
BLOCK = 1 << 17


def fit_scorer(ids, x, label, rounds: int = 120, rate: float = 0.5, shrink: float = 1e-6) -> np.ndarray:
    """Weights of a logistic scorer, the last one its constant; labels are probabilities. AdaGrad over the whole sample, in blocks of rows."""
    w = np.zeros(DIMS + 1)
    if not len(label):
        return w
    n, y = np.array([len(i) for i in ids]), np.asarray(label, float)
    cols, vals, ends = np.concatenate(ids), np.concatenate(x), np.cumsum(n)
    seen = np.zeros(DIMS, bool)
    seen[cols] = True
    used = np.append(np.flatnonzero(seen), DIMS)
    cols = (np.cumsum(seen, dtype=np.int32) - 1)[cols]
    blocks, a = [], 0
    while a < len(n):  # one row at least
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BLOCK, "right")))
        blocks.append((a, b, slice(ends[a] - n[a], ends[b - 1])))
        a = b
    v, s, d = np.zeros(len(used)), np.full(len(used), 1e-8), np.zeros(len(y))  # the constant is last
    for _ in range(rounds):
        g = np.zeros(len(used))
        for a, b, at in blocks:
            rows, own, z = np.repeat(np.arange(b - a), n[a:b]), cols[at].astype(np.int64), vals[at].astype(float)
            d[a:b] = 1 / (1 + np.exp(-np.clip(np.bincount(rows, v[own] * z, b - a) + v[-1], -30, 30))) - y[a:b]
            g += np.bincount(own, d[a:b][rows] * z, len(used))
        g = g / len(y) + shrink * v
        g[-1] = d.mean()
        s += g * g
        v -= rate * g / np.sqrt(s)
    w[used] = v
    return w


def _scored(shared, name: str):
    def run(batches):
        only(_FEATURES)
        w = shared.value
        for b in batches:
            out = []
            for t in b.column(b.num_columns - 1).cast(pa.binary()).to_pylist():
                ids, x = features(t)
                out.append(1 / (1 + np.exp(-np.clip(w[ids] @ x + w[DIMS], -30, 30))) if len(ids) else 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(out, pa.float64())], [*b.schema.names[:-1], name])

    return run


def rated(docs: DataFrame, score: str, sample_rows: int) -> DataFrame:
    """docs with a column of the name `score`, 0 to 1.

    sample_rows bounds the texts that fit the scorer: distinct ones with the smallest hashes, each counting once however
    many copies it has; all distinct texts, if there are no more. The vote patterns of the weak-label model are counted
    over all documents.
    """
    spark = docs.sparkSession
    text = docs.select(blank().alias("text"))
    votes = [f"vote_{k}" for k in _votes()]
    table = voted(text).groupBy(*votes).agg(F.count(F.lit(1)).alias("n")).toPandas()
    patterns = table[votes].to_numpy(int).reshape(-1, len(votes))
    model = WeakLabels(patterns, table["n"].to_numpy(float), np.isin(votes, [f"vote_{k}" for k in DETECTORS]))
    label = dict(zip(map(tuple, patterns), model.posterior(patterns)))
    total = max(int(table["n"].sum()), 1)
    slot = F.pmod(F.xxhash64("text"), F.lit(1 << 20))
    share = min(1.0, 1.5 * sample_rows / total)
    while share < 1:  # copies leave fewer texts than rows
        found = text.filter(slot <= int(share * (1 << 20))).select(F.xxhash64("text").alias("hash")).distinct().count()
        if found >= sample_rows:
            break
        share = min(1.0, share * max(2.0, 1.5 * sample_rows / max(found, 1)))
    near = text.filter(slot <= int(share * (1 << 20))).distinct().orderBy(F.xxhash64("text"), "text").limit(sample_rows)
    key = F.concat_ws(",", *[F.col(v).cast("string") for v in votes])
    prior = spark.createDataFrame([(",".join(map(str, k)), float(p)) for k, p in label.items()], "pattern string, label double")
    sample = voted(near).withColumn("pattern", key).join(F.broadcast(prior), "pattern").select("text", "label")
    got = mapped(sample, _sampled, "ids array<int>, x array<float>, label double").toArrow()  # flat buffers, no object for each number
    w = fit_scorer(*(got[c].to_numpy() for c in ("ids", "x", "label")))
    del got
    shared = spark.sparkContext.broadcast(w.astype(np.float32))
    return mapped(docs.select(*all_of(docs), blank().alias(hidden(docs, "text_"))), _scored(shared, score), StructType([*docs.schema.fields, StructField(score, DoubleType())]))


def quality(docs: DataFrame, sample_rows: int = 6000, keep_from: float = 0.5) -> DataFrame:
    """docs with score (0 to 1) and keep (score >= keep_from). Columns of docs with these names make way; rated() keeps them."""
    docs = docs.select(*all_of(docs, "score", "keep"))
    return rated(docs, "score", sample_rows).withColumn("keep", F.col("score") >= keep_from)


def good_documents(docs: DataFrame, sample_rows: int = 6000, keep_from: float = 0.5) -> DataFrame:
    """The rows of docs whose score is keep_from or more, all their columns as they were."""
    score = hidden(docs, "score")
    return rated(docs, score, sample_rows).filter(F.col(score) >= keep_from).select(*all_of(docs))
