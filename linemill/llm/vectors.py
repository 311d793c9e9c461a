"""Approximate nearest neighbours with balanced posting lists.

Fitting: balanced k-means over at most `sample_rows` distinct vectors (the smallest hashes) gives the centroids, and their
in-memory graph (each centroid's nearest ones, and longer random edges) is searched best-first with a bounded beam.
Indexing: every vector goes to its nearest centroid's list; one near a boundary also to further lists, whose centroids are
at most (1 + `closure`) times as far as the nearest, except those closer to a centroid already taken than to the vector.
Searching: a query's lists are all those whose centroids are at most (1 + `prune`) times as far as its nearest centroid;
the beam grows until it holds a centroid beyond that. Where these lists have too few entries for k neighbours (counted by each
entry's nearest list, without those that hold nothing but the query's id), the next nearest lists follow.
Lists longer than `list_rows` are split in parts, and a list's queries are compared with each part in blocks: no task
holds more than a part and a block.

Equal vectors are one entry that carries its smallest ids: no more than k+1 of them can be among k neighbours,
ties going to smaller ids, so nothing is lost by that.

Rows: vectors that are null, of another length than most, zero, or with null or non-finite components take no part, neither
as queries nor as candidates; so do null ids; of a repeated id each distinct vector is a candidate; ties go to smaller ids; with fewer
than k candidates a query gets all of them; empty tables give no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, saved


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


def balanced_centroids(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k-means whose distance is raised for clusters above their share, so lists come out alike."""
    if len(x) <= k:
        return x.copy()
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    fee, share = np.zeros(k), len(x) / k
    for _ in range(rounds):
        near = np.empty(len(x), np.int64)
        for i in range(0, len(x), 2048):
            near[i : i + 2048] = (_square(x[i : i + 2048], c) + fee).argmin(1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        spread = ((x - c[near]) ** 2).sum(1).mean()
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
        fee = 0.5 * fee + 0.05 * spread * (n - share) / share
    return c


class CentroidGraph:
    """Nearest-neighbour graph with random long edges over the centroids; best-first search."""

    def __init__(self, c: np.ndarray, degree: int = 16, seed: int = 11):
        self.c = c
        n = len(c)
        rng = np.random.default_rng(seed)
        self.edges = []
        for i in range(0, n, 1024):
            d = _square(c[i : i + 1024], c)
            near = np.argsort(d, axis=1, kind="stable")[:, 1 : degree + 1]
            self.edges += list(near)
        back: list[set[int]] = [set(e.tolist()) for e in self.edges]
        for i, e in enumerate(self.edges):
            for j in e.tolist():
                back[j].add(i)
        for i in range(n):
            back[i].update(rng.integers(0, n, 4).tolist())
            back[i].discard(i)
        self.edges = [np.array(sorted(e), np.int64) for e in back]
        self.start = np.unique(np.linspace(0, n - 1, min(n, 32)).astype(np.int64))

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The beam's centroids and their distances, nearest first; all centroids where the beam has room for them."""
        if beam >= len(self.c):
            d = np.sqrt(((self.c - q) ** 2).sum(1))
            out = np.argsort(d, kind="stable")
            return out, d[out]
        seen = np.zeros(len(self.c), bool)
        d = np.sqrt(((self.c[self.start] - q) ** 2).sum(1))
        seen[self.start] = True
        todo = list(zip(d.tolist(), self.start.tolist()))
        heapq.heapify(todo)
        best = [(-x, i) for x, i in todo]
        heapq.heapify(best)
        while len(best) > beam:
            heapq.heappop(best)
        while todo:
            x, i = heapq.heappop(todo)
            if len(best) >= beam and x > -best[0][0]:
                break
            new = self.edges[i][~seen[self.edges[i]]]
            if not len(new):
                continue
            seen[new] = True
            for y, j in zip(np.sqrt(((self.c[new] - q) ** 2).sum(1)).tolist(), new.tolist()):
                if len(best) < beam or y < -best[0][0]:
                    heapq.heappush(todo, (y, j))
                    heapq.heappush(best, (-y, j))
                    if len(best) > beam:
                        heapq.heappop(best)
        out = sorted((-x, i) for x, i in best)
        return np.array([i for _, i in out], np.int64), np.array([x for x, _ in out])


_GRAPHS: dict[bytes, CentroidGraph] = {}


def _graph(c: np.ndarray) -> CentroidGraph:
    key = c.tobytes()[:256] + len(c).to_bytes(8, "little")
    if key not in _GRAPHS:
        _GRAPHS.clear()
        _GRAPHS[key] = CentroidGraph(c)
    return _GRAPHS[key]


def _lists(shared, beam: int, ratio: float, most: int | None):
    """Adds the lists of each vector. most: replicas of an indexed vector at most, after the relative-neighbour rule; None for queries.

    Queries have in `need` how many entries their lists must hold; shared then has the entries by their nearest list, too.
    """

    def run(batches):
        c, size = shared.value if most is None else (shared.value, None)
        graph = _graph(c)
        for b in batches:
            at = b.schema.get_field_index("v")
            x = np.frombuffer(b"".join(b.column(at).to_pylist()), "<f8").reshape(b.num_rows, -1)
            out = []
            needs = b.column(b.schema.get_field_index("need")).to_pylist() if most is None else [0] * len(x)
            for q, need in zip(x, needs):
                ids, d = graph.search(q, beam)
                held = beam
                while most is None and len(ids) < len(c) and (d[-1] <= (1 + ratio) * d[0] + 1e-12 or size[ids].sum() < need):
                    held *= 4
                    ids, d = graph.search(q, held)
                near = int((d <= (1 + ratio) * d[0] + 1e-12).sum())
                if most is None:
                    near = max(near, int(np.searchsorted(np.cumsum(size[ids]), need)) + 1)
                ids = ids[:near]
                if most is not None:
                    took = [ids[0]]
                    for k, i in enumerate(ids[1:], 1):
                        if len(took) == most:
                            break
                        if all(((c[i] - c[j]) ** 2).sum() > d[k] ** 2 for j in took):
                            took.append(i)
                    ids = np.array(took)
                out.append(ids.astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.list_(pa.int32()))], [*b.schema.names, "lists"])

    return run


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    d = q - x
    return np.sqrt((d * d).sum(-1))


def _compared(k: int):
    """One list part with a block of its queries: rows sorted by part, candidates (side 0) first."""

    def part(rows, out):
        cand = [r for r in rows if r[0] == 0]
        if not cand or len(cand) == len(rows):
            return
        x = np.frombuffer(b"".join(r[2] for r in cand), "<f8").reshape(len(cand), -1)
        only, single = np.array([r[1][0] for r in cand]), np.array([len(r[1]) == 1 for r in cand])
        for r in rows[len(cand) :]:
            q = np.frombuffer(r[2], "<f8")
            d = _exact(q, x)
            d[np.isin(only, r[1]) & single] = np.inf  # entries that hold nothing but the query's id
            near = np.argpartition(d, k)[:k] if len(d) > k else np.arange(len(d))
            top = np.flatnonzero((d <= d[near].max()) & (d < np.inf))
            for i in top:
                for v in cand[i][1]:
                    for own in r[1]:
                        if v != own:
                            out.append((own, v, float(d[i])))

    def run(batches):
        key, rows, out = None, [], []
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["query_id", "vec_id", "score"])
        for b in batches:
            for p, *row in zip(*(c.to_pylist() for c in b.columns)):
                if p != key and rows:
                    part(rows, out)
                    rows = []
                    if len(out) > 20_000:
                        yield batch()
                        out = []
                key = p
                rows.append(row)
        if rows:
            part(rows, out)
        if out:
            yield batch()

    return run


def neighbours(vectors: DataFrame, is_query, k: int = 10, list_rows: int = 1024, sample_rows: int = 20_000, most_lists: int = 4096, closure: float = 0.15, replicas: int = 4, prune: float = 0.35, beam: int = 96, index_beam: int = 24) -> DataFrame:
    """vec_id and embedding -> query_id, rank, vec_id, score (Euclidean distance): the k nearest found of each row where is_query holds.

    sample_rows bounds the vectors that fit the centroids, most_lists the centroids held in each worker. beam and index_beam: centroids
    that the graph search holds at first for a query, and for a vector to index, which needs its few nearest only.
    """
    spark = vectors.sparkSession
    v = F.transform("embedding", lambda x: x.cast("double"))
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null and v is not null")
    good = good.filter(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    size = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if size is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    good = good.filter(F.size("v") == size[0]).select("vec_id", "v", is_query.alias("asks"))
    # one entry for each distinct vector, with its k + 1 smallest ids; the limit works before the shuffle too
    low = good.select("v", "vec_id").distinct().withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).filter(F.col("n") <= k + 1)
    entries = low.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    packed = lambda df, *cols: mapped(df.select(*cols, "v"), _bytes(), ", ".join(f"{c} {t}" for c, t in df.select(*cols).dtypes) + ", v binary", 5000)
    entries = saved(packed(entries.withColumn("key", F.xxhash64("v")), "key", "ids"), "entries")
    n = entries.count()
    lists = int(min(most_lists, max(1, n // list_rows)))
    near = entries.filter(F.pmod("key", F.lit(1 << 20)) <= int(min(1.0, 1.5 * sample_rows / max(n, 1)) * (1 << 20)))
    fit = near.orderBy("key", "v").limit(sample_rows).select("v").toPandas()["v"]
    c = balanced_centroids(np.frombuffer(b"".join(fit), "<f8").reshape(len(fit), -1), lists)
    shared = spark.sparkContext.broadcast(c)
    indexed = saved(mapped(entries, _lists(shared, index_beam, closure, replicas), "key long, ids array<bigint>, v binary, lists array<int>", 1000).select("ids", "v", F.posexplode("lists").alias("place", "list")), "index")
    sizes = np.zeros(len(c), np.int64)
    for r in indexed.filter("place = 0").groupBy("list").count().collect():  # at most most_lists rows
        sizes[r["list"]] = r["count"]
    both = spark.sparkContext.broadcast((c, sizes))
    indexed = indexed.drop("place")
    repeated = entries.select(F.explode("ids").alias("id")).groupBy("id").count().filter("count > 1")
    asked = packed(good.filter("asks").groupBy("v", "vec_id").agg(F.first("asks").alias("asks")).join(repeated, F.col("vec_id") == F.col("id"), "left").select(F.array("vec_id").alias("ids"), (F.coalesce("count", F.lit(1)) + k).alias("need"), "v"), "ids", "need")
    asked = saved(mapped(asked, _lists(both, beam, prune, None), "ids array<bigint>, need long, v binary, lists array<int>", 1000).select("ids", "v", F.explode("lists").alias("list")), "asked")
    cut = lambda df, rows: df.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("of"))
    parts, blocks = cut(indexed, 4 * list_rows), cut(asked, 1024)
    where = lambda df, of: df.join(F.broadcast(of), "list").withColumn("own", F.pmod(F.xxhash64("ids"), F.col("of")).cast("int"))  # noqa: E731  at most most_lists rows
    other = lambda of: F.explode(F.sequence(F.lit(0), F.col("of2") - 1))
    left = where(indexed, parts).join(F.broadcast(blocks.withColumnRenamed("of", "of2")), "list").select("list", "own", other("of2").alias("k"), F.lit(0).alias("side"), "ids", "v")
    right = where(asked, blocks).join(F.broadcast(parts.withColumnRenamed("of", "of2")), "list").select("list", other("of2").alias("own"), F.col("own").alias("k"), F.lit(1).alias("side"), "ids", "v")
    both = left.unionByName(right).select(F.concat_ws("/", "list", "own", "k").alias("part"), "side", "ids", "v")
    found = mapped(both.repartition("part").sortWithinPartitions("part", "side"), _compared(k), "query_id long, vec_id long, score double", 2000)
    # a vector can be found in several lists; the k best of each task go on, never all of a query's finds
    found = found.distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _bytes():
    def run(batches):
        for b in batches:
            at = b.schema.get_field_index("v")
            x = b.column(at)
            width = len(x[0]) if b.num_rows else 0
            flat = x.flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(b.num_rows, width)
            cols = [pa.array([r.tobytes() for r in flat], pa.binary()) if i == at else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return run
