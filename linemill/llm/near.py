"""N-gram Jaccard join by MinHash banding.

A document is its set of hashed runs of five words (of all its words, if it has fewer). Documents with equal sets are one
node. Nodes that share a band hash are candidates, found without pairing a bucket: each node links to its
bucket's smallest, and components of these links are verified, every pair on full sets. A component is cut in
blocks of bounded size and pairs of blocks meet in tiles, so no task holds a whole large component, and a tile
returns counts and one link a node, never its pairs.

Bands and rows: the fewest bands of `rows` minima that find a pair at the threshold with probability `recall`.

Rows: a null, empty or blank text has no runs, is linked with nothing and is its own class; null or equal doc_ids are
documents of their own, and repeated rows are copies; a text of any length is taken whole (its set is held by one task); a similarity of
exactly the threshold is a link; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HASHES, all_of, blank, dropped, grams, hidden, mapped, mixed, only, saved, words_of
from .graph import components


def bands_for(threshold: float, recall: float, rows: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def gram_set(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of n words."""
    return np.unique(grams(HASHES.of(words_of(text)), n))


class Signer:
    def __init__(self, bands: int, rows: int, seed: int = 20_240_601):
        rng = np.random.default_rng(seed)
        k = bands * rows
        self.bands, self.rows = bands, rows
        self.a = (rng.integers(0, 1 << 32, k, np.uint32) | np.uint32(1))[:, None]
        self.b = rng.integers(0, 1 << 32, k, np.uint32)[:, None]
        self.salt = mixed(np.arange(1, bands + 1, dtype=np.uint64))

    def sign(self, s: np.ndarray) -> np.ndarray:
        """Band hashes of a set."""
        x = (s >> np.uint64(32)).astype(np.uint32)[None, :]
        low = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for i in range(0, x.shape[1], 1024):
            np.minimum(low, (self.a * x[:, i : i + 1024] + self.b).min(1), out=low)
        low = low.reshape(self.bands, self.rows).astype(np.uint64)
        h = self.salt.copy()
        for r in range(self.rows):
            h = mixed(h ^ low[:, r])
        return h.view(np.int64)


def _node(s: np.ndarray) -> bytes:
    """128 bits that stand for a set."""
    return (int(mixed(s).sum(dtype=np.uint64)) & (2**64 - 1)).to_bytes(8, "big") + (int(mixed(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)) & (2**64 - 1)).to_bytes(8, "big")


def _signed(n: int, bands: int, rows: int):
    def run(batches):
        only(HASHES)
        signer = Signer(bands, rows)
        known: dict[bytes, np.ndarray] = {}
        for b in batches:
            nodes, sizes, signs = [], [], []
            for t in b.column(2).cast(pa.binary()).to_pylist():
                s = gram_set(t, n)
                node = _node(s) if len(s) else None
                if node is not None and node not in known:
                    if len(known) >= 4096:
                        known.clear()
                    known[node] = signer.sign(s)
                nodes.append(node)
                sizes.append(len(s))
                signs.append(known[node] if node is not None else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), pa.array(signs, pa.list_(pa.int64()))], ["doc_id", "text_key", "node", "grams", "bands"])

    return run


def _sets(n: int):
    def run(batches):
        only(HASHES)
        for b in batches:
            got = [gram_set(t, n) for t in b.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in got], pa.binary()), pa.array([s.tobytes() for s in got], pa.binary())], ["node", "grams_of"])

    return run


#: Numbers that are held at once when sets are compared; a run is counted by a product of matrices where 1 in so many pairs, or more, has it.
AT_ONCE, DENSE = 1 << 20, 64


def similar(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float):
    """Index pairs (i, j) of sets with Jaccard similarity >= threshold; within left (i < j) if right is None."""
    own = right is None
    right = left if own else right
    la, lb = np.array([len(s) for s in left]), np.array([len(s) for s in right])
    ids, inv = np.unique(np.concatenate([*left, *([] if own else right)]), return_inverse=True)
    ca = inv[: la.sum()]
    cb = ca if own else inv[la.sum() :]
    ra, rb = np.repeat(np.arange(len(left)), la), np.repeat(np.arange(len(right)), lb)
    na, nb = np.bincount(ca, minlength=len(ids)), np.bincount(cb, minlength=len(ids))
    both = np.zeros((len(left), len(right)), np.float32)
    common = (na > 0) & (nb > 0) & (na * nb > (1 if own else 0))
    dense = common & (na * nb * DENSE >= both.size)
    work = common & ~dense  # few pairs hold these: they are counted one by one, so many at once
    oa, ob = np.flatnonzero(work[ca]), np.flatnonzero(work[cb])
    ob = ob[np.argsort(cb[ob], kind="stable")]
    end = np.cumsum(nb * work)
    size = np.cumsum(nb[ca[oa]])
    i = 0
    while i < len(oa):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + AT_ONCE, "right")))
        part = oa[i:j]
        k = nb[ca[part]]
        at = np.arange(k.sum()) + np.repeat(end[ca[part]] - np.cumsum(k), k)
        low = int(ra[part[0]])  # parts go by rows of left
        rows = int(ra[part[-1]]) + 1 - low
        both[low : low + rows] += np.bincount(np.repeat(ra[part] - low, k) * len(right) + rb[ob[at]], minlength=rows * len(right)).reshape(rows, -1)
        i = j
    order = np.full(len(ids), -1)
    order[dense] = np.arange(dense.sum())
    wide = [(r[on], order[c[on]]) for r, c in ((ra, ca), (rb, cb)) for on in [order[c] >= 0]]
    step = max(1, AT_ONCE // (len(left) + len(right)))
    for i in range(0, int(dense.sum()), step):
        x, y = np.zeros((len(left), step), np.float32), np.zeros((len(right), step), np.float32)
        for m, (r, o) in zip((x, y), wide):
            on = (o >= i) & (o < i + step)
            m[r[on], o[on] - i] = 1
        both += x @ y.T
    found = []
    step = max(1, AT_ONCE // max(1, len(right)))
    for i in range(0, len(left), step):
        some = both[i : i + step].astype(np.float64)
        ok = some / np.maximum(la[i : i + step, None] + lb[None, :] - some, 1) >= threshold
        if own:
            ok &= np.arange(i, i + len(ok))[:, None] < np.arange(len(right))[None, :]
        x, y = np.nonzero(ok)
        found.append((x + i, y))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))


def _heads(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n is linked with, over any number of links."""
    head = np.arange(n)
    while True:
        new = head.copy()
        np.minimum.at(new, i, head[j])
        np.minimum.at(new, j, head[i])
        new = new[new]
        if (new == head).all():
            return head
        head = new


def _tiles(threshold: float):
    """Rows sorted by tile: tile, side (0: first block, 1: second, 2: a block by itself), node, copies, grams_of."""

    def tile(rows):
        rows.sort(key=lambda r: (r[0], r[1]))
        own = rows[0][0] == 2
        left, right = [r for r in rows if r[0] != 1], [r for r in rows if r[0] == 1]
        if not left or not own and not right:
            return []
        sets = lambda x: [np.frombuffer(r[3], np.uint64) for r in x]
        i, j = similar(sets(left), None if own else sets(right), threshold)
        if not own:
            j = j + len(left)
        copies = np.array([r[2] for r in rows], float)
        links = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
        by_node = np.argsort(np.array([r[1] for r in rows], dtype="S16"), kind="stable")
        place = np.empty(len(rows), int)
        place[by_node] = np.arange(len(rows))
        head = by_node[_heads(len(rows), place[i], place[j])][place]
        return [(rows[k][1], int(links[k]), rows[head[k]][1]) for k in range(len(rows)) if links[k]]

    def run(batches):
        only()
        key, rows, out = None, [], []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.binary())], ["node", "links", "head"])

        for b in batches:
            for k, *row in zip(*(c.to_pylist() for c in b.columns)):
                if k != key and rows:
                    out += tile(rows)
                    rows = []
                    if len(out) > 5000:
                        yield batch()
                        out = []
                key = k
                rows.append(row)
        if rows:
            out += tile(rows)
        if out:
            yield batch()

    return run


#: Slots that the copies of a text are dealt to where they meet the texts that are wanted.
SLOTS = 16


def _linked(docs: DataFrame, n: int, threshold: float, recall: float, rows: int, block_grams: int, block_nodes: int) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), node (null without runs), root (the class: its smallest node), class_id, n_links."""
    bands = bands_for(threshold, recall, rows)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(blank()).alias("text_key"), blank().alias("text"))
    signed = saved(mapped(base, _signed(n, bands, rows), "doc_id long, text_key long, node binary, grams long, bands array<bigint>", 500), "signatures")
    nodes = saved(signed.filter("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("low"), F.min("text_key").alias("text_key"), F.max("grams").alias("grams"), F.min("bands").alias("bands")), "nodes")
    n_nodes = nodes.count()
    in_bands = nodes.select(F.explode("bands").alias("band"), "node")
    heads = in_bands.groupBy("band").agg(F.min("node").alias("head"), F.max("node").alias("last")).filter("head <> last").select("band", "head")
    links = in_bands.join(heads, "band").select(F.col("node").alias("a"), F.col("head").alias("b"))
    groups = saved(components(links).join(nodes.drop("bands", "low"), "node"), "groups", rows=n_nodes)
    # what is grouped by a key and then joined by it is a table first: Spark can split a join of two exchanges where a key is frequent
    size = saved(groups.groupBy("root").agg(F.greatest(F.ceil(F.sum("grams") / block_grams), F.ceil(F.count(F.lit(1)) / block_nodes)).cast("int").alias("blocks")), "sizes", rows=n_nodes)
    wanted = saved(groups.select("text_key").distinct(), "wanted", rows=n_nodes).select("text_key", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("slot"))
    texts = base.select("text_key", F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).cast("int").alias("slot"), "text").join(wanted.hint("merge"), ["text_key", "slot"], "left_semi")
    texts = texts.dropDuplicates(["text_key", "slot"]).dropDuplicates(["text_key"]).select("text")
    sets = mapped(texts, _sets(n), "node binary, grams_of binary", 500).dropDuplicates(["node"])
    placed = groups.join(size.hint("merge"), "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(sets, "node")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = placed.select("root", "node", "copies", "grams_of", "block", other.alias("k"))
    tiles = tiles.select(F.concat_ws("/", F.hex("root"), F.least("block", "k").cast("string"), F.greatest("block", "k").cast("string")).alias("tile"), F.when(F.col("block") == F.col("k"), 2).otherwise((F.col("block") > F.col("k")).cast("int")).alias("side"), "node", "copies", "grams_of")
    found = saved(mapped(tiles.repartition("tile").sortWithinPartitions("tile"), _tiles(threshold), "node binary, links long, head binary", 200), "links")
    dropped(size, groups)
    classes = components(found.select(F.col("node").alias("a"), F.col("head").alias("b")))
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    info = saved(nodes.drop("bands", "text_key", "grams").join(counted, "node", "left").join(classes, "node", "left").select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "low", F.coalesce("root", "node").alias("root")), "classes", rows=n_nodes)
    dropped(nodes, found)
    lows = saved(info.groupBy("root").agg(F.min("low").alias("class_id")), "lows", rows=n_nodes)
    info = info.drop("low").join(lows.hint("merge"), "root").select("node", "n_links", "root", "class_id")
    return signed.drop("bands", "grams").join(info.hint("merge"), "node", "left").select("doc_id", "text_key", "node", "root", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def near_duplicates(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, rows: int = 6, block_grams: int = 1_000_000, block_nodes: int = 1500) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), class_id (the smallest doc_id of its class), n_links (other documents at the threshold or above).

    block_grams and block_nodes bound a block: expected runs and nodes in it.
    """
    return _linked(docs, n, threshold, recall, rows, block_grams, block_nodes).drop("node", "root")


def one_of_each(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.9999, rows: int = 6, block_grams: int = 1_000_000, block_nodes: int = 1500) -> DataFrame:
    """docs with one row of each class: the smallest doc_id's (null first), of equal ones that with the smallest text hash.

    Rows of equal doc_id and text are told apart by nothing: one of them stays. Documents without runs all stay.
    Classes are told apart by their members' texts, so null and repeated doc_ids join none. All columns pass through, whatever their names.
    """
    found = _linked(docs, n, threshold, recall, rows, block_grams, block_nodes).filter("n_links > 0").select("root", F.struct("doc_id", "text_key").alias("at"))
    found = saved(found.groupBy("root", "at").agg(F.count(F.lit(1)).alias("rows")), "members")
    n_members = found.count()
    least = saved(found.groupBy("root").agg(F.min("at").alias("stay")), "least", rows=n_members)
    gone = found.join(least.hint("merge"), "root").select("at", (F.col("at") == F.col("stay")).alias("stays"), "rows").filter(~F.col("stays") | (F.col("rows") > 1))
    k1, k2 = hidden(docs, "k1"), hidden(docs, "k2")
    id_ = lambda c: F.coalesce(c, F.lit(-(1 << 63)))
    gone = saved(gone.select(id_(F.col("at.doc_id")).alias(k1), F.col("at.text_key").alias(k2), "stays"), "gone", rows=n_members)
    keyed = docs.withColumns({k1: id_(F.col("doc_id").cast("long")), k2: F.xxhash64(blank())})
    kept = keyed.join(gone.hint("merge"), [k1, k2], "left_anti")
    repeated = gone.filter("stays")
    if not repeated.isEmpty():
        kept = kept.unionByName(keyed.join(repeated.drop("stays"), [k1, k2]).dropDuplicates([k1, k2]))
    return kept.select(*all_of(docs))
