"""Connected components as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, saved


def _marked(edges: DataFrame) -> tuple:
    """Tells a set of edges from another: how many, and their hashes' exclusive or, which no number of edges overflows."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a", F.lit(1)))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges a, b (any orderable type) -> node, root: the smallest node of its component; nodes without an edge are absent.

    Alternating large-star and small-star rounds; each halves the trees' depth or better, and ends when the edges
    no longer change. Minima are aggregated map-side and are tables of their own, so that both sides of the joins behind them
    are exchanged and Spark can split a node that has a large part of all edges.

    Rows: a null end makes no edge; loops and repeated edges, either way round, count once; no edges give no rows.
    """
    ends = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null and b is not null and a <> b").distinct()
    now, before = saved(ends, "edges"), None
    while (mark := _marked(now)) != before:
        before = mark
        both = now.union(now.select("b", "a"))
        least = saved(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least", rows=2 * mark[0])
        large = saved(both.filter("b > a").join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges", rows=mark[0])
        dropped(least)
        least = saved(large.groupBy("a").agg(F.min("b").alias("m")), "least", rows=mark[0])
        small = large.join(least.hint("merge"), "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        new = saved(small.filter("a <> b").distinct(), "edges", rows=2 * mark[0])
        dropped(least, large, now)
        now = new
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
