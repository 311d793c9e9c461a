"""Order, distinct, duplicates and ranks of lines."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import saved

ORDERS = ("dictionary", "length")


def order_keys(order: str = "dictionary") -> list[Column]:
    """dictionary: unsigned bytes, a prefix first. length: shorter first, then dictionary."""
    if order not in ORDERS:
        raise ValueError(f"order is one of {ORDERS}")
    return ([F.octet_length("line")] if order == "length" else []) + [F.col("line")]


def merged(lines: DataFrame, order: str = "dictionary", keep_duplicates: bool = False) -> DataFrame:
    """Distinct lines (or all) in a global order. Distinct first: the hash aggregate shrinks what is sorted."""
    lines = lines.select("line")
    return (lines if keep_duplicates else lines.distinct()).orderBy(*order_keys(order))


def duplicates(lines: DataFrame, order: str = "dictionary") -> DataFrame:
    """Each line that occurs more than once, once, with its count, in order."""
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(*order_keys(order))


#: Copies of a line that one row stands for at most, where copies are spread over tasks.
COPIES = 1 << 16


def in_blocks(lines: DataFrame, copies: str) -> DataFrame:
    """Rows with their number of copies -> rows of COPIES copies at most, with `_block` (from 0)."""
    last = F.expr(f"cast((`{copies}` - 1) div {COPIES} as int)")
    return lines.withColumn("_block", F.explode(F.sequence(F.lit(0), last))).withColumn(copies, F.least(F.lit(COPIES), F.col(copies) - F.col("_block") * COPIES))


def ranked(lines: DataFrame, order: str = "dictionary") -> DataFrame:
    """Adds rank, 1 for the first line of the order; equal lines have consecutive ranks, in any order. No window holds all rows.

    Lines are range-partitioned once, into a table, so that places within a partition and the numbers of rows before it (one for each partition) come
    from the same ranges. Without other columns, equal rows travel as one with their number, and copies are spread in blocks.
    """
    if lines.columns != ["line"]:
        return _ranked_rows(lines, order)
    parts, keys = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), order_keys(order)
    distinct = lines.groupBy("line").agg(F.count(F.lit(1)).alias("_n"))
    placed = saved(distinct.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("_first", F.coalesce(F.sum("_n").over(within), F.lit(0))).join(_starts(placed, "_n"), "_part").select("line", "_n", (F.col("_first") + F.col("_start")).alias("_first"))
    many = in_blocks(out.filter(F.col("_n") > COPIES), "_n").withColumn("_first", F.col("_first") + F.col("_block") * COPIES).drop("_block").repartition(parts, "line", "_first")
    out = out.filter(F.col("_n") <= COPIES).unionByName(many.select(*out.columns))
    return out.select("line", F.explode(F.sequence(F.col("_first") + 1, F.col("_first") + F.col("_n"))).alias("rank"))


def _starts(placed: DataFrame, n: str | Column) -> DataFrame:
    """`_start` for each `_part`: how many rows the partitions before it have; one row for each partition, for a broadcast."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.sum(n).alias("_all"))
    return F.broadcast(sizes.select("_part", F.coalesce(F.sum("_all").over(before), F.lit(0)).alias("_start")))


def _ranked_rows(lines: DataFrame, order: str) -> DataFrame:
    """ranked() of lines with other columns. Every row goes through one exchange, with the other columns and its number in the input as last keys, so equal lines
    and equal rows can be in many ranges; a row's place in its range is its number there, which needs no window. Only equal rows are dealt by
    their number, so only for these does a task that is run again have to get its input in the same order, as it does from files.
    """
    parts, keys = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions")), order_keys(order)
    names = {c: f"_c{i}" for i, c in enumerate(c for c in lines.columns if c != "line")}
    rows = lines.select("line", *[F.col(f"`{c}`").alias(n) for c, n in names.items()]).withColumn("_row", F.monotonically_increasing_id())
    ranges = rows.repartitionByRange(parts, *keys, *names.values(), "_row").sortWithinPartitions(*keys).drop("_row")
    at = F.col("_at")  # the partition's number, above 33 bits of a row's number in it
    placed = saved(ranges.withColumn("_at", F.monotonically_increasing_id()), "ranges").withColumn("_part", F.shiftright(at, 33))
    out = placed.join(_starts(placed, F.lit(1)), "_part").withColumn("rank", F.col("_start") + at.bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    return out.select(*[F.col("line" if c == "line" else names[c]).alias(c) for c in lines.columns], "rank")


def is_sorted(lines: DataFrame, position: str, order: str = "dictionary") -> DataFrame:
    """One row, `is_sorted`: whether lines ascend with the column `position`. By range partitions of the position, each folded where it is."""
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = lines.select(F.col(position).alias("_at"), "line").repartitionByRange(parts, "_at").sortWithinPartitions("_at")
    return _runs_ascend(placed.select(F.spark_partition_id().cast("long").alias("run"), "line"), order)


def runs_sorted(lines: DataFrame, run: str, order: str = "dictionary") -> DataFrame:
    """is_sorted() of lines that come in order already, as a file's do: rows of one value of `run`, a long, follow each other in one task, and runs are in the order of its values. Exchanges one row for each run."""
    return _runs_ascend(lines.select(F.col(run).alias("run"), "line"), order)


def _runs_ascend(rows: DataFrame, order: str) -> DataFrame:
    """Rows (run, line) -> one row: whether lines ascend within each run and from one to the next. A task holds a batch and the line before it; a null is before all lines."""
    by_length = len(order_keys(order)) > 1

    def ascend(a: pa.Array, b: pa.Array) -> pa.Array:
        up = pc.less_equal(a, b)
        if by_length:
            m, n = pc.binary_length(a), pc.binary_length(b)
            up = pc.or_(pc.less(m, n), pc.and_(pc.equal(m, n), up))
        return pc.or_(pc.is_null(a), pc.fill_null(up, False))

    def fold(batches):
        run = first = last = None
        ok = True
        for b in batches:
            runs, lines = b.column(0), b.column(1)
            ends = [*(i + 1 for i in pc.indices_nonzero(pc.not_equal(runs[1:], runs[:-1])).to_pylist()), len(runs)] if len(runs) else []
            at = 0
            for end in ends:
                own = lines[at:end]
                if runs[at].as_py() != run:
                    if run is not None:
                        yield run, ok, first, last
                    run, ok, first = runs[at].as_py(), True, own[0].as_py()
                else:
                    ok = ok and ascend(pa.array([last], own.type), own[:1])[0].as_py()
                ok = ok and pc.all(ascend(own[:-1], own[1:])).as_py() is not False
                last, at = own[-1].as_py(), end
        if run is not None:
            yield run, ok, first, last

    def folded(batches):
        for found in fold(batches):
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(found, (pa.int64(), pa.bool_(), pa.binary(), pa.binary()))], ["run", "ok", "first", "last"])

    key = lambda c: F.struct(*([F.octet_length(c)] if by_length else []), F.col(c))
    inner = rows.mapInArrow(folded, "run long, ok boolean, first binary, last binary").select("run", "ok", key("first").alias("first"), key("last").alias("last"))
    edges = inner.withColumn("before", F.lag("last").over(Window.orderBy("run")))
    return edges.agg(F.coalesce(F.min(F.col("ok") & F.coalesce(F.col("before") <= F.col("first"), F.lit(True))), F.lit(True)).alias("is_sorted"))
