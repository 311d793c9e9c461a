"""Line profiles of groups (files, or columns that stand for them): two-stage hash aggregates of built-in functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import CATEGORIES, category_mask, category_names, charset_name, from_dollar_hex, from_latin1, latin1


def decoded(lines: DataFrame) -> DataFrame:
    """Lines with $HEX[...] turned back into its bytes."""
    return lines.withColumn("line", from_latin1(from_dollar_hex(latin1(F.col("line")))))


def measured(lines: DataFrame, *by: str) -> DataFrame:
    """One row for each group, length and mask, with its lines: all other reports come from this table."""
    lines = lines.select(*by, F.octet_length("line").cast("long").alias("length"), category_mask(latin1(F.col("line"))).alias("mask"))
    return lines.groupBy(*by, "length", "mask").agg(F.count(F.lit(1)).alias("n"))


def summary(m: DataFrame, *by: str) -> DataFrame:
    """Lines, bytes with line ends, and bytes a line."""
    out = m.groupBy(*by).agg(F.sum("n").alias("lines"), F.sum(F.col("n") * (F.col("length") + 1)).alias("bytes"))
    return out.withColumn("average_length", F.round(F.col("bytes") / F.col("lines"), 6))


def length_histogram(m: DataFrame, *by: str, dense: bool = False) -> DataFrame:
    """Lines by length in bytes; dense: with rows of 0 up to the longest."""
    out = m.groupBy(*by, "length").agg(F.sum("n").alias("n"))
    if not dense:
        return out
    step = F.lit(1 << 16).cast("long")  # in blocks, so that no row has more lengths than that
    every = out.groupBy(*by).agg(F.max("length").alias("_top")).select(*by, "_top", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_top"), step)).alias("_from"))
    every = every.select(*by, F.explode(F.sequence(F.col("_from"), F.least(F.col("_top"), F.col("_from") + step - 1))).alias("length"))
    return every.join(out, [*by, "length"], "left").select(*by, "length", F.coalesce("n", F.lit(0)).alias("n"))


def _with_share(out: DataFrame, m: DataFrame, *by: str) -> DataFrame:
    """Adds share of the group's lines; groups by a join with their totals, that need not be small."""
    totals = m.groupBy(*by).agg(F.sum("n").alias("_all"))
    out = out.join(totals, list(by)) if by else out.crossJoin(F.broadcast(totals))  # without groups the total is one row
    return out.withColumn("share", F.round(F.col("n") / F.col("_all"), 6)).drop("_all")


def category_any(m: DataFrame, *by: str) -> DataFrame:
    """Lines that hold a class, for each class."""
    classes = F.explode(F.array(*[F.struct(F.lit(bit).alias("bit"), F.lit(name).alias("category")) for bit, name, _ in CATEGORIES])).alias("c")
    rows = m.groupBy(*by, "mask").agg(F.sum("n").alias("n")).select(*by, "mask", "n", classes)
    out = rows.groupBy(*by, "c.category").agg(F.sum(F.when(F.col("mask").bitwiseAND(F.col("c.bit")) != 0, F.col("n")).otherwise(0)).alias("n"))
    return _with_share(out, m, *by)


def category_full(m: DataFrame, *by: str) -> DataFrame:
    """Lines by the whole mask."""
    out = m.groupBy(*by, "mask").agg(F.sum("n").alias("n")).withColumn("categories", category_names(F.col("mask")))
    return _with_share(out, m, *by)


def charsets(m: DataFrame, *by: str) -> DataFrame:
    """Lines by the short name of their mask."""
    return _with_share(m.groupBy(*by, charset_name(F.col("mask")).alias("charset")).agg(F.sum("n").alias("n")), m, *by)
