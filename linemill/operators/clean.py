"""Per-line clean-ups and filters, in one pass, with their counters.

Order: over-long lines, $HEX, trim or strip, NUL bytes, blanks, pattern.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bytes import WHITESPACE, from_latin1, latin1, strip, strip_nulls, to_dollar_hex, trim


@dataclass(frozen=True)
class Cleaning:
    """whitespace: None, trim or strip. longest: bytes of the longest line kept; None for no limit."""

    dollar_hex: bool = False
    whitespace: str | None = None
    whitespace_chars: bytes = WHITESPACE
    keep_nulls: bool = False
    keep_blanks: bool = False
    include: str | None = None
    exclude: str | None = None
    longest: int | None = 131_071


def cleaned_text(c: Column, how: Cleaning) -> Column:
    """The clean-ups on the Latin-1 view of a line."""
    if how.dollar_hex:
        c = to_dollar_hex(c)
    chars = how.whitespace_chars or WHITESPACE
    if how.whitespace == "trim":
        c = trim(c, chars)
    elif how.whitespace == "strip":
        c = strip(c, chars)
    return c if how.keep_nulls else strip_nulls(c)


#: Flags before a pattern: a dot is any byte, only LF is a line end, classes such as \\w and \\s have letters and spaces beyond ASCII.
DIALECT = "(?sdU)"


def _stays(c: Column, how: Cleaning) -> Column:
    stay = F.lit(True)
    if how.include:
        stay = stay & c.rlike(DIALECT + how.include)
    if how.exclude:
        stay = stay & ~c.rlike(DIALECT + how.exclude)
    return stay


def counted(lines: DataFrame, how: Cleaning) -> DataFrame:
    """All lines with the cleaned one, and a flag for each counter; drop nothing yet."""
    c = latin1(F.col("line"))
    long = F.lit(False) if how.longest is None else F.octet_length("line") > how.longest
    hexed = to_dollar_hex(c) if how.dollar_hex else c
    chars = how.whitespace_chars or WHITESPACE
    spaced = {"trim": trim, "strip": strip}.get(how.whitespace, lambda x, _: x)(hexed, chars)
    out = lines.withColumns({"_long": long, "_c": c, "_hexed": hexed, "_spaced": spaced})
    out = out.withColumn("_clean", F.col("_spaced") if how.keep_nulls else strip_nulls(F.col("_spaced")))
    blank = F.length("_clean") == 0
    drop_blank = F.lit(False) if how.keep_blanks else blank
    out = out.withColumn("_stays", _stays(F.col("_clean"), how))  # a column of its own, so that the pattern runs once
    return out.withColumns({
        "skipped": F.col("_long"),
        "hexed": ~F.col("_long") & (F.col("_hexed") != F.col("_c")),
        "trimmed": F.lit(how.whitespace == "trim") & ~F.col("_long") & (F.col("_spaced") != F.col("_hexed")),
        "stripped": F.lit(how.whitespace == "strip") & ~F.col("_long") & (F.col("_spaced") != F.col("_hexed")),
        "nulls": F.lit(not how.keep_nulls) & ~F.col("_long") & (F.col("_clean") != F.col("_spaced")),
        "blank": ~F.col("_long") & blank,
        "filtered": ~F.col("_long") & ~drop_blank & ~F.col("_stays"),
        "keep": ~F.col("_long") & ~drop_blank & F.col("_stays"),
    })


#: Counters of a cleaning run.
COUNTERS = ("skipped", "hexed", "trimmed", "stripped", "nulls", "blank", "filtered")


def counter_columns() -> list[Column]:
    flags = [F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c) for c in COUNTERS]
    size = F.coalesce(F.sum(F.octet_length("line").cast("long") + 1), F.lit(0)).alias("bytes_read")
    return [F.count(F.lit(1)).alias("lines_read"), size, *flags, F.coalesce(F.sum(F.col("keep").cast("long")), F.lit(0)).alias("lines_kept")]


def clean(lines: DataFrame, how: Cleaning, observation=None) -> DataFrame:
    """The cleaned lines that stay, with all other columns. observation: a pyspark Observation that gets the counters of the pass."""
    if observation is None:
        c = cleaned_text(latin1(F.col("line")), how)
        if how.longest is not None:
            lines = lines.filter(F.octet_length("line") <= how.longest)
        # a generator of one row: filters on the cleaned line stay behind it, so the line is cleaned once
        out = lines.withColumn("_clean", F.explode(F.array(c)))
        if not how.keep_blanks:
            out = out.filter("_clean <> ''")
        return out.filter(_stays(F.col("_clean"), how)).withColumn("line", from_latin1(F.col("_clean"))).drop("_clean")
    out = counted(lines, how).observe(observation, *counter_columns()).filter("keep")
    return out.withColumn("line", from_latin1(F.col("_clean"))).select(*lines.columns)
