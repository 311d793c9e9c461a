"""The merge plan: read, clean, distinct, sort, write, with counters."""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.bytes import WHITESPACE
from ..functions.sizes import format_size, format_span, parse_size
from ..operators.clean import COUNTERS, DIALECT, Cleaning, clean, counter_columns, counted
from ..operators.ordering import ORDERS, merged
from ..sources.lines import read_lines
from ..sources.sinks import write_file, write_parts, write_text
from ..storage import dropped, saved

KB, MB, GB, TB = 1024, 1024**2, 1024**3, 1024**4
#: Resource settings: default, least and most bytes (fixed values). They are checked; Spark sizes its own memory.
SIZES = {
    "max_sort_size": (64 * MB, 256 * KB, 64 * TB),
    "slab_size": (4 * MB, 256 * KB, GB),
    "line_buffer_size": (128 * KB, KB, 128 * KB),
    "read_file_buffer_size": (128 * KB, KB, 128 * MB),
    "temp_file_buffer_size": (128 * KB, KB, 8 * MB),
    "output_file_buffer_size": (256 * KB, KB, 8 * MB),
    "large_threshold": (GB, MB, None),
    "large_chunk": (256 * MB, MB, None),
    "single_file_limit": (64 * GB, 0, None),
}


@dataclass
class MergeOptions:
    """Settings of a merge. Sizes are bytes or text such as '64 MB'.

    single_file: the output is one file (True), a folder of ordered parts (False), or one file up to single_file_limit bytes (None). line_buffer_size: lines of its size or longer are skipped and counted. large_chunk: bytes of a file that a
    task reads at most. The other sizes, workers, split_count, sort_algorithm, force_large_sort and temp_folder are accepted and checked, and
    have no effect: Spark plans splits, memory, spilling and the sort.
    """

    inputs: list[str] = field(default_factory=list)
    output: str = ""
    leave_duplicates: bool = False
    save_duplicates: bool = False
    save_stats: bool = False
    sort_by: str = "dictionary"
    whitespace: str = "nochange"
    whitespace_chars: bytes = WHITESPACE
    keep_nulls: bool = False
    keep_blanks: bool = False
    include_by_regex: str | None = None
    exclude_by_regex: str | None = None
    convert_to_dollar_hex: bool = False
    exact: bool = False
    single_file: bool | None = None
    max_sort_size: int | str = SIZES["max_sort_size"][0]
    slab_size: int | str = SIZES["slab_size"][0]
    line_buffer_size: int | str = SIZES["line_buffer_size"][0]
    read_file_buffer_size: int | str = SIZES["read_file_buffer_size"][0]
    temp_file_buffer_size: int | str = SIZES["temp_file_buffer_size"][0]
    output_file_buffer_size: int | str = SIZES["output_file_buffer_size"][0]
    large_threshold: int | str = SIZES["large_threshold"][0]
    large_chunk: int | str = SIZES["large_chunk"][0]
    single_file_limit: int | str = SIZES["single_file_limit"][0]
    split_count: int = 16
    split_workers: int = 0
    sort_workers: int = 0
    io_workers: int = 8
    max_outstanding_sorted_chunks: int = 2
    sort_algorithm: str = "auto"
    force_large_sort: bool = False
    temp_folder: str | None = None

    def size(self, name: str) -> int:
        value = getattr(self, name)
        return parse_size(value) if isinstance(value, str) else value

    def errors(self, spark: SparkSession | None = None) -> list[str]:
        """What is wrong. Patterns are compiled in Spark's dialect, so only with a session."""
        out = []
        if not self.inputs:
            out.append("inputs are required")
        if not self.output:
            out.append("output is required")
        sizes = {}
        for name, (_, least, most) in SIZES.items():
            try:
                sizes[name] = self.size(name)
            except ValueError as e:
                out.append(f"{name}: {e}")
                continue
            if sizes[name] < least:
                out.append(f"{name} must be {format_size(least)} at least")
            if most and sizes[name] > most:
                out.append(f"{name} must be {format_size(most)} at most")
        slab = sizes.get("slab_size", 0)
        if slab > 0 and slab & (slab - 1):
            out.append("slab_size must be a power of two")
        if sizes.get("max_sort_size", 0) > slab * 65532 > 0:
            out.append("max_sort_size must be 65532 slabs at most")
        if sizes.get("large_chunk", 0) > sizes.get("large_threshold", 0) > 0:
            out.append("large_chunk must be large_threshold at most")
        if not 1 <= self.split_count <= 128:
            out.append("split_count must be from 1 to 128")
        if self.sort_by.lower() not in ORDERS:
            out.append(f"sort_by must be one of {', '.join(ORDERS)}")
        if self.whitespace.lower() not in ("nochange", "trim", "strip"):
            out.append("whitespace must be nochange, trim or strip")
        if self.sort_algorithm.lower() not in ("auto", "defaultarray", "linqorderby", "timsort"):
            out.append("sort_algorithm is not known")
        if self.include_by_regex and self.exclude_by_regex:
            out.append("include_by_regex and exclude_by_regex exclude each other")
        for name in ("include_by_regex", "exclude_by_regex"):
            pattern = getattr(self, name)
            if pattern:
                if spark is None:
                    continue
                try:
                    spark.range(1).select(F.lit("").rlike(DIALECT + pattern)).collect()
                except Exception as e:  # noqa: BLE001  Spark wraps what its dialect refuses
                    out.append(f"{name} is not valid: {str(e).splitlines()[0]}")
        return out

    def validate(self, spark: SparkSession | None = None) -> None:
        if found := self.errors(spark):
            raise ValueError("; ".join(found))

    def cleaning(self) -> Cleaning:
        white = self.whitespace.lower()
        return Cleaning(self.convert_to_dollar_hex, None if white == "nochange" else white, self.whitespace_chars or WHITESPACE, self.keep_nulls, self.keep_blanks, self.include_by_regex, self.exclude_by_regex, self.size("line_buffer_size") - 1)


def merge_lines(lines: DataFrame, options: MergeOptions) -> DataFrame:
    """The merged lines as a plan, for lines from anywhere."""
    return merged(clean(lines, options.cleaning()), options.sort_by.lower(), options.leave_duplicates)


def merge_stats(lines: DataFrame, options: MergeOptions) -> DataFrame:
    """One row of counters: lines and bytes read, what each step touched, lines and bytes written, duplicates removed.

    One pass: the lines grouped by what they become, with the counters of each group, and then the groups' sums.
    """
    flagged = counted(lines, options.cleaning())
    groups = flagged.withColumn("_line", F.when(F.col("keep"), F.col("_clean"))).groupBy("_line").agg(*counter_columns())
    times = F.col("lines_kept") if options.leave_duplicates else F.lit(1)
    size = F.when(F.col("_line").isNotNull(), times * (F.length("_line").cast("long") + 1))
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("lines_read", "bytes_read", *COUNTERS, "lines_kept")]
    written = F.coalesce(F.sum(F.when(F.col("_line").isNotNull(), times)), F.lit(0)).cast("long").alias("lines_written")
    out = groups.agg(*sums, written, F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes_written"))
    return out.withColumn("duplicates", F.col("lines_kept") - F.col("lines_written"))


def run_merge(spark: SparkSession, options: MergeOptions) -> dict:
    """Merges files to options.output; returns the counters. Sidecars: <output>.duplicates and <output>.stats.

    The input is read and cleaned once, into a table of distinct lines with their numbers; the output, duplicates and counters come from that table.
    """
    options.validate(spark)
    began = time.time()
    split = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(split)
    spark.conf.set(split, str(min(options.size("large_chunk"), 128 * MB)))
    stored = None
    try:
        lines = read_lines(spark, options.inputs, exact=options.exact, longest=options.size("line_buffer_size") - 1)
        seen, order = Observation("merge"), options.sort_by.lower()
        # the observed plan runs once, into a table; a range exchange that sampled it would count lines twice
        stored = saved(clean(lines, options.cleaning(), seen).groupBy("line").agg(F.count(F.lit(1)).alias("n")), "merge")
        times = F.col("n") if options.leave_duplicates else F.lit(1)
        out = stored.agg(F.coalesce(F.sum(times), F.lit(0)).cast("long").alias("lines_written"), F.coalesce(F.sum(times * (F.octet_length("line").cast("long") + 1)), F.lit(0)).alias("bytes_written")).first().asDict()
        # a plan that turns out empty is replaced, and its observation with it
        read = seen.get if out["lines_written"] else counted(lines, options.cleaning()).agg(*counter_columns()).first().asDict()
        copies = "n" if options.leave_duplicates else None
        single = options.single_file if options.single_file is not None else out["bytes_written"] <= options.size("single_file_limit")
        wrote = write_file(stored, options.output, order, copies) if single else (write_parts(stored, options.output, order, copies) or True)
        stats = {**read, **out}
        stats["duplicates"] = stats["lines_kept"] - stats["lines_written"]
        stats["output"] = options.output if wrote else None
        if options.save_duplicates:
            write_file(stored.filter("n > 1"), f"{options.output}.duplicates", order)
    finally:
        spark.conf.set(split, before)
        if stored is not None:
            dropped(stored)
    stats["seconds"] = round(time.time() - began, 3)
    if options.save_stats:
        named = [f"{k}: {v}" for k, v in stats.items()]
        write_text(spark, f"{options.output}.stats", "\n".join([*named, f"size written: {format_size(stats['bytes_written'])}", f"time: {format_span(stats['seconds'])}", json.dumps(stats)]) + "\n")
    return stats
