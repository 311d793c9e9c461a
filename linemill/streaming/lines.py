"""Lines as streams: new files of a folder, cleaned as they come, with distinct lines or running profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.bytes import category_mask, latin1
from ..operators.clean import Cleaning, clean


def stream_lines(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """line and at (the file's time) of files that arrive in a folder."""
    text = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(folder)
    return text.select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_modification_time").alias("at"))


def clean_stream(lines: DataFrame, how: Cleaning) -> DataFrame:
    return clean(lines, how)


def distinct_stream(lines: DataFrame, keep_for: str = "1 hour") -> DataFrame:
    """Lines not seen within the time that the state keeps them."""
    return lines.withWatermark("at", keep_for).dropDuplicatesWithinWatermark(["line"])


def profile_stream(lines: DataFrame) -> DataFrame:
    """Running counts by length and mask (output mode update or complete); both have bounded ranges."""
    return lines.groupBy(F.octet_length("line").alias("length"), category_mask(latin1(F.col("line"))).alias("mask")).agg(F.count(F.lit(1)).alias("n"))
