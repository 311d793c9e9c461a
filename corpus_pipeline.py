"""From raw documents to packed training sequences: five stages, each a table of its own.

quality: documents that the weakly supervised classifier rejects go.
lines: later copies of repeated line runs leave the texts; a document that is left with nothing but white space goes.
near_duplicates: of each class of documents of Jaccard similarity 0.8 or more on runs of five words, one with the smallest doc_id stays.
decontamination: documents that overlap with a benchmark item go.
packing: what is left is packed in sequences of 1024 token ids.

All but the last stage return the columns of documents, with their values, whatever their names (n_chars follows the text).

Rows: null, empty and blank texts are rejected by the first stage; texts of any length are taken whole; repeated rows and rows of equal doc_id are
documents of their own until the third stage, which keeps one of each class (ties: the smallest doc_id, then the smallest text hash); an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linemill.llm.common import all_of, hidden, saved
from linemill.llm.decontamination import decontaminated
from linemill.llm.line_dedup import line_deduplicated
from linemill.llm.near import one_of_each
from linemill.llm.packing import packed
from linemill.llm.quality import good_documents
from linemill.llm.queries import packed_digest, vocabulary


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return good_documents(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    removed = hidden(docs, "lines_removed")
    out = line_deduplicated(docs, removed=removed).filter((F.col(removed) == 0) | F.col("text").rlike(r"\S"))
    length = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return out.withColumns(length).select(*all_of(docs))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packed_digest(packed(docs, vocabulary()))


STAGES = [
    ("quality", keep_quality),
    ("lines", drop_repeated_lines),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: The classifier, minima of hashes and the packing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
