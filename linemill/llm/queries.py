"""The operators as queries over the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import line_dedup
from .common import table_path


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_rans_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_tokens, write_tokens

    return read_tokens(spark, write_tokens(_documents(spark, sf_dir), table_path(spark, "tokens"), vocabulary()), with_ids=False)


def op2_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .katz import katz_scores

    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10))
    return katz_scores(_documents(spark, sf_dir), fold != 0).withColumn("held_out", F.coalesce(fold == 0, F.lit(False)))


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .tool_calls import TURN_SCHEMAS, from_turns, linked

    out = linked(*from_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet")), TURN_SCHEMAS)
    return out.withColumn("errors", F.array_join("errors", ","))


def op4_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .vectors import neighbours

    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op5_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5))
    out = toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), fold != 0)
    return out.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_deduplicated(_documents(spark, sf_dir)).select("doc_id", "text", "lines_removed")


def op7_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import benchmark_overlaps

    return benchmark_overlaps(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near import near_duplicates

    return near_duplicates(_documents(spark, sf_dir)).drop("text_key")


def op9_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(_documents(spark, sf_dir)).select("doc_id", "score", F.col("keep").cast("int").alias("keep"))


def packed_digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed

    return packed_digest(packed(_documents(spark, sf_dir), vocabulary()))


QUERIES = {f.__name__: f for f in (op1_rans_tokens, op2_katz_backoff, op3_tool_calls, op4_posting_lists, op5_toxic_segments, op6_line_runs, op7_spaced_seeds, op8_minhash_join, op9_weak_labels, op10_bm25_packing)}

ORACLE_SQL: dict[str, str] = {
    "op3_tool_calls": """
with t as (select *, conv_id::varchar || ':' || turn::varchar as id from conversations),
c as (select conv_id, turn as seq, role as name, id, text, max(turn) filter (where role <> 'assistant') over w as up, row_number() over (partition by conv_id order by turn) - 1 as level
  from t where role <> 'assistant' window w as (partition by conv_id order by turn range between 2 preceding and 1 preceding)),
l as (select *, sum(case when up is null then 1 else 0 end) over (partition by conv_id order by seq) as chain from c),
k as (select * replace (row_number() over (partition by conv_id, chain order by seq) - 1 as level) from l),
j as (select k.*, r.text as result from k left join t r on r.conv_id = k.conv_id and r.turn = k.seq + 1 and r.role = 'assistant'),
e as (select *, list_filter([case when result is null then 'missing_result' end, case when length(text) > 4000 then 'range:chars' end, case when length(text) < 1 then 'range:text' end], lambda x: x is not null) as errors from j)
select id as call_id, conv_id, seq, level, name, len(errors) = 0 as valid, array_to_string(errors, ',') as errors,
  '{"arguments":{"chars":' || length(text) || ',"text":' || to_json(text) || '},"depends_on":' || (case when up is null then '[]' else '["' || conv_id || ':' || up || '"]' end)
  || ',"errors":' || to_json(errors) || ',"id":"' || id || '","level":' || level || ',"name":"' || name || '","result":' || coalesce(to_json(result), 'null') || ',"valid":' || (case when len(errors) = 0 then 'true' else 'false' end) || '}' as json
from e""",
    "op6_line_runs": line_dedup.SQL.format("documents", 50) + """
select d.doc_id, case when k.text is not null then k.new when p.text is not null then '' else d.text end as text, coalesce(len(p.places), 0) as lines_removed
from documents d left join places p on d.doc_id is not distinct from p.doc_id and d.text = p.text left join kept k on d.doc_id is not distinct from k.doc_id and d.text = k.text""",
}
