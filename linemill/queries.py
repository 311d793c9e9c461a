"""The operators as queries over the tables of a folder, each with SQL for the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.bytes import shard_key
from .operators import profile
from .operators.clean import Cleaning, clean
from .operators.ordering import duplicates, is_sorted, ranked, runs_sorted
from .operators.shards import chunk_plan, shard_histogram
from .plans.analyse import write_reports
from .plans.merge import MergeOptions, merge_stats, run_merge
from .sources.lines import column_lines, union_lines
from .sources.sinks import write_groups, write_text
from .storage import table_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Non-blank lines of documents."""
    return column_lines(_table(spark, sf_dir, "documents"), "text", *keep).filter(F.octet_length("line") > 0)


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut at full stops: pieces that begin with spaces and line ends."""
    cut = _table(spark, sf_dir, "documents").select(F.explode(F.split("text", r"\.")).alias("t"))
    return cut.select(F.encode("t", "UTF-8").alias("line"))


def _spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces whose letters q are tabs and x vertical tabs, so that every default white-space byte occurs."""
    return _pieces(spark, sf_dir).select(F.encode(F.translate(F.decode("line", "UTF-8"), "qx", "\t\x0b"), "UTF-8").alias("line"))


def _text(df: DataFrame) -> DataFrame:
    return df.withColumn("line", F.decode("line", "UTF-8"))


def lines_scan(spark, sf_dir):
    return _text(_lines(spark, sf_dir, "doc_id"))


def merge_dictionary(spark, sf_dir):
    return _text(ranked(_lines(spark, sf_dir).distinct()))


def merge_length(spark, sf_dir):
    return _text(ranked(_lines(spark, sf_dir).distinct(), "length"))


def merge_leave_duplicates(spark, sf_dir):
    return _text(ranked(_lines(spark, sf_dir)))


def merge_save_duplicates(spark, sf_dir):
    return _text(duplicates(_lines(spark, sf_dir)))


def _cleaned(spark, sf_dir, lines, **how):
    return _text(clean(lines, Cleaning(**({"longest": None} | how))).distinct())


def dollar_hex(spark, sf_dir):
    return _cleaned(spark, sf_dir, _lines(spark, sf_dir), dollar_hex=True)


def trim_whitespace(spark, sf_dir):
    return _cleaned(spark, sf_dir, _spaced(spark, sf_dir), whitespace="trim")


def strip_whitespace(spark, sf_dir):
    return _cleaned(spark, sf_dir, _spaced(spark, sf_dir), whitespace="strip")


def strip_chars(spark, sf_dir):
    return _cleaned(spark, sf_dir, _lines(spark, sf_dir), whitespace="strip", whitespace_chars=b"et,")


def _with_nulls(spark, sf_dir):
    return _lines(spark, sf_dir).select(F.encode(F.replace(F.decode("line", "UTF-8"), F.lit("e"), F.lit("\x00")), "UTF-8").alias("line"))


def strip_nulls(spark, sf_dir):
    return _cleaned(spark, sf_dir, _with_nulls(spark, sf_dir))


def keep_nulls(spark, sf_dir):
    out = clean(_with_nulls(spark, sf_dir), Cleaning(keep_nulls=True, longest=None)).distinct()
    return out.select(F.lower(F.hex("line")).alias("line"))


def keep_blanks(spark, sf_dir):
    kept = clean(_pieces(spark, sf_dir), Cleaning(whitespace="trim", keep_blanks=True, longest=None))
    return _text(kept).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def drop_blanks(spark, sf_dir):
    kept = clean(_pieces(spark, sf_dir), Cleaning(whitespace="trim", longest=None))
    return _text(kept).groupBy("line").agg(F.count(F.lit(1)).alias("n"))


def include_regex(spark, sf_dir):
    return _cleaned(spark, sf_dir, _lines(spark, sf_dir), include="[0-9]{3,}")


def exclude_regex(spark, sf_dir):
    return _cleaned(spark, sf_dir, _lines(spark, sf_dir), exclude="[0-9]{3,}")


def skip_long_lines(spark, sf_dir):
    return _cleaned(spark, sf_dir, _lines(spark, sf_dir), longest=1023)


def multi_source_merge(spark, sf_dir):
    parts = [column_lines(_table(spark, sf_dir, t), "text") for t in ("documents", "conversations", "benchmark")]
    return _text(clean(union_lines(*parts), Cleaning(longest=None)).distinct())


def shard_histogram_1(spark, sf_dir):
    return shard_histogram(_lines(spark, sf_dir), 1)


def shard_histogram_2(spark, sf_dir):
    return shard_histogram(_lines(spark, sf_dir), 2)


def shard_key_40(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy(shard_key(F.col("line"), 40).alias("shard")).agg(F.count(F.lit(1)).alias("n"))


def chunk_plan_64k(spark, sf_dir):
    return chunk_plan(shard_histogram(_lines(spark, sf_dir), 1), 65_536).withColumn("chunk", F.col("chunk").cast("long"))


def length_histogram(spark, sf_dir):
    return profile.length_histogram(profile.measured(_lines(spark, sf_dir, "lang"), "lang"), "lang", dense=True)


def _by_source(spark, sf_dir):
    return profile.measured(_lines(spark, sf_dir, "source"), "source")


def category_any(spark, sf_dir):
    return profile.category_any(_by_source(spark, sf_dir), "source")


def category_full(spark, sf_dir):
    return profile.category_full(_by_source(spark, sf_dir), "source").withColumn("mask", F.col("mask").cast("long"))


def charset_friendly(spark, sf_dir):
    return profile.charsets(_by_source(spark, sf_dir), "source")


def profile_summary(spark, sf_dir):
    return profile.summary(_by_source(spark, sf_dir), "source")


def merge_counters(spark, sf_dir):
    options = MergeOptions(whitespace="trim", include_by_regex="[a-m]", keep_nulls=False)
    return merge_stats(_spaced(spark, sf_dir), options).select("lines_read", "bytes_read", "trimmed", "blank", "filtered", "lines_kept", "lines_written", "bytes_written", "duplicates")


def pipeline_all(spark, sf_dir):
    options = Cleaning(dollar_hex=True, whitespace="strip", exclude="[0-9]{3,}", longest=2047)
    return _text(ranked(clean(_lines(spark, sf_dir), options).distinct(), "length"))


def hex_round_trip(spark, sf_dir):
    lines = _lines(spark, sf_dir).distinct()
    coded = clean(lines, Cleaning(dollar_hex=True, keep_nulls=True, longest=None))
    return _text(profile.decoded(coded))


def sorted_flag(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    at = F.posexplode(F.split("text", r"[\r\n]+"))
    lines = d.filter(F.col("text").isNotNull()).select("doc_id", at.alias("i", "t")).select((F.col("doc_id") * 1_000_000 + F.col("i")).alias("at"), F.encode("t", "UTF-8").alias("line"))
    return is_sorted(lines, "at")


def top_lines(spark, sf_dir):
    """The twenty shortest, then smallest, lines."""
    return _text(_lines(spark, sf_dir).distinct().orderBy(F.octet_length("line"), "line").limit(20))


def page_lines(spark, sf_dir):
    return _text(clean(column_lines(_table(spark, sf_dir, "pages"), "html"), Cleaning(whitespace="trim", longest=None)).distinct())


def name_lines(spark, sf_dir):
    """Word lists of the relational tables, merged."""
    parts = [_table(spark, sf_dir, t).select(F.encode(c, "UTF-8").alias("line")) for t, c in (("customer", "c_name"), ("part", "p_name"), ("nation", "n_name"), ("events", "event_type"))]
    return _text(ranked(clean(union_lines(*parts), Cleaning(longest=None)).distinct(), "length"))


def ranked_with_source(spark, sf_dir):
    """Ranks of all lines with their documents: for each line its first and last rank, how many it has, and the sum of its documents' ids."""
    out = ranked(_lines(spark, sf_dir, "doc_id")).withColumn("block", F.expr("rank div 1024"))
    # a line's ranks are brought together in small blocks, once: a count of distinct ones over the line would move every row a second time
    once = out.repartition("line", "block").groupBy("line", "block", "rank").agg(F.sum("doc_id").alias("ids"))
    blocks = once.groupBy("line", "block").agg(F.min("rank").alias("first"), F.max("rank").alias("last"), F.count("rank").alias("ranks"), F.sum("ids").alias("ids"))
    return _text(blocks.groupBy("line").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("ranks").alias("ranks"), F.sum("ids").alias("ids")))


def clean_counters(spark, sf_dir):
    """Every counter of a cleaning pass that uses all of its steps."""
    lines = _with_nulls(spark, sf_dir).unionByName(_spaced(spark, sf_dir))
    options = MergeOptions(whitespace="strip", convert_to_dollar_hex=True, exclude_by_regex="[0-9]{2}", line_buffer_size=1024, leave_duplicates=True)
    return merge_stats(lines, options).select("lines_read", "skipped", "hexed", "stripped", "nulls", "blank", "filtered", "lines_kept", "lines_written")


def _files(spark, sf_dir) -> str:
    """A folder with the texts of documents as files of lines: LF in en ones, CR LF in de ones, CR in others; NUL bytes for q; and an empty file."""
    folder = table_path(spark, "texts")
    docs = _table(spark, sf_dir, "documents").filter("text is not null")
    end = F.when(F.col("lang") == "en", F.lit("\n")).when(F.col("lang") == "de", F.lit("\r\n")).otherwise(F.lit("\r"))
    text = F.replace(F.replace("text", F.lit("\n"), end), F.lit("q"), F.lit("\x00"))
    docs.select(text.alias("value")).write.text(f"{folder}/a")
    spark.createDataFrame([], "value string").coalesce(1).write.text(f"{folder}/b")
    write_text(spark, f"{folder}/b/empty.txt", "")
    return folder


def _read_back(spark, path: str, order: str = "dictionary"):
    """A written file's lines, each with whether the whole file is in order."""
    lines = spark.read.text(path, lineSep="\n").select(F.col("value").cast("binary").alias("line"), F.col("_metadata.file_block_start").alias("block"))
    flag = runs_sorted(lines, "block", order)
    return _text(lines.select("line")).join(F.broadcast(flag), F.lit(True))  # one row


def _merged_files(spark, sf_dir, order="dictionary", **options):
    out = table_path(spark, "merged") + ".txt"
    run_merge(spark, MergeOptions([_files(spark, sf_dir)], out, sort_by=order, line_buffer_size=options.pop("line_buffer_size", 64 * 1024), **options))
    return out


def merge_files_dictionary(spark, sf_dir):
    return _read_back(spark, _merged_files(spark, sf_dir))


def merge_files_length(spark, sf_dir):
    return _read_back(spark, _merged_files(spark, sf_dir, "length", exact=True), "length")


def merge_files_leave(spark, sf_dir):
    out = _read_back(spark, _merged_files(spark, sf_dir, leave_duplicates=True, single_file=True))
    return out.groupBy("line", "is_sorted").agg(F.count(F.lit(1)).alias("n"))


def merge_files_duplicates(spark, sf_dir):
    return _read_back(spark, _merged_files(spark, sf_dir, save_duplicates=True) + ".duplicates")


def merge_files_skip(spark, sf_dir):
    """Lines of 1,024 bytes or more are passed over by the exact reader, which never holds them whole."""
    return _read_back(spark, _merged_files(spark, sf_dir, exact=True, line_buffer_size=1024))


def merge_files_stats(spark, sf_dir):
    out = spark.read.text(_merged_files(spark, sf_dir, save_stats=True) + ".stats")
    row = F.from_json("value", "lines_read long, nulls long, blank long, lines_kept long, lines_written long, bytes_written long, duplicates long")
    return out.filter("value like '{%'").select(row.alias("s")).select("s.*")


def _analysed(spark, sf_dir):
    """Reports of one file for each language, read back: file (its language) and the report's lines."""
    folder = table_path(spark, "texts")
    name = F.concat(F.lit("x"), F.hex(F.encode("lang", "UTF-8")))  # any text, an empty one too, as a file name
    write_groups(_lines(spark, sf_dir, "lang").filter("lang is not null").select(name.alias("lang"), "line"), "lang", folder)
    write_reports(spark, [re.sub("^file:/+", "/", folder)] if folder.startswith("file:") or "://" not in folder else [folder])
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.Analysis.txt").text(folder)
    lang = F.regexp_extract(F.col("_metadata.file_path"), r"/lang=x([0-9A-F]*)\.Analysis\.txt$", 1)
    return found.select(F.decode(F.unhex(lang), "UTF-8").alias("lang"), "value")


def analyse_files(spark, sf_dir):
    """Total lines and counts by class and charset, out of the text reports of files."""
    at = F.regexp_extract("value", r"^([A-Za-z][A-Za-z ]*): ([0-9,]+)( \(|$)", 1)
    n = F.replace(F.regexp_extract("value", r"^([A-Za-z][A-Za-z ]*): ([0-9,]+)( \(|$)", 2), F.lit(",")).try_cast("long")
    return _analysed(spark, sf_dir).select("lang", at.alias("name"), n.alias("n")).filter("name <> '' and n is not null").distinct()


QUERIES = {f.__name__: f for f in (lines_scan, merge_dictionary, merge_length, merge_leave_duplicates, merge_save_duplicates, dollar_hex, trim_whitespace, strip_whitespace, strip_chars, strip_nulls, keep_nulls, keep_blanks, drop_blanks, include_regex, exclude_regex, skip_long_lines, multi_source_merge, shard_histogram_1, shard_histogram_2, shard_key_40, chunk_plan_64k, length_histogram, category_any, category_full, charset_friendly, profile_summary, merge_counters, pipeline_all, hex_round_trip, sorted_flag, top_lines, page_lines, name_lines, ranked_with_source, clean_counters, merge_files_dictionary, merge_files_length, merge_files_leave, merge_files_duplicates, merge_files_skip, merge_files_stats, analyse_files)}

_SPLIT = r"unnest(regexp_split_to_array({}, '[\r\n]+'))"
_LN = f"(select doc_id, lang, source, line from (select doc_id, lang, source, {_SPLIT.format('text')} as line from documents) where line <> '')"
_PIECES = "(select unnest(string_split(text, '.')) as line from documents)"
_SPACED = "(select translate(line, 'qx', chr(9) || chr(11)) as line from " + _PIECES + ")"
_WS = "' ' || chr(9) || chr(11)"
_HEX = r"case when regexp_matches(line, '[^\x20-\x7e]') then '$HEX[' || lower(hex(encode(line))) || ']' else line end"
_STRIP = "translate(line, " + _WS + ", '')"
_MASK = r"""(case when regexp_matches(line, '[A-Z]') then 1 else 0 end + case when regexp_matches(line, '[a-z]') then 2 else 0 end + case when regexp_matches(line, '[0-9]') then 4 else 0 end
+ case when regexp_matches(line, '[!-/:-@\[-`{-~]') then 8 else 0 end + case when regexp_matches(line, '[\x20\x09\x0b]') then 16 else 0 end + case when regexp_matches(line, '[\x00-\x08\x0a\x0c-\x1f]') then 32 else 0 end
+ case when regexp_matches(line, '[^\x00-\x7e]') then 64 else 0 end)"""
_M = f"(select source, {_MASK} as mask from {_LN})"
_CLASSES = "(values (1, 'UppercaseLetter'), (2, 'LowercaseLetter'), (4, 'Number'), (8, 'Punctuation'), (16, 'Whitespace'), (32, 'LowControl'), (64, 'HighNonAscii')) c(bit, name)"
_TOTALS = "(select source, count(*) as total from m group by 1)"
_CHARSET = """case when mask = 0 then 'Empty' else (case when mask & 3 = 3 then 'Mixed' when mask & 1 <> 0 then 'Upper' when mask & 2 <> 0 then 'Lower' else '' end) || (case when mask & 4 <> 0 then 'Number' else '' end)
|| (case when mask & 24 <> 0 then 'Symbol' else '' end) || (case when mask & 32 <> 0 then 'Special' else '' end) || (case when mask & 64 <> 0 then 'Extended' else '' end) end"""
_NAMES = f"coalesce((select string_agg(name, ', ' order by bit) from {_CLASSES} where mask & bit <> 0), 'Empty')"
_FILES = "(select line as raw, replace(line, chr(0), '') as line from (select unnest(string_split(replace(text, 'q', chr(0)), chr(10))) as line from documents))"
_SHARD = "lower(substr(hex(encode(line)), 1, 2))"

ORACLE_SQL = {
    "lines_scan": f"select doc_id, line from {_LN}",
    "merge_dictionary": f"select line, row_number() over (order by line) as rank from (select distinct line from {_LN})",
    "merge_length": f"select line, row_number() over (order by strlen(line), line) as rank from (select distinct line from {_LN})",
    "merge_leave_duplicates": f"select line, row_number() over (order by line) as rank from {_LN}",
    "merge_save_duplicates": f"select line, count(*) as n from {_LN} group by 1 having count(*) > 1",
    "dollar_hex": f"select distinct {_HEX} as line from {_LN}",
    "trim_whitespace": f"select distinct line from (select trim(line, {_WS}) as line from {_SPACED}) where line <> ''",
    "strip_whitespace": f"select distinct line from (select {_STRIP} as line from {_SPACED}) where line <> ''",
    "strip_chars": f"select distinct line from (select translate(line, 'et,', '') as line from {_LN}) where line <> ''",
    "strip_nulls": f"select distinct line from (select replace(line, 'e', '') as line from {_LN}) where line <> ''",
    "keep_nulls": f"select distinct lower(hex(encode(replace(line, 'e', chr(0))))) as line from {_LN}",
    "keep_blanks": f"select trim(line, {_WS}) as line, count(*) as n from {_PIECES} group by 1",
    "drop_blanks": f"select trim(line, {_WS}) as line, count(*) as n from {_PIECES} where trim(line, {_WS}) <> '' group by 1",
    "include_regex": f"select distinct line from {_LN} where regexp_matches(line, '[0-9]{{3,}}')",
    "exclude_regex": f"select distinct line from {_LN} where not regexp_matches(line, '[0-9]{{3,}}')",
    "skip_long_lines": f"select distinct line from {_LN} where strlen(line) <= 1023",
    "multi_source_merge": f"select distinct line from (select {_SPLIT.format('text')} as line from documents union all select {_SPLIT.format('text')} from conversations union all select {_SPLIT.format('text')} from benchmark) where line <> ''",
    "shard_histogram_1": f"select {_SHARD} as shard, count(*) as lines, sum(strlen(line) + 1)::bigint as bytes from {_LN} group by 1",
    "shard_histogram_2": f"select lower(substr(hex(encode(line)), 1, 4)) || (case when strlen(line) < 2 then '!' else '' end) as shard, count(*) as lines, sum(strlen(line) + 1)::bigint as bytes from {_LN} group by 1",
    "shard_key_40": f"select case when strlen(line) < 40 then '!' else lower(substr(hex(encode(line)), 79, 2)) end as shard, count(*) as n from {_LN} group by 1",
    "chunk_plan_64k": f"""with recursive s as (select *, row_number() over (order by shard) as i from (select {_SHARD} as shard, count(*) as lines, sum(strlen(line) + 1)::bigint as bytes from {_LN} group by 1)),
r as (select i, shard, lines, bytes, 0::bigint as chunk, bytes as b, lines as n from s where i = 1
union all select s.i, s.shard, s.lines, s.bytes, r.chunk + (case when r.b + s.bytes > 65536 or r.n + s.lines > 2147483647 then 1 else 0 end),
case when r.b + s.bytes > 65536 or r.n + s.lines > 2147483647 then s.bytes else r.b + s.bytes end, case when r.b + s.bytes > 65536 or r.n + s.lines > 2147483647 then s.lines else r.n + s.lines end from r join s on s.i = r.i + 1)
select shard, lines, bytes, chunk from r""",
    "length_histogram": f"""with h as (select lang, strlen(line) as length, count(*) as n from {_LN} group by all),
e as (select lang, unnest(range(0, max(length) + 1)) as length from h group by 1)
select e.lang, e.length, coalesce(h.n, 0) as n from e left join h on e.lang is not distinct from h.lang and e.length = h.length""",
    "category_any": f"""with m as {_M} select k.source, k.name as category, k.n, round(k.n / t.total, 6) as share
from (select source, name, sum(case when mask & bit <> 0 then 1 else 0 end)::bigint as n from m, {_CLASSES} group by all) k join {_TOTALS} t using (source)""",
    "category_full": f"""with m as {_M}, g as (select source, mask, count(*) as n from m group by all)
select g.source, g.mask::bigint as mask, g.n, coalesce((select string_agg(name, ', ' order by bit) from {_CLASSES} where g.mask & bit <> 0), 'Empty') as categories, round(g.n / t.total, 6) as share from g join {_TOTALS} t using (source)""",
    "charset_friendly": f"with m as {_M} select k.source, k.charset, k.n, round(k.n / t.total, 6) as share from (select source, {_CHARSET} as charset, count(*) as n from m group by all) k join {_TOTALS} t using (source)",
    "profile_summary": f"select source, count(*) as lines, sum(strlen(line) + 1)::bigint as bytes, round(sum(strlen(line) + 1) / count(*), 6) as average_length from {_LN} group by 1",
    "merge_counters": f"""with a as (select line, trim(line, {_WS}) as t from {_SPACED}), k as (select t from a where t <> '' and regexp_matches(t, '[a-m]'))
select (select count(*) from a) as lines_read, (select sum(strlen(line) + 1)::bigint from a) as bytes_read, (select count(*) from a where t <> line) as trimmed, (select count(*) from a where t = '') as blank,
(select count(*) from a where t <> '' and not regexp_matches(t, '[a-m]')) as filtered, (select count(*) from k) as lines_kept, (select count(distinct t) from k) as lines_written,
(select sum(strlen(t) + 1)::bigint from (select distinct t from k)) as bytes_written, (select count(*) - count(distinct t) from k) as duplicates""",
    "pipeline_all": f"""select line, row_number() over (order by strlen(line), line) as rank from (select distinct line from (select translate(h, {_WS}, '') as line from (select {_HEX} as h from {_LN} where strlen(line) <= 2047))
where line <> '' and not regexp_matches(line, '[0-9]{{3,}}'))""",
    "hex_round_trip": f"select distinct line from {_LN}",
    "sorted_flag": r"""with l as (select doc_id, unnest(regexp_split_to_array(text, '[\r\n]+')) as line, generate_subscripts(regexp_split_to_array(text, '[\r\n]+'), 1) as i from documents),
k as (select line, lag(line) over (order by doc_id, i) as p from l) select coalesce(bool_and(p <= line), true) as is_sorted from k where p is not null""",
    "top_lines": f"select line from (select distinct line from {_LN}) order by strlen(line), line limit 20",
    "page_lines": f"select distinct line from (select trim(line, {_WS}) as line from (select {_SPLIT.format('html')} as line from pages)) where line <> ''",
    "ranked_with_source": f"""select line, min(rank) as first, max(rank) as last, count(distinct rank) as ranks, sum(doc_id)::bigint as ids
from (select line, doc_id, row_number() over (order by line) as rank from {_LN}) group by 1""",
    "clean_counters": f"""with l as (select replace(line, 'e', chr(0)) as line from {_LN} union all select line from {_SPACED}), s as (select *, strlen(line) > 1023 as long from l),
h as (select *, {_HEX} as h from s), t as (select *, translate(h, {_WS}, '') as t from h), n as (select *, replace(t, chr(0), '') as c from t), f as (select *, regexp_matches(c, '[0-9]{{2}}') as bad from n)
select count(*) as lines_read, count(*) filter (where long) as skipped, count(*) filter (where not long and h <> line) as hexed, count(*) filter (where not long and t <> h) as stripped,
count(*) filter (where not long and c <> t) as nulls, count(*) filter (where not long and c = '') as blank, count(*) filter (where not long and c <> '' and bad) as filtered,
count(*) filter (where not long and c <> '' and not bad) as lines_kept, count(*) filter (where not long and c <> '' and not bad) as lines_written from f""",
    "merge_files_dictionary": f"select distinct line, true as is_sorted from {_FILES} where line <> '' and strlen(raw) < 65536",
    "merge_files_length": f"select distinct line, true as is_sorted from {_FILES} where line <> '' and strlen(raw) < 65536",
    "merge_files_leave": f"select line, true as is_sorted, count(*) as n from {_FILES} where line <> '' and strlen(raw) < 65536 group by 1",
    "merge_files_duplicates": f"select line, true as is_sorted from {_FILES} where line <> '' and strlen(raw) < 65536 group by 1 having count(*) > 1",
    "merge_files_skip": f"select distinct line, true as is_sorted from {_FILES} where line <> '' and strlen(raw) < 1024",
    "merge_files_stats": f"""with f as (select * from {_FILES}), k as (select line from f where line <> '' and strlen(raw) < 65536)
select (select count(*) from f) as lines_read, (select count(*) from f where strlen(raw) < 65536 and line <> raw) as nulls, (select count(*) from f where line = '') as blank,
(select count(*) from k) as lines_kept, (select count(distinct line) from k) as lines_written, (select sum(strlen(line) + 1)::bigint from (select distinct line from k)) as bytes_written,
(select count(*) - count(distinct line) from k) as duplicates""",
    "analyse_files": f"""with m as (select lang, {_MASK} as mask from {_LN} where lang is not null),
k as (select lang, name, sum(case when mask & bit <> 0 then 1 else 0 end)::bigint as n from m, {_CLASSES} group by all)
select lang, 'Total Lines' as name, count(*) as n from m group by 1 union select lang, name, n from k union select lang, {_CHARSET} as name, count(*) as n from m group by all
union select lang, {_NAMES}, count(*) from m group by lang, mask having bit_count(mask) < 2""",
    "name_lines": "select line, row_number() over (order by strlen(line), line) as rank from (select c_name as line from customer union select p_name from part union select n_name from nation union select event_type from events) where line <> ''",
}
