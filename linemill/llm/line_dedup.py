"""Removal of repeated line runs, by a suffix array over line ids and distributed prefix doubling.

The non-blank lines of all documents form sequences of line ids. A suffix's rank at depth 2**k comes from the pair of
its rank at depth 2**(k-1) and that of the suffix 2**(k-1) lines further on; pairs that occur once leave the table, so each round
holds repeated runs only. Suffixes that share their first l lines are an interval of the suffix array with a
longest common prefix of l or more, and have one rank at depth l: it is read off two overlapping powers of two.

A run counts if it has `min_words` words. Every repeated run that counts is covered by its shortest ones:
those that end as soon as they have the words, counted forwards from a line or backwards from it.
Of each such run the first occurrence (by doc_id, then place) stays and the lines of all later ones go. So a line goes exactly
if some run that counts holds it and has occurred before.

Rows: lines are equal if their bytes are (told apart by 128-bit hashes, as texts of equal doc_id are). Blank lines are in no run and stay. Null
texts stay null, empty ones empty; a null doc_id comes first; rows of equal doc_id and text are one document (each is returned, edited alike);
equal doc_ids with other texts go by the text's hash. A text of any length is taken whole: its lines are rows. An empty table gives no rows. Columns
other than text pass through, whatever their names; one with the name of the result column makes way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import all_of, dropped, hidden, saved

_DOC = ["doc1", "doc2"]


def _keys(text) -> dict:
    """A document's keys: its doc_id, and what tells texts of equal doc_id apart."""
    return {"doc1": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "doc2": F.unhex(F.md5(text))}


def _once(texts: DataFrame) -> DataFrame:
    """One row of each document. Repeated rows are found by their keys alone, so only they are exchanged with their texts."""
    repeated = saved(texts.groupBy(*_DOC).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(*_DOC), "repeated")
    if repeated.isEmpty():
        return texts
    alone = texts.join(repeated.hint("merge"), _DOC, "left_anti")
    return alone.unionByName(texts.join(repeated.hint("merge"), _DOC, "left_semi").dropDuplicates(_DOC).select(*texts.columns))


def later_lines(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """doc1, doc2 (a document's keys) and places: the line numbers, from 0, to remove.

    What is counted by a key and joined by it is a table first: both sides of the join are then exchanged, and Spark can split a frequent line.
    """
    text = F.col("text").cast("string")
    text = _once(docs.select(*[c.alias(n) for n, c in _keys(text).items()], text.alias("text")).filter("text is not null"))
    lines = text.select(*_DOC, F.posexplode(F.split("text", "\n")).alias("place", "line")).select(*_DOC, "place", F.unhex(F.md5("line")).alias("line"), F.size(F.filter(F.split("line", r"[ \t\r\x0b\x0c]+"), lambda w: w != "")).cast("long").alias("words")).filter("words > 0")
    lines = lines.repartition(*_DOC)
    doc = Window.partitionBy(*_DOC).orderBy("place")
    whole = Window.partitionBy(*_DOC)
    lines = lines.withColumns({"seq": F.row_number().over(doc).cast("long"), "upto": F.sum("words").over(doc), "all": F.sum("words").over(whole)})
    lines = lines.withColumn("before", F.col("upto") - F.col("words"))
    ahead = Window.partitionBy(*_DOC).orderBy("before").rangeBetween(0, min_words - 1)
    behind = Window.partitionBy(*_DOC).orderBy("upto").rangeBetween(-(min_words - 1), 0)
    lines = lines.withColumns({"fwd": F.when(F.col("all") - F.col("before") >= min_words, F.count(F.lit(1)).over(ahead)), "back": F.when(F.col("upto") >= min_words, F.count(F.lit(1)).over(behind))})
    lines = saved(lines.select(*_DOC, "place", "seq", "line", "fwd", "back"), "lines")
    n_lines = lines.count()
    often = saved(lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("line", F.monotonically_increasing_id().alias("r")), "often", rows=n_lines // 2)
    ranks = [saved(lines.select(*_DOC, "seq", "line").join(often.hint("merge"), "line").select(*_DOC, "seq", "r"), "rank", rows=n_lines)]
    runs = lines.select(*_DOC, "seq", F.explode(F.array_distinct(F.array(F.struct(F.col("seq").alias("start"), F.col("fwd").alias("n")), F.struct((F.col("seq") - F.col("back") + 1).alias("start"), F.col("back").alias("n"))))).alias("run")).select(*_DOC, "run.start", "run.n").filter("n is not null").distinct()
    runs = saved(runs, "runs")
    longest, n_runs = runs.agg(F.coalesce(F.max("n"), F.lit(0)), F.count(F.lit(1))).first()
    n_ranked = ranks[0].count()
    while 2 ** len(ranks) <= longest:
        step = 2 ** (len(ranks) - 1)
        now = ranks[-1]
        pairs = now.join(now.select(*_DOC, (F.col("seq") - step).alias("seq"), F.col("r").alias("r2")), [*_DOC, "seq"])
        pairs = saved(pairs, "pairs", rows=n_ranked)
        order = pairs.groupBy("r", "r2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("r", "r2").repartitionByRange("r", "r2").sortWithinPartitions("r", "r2")
        order = saved(order.withColumn("rank", F.monotonically_increasing_id()), "order", rows=n_ranked // 2)
        ranks.append(saved(pairs.join(order.hint("merge"), ["r", "r2"]).select(*_DOC, "seq", F.col("rank").alias("r")), "rank", rows=n_ranked))
        dropped(pairs, order)
    found = None
    for k, rank in enumerate(ranks):
        own = runs.filter((F.col("n") >= 2**k) & (F.col("n") < 2 ** (k + 1)))
        own = own.join(rank.withColumnRenamed("seq", "start"), [*_DOC, "start"])
        if k:
            last = rank.select(*_DOC, F.col("seq").alias("end"), F.col("r").alias("r2"))
            own = own.withColumn("end", F.col("start") + F.col("n") - 2**k).join(last, [*_DOC, "end"]).drop("end")
        else:
            own = own.withColumn("r2", F.lit(0).cast("long"))
        found = own.select(*_DOC, "start", "n", "r", "r2") if found is None else found.unionByName(own.select(*_DOC, "start", "n", "r", "r2"))
    found = saved(found, "found", rows=n_runs)
    dropped(runs, often, *ranks)
    first = found.groupBy("n", "r", "r2").agg(F.min(F.struct(*_DOC, "start")).alias("first"), F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    first = saved(first, "first", rows=n_runs // 2)
    later = found.join(first.hint("merge"), ["n", "r", "r2"]).filter(F.struct(*_DOC, "start") != F.col("first"))
    gone = later.select(*_DOC, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("seq")).distinct()
    out = saved(gone.join(lines.select(*_DOC, "seq", "place"), [*_DOC, "seq"]).groupBy(*_DOC).agg(F.collect_list("place").alias("places")), "gone", rows=n_lines)
    dropped(lines, found, first)
    return out


def line_deduplicated(docs: DataFrame, min_words: int = 50, removed: str = "lines_removed") -> DataFrame:
    """docs with later copies of repeated line runs taken out of text, and how many lines each lost, in a column (long) named by `removed`."""
    gone = later_lines(docs, min_words)
    docs = docs.select(*all_of(docs, removed))
    names = {c: hidden(docs, c) for c in ("doc1", "doc2", "places", "lines", "stay")}
    d1, d2, places, lines, stay = names.values()
    gone = gone.select(*[F.col(c).alias(names[c]) for c in ("doc1", "doc2", "places")])
    text = F.col("text").cast("string")
    split = docs.withColumns({names[c]: k for c, k in _keys(text).items()} | {lines: F.split(text, "\n")}).drop("text")
    split = split.join(gone.hint("merge"), [d1, d2], "left").withColumn(stay, F.when(F.col(places).isNotNull(), F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), places))))
    new = F.when(F.col(stay).isNull(), F.array_join(lines, "\n")).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    kept = [new.alias("text") if c == "text" else own for c, own in zip(docs.columns, all_of(docs))]
    return split.select(*kept, F.coalesce(F.size(places), F.lit(0)).cast("long").alias(removed))


#: {0}: the table, {1}: words that make a run count.
SQL = r"""
with d as (select distinct doc_id, text from {0} where text is not null),
l0 as (select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as place from d),
l1 as (select *, len(list_filter(regexp_split_to_array(line, '[ \t\r\x0b\x0c]+'), lambda w: w <> '')) as words from l0),
l as (select doc_id, text, line, place, row_number() over (partition by doc_id, text order by place) as seq,
  sum(words) over (partition by doc_id, text order by place) - words as before, sum(words) over (partition by doc_id, text order by place) as upto,
  sum(words) over (partition by doc_id, text) as total from l1 where words > 0),
w as (select *, case when total - before >= {1} then count(*) over (partition by doc_id, text order by before range between current row and {1} - 1 following) end as fwd,
  case when upto >= {1} then count(*) over (partition by doc_id, text order by upto range between {1} - 1 preceding and current row) end as back from l),
a as (select doc_id, text, list(line order by seq) as lines from l group by all),
runs as (select distinct doc_id, text, start, n from (select doc_id, text, seq as start, fwd as n from w union all select doc_id, text, seq - back + 1, back from w) where n is not null),
named as (select r.doc_id, r.text, r.start, r.n, array_to_string(list_slice(a.lines, r.start, r.start + r.n - 1), chr(10)) as run from runs r join a on r.doc_id is not distinct from a.doc_id and r.text = a.text),
ranked as (select *, row_number() over (partition by n, run order by doc_id nulls first, start) as k from named),
gone as (select distinct doc_id, text, unnest(range(start, start + n)) as seq from ranked where k > 1),
places as (select g.doc_id, g.text, list(l.place) as places from gone g join l on g.doc_id is not distinct from l.doc_id and g.text = l.text and g.seq = l.seq group by all),
kept as (select l0.doc_id, l0.text, string_agg(l0.line, chr(10) order by l0.place) as new from l0 join places p on l0.doc_id is not distinct from p.doc_id and l0.text = p.text where not list_contains(p.places, l0.place) group by all)
"""
