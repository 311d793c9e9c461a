"""What grows with the input: bytes that one task gets, and bytes that are exchanged."""

import duckdb
import pytest
from oracle import rows
from pyspark.sql import functions as F

from linemill import queries
from linemill.operators import ordering

SF, SF1 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture
def exchanged(spark):
    """exchanged(run): for each stage of run(), the most bytes that a task read from exchanges, and all bytes written to exchanges and files."""
    context = spark.sparkContext
    store, none = context._jsc.sc().statusStore(), context._gateway.new_array(spark._jvm.double, 0)

    def stages():
        context._jsc.sc().listenerBus().waitUntilEmpty()
        return _all(store.stageList(None, False, False, none, spark._jvm.java.util.ArrayList()))

    def found(run):
        seen, out = {s.stageId() for s in stages()}, []
        run()
        for s in stages():
            if s.stageId() not in seen and s.numCompleteTasks():
                reads = [t.taskMetrics().get().shuffleReadMetrics() for t in _all(store.taskList(s.stageId(), s.attemptId(), 10_000)) if t.taskMetrics().isDefined()]
                out.append((max(r.localBytesRead() + r.remoteBytesRead() for r in reads), s.shuffleWriteBytes() + s.outputBytes()))
        return out

    return found


def _all(seq):
    return [seq.apply(i) for i in range(seq.size())]


def _same_as_sql(df, name, **tables):
    db = duckdb.connect()
    for t, path in tables.items():
        db.execute(f"create view {t} as select * from '{path}'")
    assert rows(df.toPandas()) == rows(db.execute(queries.ORACLE_SQL[name]).df())


def test_a_language_is_no_task_of_its_own(spark, tmp_path, exchanged):
    """All documents in one language, in several files: no exchange brings its lines to one task. Names of languages are any text."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("lang", F.when(F.col("doc_id") == 1, "").when(F.col("doc_id") == 2, "zh/é %41").otherwise("en"))
    docs.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    stages = exchanged(lambda: _same_as_sql(queries.analyse_files(spark, str(tmp_path)), "analyse_files", documents=f"{tmp_path}/documents.parquet/*.parquet"))
    assert max(read for read, _ in stages) < size / 10


def test_no_lines_to_analyse(spark, tmp_path):
    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.analyse_files(spark, str(tmp_path)).count() == 0


def test_ranks_of_rows_move_each_row_twice(spark, exchanged):
    """Into ranges and to the sums by line, besides the table of ranges and one row for each distinct line."""
    size = spark.read.parquet(f"{SF1}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    stages = exchanged(lambda: _same_as_sql(queries.ranked_with_source(spark, SF1), "ranked_with_source", documents=f"{SF1}/documents.parquet"))
    assert sum(written for _, written in stages) < 4 * size


def test_ranks_of_equal_rows(spark, monkeypatch):
    """Rows that are equal in all columns are in several tasks, and have ranks of their own."""
    rows = spark.range(400_000).select(F.encode(F.when(F.col("id") % 100 == 0, F.lit("a")).otherwise(F.lit("m")), "UTF-8").alias("line"), F.lit(7).alias("doc_id"))
    tables, saved = [], ordering.saved
    monkeypatch.setattr(ordering, "saved", lambda df, *how: tables.append(saved(df, *how)) or tables[-1])
    out = ordering.ranked(rows)
    n = out.groupBy("line").agg(F.min("rank"), F.max("rank"), F.count_distinct("rank"), F.sum("doc_id")).orderBy("line").collect()
    assert [tuple(r[1:]) for r in n] == [(1, 4_000, 4_000, 28_000), (4_001, 400_000, 396_000, 2_772_000)]
    (placed,) = tables
    parts = placed.groupBy(F.shiftright("_at", 33)).count().collect()
    assert len(parts) > 2 and max(r["count"] for r in parts) < 200_000


def test_a_merged_file_is_checked_where_it_is_read(spark, exchanged):
    """The order of a written file is no exchange of its lines."""
    size = spark.read.parquet(f"{SF1}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]
    stages = exchanged(lambda: _same_as_sql(queries.merge_files_leave(spark, SF1), "merge_files_leave", documents=f"{SF1}/documents.parquet"))
    assert sum(written for _, written in stages) < 4.8 * size


@pytest.mark.parametrize("order", ["dictionary", "length"])
def test_order_of_lines(spark, tmp_path, order):
    """In one batch and several, in one range and several, by position and by the order of a file, with one pair the wrong way round at each place."""
    key = (lambda x: (len(x), x)) if order == "length" else (lambda x: x)
    lines = sorted([b"", b"a", b"a", b"\x7f", b"\xff", b"aa", b"ab", b"a\x00", b"\xc3\xa9"], key=key)
    cases = {True: [lines, [b"x"], [b"x", b"x"]], False: [[*lines[:i], lines[i + 1], lines[i], *lines[i + 2 :]] for i in range(len(lines) - 1) if lines[i] != lines[i + 1]]}
    for batch in ("2", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            for want, some in cases.items():
                for case in some:
                    df = spark.createDataFrame([(i, i // 4, bytearray(x)) for i, x in enumerate(case)], "at long, run long, line binary").coalesce(1)
                    assert ordering.is_sorted(df, "at", order).first()[0] is want
                    assert ordering.runs_sorted(df, "run", order).first()[0] is want
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert ordering.is_sorted(df.limit(0), "at", order).first()[0] is True
    nulls = spark.createDataFrame([(0, None), (1, None), (2, bytearray(b"a")), (3, bytearray(b"b"))], "at long, line binary")
    assert ordering.is_sorted(nulls, "at", order).first()[0] is True
    assert ordering.is_sorted(nulls.select((-F.col("at")).alias("at"), "line"), "at", order).first()[0] is False
