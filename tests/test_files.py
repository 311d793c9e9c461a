import os
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linemill.operators.clean import Cleaning, clean
from linemill.operators.ordering import duplicates, merged, ranked
from linemill.operators.shards import chunk_plan
from linemill.functions.bytes import from_dollar_hex, latin1, trim
from linemill.plans.analyse import analyse, write_reports, write_tables
from linemill.plans.merge import MergeOptions, merge_lines, merge_stats, run_merge
from linemill.sources.lines import gather, read_lines
from linemill.sources.raw import range_lines
from linemill.sources.sinks import write_parts
from linemill.streaming.lines import clean_stream, profile_stream, stream_lines

B1 = b"b\r\na\n\nab\rc\xff\xfe\x00x\n\nzz\n\n"


def split(data: bytes) -> list[bytes]:
    out = re.split(rb"\r\n|\r|\n", data)
    return out[:-1] if out and out[-1] == b"" else out


def frame(spark, lines):
    return spark.createDataFrame([(bytearray(x),) for x in lines], "line binary")


def got(df):
    return [bytes(r[0]) for r in df.select("line").collect()]


def test_gather(tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    for p in ("d/a.txt", "d/e/b.TXT", "d/e/c.log"):
        (tmp_path / p).write_bytes(b"x\n")
    assert [os.path.basename(p) for p in gather([str(tmp_path / "d")])] == ["a.txt", "b.TXT", "c.log"]
    assert [os.path.basename(p) for p in gather([str(tmp_path / "d")], [".txt"])] == ["c.log"]
    assert gather([str(tmp_path / "none")]) == []
    assert len(gather([str(tmp_path / "d"), str(tmp_path / "d" / "a.txt")])) == 4


def test_gather_without_checksums(spark, tmp_path):
    """What Spark writes to a local folder has a checksum file beside each file, which is no input; a file that is only named like one is."""
    spark.createDataFrame([("a",), ("b",)], "value string").write.text(f"file://{tmp_path}/d")
    (tmp_path / "d" / ".own.crc").write_bytes(b"own\n")
    (tmp_path / "d" / "like").write_bytes(b"like\n")
    (tmp_path / "d" / ".like.crc").write_bytes(b"not a checksum\n")
    assert any(p.name.startswith(".part-") for p in (tmp_path / "d").iterdir())
    assert not any(os.path.basename(p).startswith((".part-", "._SUCCESS")) for p in gather([str(tmp_path / "d")]))
    assert sorted(got(read_lines(spark, [str(tmp_path / "d")], exact=True))) == [b"a", b"b", b"like", b"not a checksum", b"own"]


def test_read(spark, tmp_path):
    (tmp_path / "x").write_bytes(B1)
    for exact in (False, True):
        assert sorted(got(read_lines(spark, [str(tmp_path / "x")], exact=exact))) == sorted(split(B1))
    assert read_lines(spark, [str(tmp_path / "none")]).count() == 0


def test_exact_keeps_what_text_drops(spark, tmp_path):
    (tmp_path / "_x").write_bytes(b"\xef\xbb\xbfbom\nna\xc3\xafve\n")
    assert sorted(got(read_lines(spark, [str(tmp_path)], exact=True))) == [b"na\xc3\xafve", b"\xef\xbb\xbfbom"]
    assert len(got(read_lines(spark, [str(tmp_path / "_x"), str(tmp_path / "_x")], exact=True))) == 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"bc", b"\n", b"\r", b"\r\n", b"", b"\x00\xff"]), max_size=40), st.integers(1, 9))
def test_ranges_cover_a_file(tmp_path_factory, parts, step):
    path = tmp_path_factory.mktemp("r") / "f"
    data = b"".join(parts)
    path.write_bytes(data)
    assert [x for a in range(0, len(data), step) for lines in range_lines(str(path), a, min(a + step, len(data))) for x in lines] == split(data)


def model(lines, order="dictionary", distinct=True):
    return sorted(set(lines) if distinct else lines, key=lambda x: (len(x), x) if order == "length" else x)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.binary(max_size=6), max_size=30))
def test_order_and_distinct(spark, lines):
    df = frame(spark, lines) if lines else spark.createDataFrame([], "line binary")
    for order in ("dictionary", "length"):
        assert got(merged(df, order)) == model(lines, order)
    assert got(merged(df, keep_duplicates=True)) == model(lines, distinct=False)
    assert got(duplicates(df)) == [x for x in model(lines) if lines.count(x) > 1]
    assert [bytes(r[0]) for r in ranked(df).orderBy("rank").collect()] == model(lines, distinct=False)


@pytest.mark.parametrize(
    "how, line, want",
    [
        ({"whitespace": "trim"}, b"abc ", b"abc"),
        ({"whitespace": "trim"}, b"\tabc\x0b", b"abc"),
        ({"whitespace": "trim"}, b" a b ", b"a b"),
        ({"whitespace": "trim", "whitespace_chars": b"x"}, b"x ax", b" a"),
        ({"whitespace": "strip"}, b" a\tb ", b"ab"),
        ({"whitespace": "trim"}, b"   ", None),
        ({"whitespace": "trim", "keep_blanks": True}, b"   ", b""),
        ({}, b"a\x00b", b"ab"),
        ({"keep_nulls": True}, b"a\x00b", b"a\x00b"),
        ({"dollar_hex": True}, b"a\xff", b"$HEX[61ff]"),
        ({"dollar_hex": True, "whitespace": "trim"}, b"\ta", b"$HEX[0961]"),
        ({"include": "^a.c$"}, b"a\xe9c", b"a\xe9c"),
        ({"include": "b"}, b"ac", None),
        ({"exclude": "b"}, b"abc", None),
        ({"longest": 3}, b"abcd", None),
        ({"longest": 3}, b"abc", b"abc"),
        ({}, b"", None),
    ],
)
def test_clean(spark, how, line, want):
    assert got(clean(frame(spark, [line]), Cleaning(**how))) == ([] if want is None else [want])


def test_every_byte(spark):
    lines = [b"x" + bytes([b]) + b"y" for b in range(256)]
    assert got(merged(frame(spark, lines[::-1]))) == lines
    hexed = got(clean(frame(spark, lines), Cleaning(dollar_hex=True)))
    assert sum(x.startswith(b"$HEX[") for x in hexed) == 256 - 95


def test_merge_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(B1)
    (tmp_path / "in" / "b").write_bytes(b"zz\nq \n" + b"L" * 131_071 + b"\n" + b"M" * 131_072 + b"\n")
    out = tmp_path / "out.txt"
    stats = run_merge(spark, MergeOptions([str(tmp_path / "in")], str(out), save_duplicates=True, save_stats=True, whitespace="trim"))
    want = model([x for x in [*(y.replace(b"\x00", b"") for y in split(B1)), b"zz", b"q", b"L" * 131_071] if x])
    assert out.read_bytes() == b"".join(x + b"\n" for x in want)
    assert (tmp_path / "out.txt.duplicates").read_bytes() == b"zz\n"
    assert stats["skipped"] == 1 and stats["trimmed"] == 1 and stats["nulls"] == 1 and stats["duplicates"] == 1
    assert stats["lines_read"] == len(split(B1)) + 4 and stats["lines_written"] == len(want)
    assert "lines_read" in (tmp_path / "out.txt.stats").read_text()


def test_no_lines_no_file(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"\n\n")
    (tmp_path / "out").write_bytes(b"old")
    assert run_merge(spark, MergeOptions([str(tmp_path / "a")], str(tmp_path / "out")))["output"] is None
    assert not (tmp_path / "out").exists()


def test_counters_and_partitions(spark):
    lines = [b"a", b"a", b" b", b"", b"cc\x00"] * 3
    options = MergeOptions(["-"], "-", whitespace="trim")
    for parts in (1, 3, 7):
        df = frame(spark, lines).repartition(parts)
        assert got(merge_lines(df, options)) == [b"a", b"b", b"cc"]
        row = merge_stats(df, options).first()
        assert (row["lines_read"], row["lines_kept"], row["lines_written"], row["duplicates"], row["blank"]) == (15, 12, 3, 9, 3)


def test_chunks(spark):
    shards = spark.createDataFrame([(f"{i:02x}", 1, n) for i, n in enumerate([5, 5, 3, 20, 1, 1])], "shard string, lines long, bytes long")
    assert [r["chunk"] for r in chunk_plan(shards, 10).orderBy("shard").collect()] == [0, 0, 1, 2, 3, 3]
    assert chunk_plan(shards.limit(0), 10).count() == 0


def test_analyse(spark, tmp_path):
    (tmp_path / "w.txt").write_bytes(b"Abc\nabc1\n\n\xff \n$HEX[6162]\n")
    (path,) = write_reports(spark, [str(tmp_path)])
    text = open(path).read()
    for part in ("Total Lines: 5", "0: 1 (20.00%)", "1: 0 (0.00%)", "Mixed: 1", "Empty: 1", "UppercaseLetter: 2", "Whitespace, HighNonAscii: 1"):
        assert part in text
    again = analyse(spark, [str(tmp_path)])
    assert again["summary"].count() == 1  # the report itself is left out
    assert analyse(spark, [str(tmp_path)], decode_hex=True)["lengths"].filter("length = 2").first()["n"] == 2


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a").write_bytes(b"x\n y \n\n")
    lines = clean_stream(stream_lines(spark, str(tmp_path / "in")), Cleaning(whitespace="trim"))
    q = profile_stream(lines).writeStream.outputMode("complete").format("memory").queryName("profile").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select sum(n) from profile").first()[0] == 2


def test_ranks_with_other_columns(spark):
    """More rows than a range exchange samples, in many partitions, with another column and a line that a third of the rows have."""
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = spark.range(1_200_000).select(F.encode(F.when(F.col("id") % 3 == 0, F.lit("often")).otherwise(F.sha1(F.col("id").cast("string"))), "UTF-8").alias("line"), F.col("id").alias("source.id"))
        out = ranked(rows)
        assert out.columns == ["line", "source.id", "rank"]
        n = out.agg(F.count_distinct("rank"), F.min("rank"), F.max("rank"), F.count_distinct("`source.id`")).first()
        assert tuple(n) == (1_200_000, 1, 1_200_000, 1_200_000)
        assert out.select("line", F.col("rank").alias("at")).groupBy("line").agg((F.max("at") - F.min("at") + 1 == F.count(F.lit(1))).alias("together")).filter("not together").count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_ranks_of_copies(spark):
    lines = spark.range(200_000).select(F.encode(F.when(F.col("id") < 150_000, F.lit("m")).otherwise(F.concat(F.lit("z"), F.col("id") % 7)), "UTF-8").alias("line"))
    out = ranked(lines).groupBy("line").agg(F.min("rank"), F.max("rank"), F.count_distinct("rank")).orderBy("line").collect()
    assert tuple(out[0][1:]) == (1, 150_000, 150_000) and out[-1][2] == 200_000 and sum(r[3] for r in out) == 200_000


#: Bytes that are letters, digits or the low line, and those that are spaces, in the Latin-1 view (fixed values).
WORD = {*range(48, 58), *range(65, 91), 95, *range(97, 123), 0xAA, 0xB5, 0xBA, *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)}
SPACE = {9, 10, 11, 12, 13, 32, 0x85, 0xA0}


@pytest.mark.parametrize("pattern, fine", [(r"^a\wb$", WORD), (r"^a\sb$", SPACE), (r"^a.b$", set(range(256))), (r"^a\db$", set(range(48, 58)))])
def test_patterns_on_every_byte(spark, pattern, fine):
    lines = [b"a" + bytes([b]) + b"b" for b in range(256)]
    kept = got(clean(frame(spark, lines), Cleaning(keep_nulls=True, include=pattern)))
    assert {x[1] for x in kept} == fine


def test_end_of_line_is_no_other_byte(spark):
    lines = [b"abc" + bytes([b]) for b in range(256) if b != 10]
    assert got(clean(frame(spark, lines), Cleaning(keep_nulls=True, include="abc$"))) == []
    tails = [b"$HEX[61]" + bytes([b]) for b in range(256)]
    decoded = frame(spark, tails).select(F.encode(from_dollar_hex(latin1(F.col("line"))), "ISO-8859-1").alias("line"))
    assert got(decoded) == tails
    assert got(frame(spark, [b"$HEX[61]"]).select(F.encode(from_dollar_hex(latin1(F.col("line"))), "ISO-8859-1").alias("line"))) == [b"a"]


def test_trim_every_byte(spark):
    lines = [bytes([b]) + b" x " + bytes([b]) for b in range(256)]
    trimmed = got(frame(spark, lines).select(F.encode(trim(latin1(F.col("line"))), "ISO-8859-1").alias("line")))
    assert trimmed == [x.strip(b"\x20\x09\x0b") for x in lines]


def test_a_long_line(tmp_path):
    """Linear in its length, and no more of it is held than matters."""
    with open(tmp_path / "f", "wb") as f:
        f.write(b"a\n" + b"x" * (128 << 20) + b"\nb")
    began = time.time()
    found = [x for lines in range_lines(str(tmp_path / "f"), 0, 128 << 20, 1000) for x in lines]
    assert [len(x) for x in found] == [1, 1001] and time.time() - began < 4
    assert [x for lines in range_lines(str(tmp_path / "f"), 128 << 20, (128 << 20) + 5, 1000) for x in lines] == [b"b"]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"bcdefgh", b"\n", b"\r", b"\r\n", b""]), max_size=30), st.integers(1, 9), st.integers(1, 5))
def test_cut_ranges_cover_a_file(tmp_path_factory, parts, step, longest):
    path = tmp_path_factory.mktemp("r") / "f"
    data = b"".join(parts)
    path.write_bytes(data)
    assert [x for a in range(0, len(data), step) for lines in range_lines(str(path), a, min(a + step, len(data)), longest) for x in lines] == [x[: longest + 1] for x in split(data)]


def test_exact_by_uri(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "_x").write_bytes(b"a\rb")
    assert sorted(got(read_lines(spark, [f"file://{tmp_path}/d"], exact=True))) == [b"a", b"b"]


def test_copies_are_spread_over_parts(spark, tmp_path):
    lines = spark.createDataFrame([(bytearray(b"m"), 400_000), (bytearray(b"a"), 1), (bytearray(b"z"), 2)], "line binary, n long")
    write_parts(lines, str(tmp_path / "out"), copies="n")
    parts = [p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*"))]
    assert b"".join(parts) == b"a\n" + b"m\n" * 400_000 + b"z\n" * 2
    assert sum(b"m" in p for p in parts) > 1


def test_sizes_choose_one_file_or_parts(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x\ny\n")
    run_merge(spark, MergeOptions([str(tmp_path / "a")], str(tmp_path / "one")))
    run_merge(spark, MergeOptions([str(tmp_path / "a")], str(tmp_path / "many"), single_file_limit=1))
    assert (tmp_path / "one").read_bytes() == b"x\ny\n" == b"".join(p.read_bytes() for p in sorted((tmp_path / "many").glob("part-*")))


def test_merge_leaves_nothing_behind(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"x\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    run_merge(spark, MergeOptions([str(tmp_path / "a")], str(tmp_path / "o"), leave_duplicates=True))
    assert {p.name for p in tmp_path.iterdir()} == {"a", "o"} and spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_reports_of_many_files(spark, tmp_path):
    for i in range(12):
        (tmp_path / f"f{i:02}.txt").write_bytes(b"a1\n" * i)
    for exact in (False, True):
        assert len(write_reports(spark, [str(tmp_path)], exact=exact)) == 12
        texts = [(tmp_path / f"f{i:02}.Analysis.txt").read_text() for i in range(12)]
        assert all(f"Total Lines: {i}\n" in t for i, t in enumerate(texts)) and "UppercaseLetter: 0" in texts[0] and "LowerNumber: 11" in texts[11]


@pytest.mark.parametrize("kind", ["csv", "tsv", "json"])
def test_tables_of_an_analysis(spark, tmp_path, kind):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "w.txt").write_bytes(b"Abc\nabc1\n")
    for path in write_tables(spark, [str(tmp_path / "in")], str(tmp_path / "out"), kind):
        df = spark.read.json(path) if kind == "json" else spark.read.csv(path, header=True, sep="," if kind == "csv" else "\t")
        assert "path" in df.columns and df.count() > 0


def test_chunks_of_many_shards(spark):
    shards = spark.range(30_000).select(F.format_string("%06x", "id").alias("shard"), F.lit(1).alias("lines"), F.lit(7).alias("bytes"))
    assert chunk_plan(shards, 70).agg(F.max("chunk")).first()[0] == 2999
