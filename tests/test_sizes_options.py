import pytest

from linemill.cli import cancellable, clean_temp, crash_report, main
from linemill.functions.sizes import format_size, format_span, parse_size
from linemill.plans.merge import MergeOptions


@pytest.mark.parametrize("text, size", [("10", 10), ("1 B", 1), ("1KB", 1024), ("1.5 mb", 1572864), ("2gb", 2 << 30), ("1 TB", 1 << 40), ("1pb", 1 << 50)])
def test_parse(text, size):
    assert parse_size(text) == size


@pytest.mark.parametrize("text", ["", "KB", "1 XB", "1.2.3 KB"])
def test_parse_fails(text):
    with pytest.raises(ValueError):
        parse_size(text)


@pytest.mark.parametrize("n, text", [(0, "0 bytes"), (1, "1 byte"), (1023, "1023 bytes"), (1024, "1 KB"), (1536, "1.5 KB"), (1 << 20, "1 MB"), (5 << 40, "5 TB")])
def test_format(n, text):
    assert format_size(n) == text


@pytest.mark.parametrize("s, text", [(0.5, "500.00 ms"), (2, "2,000.0 ms"), (20, "20.00 sec"), (600, "10.00 min"), (7200, "2.00 hrs"), (200000, "2 days, 7.6 hrs.")])
def test_span(s, text):
    assert format_span(s) == text


def test_defaults_are_valid():
    MergeOptions(["a"], "b").validate()


@pytest.mark.parametrize(
    "change, word",
    [({"inputs": []}, "inputs"), ({"output": ""}, "output"), ({"slab_size": "300 KB"}, "power of two"), ({"slab_size": "128 KB"}, "slab_size"), ({"max_sort_size": "65 TB"}, "max_sort_size"), ({"line_buffer_size": 100}, "line_buffer_size"), ({"line_buffer_size": "1 MB"}, "line_buffer_size"), ({"large_chunk": "2 GB"}, "large_chunk"), ({"split_count": 0}, "split_count"), ({"split_count": 129}, "split_count"), ({"include_by_regex": "a", "exclude_by_regex": "b"}, "exclude each other"), ({"sort_by": "size"}, "sort_by"), ({"whitespace": "all"}, "whitespace"), ({"max_sort_size": "x"}, "max_sort_size")],
)
def test_validation(change, word):
    options = MergeOptions(**({"inputs": ["a"], "output": "b"} | change))
    assert any(word in e for e in options.errors())
    with pytest.raises(ValueError):
        options.validate()


def test_pattern_is_compiled_by_spark(spark):
    assert not MergeOptions(["a"], "b", include_by_regex="(?<n>a)").errors(spark)
    assert not MergeOptions(["a"], "b", include_by_regex=r"\p{Lu}").errors(spark)
    assert MergeOptions(["a"], "b", exclude_by_regex="a{2,1}").errors(spark)
    assert any("not valid" in e for e in MergeOptions(["a"], "b", include_by_regex="(").errors(spark))


def test_cli_patterns(spark, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr("linemill.cli.session", lambda: spark)
    (tmp_path / "a").write_bytes("É\ne\n".encode("latin-1"))
    assert main(["merge", "-i", str(tmp_path / "a"), "-o", str(tmp_path / "b"), "--include-by-regex", r"\p{Lu}"]) == 0
    assert (tmp_path / "b").read_bytes() == b"\xc9\n"
    assert main(["merge", "-i", str(tmp_path / "a"), "-o", str(tmp_path / "b"), "--include-by-regex", "("]) == 1
    assert main(["analyse", "-i", str(tmp_path / "a"), "--format", "json", "-o", str(tmp_path / "t")]) == 0 and (tmp_path / "t" / "summary").is_dir()
    assert main(["analyse", "-i", "a", "--format", "json"]) == 1


def test_cancelling(spark, monkeypatch):
    import os
    import signal
    import threading

    monkeypatch.setattr("linemill.cli.session", lambda: spark)
    threading.Timer(3, lambda: os.kill(os.getpid(), signal.SIGINT)).start()
    with pytest.raises(RuntimeError, match="cancelled"):
        cancellable(lambda s: s.range(10**13).selectExpr("sum(hash(id))").collect())
    assert spark.range(3).count() == 3


def test_cli_codes(tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    assert main(["about"]) == 0
    assert main(["merge"]) == 1
    assert main(["nothing"]) == 1
    assert main(["crash"]) == -1
    assert list(tmp_path.glob("*_CrashDetails_*.txt"))
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x").write_bytes(b"abc")
    assert clean_temp(str(tmp_path / "t")) == 3
    assert not (tmp_path / "t").exists()
    assert crash_report(ValueError("x"))
