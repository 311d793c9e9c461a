import pytest
from oracle import check

from linemill import queries, storage

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_same_rows_as_sql(spark, name):
    check(spark, SF, queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["merge_files_skip"])
def test_same_rows_in_a_folder_as_hadoop_writes_it(spark, tmp_path, monkeypatch, name):
    """The shared folder's scheme has one slash behind it."""
    monkeypatch.setattr(storage, "shared_dir", lambda _: f"file:{tmp_path}")
    check(spark, SF, queries.QUERIES[name], queries.ORACLE_SQL[name])


@pytest.mark.parametrize("name", ["merge_files_length", "merge_files_skip"])
def test_same_rows_in_a_local_folder(spark, tmp_path, monkeypatch, name):
    """The shared folder is named without a scheme, as in local mode without a setting."""
    monkeypatch.setattr(storage, "shared_dir", lambda _: str(tmp_path))
    check(spark, SF, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_every_query_is_registered():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries())
    assert set(queries.ORACLE_SQL) == set(queries.QUERIES)


def test_only_the_subpackage_may_be_missing(monkeypatch):
    """Without the corpus operators the rest is registered; another missing module is no reason to leave queries out."""
    import importlib
    import sys

    import __spark_entry__ as entry

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("linemill.llm")]:
        monkeypatch.delitem(sys.modules, name)

    class Missing:
        name = "corpus_pipeline"

        def find_spec(self, full, path=None, target=None):
            if full == self.name:
                raise ModuleNotFoundError(f"No module named {full!r}", name=full)

    finder = Missing()
    monkeypatch.setattr(sys, "meta_path", [finder, *sys.meta_path])
    assert set(importlib.reload(entry).queries()) == set(queries.QUERIES)
    finder.name = "xxhash"
    monkeypatch.delitem(sys.modules, "xxhash", raising=False)
    if importlib.util.find_spec("linemill.llm"):
        with pytest.raises(ModuleNotFoundError):
            importlib.reload(entry)
    finder.name = ""
    importlib.reload(entry)
