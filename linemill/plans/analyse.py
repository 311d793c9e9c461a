"""The analysis plan: a profile of each file, as tables or as text reports."""

from __future__ import annotations

import os
import re
from datetime import datetime, timezone
from itertools import groupby
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession

from ..functions.bytes import CATEGORIES
from ..operators import profile
from ..sources.lines import gather, read_lines
from ..sources.sinks import write_text
from ..storage import dropped, saved

SUFFIX = ".Analysis.txt"


def analyse(spark: SparkSession, paths: list[str], ending: str = SUFFIX, decode_hex: bool = False, exact: bool = False) -> dict[str, DataFrame]:
    """Reports by path: summary, lengths, charsets, categories, masks. Files with the reports' ending are left out.

    Lines are read once, into a table by path, length and mask in the shared folder; `measured` is that table, for dropped() when all is read.
    """
    lines = read_lines(spark, paths, [ending.rpartition("*")[2]], exact)
    m = saved(profile.measured(profile.decoded(lines) if decode_hex else lines, "path"), "profile")
    return {"measured": m, "summary": profile.summary(m, "path"), "lengths": profile.length_histogram(m, "path", dense=True), "charsets": profile.charsets(m, "path"), "categories": profile.category_any(m, "path"), "masks": profile.category_full(m, "path")}


def report(path: str, size: int, at: datetime, summary, lengths, charsets, categories, masks) -> str:
    total = max(summary["lines"], 1)
    row = lambda name, n: f"{name}: {n:,} ({n / total:.2%})"
    order = {name: i for i, (_, name, _) in enumerate(CATEGORIES)}
    return "\n".join([
        f"Analysis of file '{os.path.basename(path)}', as at {at:%Y-%m-%d %H:%M:%S %z}",
        f"File Size: {size:,} bytes ({size / 1024**2:,.1f} MB)",
        f"Total Lines: {summary['lines']:,}",
        f"Average Line Length (bytes): {size / total:,.2f}",
        "", "Length (bytes) Histogram:", *[row(r["length"], r["n"]) for r in sorted(lengths, key=lambda r: r["length"])],
        "", "Charset Counts:", *[row(r["charset"], r["n"]) for r in sorted(charsets, key=lambda r: r["charset"])],
        "", "Lines With Char Category:", *[row(r["category"], r["n"]) for r in sorted(categories, key=lambda r: order[r["category"]])],
        "", "Full Charset Counts:", *[row(r["categories"], r["n"]) for r in sorted(masks, key=lambda r: r["mask"])],
    ]) + "\n"


def _plain(path: str) -> str:
    """A path as it was gathered: local ones without their scheme."""
    return unquote(re.sub("^file:/+", "/", path)) if path.startswith("file:") else path


def _by_path(df: DataFrame):
    """path, its rows; one file after the other, in the order of paths, however many there are."""
    for path, rows in groupby(df.orderBy("path").toLocalIterator(prefetchPartitions=True), key=lambda r: r["path"]):
        yield path, [r.asDict() for r in rows]


def write_reports(spark: SparkSession, paths: list[str], ending: str = SUFFIX, **options) -> list[str]:
    """A text report beside each file, empty ones included; its extension makes way for the ending.

    Each table is read once, in the order of paths, and the reports are merged from them: the jobs' number does not grow with the files'.
    """
    got, out, now = analyse(spark, paths, ending, **options), [], datetime.now(timezone.utc)
    names = ("summary", "lengths", "charsets", "categories", "masks")
    files = list(dict.fromkeys(map(_plain, gather(paths, [ending.rpartition("*")[2]], spark))))

    def write(path: str, own: dict) -> None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        size = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(p).getLen()
        target = os.path.splitext(path)[0] + ending
        write_text(spark, target, report(path, size, now, **own))
        out.append(target)

    seen = set()
    for group in zip(*(_by_path(got[k]) for k in names), strict=True):
        path = _plain(group[0][0])
        seen.add(path)
        own = {k: rows for k, (_, rows) in zip(names, group)}
        write(path, own | {"summary": own["summary"][0]})
    for path in files:
        if path not in seen:
            nothing = [{"category": name, "n": 0} for _, name, _ in CATEGORIES]
            write(path, {"summary": {"lines": 0}, "lengths": [], "charsets": [], "categories": nothing, "masks": []})
    dropped(got["measured"])
    return sorted(out)


#: Writers of analysis tables: format and its options.
FORMATS = {"csv": ("csv", {"header": True}), "tsv": ("csv", {"header": True, "sep": "\t"}), "json": ("json", {})}


def write_tables(spark: SparkSession, paths: list[str], folder: str, kind: str = "csv", ending: str = SUFFIX, **options) -> list[str]:
    """The reports of all files as one table a kind of report, below `folder`, as csv, tsv or json."""
    if kind not in FORMATS:
        raise ValueError(f"kind is one of {', '.join(FORMATS)}")
    got = analyse(spark, paths, ending, **options)
    form, how = FORMATS[kind]
    for name in ("summary", "lengths", "charsets", "categories", "masks"):
        got[name].write.mode("overwrite").format(form).options(**how).save(f"{folder}/{name}")
    dropped(got["measured"])
    return [f"{folder}/{name}" for name in ("summary", "lengths", "charsets", "categories", "masks")]
