"""Command line: merge, analyse, cleantemp, crash, about, help. Exit codes: 0 done, 1 wrong arguments, -1 failure, -2 no crash report."""

from __future__ import annotations

import argparse
import os
import platform
import shutil
import signal
import sys
import tempfile
import threading
import traceback
from datetime import datetime
from pathlib import Path

from .functions.bytes import WHITESPACE
from .functions.sizes import format_size
from .plans.analyse import FORMATS
from .plans.merge import SIZES, MergeOptions

NAME = "linemill"


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(NAME, description="Merges, sorts, de-duplicates and profiles very large collections of text lines on Spark.")
    verbs = out.add_subparsers(dest="verb", required=True)
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("--debug", action="store_true")
    m = verbs.add_parser("merge", parents=[common], help="merge files and folders to one sorted file")
    m.add_argument("-i", "--input", nargs="+", action="extend", default=[], dest="inputs")
    m.add_argument("-o", "--output", default="")
    m.add_argument("-t", "--temp-folder")
    for name, (default, _, _) in SIZES.items():
        m.add_argument("--" + name.replace("_", "-"), default=str(default) + " B")
    for name in ("leave-duplicates", "save-duplicates", "save-stats", "keep-nulls", "keep-blanks", "convert-to-dollar-hex", "force-large-sort", "exact"):
        m.add_argument("--" + name, action="store_true")
    for name, default in (("split-workers", 0), ("sort-workers", 0), ("io-workers", 8), ("max-outstanding-sorted-chunks", 2), ("split-count", 16)):
        m.add_argument("--" + name, type=int, default=default)
    m.add_argument("-s", "--sort-by", default="dictionary", type=str.lower)
    m.add_argument("--sort-algorithm", default="auto", type=str.lower)
    m.add_argument("--whitespace", default="nochange", type=str.lower)
    m.add_argument("--whitespace-chars", nargs="*", default=[], type=lambda x: int(x, 0))
    m.add_argument("--include-by-regex")
    m.add_argument("--exclude-by-regex")
    kind = m.add_mutually_exclusive_group()
    kind.add_argument("--parts", action="store_true", help="leave the output a folder of ordered parts")
    kind.add_argument("--one-file", action="store_true", help="one file whatever its size")
    a = verbs.add_parser("analyse", aliases=["analyze"], parents=[common], help="profile files")
    a.add_argument("-i", "--input", nargs="+", action="extend", default=[], dest="inputs")
    a.add_argument("-e", "--file-ending", default=".Analysis.txt")
    a.add_argument("--format", default="text", choices=["text", *FORMATS], help="text: a report beside each file; else tables of all files below --output")
    a.add_argument("-o", "--output")
    a.add_argument("-t", "--temp-folder")
    a.add_argument("-w", "--workers", type=int, default=0)
    for name in ("large-threshold", "large-chunk", "line-buffer-size", "read-file-buffer-size"):
        a.add_argument("--" + name)
    a.add_argument("--decode-hex", action="store_true")
    a.add_argument("--exact", action="store_true")
    c = verbs.add_parser("cleantemp", parents=[common], help="delete temporary files")
    c.add_argument("-t", "--temp-folder")
    k = verbs.add_parser("crash", parents=[common], help="fail on purpose")
    k.add_argument("-f", "--from", dest="source", default="throw", type=str.lower, choices=["throw", "task"])
    verbs.add_parser("about", parents=[common], help="what this is")
    h = verbs.add_parser("help", parents=[common], help="help on a verb")
    h.add_argument("topic", nargs="?")
    return out


def temp_root(folder: str | None = None) -> Path:
    return Path(folder or os.path.join(tempfile.gettempdir(), NAME))


def clean_temp(folder: str | None = None) -> int:
    """Deletes the temporary tree; the bytes that it held."""
    root = temp_root(folder)
    held = sum(p.stat().st_size for p in root.rglob("*") if p.is_file()) if root.exists() else 0
    shutil.rmtree(root, ignore_errors=True)
    return held


def crash_report(error: BaseException) -> str | None:
    """A file with the error and the machine, in the current folder or else the home folder."""
    text = "".join(traceback.format_exception(error)) + f"\n{platform.platform()}\nPython {sys.version}\ncores {os.cpu_count()}\n"
    for folder in (Path.cwd(), Path.home()):
        try:
            path = folder / f"{NAME}_CrashDetails_{datetime.now():%Y%m%d_%H%M%S}.txt"
            path.write_text(text)
            return str(path)
        except OSError:
            continue
    return None


def session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName(NAME).getOrCreate()


def cancellable(run):
    """run(spark) as one job group; the first Ctrl-C cancels its jobs, which ends the run with an error after temporary files are gone."""
    spark = session()
    sc = spark.sparkContext
    sc.setJobGroup(NAME, NAME, interruptOnCancel=True)
    stopped = []

    def stop(*_):
        signal.signal(signal.SIGINT, signal.default_int_handler)  # a second one ends at once
        stopped.append(True)
        threading.Thread(target=sc.cancelJobGroup, args=(NAME,)).start()  # this thread's connection waits for the job

    before = signal.signal(signal.SIGINT, stop) if threading.current_thread() is threading.main_thread() else None
    try:
        return run(spark)
    except Exception as e:
        if stopped:
            raise RuntimeError("cancelled") from e
        raise
    finally:
        if before is not None:
            signal.signal(signal.SIGINT, before)


def dispatch(args: argparse.Namespace) -> int:
    if args.verb == "about":
        print(f"{NAME}: sorted merges and profiles of text lines as Spark plans")
    elif args.verb == "help":
        parser().parse_args([args.topic, "--help"] if args.topic else ["--help"])
    elif args.verb == "cleantemp":
        print(f"freed {format_size(clean_temp(args.temp_folder))}")
    elif args.verb == "crash":
        if args.source == "task":
            session().range(1).selectExpr("raise_error('crash')").collect()
        raise RuntimeError("crash")
    elif args.verb == "merge":
        from .plans.merge import run_merge

        values = vars(args)
        chars = bytes(values.pop("whitespace_chars")) or WHITESPACE
        options = MergeOptions(**{k: v for k, v in values.items() if k not in ("verb", "debug", "parts", "one_file")}, whitespace_chars=chars, single_file=False if args.parts else True if args.one_file else None)
        if found := options.errors() or (options.include_by_regex or options.exclude_by_regex) and options.errors(session()):
            print("\n".join(found), file=sys.stderr)
            return 1
        for k, v in cancellable(lambda spark: run_merge(spark, options)).items():
            print(f"{k}: {v}")
    else:
        from .plans.analyse import write_reports, write_tables

        if not args.inputs or (args.format != "text" and not args.output):
            print("inputs are required, and an output for tables", file=sys.stderr)
            return 1
        how = {"ending": args.file_ending, "decode_hex": args.decode_hex, "exact": args.exact}
        for path in cancellable(lambda spark: write_reports(spark, args.inputs, **how) if args.format == "text" else write_tables(spark, args.inputs, args.output, args.format, **how)):
            print(path)
    return 0


def main(argv: list[str] | None = None) -> int:
    try:
        args = parser().parse_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0
    try:
        return dispatch(args)
    except SystemExit as e:
        return 1 if e.code else 0
    except Exception as e:  # noqa: BLE001  the report is for any failure
        path = crash_report(e)
        print(f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}\n{path or 'no crash report could be written'}", file=sys.stderr)
        return -1 if path else -2


if __name__ == "__main__":
    sys.exit(main())
