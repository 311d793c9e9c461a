"""Times headline queries over the tables in $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query's full result is written to Spark's no-op sink: nothing is left out, and no driver transfer is timed. The best of
$BENCH_RUNS runs (2) counts. `rates` has MB of text a second for the merges. $BENCH_GB (none by default) adds a merge of files of so many GB of
text, made of the documents' lines with a number before each and every tenth line repeated, run once, with the largest resident size of the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = ("merge_dictionary", "merge_length", "merge_leave_duplicates", "merge_save_duplicates", "pipeline_all", "multi_source_merge", "trim_whitespace", "dollar_hex", "include_regex", "shard_histogram_2", "length_histogram", "category_full", "charset_friendly", "merge_counters")


def main() -> None:
    from pyspark.sql import SparkSession

    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.files.maxPartitionBytes", "4m")
        .config("spark.sql.files.openCostInBytes", "1m")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from linemill.plans.merge import MergeOptions, run_merge
    from linemill.queries import QUERIES
    from pyspark.sql import functions as F

    times: dict[str, float] = {}
    large = None

    def timed(name, run):
        best = None
        for _ in range(runs):
            began = time.time()
            run()
            took = time.time() - began
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)

    for name in HEADLINE:
        timed(name, lambda q=QUERIES[name]: q(spark, sf_dir).write.format("noop").mode("overwrite").save())
    with tempfile.TemporaryDirectory() as folder:
        spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("text").alias("value")).write.text(f"{folder}/in")
        size = sum(p.stat().st_size for p in Path(folder, "in").iterdir()) / 1e6
        timed("merge_files", lambda: run_merge(spark, MergeOptions([f"{folder}/in"], f"{folder}/out.txt")))
        big = float(os.environ.get("BENCH_GB", "0"))
        if big:
            copies = max(1, round(big * 1e9 / size / 1e6))
            lines = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.explode(F.split("text", r"[\r\n]+")).alias("t"))
            lines = lines.crossJoin(spark.range(copies)).select(F.concat(F.when(F.crc32("t") % 10 == 0, F.lit(0)).otherwise(F.col("id")).cast("string"), F.lit(" "), "t").alias("value"))
            lines.write.text(f"{folder}/big")
            size_big = sum(p.stat().st_size for p in Path(folder, "big").iterdir()) / 1e6
            began = time.time()
            stats = run_merge(spark, MergeOptions([f"{folder}/big"], f"{folder}/big-out.txt"))
            took = time.time() - began
            peak = max(int(l.split()[1]) for p in Path("/proc").iterdir() if p.name.isdigit() and (p / "comm").exists() and (p / "comm").read_text().strip() == "java" for l in (p / "status").read_text().splitlines() if l.startswith("VmHWM"))
            large = {"text_mb": round(size_big, 1), "seconds": round(took, 1), "mb_a_second": round(size_big / took, 1), "lines": stats["lines_read"], "written": stats["lines_written"], "jvm_peak_mb": peak // 1024}
    rates = {n: round(size / times[n], 2) for n in ("merge_dictionary", "merge_length", "merge_leave_duplicates", "merge_files")}
    print(json.dumps({"metric": "sum of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir, "cpus": cpus, "text_mb": round(size, 1), "rates": rates} | ({"large_merge": large} if large else {})))
    spark.stop()


if __name__ == "__main__":
    main()
