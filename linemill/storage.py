"""Tables between the steps of a plan, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. In local mode, where it is unset, a folder of this machine's.

    A cluster without that setting has no folder that all of its machines see, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="linemill-checkpoints-")
        atexit.register(shutil.rmtree, _LOCAL[app], True)
    return _LOCAL[app]


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/linemill/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_go(spark: SparkSession):
    """What runs inside leaves no shuffle files behind: once a table is written, nothing reads its plan's exchanges again."""
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


#: Rows of a file where a table's rows are gathered in few files, and how many times fewer than the shuffle partitions these have to be.
FILE_ROWS, FEWER = 1 << 15, 32


def saved(df: DataFrame, name: str, codec: str = "zstd", rows: int | None = None) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: lineage ends here and survives lost executors.

    rows: as many as df has at most, if that is known. Narrow rows that are few for the shuffle partitions are gathered before they are
    written: the work on them is dealt out as before, but a local folder's file costs an executor three processes, for its modes.
    """
    spark, path = df.sparkSession, table_path(df.sparkSession, name)
    files = max(1, -(-rows // FILE_ROWS)) if rows is not None else None
    if files and files * FEWER < int(spark.conf.get("spark.sql.shuffle.partitions")):
        df = df.repartition(files)
    with _shuffles_go(spark):
        df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._linemill_path = path
    return out


def bucketed(df: DataFrame, name: str, buckets: int, column: str) -> DataFrame:
    """saved() as a table in buckets by a column: joins on it move only the other side."""
    spark, path = df.sparkSession, table_path(df.sparkSession, name)
    table = "linemill_" + uuid.uuid4().hex
    with _shuffles_go(spark):
        df.write.bucketBy(buckets, column).option("path", path).option("compression", "uncompressed").format("parquet").saveAsTable(table)
    out = spark.table(table)
    out._linemill_path, out._linemill_table = path, table
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables from saved() or bucketed() that nothing reads any more."""
    for df in tables:
        if getattr(df, "_linemill_table", None):
            df.sparkSession.sql(f"drop table if exists {df._linemill_table}")
        if getattr(df, "_linemill_path", None):
            delete(df.sparkSession, df._linemill_path)
