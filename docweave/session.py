"""Session helpers: settings that every query may rely on, and lineage cuts that survive the loss of executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "docweave", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with the settings the results depend on (UTC, non-ANSI-independent options are left alone)."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: the cluster's own setting. Only a local session may go without one."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="docweave-"))
        folder = sc.getCheckpointDir()
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_opened: set[str] = set()


def _own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; it is deleted when the program ends."""
    own = f"{shared_folder(spark).rstrip('/')}/docweave-{spark.sparkContext.applicationId}"
    if own not in _opened:
        _opened.add(own)
        atexit.register(release, spark, own)
    return own


def release(spark: SparkSession, folder: str | None = None) -> None:
    """Deletes what cut_lineage wrote in this session; DataFrames that read it are of no use afterwards."""
    own = folder or _own_folder(spark)
    try:
        _delete(spark, own)
    except Exception:  # the context may be gone already; what is left lies in the cluster's own folder
        pass


def cut_lineage(df: DataFrame) -> DataFrame:
    """df as a table written to the shared folder, read back; later stages survive the loss of any executor.

    Columns are compressed, the files tell the optimizer the table's size, and only columns in use are read again.
    """
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def free(df: DataFrame) -> None:
    """Deletes the table behind a DataFrame of cut_lineage that no plan reads any more."""
    path = getattr(df, "_written_to", None)
    if path:
        _delete(df.sparkSession, path)


__all__ = ["build_session", "cut_lineage", "free", "release", "shared_folder"]
