"""Tables written once to the folder that all executors share.

A table that is read more than once, or that a lost executor must not cost
again, is written as Parquet and read back.  The folder is the session's
``spark.checkpoint.dir``; only a session without it gets one of its own, which
suits one machine (tests) and is refused on a cluster.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared folder, without a slash at its end."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="factlane-llm-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing uses yet."""
    return f"{shared_folder(spark)}/llm/{name}-{uuid.uuid4().hex}"


def write_once(df: DataFrame, path: str, codec: str = "zstd") -> None:
    """``df`` written to ``path``.  What was shuffled for it goes when it is written: nothing reads it again."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)


def keep(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written to the shared folder, and a table that reads it."""
    path = new_path(df.sparkSession, name)
    write_once(df, path, codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_kept(spark: SparkSession) -> None:
    """Delete all tables that ``keep`` has written below the shared folder.

    For the end of a job: results of operators that have not been written yet
    still read those tables.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/llm")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
