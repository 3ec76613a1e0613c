"""Session helpers: the folder that all executors share, and tables written in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Most bytes of rows that Python is given at a time.
BATCH = 1 << 22


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a folder of our own only in local mode, where the session names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="palimpsest-"))
    return spark.sparkContext.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The rows written once as Parquet in the shared folder and read back: nothing before is done twice, by plan or by a lost executor."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Lets the session send Python at most BATCH bytes of rows (and one row more) at a time; a lower limit stays.

    Every worker holds several copies of a batch, and an executor has a few workers for each core. Spark's own limit
    of 64 MB is reached only by large tables, so that memory grows with the table until then.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < held <= BATCH:
        spark.conf.set(name, str(BATCH))


def local_path(path: str) -> str:
    """A path that Python can open: of a file system that every node mounts."""
    short = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    if "://" in short:
        raise ValueError(f"{path}: dumps and pack files are read and written by path, so their file system must be mounted on every node")
    return short
