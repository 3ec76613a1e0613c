"""Session helpers of the corpus operators: shared storage, lineage cuts, table access, joins with hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_KEYS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); one of our own only in local mode, where the session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="palimpsest-"))
    return spark.sparkContext.getCheckpointDir()


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared storage."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def store(df: DataFrame, path: str) -> DataFrame:
    """The DataFrame written once as Parquet and read back: its lineage is cut, and its size is known to the planner."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(df: DataFrame) -> DataFrame:
    """store() in a new folder of the shared storage."""
    return store(df, f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}")


class Scratch:
    """A folder of the shared storage for tables that only the with block needs."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        remove(self.spark, self.path)

    def stored(self, df: DataFrame) -> DataFrame:
        return store(df, f"{self.path}/{uuid.uuid4().hex}")


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, count: str) -> DataFrame:
    """rows inner-joined to keyed, which has each key once and with it the number of rows that have the key.

    Keys of more than one in HOT_KEYS of all rows are fewer than HOT_KEYS, whatever the data: those are
    broadcast, so that no hot key goes to one task; the rest is joined as Spark plans it.
    """
    most = (keyed.agg(F.sum(count)).first()[0] or 0) / HOT_KEYS
    hot = F.broadcast(keyed.filter(F.col(count) > most))
    cold = rows.join(hot.select(key), key, "left_anti").join(keyed.filter(F.col(count) <= most), key)
    return rows.join(hot, key).unionByName(cold)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(taken: list[str], name: str) -> str:
    """A column name like `name` that none of the taken ones equals, in any case of letters."""
    have = {t.lower() for t in taken}
    while name.lower() in have:
        name += "_"
    return name

