"""Weekly from daily dumps: segments that arrive as files are merged into a stored snapshot, the newest version of a page winning.

The snapshot is kept as a log. A batch writes only its own pages (folder v<batch>); reading merges them over the newest whole
snapshot (b<batch>). When the batches since then are more than `COMPACT` of its size, a new whole snapshot is written, so
the work of a batch follows the batch, and that of the rare rewriting is paid for by the pages that came in between. Folders
that a later whole snapshot covers are removed when the next one is complete; a reader that began before has until then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.merge import winner
from ..schema import SEGMENT

_COLUMNS = [f.name for f in SEGMENT]
COMPACT = 0.25


class _Log:
    """The complete folders of a snapshot: batch numbers and sizes of v<n> and b<n>."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        root = self.path(folder)
        self.fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        self.sizes: dict[str, dict[int, int]] = {"v": {}, "b": {}}
        for s in self.fs.listStatus(root) if self.fs.exists(root) else []:
            name = s.getPath().getName()
            if name[:1] in self.sizes and name[1:].isdigit() and self.fs.exists(self.path(s.getPath(), "_SUCCESS")):
                self.sizes[name[0]][int(name[1:])] = self.fs.getContentSummary(s.getPath()).getLength()

    def base(self, before: int) -> int | None:
        return max((n for n in self.sizes["b"] if n < before), default=None)

    def since(self, base: int | None, before: int) -> list[int]:
        return sorted(n for n in self.sizes["v"] if n < before and (base is None or n > base))

    def merged(self, before: int) -> DataFrame:
        """Every page as of the batches with smaller numbers."""
        base = self.base(before)
        folders = [(f"v{n}", -n) for n in self.since(base, before)] + ([(f"b{base}", -base)] if base is not None else [])
        rows = self.spark.createDataFrame([], SEGMENT).withColumn("age", F.lit(0))
        for name, age in folders:
            rows = rows.unionByName(self.spark.read.schema(SEGMENT).parquet(f"{self.folder}/{name}").withColumn("age", F.lit(age)))
        return winner(rows, [F.col("age")]).select(*_COLUMNS)

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(f"{self.folder}/{name}"), True)


_ALL = 1 << 62


def snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Every page in its newest version; empty before the first batch."""
    return _Log(spark, folder).merged(_ALL)


def upsert(batch: DataFrame, number: int, folder: str, compact: float = COMPACT) -> None:
    """Writes a batch, and a whole snapshot with it if it is time for one; a batch that is repeated writes the same again."""
    spark = batch.sparkSession
    # within a batch the higher source number is the newer dump
    rows = winner(batch.select(*_COLUMNS), [-F.coalesce(F.col("source"), F.lit(0)), F.col("start"), F.col("text")])
    rows.select(*_COLUMNS).write.mode("overwrite").parquet(f"{folder}/v{number}")
    log = _Log(spark, folder)
    base = log.base(number)
    size = sum(log.sizes["v"][n] for n in log.since(base, number + 1))
    if base is not None and size <= compact * log.sizes["b"][base]:
        return
    log.merged(number + 1).write.mode("overwrite").parquet(f"{folder}/b{number}")
    if base is not None:  # what the base before covers was replaced a whole snapshot ago
        for kind, numbers in log.sizes.items():
            for n in numbers:
                if n < base or (n == base and kind == "v"):
                    log.remove(f"{kind}{n}")


def follow(spark: SparkSession, incoming: str, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Merges Parquet segments that arrive in `incoming` into the snapshot in `folder`.

    The state is the snapshot itself, not memory of the stream, so its size is not bound by the executors.
    """
    stream = spark.readStream.schema(SEGMENT).parquet(incoming)
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, n: upsert(batch, n, folder))
    return (writer.trigger(availableNow=True) if once else writer).start()
