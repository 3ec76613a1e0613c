"""Ordered union of dumps, newest first: one segment for each key, from the leftmost dump that has it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cut import cut

#: Bytes of a dump in one step of the running maximum.
STRIDE = 1 << 28


def numbered(dumps: list[DataFrame]) -> DataFrame:
    """The dumps as one relation, with their place in the list as `rank`."""
    return reduce(DataFrame.unionByName, [d.withColumn("rank", F.lit(k)) for k, d in enumerate(dumps)])


def ascending_only(rows: DataFrame, source: str = "rank", stride: int = STRIDE) -> DataFrame:
    """Rows whose key exceeds every key before it in its dump.

    The running maximum is taken in strides of the byte offset, each a window of its own, on top of the
    maximum of the strides before it, so a dump is never one partition.
    """
    rows = rows.withColumn("__stride", F.floor(F.col("start") / F.lit(stride)))
    order = Window.partitionBy(source, "__stride").orderBy("start", "length", "key")
    inside = F.max("key").over(order.rowsBetween(Window.unboundedPreceding, -1))
    steps = rows.groupBy(F.col(source).alias("__source"), F.col("__stride").alias("__s")).agg(F.max("key").alias("__m"))
    w = Window.partitionBy("__source").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)  # one row a stride
    steps = steps.select("__source", "__s", F.max("__m").over(w).alias("__before"))
    joined = rows.withColumn("__inside", inside).join(steps, (F.col(source) == F.col("__source")) & (F.col("__stride") == F.col("__s")))
    held = F.greatest("__inside", "__before")  # nulls are skipped
    return joined.filter(held.isNull() | (F.col("key") > held)).drop("__stride", "__source", "__s", "__before", "__inside")


def winner(rows: DataFrame, priority: list[Column]) -> DataFrame:
    """One row for each key, that of least priority; map-side combined, so a key costs one row a task in the shuffle."""
    rest = [c for c in rows.columns if c != "key"]
    return rows.groupBy("key").agg(F.min_by(F.struct(*rest), F.struct(*priority)).alias("__r")).select("key", "__r.*")


def merge(dumps: list[DataFrame], lastrev: bool = False, ns: int | None = None, cutmeta: bool = False, strict: bool = False) -> DataFrame:
    """One segment for each key of the dumps, listed newest first; order by key to write them.

    Cutting comes before the choice: an older version in the wanted namespace wins over a newer one elsewhere.
    Of several segments with one key in a dump the first counts. strict also drops what stands out of order
    in its dump. Pages that no dump lists as deleted stay.
    """
    rows = numbered([d if strict else cut(d, lastrev, ns, cutmeta) for d in dumps])
    if strict:
        rows = cut(ascending_only(rows if ns is None else cut(rows, ns=ns)), lastrev, None, cutmeta)
    return winner(rows, [F.col("rank"), F.col("start"), F.col("length"), F.col("text")]).drop("rank")
