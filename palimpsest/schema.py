"""Row shapes of the engine: segments of a dump and the deltas between two dumps."""

from __future__ import annotations

from pyspark.sql import types as T

#: Keys of the rows that are not pages: what precedes the first page and what follows the last one.
PREAMBLE, TRAILER = 0, 2**63 - 1

#: Source numbers that stand for no segment: nothing found, and a text that is no slice of its source.
NOT_FOUND, NO_SLICE = -1, -3

#: A longer source segment is treated as if it were absent.
MAX_SOURCE_BYTES = 100_000_000

SEGMENT = T.StructType(
    [
        T.StructField("source", T.IntegerType()),
        T.StructField("key", T.LongType()),
        T.StructField("ns", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
    ]
)

DELTA = T.StructType(
    [
        T.StructField("ord", T.LongType()),
        T.StructField("source_number", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("src_cksum", T.LongType()),
        T.StructField("delta", T.BinaryType()),
        T.StructField("out_cksum", T.LongType()),
    ]
)
