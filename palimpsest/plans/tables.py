"""Dumps and snapshots made of the relational tables, so that every operator runs over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PREAMBLE, TRAILER

#: Namespace of each language.
NAMESPACES = {"en": 0, "fr": 1, "de": 2, "es": 3}
HEAD, TAIL = "<mediawiki>\n  ", "\n</mediawiki>\n"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def namespace(lang: Column) -> Column:
    out = F.lit(4)
    for name, ns in NAMESPACES.items():
        out = F.when(lang == name, ns).otherwise(out)
    return out


def segments(rows: DataFrame, key: Column, ns: Column, text: Column, source: int = 0) -> DataFrame:
    """Any rows as segments of a snapshot in which each key is a slice of its own."""
    k = key.cast("bigint")
    return rows.select(F.lit(source).alias("source"), k.alias("key"), ns.cast("int").alias("ns"), text.alias("text"), k.alias("start"), F.octet_length(text).cast("bigint").alias("length"))


def snapshots(spark: SparkSession, folder: str) -> tuple[DataFrame, list[DataFrame]]:
    """Three states of the documents: today's, with long texts edited; yesterday's, which lacks the newest source; an older one in other words."""
    d = table(spark, folder, "documents")
    key, ns = F.col("doc_id") + 1, namespace(F.col("lang"))
    new = segments(d, key, ns, F.when(F.col("n_chars") > 2000, F.concat("text", F.lit(" [edited]"))).otherwise(F.col("text")))
    ref1 = segments(d.filter("source <> 'src7'"), key, ns, F.col("text"), 1)
    ref2 = segments(d.filter("lang <> 'de'"), key, ns, F.when(F.col("lang") == "es", F.concat("text", F.lit(" [old]"))).otherwise(F.col("text")), 2)
    return new, [ref1, ref2]


def page_markup() -> Column:
    """A page with one revision, of a row of documents."""
    return F.concat(
        F.lit("<page>\n    <title>"), F.col("source"), F.lit("</title>\n    <ns>"), namespace(F.col("lang")), F.lit("</ns>\n    <id>"), F.col("doc_id") + 1,
        F.lit("</id>\n    <revision>\n      <id>"), F.col("n_chars"), F.lit("</id>\n      <contributor>\n        <username>"), F.col("lang"),
        F.lit("</username>\n      </contributor>\n      <minor />\n      <comment>of "), F.col("source"), F.lit("</comment>\n      <text>"), F.col("text"),
        F.lit("</text>\n    </revision>\n  </page>"),
    )


def thread_markup(turns: DataFrame) -> DataFrame:
    """(key, text): each conversation as a page with a revision for each turn."""
    revision = F.concat(F.lit("    <revision>\n      <id>"), F.col("turn"), F.lit("</id>\n      <comment>"), F.col("role"), F.lit("</comment>\n      <text>"), F.col("text"), F.lit("</text>\n    </revision>\n"))
    each = turns.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("turn", revision.alias("r"))))["r"], "").alias("body"))
    return each.select((F.col("conv_id") + 1).alias("key"), F.concat(F.lit("  <page>\n    <id>"), F.col("conv_id") + 1, F.lit("</id>\n"), F.col("body"), F.lit("  </page>")).alias("text"))


def whole_dump(spark: SparkSession, folder: str, where: str = "true") -> DataFrame:
    """Segments of a dump of the documents, with a preamble and a trailer; start and length are left to the scan."""
    d = table(spark, folder, "documents").filter(where)
    ends = spark.createDataFrame([(PREAMBLE, HEAD), (TRAILER, TAIL)], "key long, text string")
    first = d.agg(F.min("doc_id").alias("first"))  # one row: its indent is part of the preamble
    pages = d.crossJoin(F.broadcast(first)).select((F.col("doc_id") + 1).alias("key"), F.concat(F.when(F.col("doc_id") == F.col("first"), "").otherwise("\n  "), page_markup()).alias("text"))
    return pages.unionByName(ends)
