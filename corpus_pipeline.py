"""A corpus pipeline of five stages: toxicity, line dedup, near-duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of documents; the last
adds sample_prob and sample_weight. run() writes each stage's result as Parquet in the shared folder and
reads it back as the next one's input, so a lost executor never repeats more than one stage.

Every stage decides on all rows that its predecessor kept:

- toxicity drops the documents whose score reaches the cutoff; without labels of both classes it keeps all;
- line_dedup keeps each repeated long line in the first place of the document with the smallest doc_id, sets n_chars
  anew, and drops a document of which nothing is left (not one that was empty before);
- near_duplicates keeps of each group the document with the smallest doc_id;
- decontamination keeps every document and cuts benchmark passages out of its text;
- mixing draws documents by the probability of their source, language and topic.

Defined results, in all stages: rows with a null doc_id are in no group and lose no line, and are otherwise treated like
others; null and empty texts pass all stages but the last, which samples no text without tokens; null sources and
languages are values of their own; repeated rows share one fate; very long texts are read whole; extra columns pass,
whatever their names; an empty table gives an empty table with the same columns.

ORACLE_SQL is None: SQL cannot express the toxicity stage (nearest examples under a fitted curve) or the
near-duplicate stage (connected components over fingerprints); tests/llm holds the pipeline against a
brute-force version.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import decontaminate, linededup, mixing, simhash, toxicity
from palimpsest.llm.common import remove, shared_dir, store, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents under the toxicity cutoff, by the nearest labelled examples among them."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without lines that stand elsewhere before."""
    return linededup.dedup_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample at the target weights of sources, languages and topics."""
    return mixing.mix(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents; a stage's result is removed when the next one's is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
        docs = store(stage(spark, docs, sf_dir), path)
        if before:
            remove(spark, before)
        before = path
    return docs
