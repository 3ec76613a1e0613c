"""Repeated passages across documents by sparse suffix arrays.

Only suffixes that start at minimiser positions are kept: of each run of `WINDOW` word k-grams the one
with the smallest hash, the leftmost on ties. A passage of `min_words` tokens that occurs twice holds the
same minimiser in both places, at most WINDOW-1 tokens from its start, so both suffixes share their next
min_words - WINDOW + 1 tokens. The suffixes are hashed by that prefix, sorted, and compared with their
neighbours: one with no equal neighbour of another document cannot be part of a repeated passage and is dropped.
The survivors go back to their texts and are extended left (to the earliest start whose first minimiser they
are) and right (to min_words tokens); the extensions are sorted and compared once more, and the starts
that match are merged into the longest repeated spans.

The result is exact up to 64-bit hash equality: a token is covered if and only if it lies in a run of
`min_words` raw tokens (split at ASCII white space, case and punctuation kept) that occurs in two or more
documents. What a document repeats within itself alone is no passage.

Both sorts are made in two levels, so that a suffix that everything repeats does not fall to one task. Each
task sorts runs of `RUN` suffixes and compares neighbours there: those with an equal neighbour of another document
are decided, and one representative of theirs goes on with the undecided ones to the sort of all. In that sort a
suffix has so no more rows than a run of a task has from one document, for each run, however many documents hold it;
the decided places go as one list for each text.

Defined results: null and empty texts and texts shorter than min_words give no span; empty tables give an
empty result; a document is a doc_id and its text: repeated rows are one document and have their spans given once,
rows of one doc_id with different texts are different documents; a null doc_id is carried as null, and such rows
are told apart by their texts;
extra columns are not read; very long texts are read whole; ties cannot arise, as each text's places are sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as tx

MIN_WORDS = 50
GRAM = 8
RUN = 1 << 19
WINDOW = 24


def first_minimisers(h: np.ndarray, first: np.ndarray, min_words: int, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of min_words tokens within one row, and for each the place of its leftmost minimiser."""
    n = len(h)
    size = np.diff(first)
    starts = np.arange(n) - np.repeat(first[:-1], size)
    starts = np.flatnonzero(starts + min_words <= np.repeat(size, size))
    if not len(starts):
        return starts, starts
    g = tx.windows(h, gram)
    bits = U(max(1, int(n).bit_length()))
    low = (g >> bits << bits) | np.arange(len(g), dtype=np.uint64)  # the smallest hash, then the leftmost
    span = 1
    while span * 2 <= window:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if window > span:
        low = np.minimum(low[: len(low) - (window - span)], low[window - span :])
    return starts, (low[starts] & ((U(1) << bits) - U(1))).astype(np.int64)


U = np.uint64


def _long(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(doc_id, token_start, token_end): merged spans of repeated runs of min_words raw tokens, the end exclusive."""
    window = max(1, min(window, min_words - gram + 1))
    if gram > min_words:
        raise ValueError("gram must not exceed min_words")
    prefix = min_words - window + 1

    def rows_of(h: np.ndarray, at: np.ndarray, first: np.ndarray, n: int, b: pa.RecordBatch, row0: int) -> tuple[np.ndarray, ...]:
        """Hash of the n tokens from each place on, its text, its place in it, and the text's doc_id."""
        row = np.searchsorted(first, at, "right") - 1
        take = pa.array(row + row0)
        ids = b.column(0).take(take)
        return tx.windows(h, n)[at], b.column(1).take(take).to_numpy(), at - first[row], ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for b in batches:
            for row0, _, data, offs in tx.chunks(b.column(2)):
                s, e, first = tx.runs(data, offs, tx.TOKEN)
                h = tx.hashes(data, s, e)
                _, at = first_minimisers(h, first, min_words, gram, window)
                yield rows_of(h, np.unique(at), first, prefix, b, row0)

    def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for b in batches:
            kept = b.column(3)
            for row0, end, data, offs in tx.chunks(b.column(2)):
                s, e, first = tx.runs(data, offs, tx.TOKEN)
                h = tx.hashes(data, s, e)
                starts, at = first_minimisers(h, first, min_words, gram, window)
                part = kept.slice(row0, end - row0)
                survives = np.zeros(len(h), bool)
                survives[part.flatten().to_numpy(zero_copy_only=False) + np.repeat(first[:-1], np.diff(part.offsets.to_numpy()))] = True
                yield rows_of(h, starts[survives[at]], first, min_words, b, row0)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            o = lists.offsets.to_numpy()
            at = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            row = np.repeat(np.arange(len(o) - 1), np.diff(o))
            order = np.lexsort((at, row))
            at, row = at[order], row[order]
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (at[1:] > at[:-1] + min_words)])[: len(at)]  # repeated places do no harm
            f = np.flatnonzero(new)
            last = np.concatenate([f[1:], [len(at)]]) - 1 if len(f) else f
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row[f])), pa.array(at[f]), pa.array(at[last] + min_words)], names=["doc_id", "token_start", "token_end"])

    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    base = docs.select(doc_id.alias("doc_id"), F.xxhash64(F.coalesce(doc_id, F.lit(0)), doc_id.isNull(), text).alias("row"), text.alias("text"))
    found = _with_equal_neighbour(base.mapInArrow(_sorted_runs(anchors), _PLACES), "places").select("row", "places")
    texts = base.join(found, "row").select("doc_id", "row", "text", "places")
    spans = _with_equal_neighbour(texts.mapInArrow(_sorted_runs(extended), _PLACES), "starts")
    return spans.select("doc_id", "starts").mapInArrow(merged, "doc_id long, token_start long, token_end long")


_PLACES = "suffix long, kind tinyint, row long, at int, more array<int>, doc_id long"
_DECIDED, _STANDS, _OPEN = 0, 1, 2


def _sorted_runs(source):
    """Rows of _PLACES: of each run of suffixes, the decided ones (under a hash of their own), one that stands for each group of equal ones, the open ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for part in source(batches):
            if len(part[0]):
                held.append(part)
                size += len(part[0])
            if size >= RUN:
                yield from compared(*(np.concatenate(c) for c in zip(*held)))
                held, size = [], 0
        if held:
            yield from compared(*(np.concatenate(c) for c in zip(*held)))

    def compared(key: np.ndarray, row: np.ndarray, at: np.ndarray, doc: np.ndarray, null: np.ndarray) -> Iterator[pa.RecordBatch]:
        order = np.lexsort((at, row, key))
        key, row, at, doc, null = (c[order] for c in (key, row, at, doc, null))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([first, [len(key)]]))
        shared = row[first] != row[first + size - 1]  # neighbours are in order of their texts
        equal = np.repeat(shared, size)
        # one list of decided places for each text, under a hash of its own, and with it the text's doc_id
        by_text = np.argsort(row, kind="stable")
        f = np.flatnonzero(np.concatenate([[True], row[by_text][1:] != row[by_text][:-1]]))
        one = by_text[f]
        decided = by_text[equal[by_text]]
        offsets = np.concatenate([np.add.reduceat(equal[by_text].astype(np.int64), f).cumsum()])
        offsets = np.concatenate([[0], offsets]).astype(np.int32)
        lists = pa.ListArray.from_arrays(offsets, pa.array(at[decided].astype(np.int32)))
        yield batch(tx.mix(row[one].view(U)), _DECIDED, row[one], np.zeros(len(one)), lists, pa.array(doc[one], mask=null[one]))
        for kind, k in ((_STANDS, first[shared]), (_OPEN, np.flatnonzero(~equal))):
            yield batch(key[k], kind, row[k] if kind == _OPEN else np.zeros(len(k), np.int64), at[k] if kind == _OPEN else np.zeros(len(k)), pa.nulls(len(k), pa.list_(pa.int32())), pa.nulls(len(k), pa.int64()))

    def batch(key: np.ndarray, kind: int, row: np.ndarray, at: np.ndarray, more: pa.Array, doc: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([_long(key), pa.array(np.full(len(key), kind, np.int8)), pa.array(row), pa.array(at.astype(np.int32)), more, doc], names=["suffix", "kind", "row", "at", "more", "doc_id"])

    return run


def _with_equal_neighbour(rows: DataFrame, name: str) -> DataFrame:
    """(row, doc_id, name): the places of each text whose suffix has an equal neighbour of another text, decided or in the sort of all."""
    w = Window.partitionBy("suffix", F.col("kind") == _DECIDED)
    others = (F.min("kind").over(w) == _STANDS) | (F.min("row").over(w) != F.max("row").over(w))
    kept = rows.withColumn("others", others).filter((F.col("kind") == _DECIDED) | (F.col("kind") == _OPEN) & F.col("others"))
    open_places = F.collect_list(F.when(F.col("kind") == _OPEN, F.col("at")))  # null, and so left out, of the others
    places = F.concat(F.flatten(F.collect_list("more")), open_places)
    return kept.groupBy("row").agg(F.max("doc_id").alias("doc_id"), places.alias(name)).filter(F.size(name) > 0)
