"""Benchmark decontamination by an FM-index per training shard.

A mapped task cuts its documents into shards of about `SHARD_WORDS` words. Each shard becomes one
sequence of word symbols (words that no test phrase holds share one symbol, which loses nothing), with
its suffix array, its Burrows-Wheeler transform in a wavelet matrix and sampled suffix positions. All
test phrases are searched backward at once through wavelet ranks, their occurrences are located from
the samples, and overlapping or touching occurrences are merged into removal spans. Nothing is shuffled.

A test phrase is any run of `n` words of a benchmark item; an item of `min_words` to n-1 words is one
phrase as a whole, and shorter items are not searched, as they would match ordinary prose.

The benchmark travels with the tasks as word hashes, in passes of at most `PASS_WORDS` words (16 MB); how many passes there are is known from a count of its bytes before any of
it is read. Every pass searches the original texts, and the spans of all passes are united before anything is
cut, so results do not depend on the passes. One pass at a time is in the driver.

Defined results: null or empty texts, null or empty items and empty tables give no span; a null doc_id
is carried as null; rows of one doc_id give the united spans of each distinct text, once; extra columns are not
read by `contaminated_spans` and pass unchanged through `decontaminate`; ties cannot arise; very long texts
are read whole, by shards of their own; repeated items count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as tx
from .common import Scratch, free_name, stored

SHARD_WORDS = 400_000
PASS_WORDS = 2_000_000
N_WORDS = 8
MIN_WORDS = 5


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Suffix array of non-negative symbols by prefix doubling that resorts only tied suffixes; a shorter suffix comes first."""
    n = len(seq)
    bits = max(1, int(seq.max() + 1).bit_length())
    depth = 63 // bits
    key = np.zeros(n, np.int64)
    padded = np.concatenate([seq.astype(np.int64) + 1, np.zeros(depth, np.int64)])
    for j in range(depth):
        key = (key << bits) | padded[j : j + n]
    sa = np.argsort(key)
    key = key[sa]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    rank = np.zeros(n + 1, np.int64)  # rank[n] = 0: past the end
    rank[sa] = np.flatnonzero(new)[np.cumsum(new) - 1] + 1
    while True:
        last = np.concatenate([new[1:], [True]])
        slots = np.flatnonzero(~(new & last))
        if not len(slots):
            return sa
        pos = sa[slots]
        key = rank[pos] * (n + 2) + rank[np.minimum(pos + depth, n)]
        order = np.argsort(key)
        key, pos = key[order], pos[order]
        sa[slots] = pos
        differs = np.concatenate([[True], key[1:] != key[:-1]])
        new[slots] = differs
        rank[pos] = slots[np.flatnonzero(differs)][np.cumsum(differs) - 1] + 1
        depth *= 2


class FMIndex:
    """FM-index over symbols 1..sigma-1 (0 is kept for the end); ranks by a wavelet matrix, positions by sampling."""

    def __init__(self, seq: np.ndarray, sigma: int, sample: int = 16):
        seq = np.concatenate([seq, [0]]).astype(np.int32)
        sa = suffix_array(seq)
        self.n = len(seq)
        self.bwt = seq[sa - 1]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))])
        self.bits = max(1, int(sigma - 1).bit_length())
        self.ones, self.zeros = [], []
        level = self.bwt
        for b in range(self.bits - 1, -1, -1):
            bit = (level >> b) & 1
            ranks = np.zeros(self.n + 1, np.int32)
            np.cumsum(bit, out=ranks[1:])
            self.ones.append(ranks)
            self.zeros.append(self.n - int(ranks[-1]))
            level = np.concatenate([level[bit == 0], level[bit == 1]])
        marked = sa % sample == 0
        self.marked = marked
        self.nth = np.cumsum(marked) - 1
        self.sampled = sa[marked]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Row of the FM order that `symbol` before row `at` leads to: start[symbol] + occurrences of symbol before at."""
        base = np.zeros_like(at)
        for level, b in enumerate(range(self.bits - 1, -1, -1)):
            up = ((symbol >> b) & 1).astype(bool)
            ones, zeros = self.ones[level], self.zeros[level]
            a, z = ones[at], ones[base]
            at = np.where(up, zeros + a, at - a)
            base = np.where(up, zeros + z, base - z)
        return self.start[symbol] + at - base

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of all rows of `phrases` at once: indexes of those found, and their row ranges."""
        alive = np.arange(len(phrases))
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[alive, k]
            lo, hi = self.rank(c, lo), self.rank(c, hi)
            keep = lo < hi
            alive, lo, hi = alive[keep], lo[keep], hi[keep]
        return alive, lo, hi

    def locate(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text positions of all rows of the ranges, and which range each is of."""
        size = hi - lo
        of = np.repeat(np.arange(len(lo)), size)
        row = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
        out = np.zeros(len(row), np.int64)
        todo = np.arange(len(row))
        steps = 0
        while len(todo):
            found = self.marked[row]
            out[todo[found]] = self.sampled[self.nth[row[found]]] + steps
            todo, row = todo[~found], row[~found]
            row = self.rank(self.bwt[row], row)
            steps += 1
        return out, of


def phrases_of(items: list[np.ndarray], n: int, min_words: int) -> list[np.ndarray]:
    """Distinct phrases of items given as word hashes: rows of hashes, one array for each length."""
    by_length: dict[int, list[np.ndarray]] = {}
    for h in items:
        if len(h) >= n:
            by_length.setdefault(n, []).append(np.lib.stride_tricks.sliding_window_view(h, n))
        elif len(h) >= min_words:
            by_length.setdefault(len(h), []).append(h[None])
    out = []
    for k, parts in by_length.items():
        rows = np.concatenate(parts)
        out.append(rows[np.unique(tx.windows(rows.ravel(), k)[::k], return_index=True)[1]])
    return out


def passes(benchmark: DataFrame, most: int | None = None, column: str = "text") -> Iterator[list[np.ndarray]]:
    """The distinct items of each pass as word hashes, at most about `most` words of them."""
    most = most or PASS_WORDS
    items = benchmark.select(F.col(column).cast("string").alias("item")).filter("item is not null")
    # a word and what parts it from the next take two bytes at least
    words = F.floor(F.octet_length("item") / 2) + 1
    n = -(-int(items.agg(F.sum(words)).first()[0] or 0) // most)
    for k in range(n):
        own = items.filter(F.pmod(F.xxhash64("item"), F.lit(n)) == k).distinct()

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for _, _, data, offs in tx.chunks(b.column(0)):
                    _, _, first, h = tx.words(data, offs)
                    yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(first.astype(np.int32), pa.array(h.view(np.int64)))], names=["item"])

        rows = own.mapInArrow(hashed, "item array<long>").toArrow()["item"]
        held = [np.asarray(x.values.to_numpy(zero_copy_only=False)).view(np.uint64) for c in rows.chunks for x in c if len(x)]
        if held:
            yield held


class Searcher:
    """Finds the removal spans of the phrases in shards of documents."""

    def __init__(self, phrases: list[np.ndarray]):
        self.vocabulary = np.unique(np.concatenate([p.ravel() for p in phrases]))
        self.phrases = [(np.searchsorted(self.vocabulary, p) + 2).astype(np.int32) for p in phrases]

    def symbols(self, h: np.ndarray) -> np.ndarray:
        """1 for words of no phrase, else 2 and up."""
        at = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == h, at + 2, 1).astype(np.int32)

    def covered(self, seq: np.ndarray) -> np.ndarray:
        """Which places of the shard lie in an occurrence of a phrase."""
        index = FMIndex(seq, len(self.vocabulary) + 2)
        edge = np.zeros(len(seq) + 1, np.int64)
        for p in self.phrases:
            _, lo, hi = index.search(p)
            at, _ = index.locate(lo, hi)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + p.shape[1], -1)
        return np.cumsum(edge[:-1]) > 0

    def spans(self, column: pa.Array) -> tuple[np.ndarray, ...]:
        """Row, first word, end word, first byte, end byte of each merged span."""
        out: list[tuple[np.ndarray, ...]] = []
        held: list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if not size:
                held.clear()
                return
            # symbol 1 stands between documents, so that no occurrence crosses them
            seqs = [np.insert(s, first[1:-1], 1) if len(first) > 2 else s for _, s, first, _, _ in held]
            seq = np.concatenate([x for s in seqs for x in (s, np.ones(1, np.int32))])
            cover = self.covered(seq)
            at = 0
            for (row0, _, first, starts, ends), s in zip(held, seqs):
                c = cover[at : at + len(s)]
                at += len(s) + 1
                if c.any():
                    e = np.flatnonzero(np.diff(np.concatenate([[False], c, [False]]).astype(np.int8)))
                    a, b = e[0::2], e[1::2]
                    # places in the sequence: first[r] + r is where row r begins
                    r = np.searchsorted(first[:-1] + np.arange(len(first) - 1), a, "right") - 1
                    a, b = a - r, b - r
                    out.append((r + row0, a - first[r], b - first[r], starts[a], ends[b - 1], r))
            held.clear()
            size = 0

        bytes_at: dict[int, np.ndarray] = {}
        for row0, _end, data, offs in tx.chunks(column):
            starts, ends, first, h = tx.words(data, offs)
            bytes_at[row0] = offs
            of = tx.row_of(first)
            held.append((row0, self.symbols(h), first, starts - offs[of], ends - offs[of]))
            size += len(h)
            if size >= SHARD_WORDS:
                flush()
        flush()
        if not out:
            return (np.zeros(0, np.int64),) * 5
        return tuple(np.concatenate([o[k] for o in out]) for k in range(5))


def united(spans: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Searcher.spans() of several passes over the same texts as one, overlapping and touching spans merged, in order."""
    row, a, z, x, y = (np.concatenate(c) for c in zip(*spans))
    order = np.lexsort((a, row))
    row, a, z, x, y = (c[order] for c in (row, a, z, x, y))
    if not len(row):
        return row, a, z, x, y
    wide = int(z.max()) + 2
    far = np.maximum.accumulate(row * wide + z)  # the farthest end so far within the row
    far_byte = np.maximum.accumulate(row * (int(y.max()) + 2) + y) - row * (int(y.max()) + 2)
    new = np.concatenate([[True], row[1:] * wide + a[1:] > far[:-1]])
    f = np.flatnonzero(new)
    last = np.concatenate([f[1:], [len(row)]]) - 1
    return row[f], a[f], (far - row * wide)[last], x[f], far_byte[last]


def _finder(items: list[np.ndarray], n: int, min_words: int):
    """A function of a text column that gives the spans of one pass; the index of the phrases is made on first use."""
    made: list[Searcher | None] = []

    def spans(column: pa.Array) -> tuple[np.ndarray, ...]:
        if not made:
            phrases = phrases_of(items, n, min_words)
            made.append(Searcher(phrases) if phrases else None)
        return made[0].spans(column) if made[0] else (np.zeros(0, np.int64),) * 5

    return spans


_SPANS = "doc_id long, of long, word_start long, word_end long, byte_start long, byte_end long"


def _spans(base: DataFrame, benchmark: DataFrame, n: int, min_words: int) -> DataFrame | None:
    """(doc_id, of, spans): the merged spans of each text of the rows (doc_id, of, text) that has any; a pass after the other over the same texts."""

    def run(items: list[np.ndarray]):
        def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            spans = _finder(items, n, min_words)
            for b in batches:
                row, *rest = united([spans(b.column(2))])
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *(pa.array(c, pa.int64()) for c in rest)], names=[f.split()[0] for f in _SPANS.split(", ")])

        return find

    found = passes(benchmark)
    first = list(islice(found, 2))
    if len(first) < 2:
        return _united(base.mapInArrow(run(first[0]), _SPANS)) if first else None
    with Scratch(base.sparkSession) as scratch:  # one pass at a time is in the driver
        parts = [scratch.stored(base.mapInArrow(run(items), _SPANS)) for items in chain(first, found)]
        return stored(_united(reduce(DataFrame.unionByName, parts)))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("of"), F.col("text").cast("string").alias("text"))


def _united(spans: DataFrame) -> DataFrame:
    """One row (doc_id, of, spans) for each text, its spans merged."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(2)
            row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            row, *rest = united([(row, *(flat.field(k).to_numpy() for k in range(4)))])
            offsets = np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32)
            values = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in rest], fields=list(flat.type))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(offsets, values)], names=["doc_id", "of", "spans"])

    fields = ("word_start", "word_end", "byte_start", "byte_end")
    schema = "doc_id long, of long, spans array<struct<" + ", ".join(f"{f}: bigint" for f in fields) + ">>"
    return spans.groupBy("doc_id", "of").agg(F.collect_set(F.struct(*fields)).alias("spans")).mapInArrow(merge, schema)


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, word_start, word_end): merged spans of benchmark phrases, in words of the document, the end exclusive."""
    spans = _spans(_rows(docs), benchmark, n, min_words)
    if spans is None:
        return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("word_start"), F.lit(0).cast("long").alias("word_end")).filter(F.lit(False))
    return spans.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.word_start", "s.word_end")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with every removal span cut out of the text (and n_chars set anew, if there is such a column).

    Every document stays, a wholly contaminated one with what is left around its spans; untouched texts keep their bytes.
    """
    found = list(islice(passes(benchmark), 2))
    schema = T.StructType(docs.schema.fields)
    counted = "n_chars" in docs.columns
    if not found:
        return docs
    if len(found) == 1:
        return docs.mapInArrow(_cutter(found[0], n, min_words, counted), schema)
    # several passes: the spans of all of them, once for each text, then one cut
    cuts = _spans(_rows(docs), benchmark, n, min_words)
    name = free_name(docs.columns, "cuts")
    spans = F.transform("c.spans", lambda s: F.struct(s["byte_start"].alias("a"), s["byte_end"].alias("z"))).alias(name)
    on = F.col("d.doc_id").cast("long").eqNullSafe(F.col("c.doc_id")) & (F.xxhash64(F.col("d.text").cast("string")) == F.col("c.of"))
    return docs.alias("d").join(cuts.alias("c"), on, "left").select("d.*", spans).mapInArrow(_cut_joined(counted), schema)


def _cut(b: pa.RecordBatch, by: dict[int, list[tuple[int, int]]], counted: bool) -> pa.RecordBatch:
    """The batch with the byte spans of its rows cut out of the texts."""
    k = b.schema.get_field_index("text")
    texts = b.column(k).to_pylist()
    for r, cuts in by.items():
        raw, at, keep = texts[r].encode(), 0, []
        for x, y in cuts:
            keep.append(raw[at:x])
            at = y
        texts[r] = b"".join([*keep, raw[at:]]).decode()
    columns = list(b.columns)
    columns[k] = pa.array(texts, b.schema.field(k).type)
    if counted:
        c = b.schema.get_field_index("n_chars")
        old = b.column(c).to_pylist()
        for r in by:
            old[r] = len(texts[r])
        columns[c] = pa.array(old, b.schema.field(c).type)
    return pa.RecordBatch.from_arrays(columns, schema=b.schema)


def _cutter(items: list[np.ndarray], n: int, min_words: int, counted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = _finder(items, n, min_words)
        for b in batches:
            row, _, _, a, z = united([spans(b.column(b.schema.get_field_index("text")))])
            by: dict[int, list[tuple[int, int]]] = {}
            for r, x, y in zip(row.tolist(), a.tolist(), z.tolist()):
                by.setdefault(r, []).append((x, y))
            yield _cut(b, by, counted) if by else b

    return run


def _cut_joined(counted: bool):
    """The same for batches whose last column has the byte spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cuts = b.column(b.num_columns - 1).to_pylist()
            b = b.select(list(range(b.num_columns - 1)))
            by = {r: [(s["a"], s["z"]) for s in c] for r, c in enumerate(cuts) if c}
            yield _cut(b, by, counted) if by else b

    return run
