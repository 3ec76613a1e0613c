"""Line deduplication by a sharded minimal perfect hash.

Each distinct line is known by a 64-bit hash. The distinct hashes are split into shards of about `SHARD_LINES`;
each shard gets a minimal perfect hash (levels of collision-free bit arrays with ranks) that numbers its lines,
and at that number a 16-bit fingerprint, a saturating 8-bit count of occurrences and, for repeated lines alone,
the smallest doc_id that holds the line. Documents send probes of four numbers (hash, doc_id, place, copies) to
the shards and never a line's text; a probe is answered from the arrays. A task reads a shard's arrays and then
its probes as a stream, in batches.

Lines of more than one in `HOT_LINES` of all occurrences are fewer than HOT_LINES, whatever the data: their arrays
(some megabytes at most) go to the tasks that read the documents, which answer those probes on the spot. So a line
that everything repeats is neither sent nor served by one task.

A line is a piece of the text between line feeds, taken byte for byte. Lines of at least `min_chars`
characters that occur more than once are repeated; the occurrence kept is the first one in the document
with the smallest doc_id.

Defined results: a null text stays null and an empty text empty; shorter and empty lines are always kept;
a document whose every line went keeps an empty text, and `dedup_lines` drops it if `drop_emptied`; a row
with a null doc_id is passed on untouched and not counted; rows with the same doc_id count as one document
for which-is-first, and each keeps its first occurrence of a line; extra columns pass unchanged; an empty
table gives an empty table; very long texts are read whole; ties (a line twice in the first document) go to the
first place. Counts saturate at 255 in the arrays, which decides nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .common import Scratch, free_name, stored

MIN_CHARS = 20
SHARD_LINES = 1 << 20
HOT_LINES = 100_000
U = np.uint64
_ARRAYS, _PROBE, _ANSWERED = 0, 1, 2


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit keys; levels hold a bit for each key that no other key of the level meets."""

    def __init__(self, keys: np.ndarray, gamma: float = 1.6):
        self.levels: list[tuple[int, np.ndarray]] = []
        left = keys.astype(U)
        while len(left):
            size = max(64, int(len(left) * gamma))
            at = self._at(left, len(self.levels), size)
            bits = np.bincount(at, minlength=size) == 1
            self.levels.append((size, bits))
            left = left[~bits[at]]
        self._rank()

    def _rank(self) -> None:
        base, self.ranks = 0, []
        for _, bits in self.levels:
            r = np.cumsum(bits) - 1 + base
            self.ranks.append(r)
            base += int(bits.sum())
        self.size = base

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (tx.mix(keys + U((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % U(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, -1 for some that are not members."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, (size, bits) in enumerate(self.levels):
            at = self._at(keys[todo], level, size)
            hit = bits[at]
            out[todo[hit]] = self.ranks[level][at[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
        return out

    def dump(self) -> bytes:
        head = np.array([len(self.levels), *(s for s, _ in self.levels)], np.int64).tobytes()
        return head + b"".join(np.packbits(b).tobytes() for _, b in self.levels)

    @classmethod
    def load(cls, raw: bytes) -> tuple[PerfectHash, int]:
        """The hash, and the bytes that it took."""
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        sizes = np.frombuffer(raw, np.int64, n, 8)
        self, at = cls.__new__(cls), 8 * (n + 1)
        self.levels = []
        for s in sizes.tolist():
            w = (s + 7) // 8
            self.levels.append((s, np.unpackbits(np.frombuffer(raw, np.uint8, w, at), count=s).astype(bool)))
            at += w
        self._rank()
        return self, at


def fingerprint(h: np.ndarray) -> np.ndarray:
    return (h >> U(48)).astype(np.uint16)


def dump_shard(h: np.ndarray, n: np.ndarray, first_doc: np.ndarray) -> bytes:
    """Perfect hash, fingerprints, counts and first documents of a shard's distinct lines."""
    mph = PerfectHash(h)
    order = np.empty(len(h), np.int64)
    order[mph(h)] = np.arange(len(h))
    h, n, first_doc = h[order], n[order], first_doc[order]
    return mph.dump() + fingerprint(h).tobytes() + np.minimum(n, 255).astype(np.uint8).tobytes() + first_doc[n > 1].astype(np.int64).tobytes()


class Shard:
    def __init__(self, raw: bytes):
        self.mph, at = PerfectHash.load(raw)
        m = self.mph.size
        self.fp = np.frombuffer(raw, np.uint16, m, at)
        self.count = np.frombuffer(raw, np.uint8, m, at + 2 * m)
        self.nth = np.cumsum(self.count > 1) - 1
        self.first = np.frombuffer(raw[at + 3 * m :], np.int64)

    def probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of each line, 0 if it is unknown, and its first document, if its count is over 1."""
        at = self.mph(h)
        known = (at >= 0) & (len(self.fp) > 0)
        known[known] = self.fp[at[known]] == fingerprint(h[known])
        count = np.zeros(len(h), np.int64)
        count[known] = self.count[at[known]]
        first = np.full(len(h), -1, np.int64)
        rep = count > 1
        first[rep] = self.first[self.nth[at[rep]]]
        return count, first


def _lines(min_chars: int, hot: tuple[np.ndarray, bytes] | None = None, shards: int = 1):
    """(h, doc_id, place, copies): each distinct long line of each row at its first place, and each later place with copies 0.

    A place is the number of the line below 32 bits of the text's hash, as rows of one doc_id may differ. With
    the sorted hashes and the arrays of hot lines, rows are probes (shard, kind, h, doc_id, place, copies): of the hot lines only places
    to drop, of kind `_ANSWERED`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, known = (np.append(hot[0], U(0)), Shard(hot[1])) if hot else (None, None)
        for b in batches:
            for row0, _, data, offs in tx.chunks(b.column(1)):
                ends = np.flatnonzero(data == 10)
                starts = np.concatenate([[0], ends[:-1] + 1])
                first = np.searchsorted(starts, offs)
                row = tx.row_of(first)
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                keep = np.flatnonzero(chars[ends] - chars[starts] >= min_chars)
                if not len(keep):
                    continue
                h, row = tx.hashes(data, starts[keep], ends[keep]), row[keep]
                line = keep - first[row]
                order = np.lexsort((line, h, row))
                h, row, line = h[order], row[order], line[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])
                f = np.flatnonzero(new)
                copies = np.zeros(len(h), np.int32)
                copies[f] = np.diff(np.concatenate([f, [len(h)]]))
                take = pa.array(row + row0)
                doc, place = b.column(0).take(take).to_numpy(), b.column(2).take(take).to_numpy() << 32 | line
                if known is None:
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(doc), pa.array(place), pa.array(copies)], names=["h", "doc_id", "place", "copies"])
                    continue
                member = np.searchsorted(keys[:-1], h)
                member = (keys[member] == h) & (member < len(keys) - 1)  # only members may ask: a fingerprint is too short for strangers
                count, holder = np.zeros(len(h), np.int64), np.full(len(h), -1)
                count[member], holder[member] = known.probe(h[member])
                drop = (count > 1) & ((doc != holder) | (copies == 0))
                kind = np.where(drop, _ANSWERED, _PROBE).astype(np.int32)
                shard = np.where(drop, tx.mix(doc.view(U)) % U(shards), h % U(shards)).astype(np.int32)
                k = np.flatnonzero(drop | (count == 0))
                yield pa.RecordBatch.from_arrays([pa.array(c[k]) for c in (shard, kind, h.view(np.int64), doc, place, copies)], names=["shard", "kind", "h", "doc_id", "place", "copies"])

    return run


def text_hash(text: Column) -> Column:
    """32 bits, signed."""
    return F.shiftright(F.xxhash64(text.cast("string")), 32)


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, shard_lines: int = SHARD_LINES, hot_lines: int = HOT_LINES) -> DataFrame:
    """(doc_id, text_hash, line): the numbers, from 0, of the lines to drop from the row with this hash."""
    spark = docs.sparkSession
    base = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_hash(F.col("text")))
    with Scratch(spark) as scratch:
        lines = base.mapInArrow(_lines(min_chars), "h long, doc_id long, place long, copies int")
        distinct = scratch.stored(lines.groupBy("h").agg(F.sum("copies").alias("n"), F.min("doc_id").alias("first_doc")))
        lines_all, lines_distinct = distinct.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-lines_distinct // shard_lines))
        most = max(1, lines_all // hot_lines)  # fewer than hot_lines lines are more frequent
        hot = distinct.filter(F.col("n") > most).toArrow()
        keys = hot["h"].to_numpy().view(U)
        hot_arrays = np.sort(keys), dump_shard(keys, hot["n"].to_numpy(), hot["first_doc"].to_numpy())

        def build(t: pa.Table) -> pa.Table:
            h = t["h"].to_numpy().view(U)
            return pa.table({"shard": t["shard"].slice(0, 1), "arrays": pa.array([dump_shard(h, t["n"].to_numpy(), t["first_doc"].to_numpy())], pa.binary())})

        shard = F.expr(f"cast(((h % {shards}) + if(h < 0, {2**64 % shards}, 0) + {shards}) % {shards} as int)")  # of the hash as an unsigned number
        arrays = stored(distinct.filter(F.col("n") <= most).withColumn("shard", shard).groupBy("shard").applyInArrow(build, "shard int, arrays binary"))

    probes = base.mapInArrow(_lines(min_chars, hot_arrays, shards), "shard int, kind int, h long, doc_id long, place long, copies int")
    empty = [F.lit(None).cast(t).alias(c) for c, t in (("h", "long"), ("doc_id", "long"), ("place", "long"), ("copies", "int"))]
    rows = probes.withColumn("arrays", F.lit(None).cast("binary")).unionByName(arrays.select("shard", F.lit(_ARRAYS).alias("kind"), *empty, "arrays"))
    drops = rows.repartition(shards, "shard").sortWithinPartitions("shard", "kind").mapInArrow(_serve, "doc_id long, place long")
    return drops.select("doc_id", F.shiftright("place", 32).alias("text_hash"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int").alias("line"))


def _serve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places to drop, from each shard's arrays and then its probes."""
    held, arrays = -1, None
    for b in batches:
        if not b.num_rows:
            continue
        shard, kind, h, doc, place, copies = (b.column(k).fill_null(0).to_numpy() for k in range(6))
        cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])).tolist()
        for lo, hi in zip(cuts, [*cuts[1:], len(shard)]):
            if shard[lo] != held:
                held, arrays = int(shard[lo]), None
            if kind[lo] == _ARRAYS:
                arrays = Shard(b.column(6)[lo].as_py())
            k = kind[lo:hi]
            drop = k == _ANSWERED
            ask = np.flatnonzero(k == _PROBE)
            if len(ask):
                count, first = arrays.probe(h[lo:hi][ask].view(U))
                drop[ask] = (count > 1) & ((doc[lo:hi][ask] != first) | (copies[lo:hi][ask] == 0))
            if drop.any():
                yield pa.RecordBatch.from_arrays([pa.array(doc[lo:hi][drop]), pa.array(place[lo:hi][drop])], names=["doc_id", "place"])


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, drop_emptied: bool = True, shard_lines: int = SHARD_LINES, hot_lines: int = HOT_LINES) -> DataFrame:
    """The documents without their repeated lines (n_chars set anew, if there is such a column)."""
    drops = repeated_lines(docs, min_chars, shard_lines, hot_lines).groupBy("doc_id", "text_hash").agg(F.collect_set("line").alias("drops"))
    schema, names = docs.schema, docs.columns
    on = (F.col("d.doc_id") == F.col("x.doc_id")) & (text_hash(F.col("d.text")) == F.col("x.text_hash"))
    joined = docs.alias("d").join(drops.alias("x"), on, "left").select("d.*", F.col("x.drops").alias(free_name(names, "drops")))
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else -1

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = list(b.columns)
            drops = columns.pop()
            hit = np.flatnonzero(drops.is_valid().to_numpy(zero_copy_only=False))
            keep = np.ones(len(drops), bool)
            if len(hit):
                texts = columns[text_at].to_pylist()
                chars = columns[chars_at].to_pylist() if chars_at >= 0 else None
                for i in hit.tolist():
                    if texts[i] is None:
                        continue
                    gone = set(drops[i].as_py())
                    left = [x for k, x in enumerate(texts[i].split("\n")) if k not in gone]
                    texts[i] = "\n".join(left)
                    keep[i] = not drop_emptied or bool(texts[i].strip())
                    if chars:
                        chars[i] = len(texts[i])
                columns[text_at] = pa.array(texts, columns[text_at].type)
                if chars:
                    columns[chars_at] = pa.array(chars, columns[chars_at].type)
            out = pa.RecordBatch.from_arrays(columns, names=names)
            yield out if keep.all() else out.filter(pa.array(keep))

    return joined.mapInArrow(apply, schema)
