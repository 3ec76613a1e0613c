"""Near-duplicates by SimHash with a byte-position inverted index and count filtering.

A document's fingerprint is a SimHash of `BYTES` = 32 bytes over its set of words. The index has a list for
each positional byte. Two fingerprints at most `DISTANCE` = 29 bits apart share at least 32 - 29 = `SHARED` = 3
positional bytes, the guaranteed minimum. Positions are split into two halves: of any three shared ones two
are in one half, so in a list only the documents that also share a later byte of the same half meet. For each
pair that meets, the shared positional bytes are tallied over all positions; pairs under SHARED are dropped,
and a pair is given out once, by the first two bytes that it shares. So every pair within DISTANCE is found.

Documents wanted, word sets of Jaccard similarity `THRESHOLD` = 0.7 and more, may be further apart (at 0.7, 49
of 256 bits on average, with a standard deviation of 6.3): they are found with a probability, about 0.95 at
0.70 and over 0.99 from 0.8 on. Before the exact verification, pairs of more than `VERIFY_BITS` = 68 bits are
dropped, which loses one in a thousand at 0.7.

Retained pairs are verified exactly on their whole word sets, which are read again for the documents of such
pairs only. For that, the sets of one connected component of candidates come together: a component of up to
`BLOCK` word sets in one place, a larger one in blocks of about that many, each two blocks in a place of their
own. Every set is moved once for each block of its component, not once for each pair.

Documents with the same word set are one node of the index, however many there are, so exact copies cost
nothing. Groups are the connected components of the verified pairs; the smallest doc_id names its group.

Defined results: null and empty texts and texts without words are in no group; empty tables give empty
results; rows with the same doc_id are one document (it has the smallest of its groups and the most of its
links); rows with a null doc_id are in no group and stay; ties cannot arise, as groups do not depend on
order; extra columns are not read and pass unchanged through `keep_one`; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as tx
from .common import Scratch, join_counted, stored

BYTES = 32
SHARED = 3
DISTANCE = BYTES - SHARED
VERIFY_BITS = 68
THRESHOLD = 0.7
BLOCK = 1000
MEMBER_BITS = 25
BATCH_WORDS = 1 << 20
U = np.uint64
_SALTS = [U(0x5851F42D4C957F2D), U(0x14057B7EF767814F), U(0x2545F4914F6CDD1D), U(0x9FB21C651E98DF25)]
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(U)[:, 0]


def distinct_words(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Row, first place and size of each word set of a chunk of texts, and the sorted hashes of all its words."""
    for row0, _, data, offs in tx.chunks(column):
        _, _, first, h = tx.words(data, offs)
        row = tx.row_of(first)
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])[: len(h)]
        h, row = h[new], row[new]
        if len(h):
            start = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            yield row[start] + row0, start, np.diff(np.concatenate([start, [len(h)]])), h


def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, whole, fp): hash of the word set and its SimHash."""
    for b in batches:
        for row, start, size, h in distinct_words(b.column(1)):
            votes = np.empty((len(start), 8 * BYTES), np.int32)
            step = 1 << 15  # words at a time
            at = 0
            while at < len(start):
                to = max(at + 1, int(np.searchsorted(start, start[at] + step)))
                lo, hi = start[at], start[to] if to < len(start) else len(h)
                raw = np.stack([tx.mix(h[lo:hi] ^ salt) for salt in _SALTS], 1).view(np.uint8).reshape(-1, BYTES)
                # the bits of a byte in eight lanes of one number, so up to 255 words are added at once
                own = start[at:to] - lo
                pieces = -(-size[at:to] // 255)
                first = np.cumsum(pieces) - pieces
                piece = np.repeat(own - 255 * first, pieces) + 255 * np.arange(int(pieces.sum()))
                lanes = np.add.reduceat(_LANES[raw], piece, axis=0)
                votes[at:to] = np.add.reduceat(lanes.view(np.uint8), first, axis=0, dtype=np.int32)
                at = to
            fp = np.packbits(votes * 2 > size[:, None], axis=1)
            whole = np.add.reduceat(tx.mix(h), start)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(row)), pa.array(whole.view(np.int64)), pa.FixedSizeBinaryArray.from_buffers(pa.binary(BYTES), len(fp), [None, pa.py_buffer(np.ascontiguousarray(fp))]).cast(pa.binary())],
                names=["doc_id", "whole", "fp"],
            )


FINGERPRINT = "doc_id long, whole long, fp binary"


def _bytes_of(column: pa.Array) -> np.ndarray:
    """The fingerprints of a column as rows of bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(list, node, fp): the lists of each node; the list number holds the place and its byte. The last place of a half has no later byte."""
    for b in batches:
        for at in range(0, b.num_rows, 2000):
            part = b.slice(at, 2000)
            fp = _bytes_of(part.column(1)).astype(np.int32)
            half = fp.shape[1] // 2
            place = np.concatenate([np.arange(half - 1), np.arange(half, 2 * half - 1)]).astype(np.int32)
            key = (place << 8) | fp[:, place]
            take = pa.array(np.repeat(np.arange(len(fp)), len(place)))
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), part.column(0).take(take), part.column(1).take(take)], names=["list", "node", "fp"])


def tallied(shared: int, bits: int):
    """Pairs of one list that share enough positional bytes; partitions come sorted by list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), _bytes_of(b.column(2))))
            if held[0][0][0] == held[-1][0][-1]:  # one list still
                continue
            key, node, fp = (np.concatenate(x) for x in zip(*held))
            done = int(np.searchsorted(key, key[-1]))  # the last list may go on
            yield from lists(key[:done], node[:done], fp[:done])
            held = [(key[done:], node[done:], fp[done:])]
        if held:
            yield from lists(*(np.concatenate(x) for x in zip(*held)))

    def lists(key: np.ndarray, node: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        place, half = key >> 8, fp.shape[1] // 2
        for later in range(1, half):
            rows = np.flatnonzero(place % half + later < half)
            both = (key[rows].astype(np.int64) << 8) | fp[rows, place[rows] + later]
            order = np.argsort(both)
            rows, both = rows[order], both[order]
            _, first, size = np.unique(both, return_index=True, return_counts=True)
            rows = rows[np.repeat(size > 1, size)]
            if len(rows):
                yield from pairs(both[np.repeat(size > 1, size)], node[rows], fp[rows], place[rows], later)

    def pairs(key: np.ndarray, node: np.ndarray, fp: np.ndarray, place: np.ndarray, later: int) -> Iterator[pa.RecordBatch]:
        n, half = len(key), fp.shape[1] // 2
        end = np.searchsorted(key, key, "right")
        more = end - np.arange(n) - 1  # partners after each entry
        done = np.concatenate([[0], np.cumsum(more)])
        words = np.ascontiguousarray(fp).view(U)
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(done, done[at] + (1 << 18), "right")) - 1)
            m = more[at:to]
            a = np.repeat(np.arange(at, to), m)
            z = np.arange(len(a)) - np.repeat(done[at:to] - done[at], m) + a + 1
            at = to
            far = np.bitwise_count(words[a] ^ words[z]).sum(1, dtype=np.int32)
            near = far <= bits
            a, z = a[near], z[near]
            same = fp[a] == fp[z]
            enough = same.sum(1) >= shared
            a, z, same = a[enough], z[enough], same[enough]
            # the first two shared bytes of the first half that has two
            of = np.where(same[:, :half].sum(1) >= 2, 0, half)
            row = np.arange(len(a))
            own = same.reshape(len(a), 2, half)[row, of // half]
            one = own.argmax(1)
            own[row, one] = False
            first = (of + one == place[a]) & (own.argmax(1) - one == later)
            a, z = a[first], z[first]
            if len(a):
                x, y = node[a], node[z]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])

    return run


def candidate_pairs(nodes: DataFrame, shared: int = SHARED, bits: int = VERIFY_BITS) -> DataFrame:
    """(a, b), a < b, each pair once: nodes that share at least `shared` (3 or more) positional bytes and are at most `bits` bits apart."""
    lists = nodes.select("node", "fp").mapInArrow(postings, "list int, node long, fp binary")
    return lists.repartition("list").sortWithinPartitions("list").mapInArrow(tallied(shared, bits), "a long, b long")


def word_sets(base: DataFrame, ids: DataFrame) -> DataFrame:
    """(node, set): the whole word sets of the documents with these ids, and of a few others that share a bit with one."""
    bit = F.pmod(F.xxhash64("id"), F.lit(1 << MEMBER_BITS))
    held = ids.select((bit / 64).cast("int").alias("at"), F.expr("1L").alias("one"), (bit % 64).cast("int").alias("k")).groupBy("at").agg(F.expr("bit_or(shiftleft(one, k))").alias("bits")).toArrow()
    members = np.zeros(1 << MEMBER_BITS - 6, np.int64)
    members[held["at"].to_numpy()] = held["bits"].to_numpy()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k = b.column(2).to_numpy()
            b = b.filter(pa.array((members[k >> 6] >> (k & 63)) & 1 == 1))
            for _, start, _, h in distinct_words(b.column(1)):
                lists = pa.ListArray.from_arrays(np.concatenate([start, [len(h)]]).astype(np.int32), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(np.add.reduceat(tx.mix(h), start).view(np.int64)), lists], names=["node", "set"])

    with_bit = base.withColumnRenamed("doc_id", "id").select("id", "text", bit.alias("k"))
    return with_bit.mapInArrow(sets, "node long, set array<long>")


def _local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each one's connected component, for n numbered members."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while (root[root] != root).any():
            root = root[root]
        if (root == before).all():
            break
    return root


def linked(threshold: float):
    """(node, to, links) of rows (root, lo, hi, node, n, set, b), sorted by the first three; sets, then pairs (node, b).

    For each node of a place: the smallest node that it is connected to there, and the documents it is similar to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            held.append(b)
            size += len(b.column(5).flatten()) + b.num_rows
            if size >= BATCH_WORDS:
                t = pa.Table.from_batches(held).combine_chunks()
                new = _changes(t)
                if new[-1] > 0:
                    yield from verified(t.slice(0, new[-1]))
                held = t.slice(new[-1]).to_batches()
                size = sum(len(x.column(5).flatten()) + x.num_rows for x in held)
        if held and sum(b.num_rows for b in held):
            yield from verified(pa.Table.from_batches(held).combine_chunks())

    def _changes(t: pa.Table) -> np.ndarray:
        """Where another place begins."""
        k = [t[c].to_numpy() for c in ("root", "lo", "hi")]
        return np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in k], axis=0)]))

    def verified(t: pa.Table) -> Iterator[pa.RecordBatch]:
        new = np.zeros(t.num_rows, np.int64)
        new[_changes(t)] = 1
        place = np.cumsum(new) - 1
        pair = t["b"].is_valid().to_numpy()
        node, other = t["node"].to_numpy(), t["b"].fill_null(0).to_numpy()
        names = np.unique(np.concatenate([node, other[pair]]))
        mine = place * len(names) + np.searchsorted(names, node)
        s = np.flatnonzero(~pair)
        s = s[np.unique(mine[s], return_index=True)[1]]  # one row for each set of a place, in order
        a = np.searchsorted(mine[s], mine[pair])
        z = np.searchsorted(mine[s], place[pair] * len(names) + np.searchsorted(names, other[pair]))
        if not len(a):
            return
        lists = t["set"].combine_chunks().take(pa.array(s))
        ids = np.unique(lists.flatten().to_numpy(), return_inverse=True)[1].astype(np.int32)
        at = lists.offsets.to_numpy().astype(np.int64)
        words = np.diff(at)
        order = np.argsort(a, kind="stable")
        a, z = a[order], z[order]
        common = np.zeros(len(a), np.int64)
        mark = np.zeros(int(ids.max()) + 1, np.uint8)
        first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(a)]):
            own = ids[at[a[lo]] : at[a[lo] + 1]]
            mark[own] = 1
            while lo < hi:
                to = max(lo + 1, lo + int(np.searchsorted(np.cumsum(words[z[lo:hi]]), BATCH_WORDS)))
                w = words[z[lo:to]]
                begin = np.cumsum(w) - w
                flat = np.arange(int(w.sum())) + np.repeat(at[z[lo:to]] - begin, w)
                common[lo:to] = np.add.reduceat(mark[ids[flat]], begin, dtype=np.int64)
                lo = to
            mark[own] = 0
        ok = common >= threshold * (words[a] + words[z] - common) - 1e-9
        a, z = a[ok], z[ok]
        if not len(a):
            return
        n = t["n"].take(pa.array(s)).to_numpy()
        links = np.bincount(a, weights=n[z], minlength=len(s)) + np.bincount(z, weights=n[a], minlength=len(s))
        root = _local_roots(len(s), a, z)  # sets of a place are in order of node, so the smallest number is the smallest node
        got = np.flatnonzero(links)
        yield pa.RecordBatch.from_arrays([pa.array(node[s][got]), pa.array(node[s][root[got]]), pa.array(links[got].astype(np.int64))], names=["node", "to", "links"])

    return run


def similar(pairs: DataFrame, nodes: DataFrame, base: DataFrame, scratch: Scratch, threshold: float = THRESHOLD) -> DataFrame:
    """(node, to, links) as of linked(), over all places."""
    roots = components(pairs, scratch)
    both = scratch.stored(roots.unionByName(roots.select("root").distinct().select(F.col("root").alias("node"), "root")))
    parts = F.ceil(F.count("*") / F.lit(BLOCK)).cast("int")
    sizes = scratch.stored(both.groupBy("root").agg(parts.alias("parts"), F.count("*").alias("size")))
    placed = join_counted(both, sizes, "root", "size").join(nodes.select("node", "n", "id"), "node")
    placed = scratch.stored(placed.select("node", "root", "parts", F.pmod(F.xxhash64("node"), "parts").cast("int").alias("part"), "n", "id"))
    sets = word_sets(base, placed.select("id")).join(placed, "node")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")
    sets = sets.select("root", "part", other, "node", "n", "set").select("root", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "node", "n", "set", F.lit(None).cast("long").alias("b"))
    side = lambda k: placed.select(F.col("node").alias(k), F.col("part").alias(f"part_{k}"), *([F.col("root")] if k == "a" else []))
    rows = pairs.join(side("a"), "a").join(side("b"), "b")
    rows = rows.select("root", F.least("part_a", "part_b").alias("lo"), F.greatest("part_a", "part_b").alias("hi"), F.col("a").alias("node"), F.lit(0).cast("long").alias("n"), F.array().cast("array<long>").alias("set"), "b")
    together = sets.unionByName(rows).repartition("root", "lo", "hi").sortWithinPartitions("root", "lo", "hi")
    return together.mapInArrow(linked(threshold), "node long, to long, links long")


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): of each run of edges one to every node from the smallest that it is connected to there; the same components with fewer edges."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([x.column(k).to_numpy() for x in held]) for k in range(2))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = _local_roots(len(nodes), at[: len(a)], at[len(a) :])
        k = np.flatnonzero(root != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[root[k]]), pa.array(nodes[k])], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(x.num_rows for x in held) >= BATCH_WORDS:
            yield stars(held)
            held = []
    if held:
        yield stars(held)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node but the roots: connected components of (a, b); root is the smallest node.

    Edges are contracted in their tasks first. If no more than BATCH_WORDS are left, one task contracts them to the
    end; else large and small stars alternate, round by round.
    """
    few = scratch.stored(edges.select("a", "b").filter("a <> b").mapInArrow(forest, "a long, b long"))
    if few.count() <= BATCH_WORDS:
        return few.coalesce(1).mapInArrow(forest, "a long, b long").select(F.col("b").alias("node"), F.col("a").alias("root"))
    edges = few.select(F.col("a").alias("u"), F.col("b").alias("v"))
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("m").alias("v"), F.col("v").alias("u")).filter("u <> v").distinct()
        # small star: every edge runs from the larger u to the smaller v
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        edges = scratch.stored(small)
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = state


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links): every document that is similar to another, its group's smallest doc_id, and to how many rows it is similar.

    Rows of the same word set are similar without limit to their number; each counts in the links of the others.
    """
    base = docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    with Scratch(docs.sparkSession) as scratch:
        prints = scratch.stored(base.mapInArrow(fingerprints, FINGERPRINT))
        nodes = scratch.stored(prints.groupBy(F.col("whole").alias("node")).agg(F.min("doc_id").alias("id"), F.first("fp").alias("fp"), F.count("*").alias("n")))
        pairs = scratch.stored(candidate_pairs(nodes))
        found = scratch.stored(similar(pairs, nodes, base, scratch, threshold))
        roots = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")), scratch)
        links = found.groupBy("node").agg(F.sum("links").alias("more"))
        grouped = nodes.select("node", "id", "n").join(links, "node", "left").filter("n > 1 or more is not null").join(roots, "node", "left").select("node", "id", "n", F.coalesce("root", "node").alias("root"), (F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("links"))
        grouped = scratch.stored(grouped)
        classes = scratch.stored(grouped.groupBy("root").agg(F.min("id").alias("class_id"), F.count("*").alias("size")))
        named = join_counted(grouped, classes, "root", "size").select(F.col("node").alias("whole"), "class_id", "links", "n")
        members = join_counted(prints.select("doc_id", "whole"), scratch.stored(named), "whole", "n")
        return stored(members.groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("links").alias("links")))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without the near-duplicates of an earlier one: of each group the smallest doc_id stays."""
    gone = near_duplicates(docs, threshold).filter("doc_id <> class_id").select("doc_id")
    return docs.join(gone, docs["doc_id"] == gone["doc_id"], "left_anti")
