"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1; one binary classifier over hashed character n-grams (1 to 3
bytes of the folded text, other ASCII bytes than letters read as spaces) predicts each bit. Decoding is
loss-weighted: a language's loss is the sum over bits of the bit's weight times the hinge loss of the
prediction against the codeword, and the language with the smallest loss wins. It is ambiguous when the
second loss is less than `MARGIN` (of the number of bits) above the first.

The classifiers are ridge regressions fitted to at most `PER_LANGUAGE` documents of each language and at most
`TRAIN_ROWS` in all, those with the smallest hash of doc_id; the n-grams of their whole texts are counted in
tasks, and only the counts come to the driver. More languages than TRAIN_ROWS are refused. Bits are weighted by
their leave-one-out accuracy above chance. Documents are classified by their whole texts, in one map without a
shuffle.

Defined results: texts that are null or have no letter get language 'und', ambiguous, confidence 0; rows
with a null language are classified but not trained on; with fewer than two languages every text with a
letter gets the only one (or 'und'); equal losses go to the first language in order of name; repeated
rows are classified alike, and of different texts under one doc_id and language the smallest is trained on;
extra columns are not read; very long texts are read whole; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textops as tx

PER_LANGUAGE = 400
TRAIN_ROWS = 3200
BUCKETS = 1 << 13
MARGIN = 0.1
U = np.uint32
_LETTER = np.full(256, 32, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def codewords(languages: int, seed: int = 5) -> np.ndarray:
    """Rows of +1 and -1, far apart: every two-way split for up to 5 languages, else the best of random codes."""
    if languages <= 5:
        bits = [b for b in product((1, -1), repeat=languages - 1) if -1 in b]
        return np.array([(1,) * len(bits), *zip(*bits)]) if bits else np.ones((languages, 1), int)
    rng, length = np.random.default_rng(seed), 8 * int(np.ceil(np.log2(languages)))
    best, far = np.zeros(0), -1
    for _ in range(200):
        c = rng.choice((-1, 1), (languages, length))
        d = ((length - c @ c.T) // 2 + length * np.eye(languages, dtype=int)).min()
        ok = (np.abs(c.sum(0)) < languages).all()
        if ok and d > far:
            best, far = c, d
    return best


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Which bytes begin n-grams inside their row, and the buckets of the 1-, 2- and 3-grams that begin at each byte."""
    d = _LETTER[tx.fold(data)]
    keep = np.ones(len(d), bool)
    keep[1:] = ~((d[1:] == 32) & (d[:-1] == 32))  # runs of spaces read as one
    keep[offs[1:] - 1] = True
    d = d.astype(U)
    b = np.concatenate([d[1:], [U(32)]])
    c = np.concatenate([d[2:], [U(32), U(32)]])[: len(d)]
    last = offs[1:] - 1
    c[last] = 32  # not into the next row
    b[last] = 32
    c[last[np.diff(offs) > 1] - 1] = 32
    two = (d * U(0x9E3779B1) + b * U(0x85EBCA6B)) >> U(19)
    three = (d * U(0xC2B2AE35) ^ b * U(0x27D4EB2F) ^ c * U(0x165667B1)) * U(0x9E3779B1) >> U(19)
    return keep, [d.astype(np.int32), two.astype(np.int32), three.astype(np.int32)]


class Decoder:
    """Codewords, the binary classifiers' weights, and the weights of the bits."""

    def __init__(self, languages: list[str], shares: np.ndarray, labels: np.ndarray, ridge: float = 1.0):
        """shares: one row for each training text, the share of each n-gram among those of its length."""
        self.languages = languages
        self.code = codewords(len(languages))
        x = shares.astype(np.float32)
        self.scale = 1 / (np.sqrt(x.mean(0)) + 1e-3)
        x *= self.scale
        self.mean = x.mean(0)
        x -= self.mean
        y = self.code[labels].astype(float)
        k = (x @ x.T).astype(float)
        k /= np.trace(k) / len(k)
        g = np.linalg.inv(k + ridge * 0.05 * np.eye(len(k)))
        dual = g @ (y - y.mean(0))
        loo = y - dual / np.diag(g)[:, None]  # leave-one-out predictions in closed form
        self.bit_weight = np.clip(2 * ((loo > 0) == (y > 0)).mean(0) - 1, 0.05, 1)
        self.bit_weight /= self.bit_weight.sum()
        w = x.T @ dual / (np.einsum("ij,ij->", x, x) / len(x))
        self.bias = y.mean(0) - self.mean @ w
        self.weights = (w * self.scale[:, None]).astype(np.float32)

    def losses(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Loss of each language for each row, and which rows have letters."""
        keep, at = grams(data, offs)
        total = np.zeros((len(data), self.weights.shape[1]), np.float32)
        for n, a in enumerate(at):
            total += self.weights[a + n * BUCKETS]
        total[~keep] = 0
        begin = offs[:-1]
        sums = np.add.reduceat(total, begin, axis=0, dtype=np.float64)
        size = np.add.reduceat(keep.astype(np.int64), begin)
        letters = np.add.reduceat((at[0] != 32).astype(np.int64), begin) > 0
        f = sums / np.maximum(size, 1)[:, None] + self.bias
        loss = np.stack([(self.bit_weight * np.maximum(0, 1 - c * f)).sum(1) for c in self.code], 1)
        return loss, letters


def gram_counts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, n-gram (2- and 3-grams numbered after the 1-grams) and count of each distinct n-gram of each row."""
    keep, at = grams(data, offs)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[keep]
    both, n = np.unique(np.concatenate([row * (3 * BUCKETS) + a[keep] + k * BUCKETS for k, a in enumerate(at)]), return_counts=True)
    return both // (3 * BUCKETS), both % (3 * BUCKETS), n


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, language, gram, n) of rows (id, language, text): lists of the n-grams of each whole text and their counts."""
    for b in batches:
        for row0, end, data, offs in tx.chunks(b.column(2), 1 << 18):
            row, gram, n = gram_counts(data, offs)
            starts = np.searchsorted(row, np.arange(end - row0 + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(starts, pa.array(c.astype(np.int32))) for c in (gram, n)]
            yield pa.RecordBatch.from_arrays([b.column(k).slice(row0, end - row0) for k in (0, 1)] + lists, names=["id", "language", "gram", "n"])


def shares_of(gram: list[np.ndarray], n: list[np.ndarray]) -> np.ndarray:
    """Dense rows of n-gram shares from the lists of counted()."""
    out = np.zeros((len(gram), 3 * BUCKETS), np.float32)
    for k, (g, c) in enumerate(zip(gram, n)):
        out[k, g] = c
    return out / np.maximum(out[:, :BUCKETS].sum(1), 1)[:, None]


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, train_rows: int = TRAIN_ROWS) -> tuple[list[str], Decoder | None]:
    base = docs.select(docs["doc_id"].cast("long").alias("id"), docs["lang"].cast("string").alias("language"), docs["text"].cast("string").alias("text")).filter("id is not null and language is not null")
    known = base.select("language").distinct().limit(train_rows + 1).count()
    if known > train_rows:
        raise ValueError(f"more than {train_rows} languages")
    per_language = min(per_language, max(1, train_rows // max(1, known)))
    w = Window.partitionBy("language").orderBy(F.xxhash64("id"), "id")
    # ids of repeated rows take several of the first places; they are one training text all the same
    picked = base.select("id", "language").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= per_language).select(F.col("id").alias("i"), F.col("language").alias("l")).distinct()
    joined = base.join(F.broadcast(picked), (F.col("id") == F.col("i")) & (F.col("language") == F.col("l")))  # at most train_rows ids
    texts = joined.filter("text <> ''").groupBy("id", "language").agg(F.min("text").alias("text"))
    rows = texts.mapInArrow(counted, "id long, language string, gram array<int>, n array<int>").toArrow()
    names, ids = rows["language"].to_pylist(), rows["id"].to_pylist()
    order = sorted(range(len(names)), key=lambda k: (names[k], ids[k]))
    languages = sorted(set(names))
    if len(languages) < 2:
        return languages, None
    lists = [[x.values.to_numpy(zero_copy_only=False) for c in rows[f].chunks for x in c] for f in ("gram", "n")]
    shares = shares_of(*([x[k] for k in order] for x in lists))
    return languages, Decoder(languages, shares, np.array([languages.index(names[k]) for k in order]))


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE, margin: float = MARGIN) -> DataFrame:
    """(doc_id, language, second, confidence, ambiguous) of every document; confidence is the gap between the two smallest losses."""
    languages, model = fit(docs, per_language)
    names = np.array(languages, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row0, end, data, offs in tx.chunks(b.column(1), 1 << 18):
                ids = b.column(0).slice(row0, end - row0)
                if model is None:
                    letters = np.add.reduceat((_LETTER[tx.fold(data)] != 32).astype(np.int64), offs[:-1]) > 0
                    ok = letters & bool(languages)
                    first, second, gap = np.where(ok, names[0] if languages else "und", "und"), np.full(len(ok), None), ok.astype(float)
                else:
                    loss, ok = model.losses(data, offs)
                    order = np.argsort(loss, axis=1, kind="stable")
                    gap = np.take_along_axis(loss, order[:, 1:2], 1)[:, 0] - np.take_along_axis(loss, order[:, :1], 1)[:, 0]
                    first, second = np.where(ok, names[order[:, 0]], "und"), np.where(ok, names[order[:, 1]], None)
                    gap = np.where(ok, gap, 0.0)
                yield pa.RecordBatch.from_arrays([ids, pa.array(first.tolist(), pa.string()), pa.array(second.tolist(), pa.string()), pa.array(np.round(gap, 6)), pa.array(~ok | (gap < margin))], names=["doc_id", "language", "second", "confidence", "ambiguous"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, language string, second string, confidence double, ambiguous boolean")
