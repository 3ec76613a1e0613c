"""Vectorised byte-level text primitives shared by the corpus operators.

A *word* is a maximal run of ASCII letters, digits and bytes >= 0x80 (so every non-ASCII character
is a word character) after case folding of ASCII and Latin-1; a *raw token* is a maximal run of bytes
that are not ASCII white space, as it stands. Everything works on Arrow string buffers through numpy,
with no Python object per word. Null texts count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_MUL = U64(0x9E3779B97F4A7C15)
_INV = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[65:91] = True
WORD[128:] = True
TOKEN = np.ones(256, bool)
TOKEN[[9, 10, 11, 12, 13, 32]] = False
LINE = np.ones(256, bool)
LINE[10] = False
_powers = {"p": np.ones(1, U64), "i": np.ones(1, U64)}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash multiplier and of its inverse modulo 2**64."""
    if len(_powers["p"]) < n:
        size = 1 << max(20, int(n - 1).bit_length())
        for key, base in (("p", _MUL), ("i", _INV)):
            a = np.full(size, base, U64)
            a[0] = 1
            _powers[key] = np.multiply.accumulate(a)
    return _powers["p"][:n], _powers["i"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def chunks(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of runs of rows of about `most` bytes; every row ends in a line feed."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    text = pc.binary_join_element_wise(
        pc.fill_null(column.cast(pa.large_binary()), b""), pa.scalar(b"\n", pa.large_binary()), pa.scalar(b"", pa.large_binary())
    )
    n = len(text)
    if not n:
        return
    offs = np.frombuffer(text.buffers()[1], np.int64, n + 1, text.offset * 8)
    data = np.frombuffer(text.buffers()[2], np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield at, end, data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case of ASCII and Latin-1 letters, byte for byte."""
    data = _FOLD[data]
    c = np.flatnonzero(data[:-1] == 0xC3) + 1
    v = data[c]
    data[c[(v >= 0x80) & (v <= 0x9E) & (v != 0x97)]] += np.uint8(32)
    return data


def runs(data: np.ndarray, offs: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the runs of bytes of a kind, and the index of each row's first run (one more at the end)."""
    m = kind[data]
    e = np.flatnonzero(m[1:] != m[:-1]) + 1
    if len(m) and m[0]:
        e = np.concatenate([[0], e])
    starts, ends = e[0::2], e[1::2]
    return starts, ends, np.searchsorted(starts, offs)


def sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums of random byte codes, from which any span can be hashed."""
    p, _ = powers(len(data) + 1)
    c = np.empty(len(data) + 1, U64)
    c[0] = 0
    np.cumsum(_BYTE[data] * p[:-1], out=c[1:])
    return c


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, c: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each byte span; c: the sums of data, if they are there already."""
    c = sums(data) if c is None else c
    _, i = powers(len(data) + 1)
    return mix((c[ends] - c[starts]) * i[starts] + (ends - starts).astype(U64))


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n hashes from each position on; the last n-1 positions have none."""
    if len(h) < n:
        return np.zeros(0, U64)
    p, i = powers(len(h) + 1)
    c = np.empty(len(h) + 1, U64)
    c[0] = 0
    np.cumsum(h * p[:-1], out=c[1:])
    return mix((c[n:] - c[:-n]) * i[: len(h) - n + 1])


def row_of(offs: np.ndarray) -> np.ndarray:
    """Row number of each run, from the index of each row's first run."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, first-word indexes and hashes of the folded words."""
    data = fold(data)
    starts, ends, first = runs(data, offs, WORD)
    return starts, ends, first, hashes(data, starts, ends)


def hash_words(text: str) -> np.ndarray:
    """Hashes of the words of one text (driver side)."""
    out = [words(d, o)[3] for _, _, d, o in chunks(pa.array([text]))]
    return out[0] if out else np.zeros(0, U64)


