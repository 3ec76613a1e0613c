"""Binary deltas and their checksum, vectorised with numpy, and the Arrow functions that apply them to columns.

A delta is a run of instructions. Each begins with a zig-zag varint n: n > 0 is followed by n literal
bytes, n < 0 copies -n bytes of the source from where a second varint moves the cursor to, and 0 ends the
delta. The cursor stands after the last copy, moved on by the literals since.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLE = 1 << 17
WINDOW = 24
STEP = 16777619
_BASIS = 2166136261
_POWERS = np.array([pow(STEP, k, 2**32) for k in range(WINDOW)], np.uint32)
_INVERSE = pow(STEP, -1, 2**32)


#: What delta_expand returns.
EXPANDED = T.StructType([T.StructField("text", T.BinaryType()), T.StructField("before", T.LongType()), T.StructField("after", T.LongType())])
#: What delta_ops returns.
OPS = T.ArrayType(T.StructType([T.StructField("pos", T.IntegerType()), T.StructField("op", T.StringType()), T.StructField("a_start", T.LongType()), T.StructField("len", T.LongType())]))


class DeltaError(ValueError):
    """A delta that is cut short, or that copies from outside its source."""


def varint(n: int) -> bytes:
    """Signed 64-bit zig-zag varint."""
    return uvarint(n << 1 if n >= 0 else (-n << 1) - 1)


def uvarint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_uvarint(raw: bytes, at: int) -> tuple[int, int]:
    """The number at a place and the place after it."""
    n = shift = 0
    while True:
        if at >= len(raw):
            raise DeltaError("cut short inside a number")
        byte = raw[at]
        at += 1
        n |= (byte & 127) << shift
        if byte < 128:
            if n >= 1 << 64:
                raise DeltaError("number over 64 bits")
            return n, at
        shift += 7
        if shift > 63:
            raise DeltaError("number over 64 bits")


def read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n, at = read_uvarint(raw, at)
    return (n >> 1) ^ -(n & 1), at


def rolling(a: np.ndarray) -> np.ndarray:
    """Rolling hash of the window that ends at each byte from the WINDOW-th on (index 0 is the byte at WINDOW)."""
    n = len(a) - WINDOW
    if n <= 0:
        return np.zeros(0, np.uint32)
    v = np.zeros(n, np.uint32)
    wide = a.astype(np.uint32)
    for k, p in enumerate(_POWERS):
        v += wide[WINDOW - k : WINDOW - k + n] * p
    return v


def sampling_mask(size: int) -> int:
    """High bits that a hash must have set for its place to be kept, so that about half of the table fills."""
    bits = int(np.float32(size) / np.float32(TABLE) * 2).bit_length()
    return ((1 << bits) - 1) << (32 - bits)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differs = a[at : min(n, at + step)] != b[at : min(n, at + step)]
        if differs.any():
            return at + int(differs.argmax())
        at += len(differs)
        step *= 4
    return n


def encode(a: bytes, b: bytes) -> bytes:
    """A delta that makes b of a."""
    if a == b:
        return (varint(-len(a)) + varint(0) if a else b"") + b"\0"
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    head = common(x, y)
    tail = common(x[head:][::-1], y[head:][::-1])
    head, tail = (head if head >= WINDOW else 0), (tail if tail >= WINDOW else 0)
    out: list[bytes] = []
    cursor, done, end = head, head, len(b) - tail  # what lies between head and tail is searched for
    if head:
        out += [varint(-head), varint(0)]
    for at, start, size in _matches(x, y[:end], done):
        if at > done:
            out += [varint(at - done), b[done:at]]
            cursor += at - done
        out += [varint(-size), varint(start - cursor)]
        cursor, done = start + size, at + size
    if done < end:
        out += [varint(end - done), b[done:end]]
        cursor += end - done
    if tail:
        out += [varint(-tail), varint(len(a) - tail - cursor)]
    return b"".join([*out, b"\0"])


def _matches(x: np.ndarray, y: np.ndarray, done: int) -> Iterator[tuple[int, int, int]]:
    """(place in y, place in x, length) of the copies for y from `done` on, in order, found by sampled rolling hashes."""
    if len(x) <= WINDOW or len(y) - done <= WINDOW:
        return
    mask, low = np.uint32(sampling_mask(len(x))), np.uint32(TABLE - 1)
    va, vb = rolling(x), rolling(y[done:])
    places = np.flatnonzero((va & mask) == mask)
    table = np.full(TABLE, -1, np.int32)
    table[va[places] & low] = places + WINDOW  # the last of several stays
    ends = np.flatnonzero((vb & mask) == mask)
    seen = table[vb[ends] & low]
    for i, j in zip((ends[seen >= 0] + WINDOW + done).tolist(), seen[seen >= 0].tolist()):
        if i < done + WINDOW:
            continue
        back = common(x[: j + 1][::-1], y[done : i + 1][::-1])
        if not back:
            continue
        start, at = j + 1 - back, i + 1 - back
        size = back + common(x[j + 1 :], y[i + 1 :])
        if size >= WINDOW:
            yield at, start, size
            done = at + size


def instructions(raw: bytes, at: int = 0) -> tuple[list[tuple[str, int, int, int]], int]:
    """(op, where in the source, length, where in the delta) of each instruction, and the place after the end mark."""
    out, cursor = [], 0
    while True:
        n, at = read_varint(raw, at)
        if not n:
            return out, at
        if n > 0:
            if at + n > len(raw):
                raise DeltaError("literal longer than the delta")
            out.append(("literal", -1, n, at))
            cursor += n
            at += n
        else:
            move, at = read_varint(raw, at)
            cursor += move
            out.append(("copy", cursor, -n, -1))
            cursor += -n


def apply(a: bytes, delta: bytes) -> bytes:
    """What a delta makes of a."""
    out = []
    for op, start, size, at in instructions(delta)[0]:
        if op == "literal":
            out.append(delta[at : at + size])
        else:
            if start < 0 or start + size > len(a):
                raise DeltaError(f"copy of {start}..{start + size} from a source of {len(a)} bytes")
            out.append(a[start : start + size])
    return b"".join(out)


def fnv1a_rows(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """32-bit FNV-1a of each row of a byte buffer, without a loop over its bytes.

    The low byte of the state runs on its own: bit j of it is a running exclusive or of bit j of the input
    and a carry that the lower bits give. With the low bytes known, the exclusive or that each step takes is
    a difference, and the state is a sum of differences times powers of the prime.
    """
    size = np.diff(offs)
    start = np.repeat(offs[:-1], size)
    low = np.zeros(len(data), np.uint32)  # of the state before each byte
    wide = data.astype(np.uint32)
    for j in range(8):
        x = (low ^ wide) & np.uint32((1 << j) - 1)
        flips = ((x * np.uint32(STEP & 255)) >> np.uint32(j) ^ wide >> np.uint32(j)) & np.uint32(1)
        total = np.concatenate([np.zeros(1, np.uint32), np.cumsum(flips, dtype=np.uint32)])
        bit = (total[:-1] - total[start]) & np.uint32(1) ^ np.uint32(_BASIS >> j & 1)
        low |= bit << np.uint32(j)
    longest = int(size.max(initial=0))
    back = np.full(longest + 1, _INVERSE, np.uint32)
    back[0] = 1
    back = np.multiply.accumulate(back, dtype=np.uint32)
    ahead = np.full(longest + 1, STEP, np.uint32)
    ahead[0] = 1
    ahead = np.multiply.accumulate(ahead, dtype=np.uint32)
    d = ((low ^ wide) - low) * back[np.arange(len(data)) - start]
    total = np.concatenate([np.zeros(1, np.uint32), np.cumsum(d, dtype=np.uint32)])
    return (total[offs[1:]] - total[offs[:-1]] + np.uint32(_BASIS)) * ahead[size]


def fnv1a_of(raw: bytes) -> int:
    return int(fnv1a_rows(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0])


def _binary(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_binary())


def checksums(column: pa.Array) -> pa.Array:
    """FNV-1a of each value; null counts as empty."""
    column = _binary(column).fill_null(b"")
    out, at, n = [], 0, len(column)
    offs = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8) if n else np.zeros(0, np.uint8)
    while at < n:  # what fits a cache at a time
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + (1 << 16), "right")) - 1)
        out.append(fnv1a_rows(data[offs[at] : offs[end]], offs[at : end + 1] - offs[at]))
        at = end
    return pa.array(np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64))


def _pairs(f: Callable[[bytes, bytes], bytes], a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if y is None else f(x or b"", y) for x, y in zip(_binary(a).to_pylist(), _binary(b).to_pylist())], pa.binary())


@F.arrow_udf(T.LongType())
def _fnv1a(text: pa.Array) -> pa.Array:
    return checksums(text)


@F.arrow_udf(T.BinaryType())
def _encode(a: pa.Array, b: pa.Array) -> pa.Array:
    return _pairs(encode, a, b)


@F.arrow_udf(T.BinaryType())
def _apply(a: pa.Array, delta: pa.Array) -> pa.Array:
    return _pairs(apply, a, delta)


@F.arrow_udf(EXPANDED)
def _expand(a: pa.Array, delta: pa.Array) -> pa.Array:
    text = _pairs(apply, a, delta)
    return pa.StructArray.from_arrays([text, checksums(a), checksums(text)], names=["text", "before", "after"])


@F.arrow_udf(OPS)
def _ops(delta: pa.Array) -> pa.Array:
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("op", pa.string()), ("a_start", pa.int64()), ("len", pa.int64())]))
    rows = [None if d is None else [{"pos": k, "op": op, "a_start": start, "len": size} for k, (op, start, size, _) in enumerate(instructions(d)[0])] for d in _binary(delta).to_pylist()]
    return pa.array(rows, kind)


def fnv1a(text: Column) -> Column:
    """FNV-1a of the bytes, 0 to 2^32-1; null counts as empty."""
    return _fnv1a(text.cast("binary"))


def delta_encode(a: Column, b: Column) -> Column:
    """Delta from a to b; a null a is empty, a null b gives null."""
    return _encode(a.cast("binary"), b.cast("binary"))


def delta_apply(a: Column, delta: Column) -> Column:
    """The text that a delta makes of a; a null a is empty, a null delta gives null; a broken delta fails the query."""
    return _apply(a.cast("binary"), delta.cast("binary"))


def delta_expand(a: Column, delta: Column) -> Column:
    """(text, before, after): delta_apply with the FNV-1a of the source and of the text, by one worker."""
    return _expand(a.cast("binary"), delta.cast("binary"))


def delta_ops(delta: Column) -> Column:
    """The instructions of a delta as an array of (pos, op, a_start, len); a_start is -1 for literals."""
    return _ops(delta)
