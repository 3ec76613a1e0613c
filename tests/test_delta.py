from __future__ import annotations

import bz2
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import delta as d


def slow_fnv(raw: bytes) -> int:
    h = 2166136261
    for b in raw:
        h = (h ^ b) * 16777619 % 2**32
    return h


def test_golden_vectors():
    assert [d.fnv1a_of(x) for x in (b"", b"a", b"foobar")] == [0x811C9DC5, 0xE40C292C, 0xBF9CF968]
    numbers = (0, -1, 1, -2, 63, 64, -64, -65, 300, -300)
    assert [d.varint(n).hex() for n in numbers] == "00 01 02 03 7e 8001 7f 8101 d804 d704".split()
    assert [d.read_varint(d.varint(n), 0)[0] for n in numbers] == list(numbers)
    pangram = b"the quick brown fox jumps over the lazy dog\n"
    assert d.encode(pangram, pangram).hex() == "570000" and d.fnv1a_of(pangram) == 0xDCAFB68E
    assert d.encode(b"", b"hello").hex() == "0a68656c6c6f00" and d.fnv1a_of(b"hello") == 0x4F9F2CAB
    assert d.encode(b"", b"") == b"\0"


@given(st.lists(st.one_of(st.none(), st.binary(max_size=60))))
@settings(max_examples=60, deadline=None)
def test_checksums_equal_the_loop(rows):
    assert d.checksums(pa.array(rows, pa.binary())).to_pylist() == [slow_fnv(r or b"") for r in rows]
    assert d.checksums(pa.array([b"x", *rows], pa.binary()).slice(1)).to_pylist() == [slow_fnv(r or b"") for r in rows]


@given(st.integers(0, 2**32))
@settings(max_examples=300, deadline=None)
def test_round_trip_of_edits(seed):
    r = random.Random(seed)
    a = b = bytes(r.choices(b"abcdef", k=r.randrange(400)))
    for _ in range(r.randrange(4)):
        i, j = r.randrange(len(b) + 1), r.randrange(len(b) + 1)
        b = b[:i] + (r.randbytes(r.randrange(9)) or b[j : j + 50]) + b[min(len(b), i + r.randrange(40)) :]
    delta = d.encode(a, b)
    assert d.apply(a, delta) == b
    if len(b) > 200 and a == b:
        assert len(delta) < 10


def test_moved_blocks_are_copied():
    r = random.Random(3)
    blocks = [r.randbytes(500) for _ in range(6)]
    a, b = b"".join(blocks), b"".join(reversed(blocks))
    delta = d.encode(a, b)
    assert d.apply(a, delta) == b and len(delta) < len(b) // 4


def test_rolling_hash_is_the_polynomial():
    a = np.frombuffer(bytes(range(40)), np.uint8)
    want = [sum(int(a[i - j]) * 16777619**j for j in range(24)) % 2**32 for i in range(24, 40)]
    assert d.rolling(a).tolist() == want


@pytest.mark.parametrize("raw", [b"", b"\x0aab", b"\x57", b"\x57\x00\x00", b"\x80" * 12, b"\x02\x01\x00"])
def test_broken_deltas_are_refused(raw):
    if raw == b"\x02\x01\x00":
        raw = d.varint(-3) + d.varint(-1) + b"\0"
    with pytest.raises(d.DeltaError):
        d.apply(b"short", raw)


def test_columns(spark):
    rows = [(b"x" * 50 + b"tail", b"x" * 50 + b"TAIL"), (None, b"new"), (b"old", None), (b"", b""), (bytes(range(256)), bytes(range(255, -1, -1)))]
    df = spark.createDataFrame(rows, "a binary, b binary")
    out = df.select("a", "b", d.delta_encode(F.col("a"), F.col("b")).alias("x")).select("b", d.delta_apply(F.col("a"), F.col("x")).alias("y"), d.fnv1a(F.col("b")).alias("h"), d.delta_ops(F.col("x")).alias("ops")).collect()
    for r in out:
        assert r.b == r.y and r.h == slow_fnv(bytes(r.b or b""))
    assert [o.asDict() for o in out[0].ops] == [{"pos": 0, "op": "copy", "a_start": 0, "len": 50}, {"pos": 1, "op": "literal", "a_start": -1, "len": 4}]


@pytest.mark.parametrize("payload", [b"hello world\n", b"\0" * 32, b"\0" * (1 << 20), bytes(range(256)) * 4096, random.Random(1).randbytes(5000), b"ab" * 3000])
def test_bzip2_payloads_read_back(spark, tmp_path, payload):
    """The codec that Spark reads .bz2 with gives each payload back, in one stream and in several."""
    for k, packed in enumerate((bz2.compress(payload), bz2.compress(payload[: len(payload) // 2]) + bz2.compress(payload[len(payload) // 2 :]))):
        p = tmp_path / f"{k}.bz2"
        p.write_bytes(packed)
        # no separator of 64 bytes occurs, so a file is one row
        got = spark.read.option("lineSep", "\x01\x02" * 8 + "end-of-nothing").text(str(p)).select(F.col("value").cast("binary")).collect()
        assert b"".join(bytes(r[0]) for r in got) == payload
