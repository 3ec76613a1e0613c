"""Near-duplicates, mixing, reply trees and TIFF against brute force and exact round trips."""

from __future__ import annotations

import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import mixing, replytrees, simhash, tiff
from palimpsest.llm import textops as tx
from palimpsest.llm.common import Scratch


def near_copies(seed, n=150):
    """Documents and, for some, copies with a few words changed."""
    r = random.Random(seed)
    texts = []
    for _ in range(n):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randrange(20, 200))]
        texts.append(" ".join(words))
        for _ in range(r.choice((0, 0, 1, 3))):
            w = list(words)
            for _ in range(r.randrange(0, max(2, len(w) // 20))):
                w[r.randrange(len(w))] = f"n{r.randrange(5000)}"
            texts.append(" ".join(w))
    r.shuffle(texts)
    return texts


def word_sets(texts):
    return [set(tx.hash_words(t or "").tolist()) for t in texts]


def closure(pairs, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {k: find(k) for k in range(n) if find(k) != k}


def jaccard_pairs(sets):
    return [(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= simhash.THRESHOLD * len(sets[i] | sets[j])]


@pytest.mark.parametrize("seed", range(2))
def test_near_duplicates_against_all_pairs(docs_of, seed):
    """Class, and number of links, of every document; only pairs near the threshold may be missed."""
    texts = near_copies(seed)
    sets = word_sets(texts)
    near = jaccard_pairs(sets)
    want = closure(near, len(sets))
    got = {r.doc_id: (r.class_id, r.links) for r in simhash.near_duplicates(docs_of(texts)).collect()}
    linked = {k for p in near for k in p}
    assert len(want) > 50 and set(got) <= linked
    assert sum(got.get(k, (None,))[0] == want.get(k, k) for k in linked) >= 0.98 * len(linked)
    links = {k: sum(k in p for p in near) for k in linked}
    assert all(n <= links[k] for k, (_, n) in got.items())
    assert sum(n for _, n in got.values()) >= 0.98 * sum(links.values())
    kept = {r.doc_id for r in simhash.keep_one(docs_of(texts)).collect()}
    assert kept == set(range(len(texts))) - {k for k, (c, _) in got.items() if c != k}


def test_count_filter_misses_no_guaranteed_pair(spark):
    """Every pair at most DISTANCE bits apart is a candidate, and every candidate shares SHARED bytes by position, two in one half."""
    r = np.random.default_rng(0)
    base = r.integers(0, 256, (30, simhash.BYTES), dtype=np.uint8)
    fps = [base]
    for flips in (1, 9, 20, 29, 30, 45, 60):
        bits = np.unpackbits(base, axis=1)
        for row in bits:
            row[r.choice(8 * simhash.BYTES, flips, replace=False)] ^= 1
        fps.append(np.packbits(bits, axis=1))
    for places in ((0, 1), (0, 16, 17), (3, 20), (0, 1, 2), (15, 31, 30)):  # bytes kept, all others changed
        kept = (base + r.integers(1, 256, base.shape, dtype=np.uint8)).astype(np.uint8)
        kept[:, places] = base[:, places]
        fps.append(kept)
    fps = np.concatenate(fps)
    nodes = spark.createDataFrame([(k, bytearray(f.tobytes())) for k, f in enumerate(fps)], "node long, fp binary")
    far = np.bitwise_count(fps[:, None] ^ fps[None]).sum(-1)
    same = (fps[:, None] == fps[None]).sum(-1)
    mid = simhash.BYTES // 2
    half = np.maximum((fps[:, None, :mid] == fps[None, :, :mid]).sum(-1), (fps[:, None, mid:] == fps[None, :, mid:]).sum(-1))
    pairs = [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps))]
    for bits in (simhash.VERIFY_BITS, 8 * simhash.BYTES):
        rows = [(x.a, x.b) for x in simhash.candidate_pairs(nodes, bits=bits).collect()]
        got = set(rows)
        assert len(rows) == len(got)  # each pair once
        assert simhash.DISTANCE == simhash.BYTES - simhash.SHARED and {p for p in pairs if far[p] <= simhash.DISTANCE} <= got
        assert all(half[p] >= 2 for p in pairs if same[p] >= simhash.SHARED)
        assert got == {p for p in pairs if same[p] >= simhash.SHARED and far[p] <= bits}


def test_blocks_of_a_component_miss_no_pair(docs_of, monkeypatch):
    """A component in many blocks gives the links of one in a single place."""
    texts = near_copies(7, 40)
    words = texts[0].split()
    texts += [" ".join([*words, f"x{k}"]) for k in range(30)] + texts[:5]
    whole = {(r.doc_id, r.class_id, r.links) for r in simhash.near_duplicates(docs_of(texts)).collect()}
    monkeypatch.setattr(simhash, "BLOCK", 3)
    monkeypatch.setattr(simhash, "BATCH_WORDS", 500)
    assert {(r.doc_id, r.class_id, r.links) for r in simhash.near_duplicates(docs_of(texts)).collect()} == whole
    assert max(n for _, _, n in whole) >= 30


def test_fingerprints_against_direct_votes(prose):
    texts = [prose(1, 7), prose(2, 255), prose(3, 700), "x", prose(4, 60_000, 10**6), prose(5, 256)]
    batch = pa.RecordBatch.from_pydict({"d": pa.array(range(len(texts))), "t": pa.array(texts, pa.large_string())})
    got = {d: f for b in simhash.fingerprints(iter([batch])) for d, f in zip(b["doc_id"].to_pylist(), b["fp"].to_pylist())}
    for k, t in enumerate(texts):
        h = np.unique(tx.hash_words(t))
        raw = np.stack([tx.mix(h ^ s) for s in simhash._SALTS], 1).view(np.uint8).reshape(len(h), -1)
        assert got[k] == np.packbits(2 * np.unpackbits(raw, axis=1).sum(0, dtype=int) > len(h)).tobytes()


def pairs_of(seed, kept, size=200, n=60):
    """Pairs of texts of `size` distinct words each that have `kept` words in common."""
    r = random.Random(seed)
    texts = []
    for _ in range(n):
        words = r.sample(range(10**6), 2 * size - kept)
        texts += [" ".join(f"w{k}" for k in words[:size]), " ".join(f"w{k}" for k in words[size - kept :])]
    return texts


def test_pairs_at_the_threshold_meet(spark, docs_of):
    """Jaccard similarity 0.702 to 0.739: at least 9 of 10 pairs are candidates."""
    texts = [t for kept in (165, 167, 170) for t in pairs_of(kept, kept)]
    nodes = docs_of(texts).select("doc_id", "text").mapInArrow(simhash.fingerprints, simhash.FINGERPRINT).select(F.col("doc_id").alias("node"), "fp")
    got = {(x.a, x.b) for x in simhash.candidate_pairs(nodes).collect()}
    assert sum((k, k + 1) in got for k in range(0, len(texts), 2)) >= 0.9 * len(texts) / 2


def test_large_word_sets_are_verified_whole(docs_of):
    """Sets of 200 words: the pairs found are those of exact similarity 0.7 and more, just under it none."""
    texts = [t for kept in (158, 161, 164, 166) for t in pairs_of(kept, kept)]
    sets = word_sets(texts)
    want = {k + 1 for k in range(0, len(texts), 2) if len(sets[k] & sets[k + 1]) >= simhash.THRESHOLD * len(sets[k] | sets[k + 1])}
    got = {r.doc_id for r in simhash.near_duplicates(docs_of(texts)).collect() if r.doc_id != r.class_id}
    assert len(want) == 60 and got <= want and len(got) >= 0.9 * len(want)


@pytest.mark.parametrize("most", [1 << 20, 7])
def test_components_of_chains(spark, monkeypatch, most):
    """In one task, and in rounds of stars."""
    monkeypatch.setattr(simhash, "BATCH_WORDS", most)
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(1, 60)] + [(200, 100), (100, 150)] + [(300 + k, 300) for k in range(1, 30)]
    edges = [(min(e), max(e)) for e in edges]
    r.shuffle(edges)
    with Scratch(spark) as scratch:
        got = {x.node: x.root for x in simhash.components(spark.createDataFrame(edges, "a long, b long").repartition(5), scratch).collect()}
    assert got == {k: 1 for k in range(2, 61)} | {150: 100, 200: 100} | {k: 300 for k in range(301, 330)}


def test_near_duplicates_of_odd_rows(odd, none):
    got = {r.doc_id: (r.class_id, r.links) for r in simhash.near_duplicates(odd).collect()}
    assert got == {1: (-9, 2), -9: (-9, 2)}  # three rows
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_mixing_reaches_its_targets(docs_of, prose):
    r = random.Random(1)
    rows = []
    for k in range(3000):
        text = prose(k, r.randrange(5, 40))
        rows.append((k, text, r.choice(("en", "en", "en", "fr")), r.choice("aaaaab"), len(text)))
    docs = docs_of(rows)
    want = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.4, "fr": 0.6}}
    out = mixing.mix(docs, want, rate=0.3).toPandas()
    w = out["text"].str.split().str.len() * out["sample_weight"]
    for d, shares in want.items():
        for value, share in shares.items():
            assert abs(w[out[d] == value].sum() / w.sum() - share) < 0.05
    assert out["sample_prob"].between(0, 1).all() and 0.1 < len(out) / 3000 < 0.6
    again = mixing.mix(docs.repartition(7), want, rate=0.3).select("doc_id").toPandas()
    assert set(again.doc_id) == set(out.doc_id)
    given = mixing.mix(docs.withColumn("subject", F.when(F.col("doc_id") % 3 == 0, "x")), {"topic": {"x": 0.8, "␀": 0.2}}, topic="subject", rate=0.2).toPandas()
    w = given["text"].str.split().str.len() * given["sample_weight"]
    assert abs(w[given.subject == "x"].sum() / w.sum() - 0.8) < 0.05


def test_raking_by_aggregations_is_raking(docs_of, prose, monkeypatch):
    """Cells too many for one task: 8 rounds over written tables give the numbers of rake()."""
    r = random.Random(2)
    docs = docs_of([(k, f"{prose(k, r.randrange(5, 40))} topicword{k % 3}", r.choice(("en", "en", "fr")), r.choice("aaab"), 0) for k in range(300)])
    words = mixing.topic_words(docs, 3)
    assert sorted(words) == ["topicword0", "topicword1", "topicword2"]
    for given in (None, {"source": {"a": 0.2, "b": 0.8}}):
        one, many = (mixing.fitted_cells(docs, words, None, given, rounds=4, most=8, max_cells=n)[0].toPandas() for n in (100, 0))
        m = one.merge(many, on=list(mixing.DIMENSIONS), how="outer")
        assert len(m) == len(one) == 12 and np.allclose(m.fitted_x, m.fitted_y, atol=1e-12) and np.allclose(m.share_x, m.share_y)


@pytest.mark.parametrize("seed", range(3))
def test_raking_fits_the_marginals(seed):
    """With the production rounds every marginal is met; marginals that cannot be met end with the topic as it should be."""
    r = np.random.default_rng(seed)
    cells = pd.DataFrame([(f"s{i}", f"l{j}", t, int(r.integers(1, 1000))) for i in range(20) for j in range(4) for t in ("", "x", "y") if r.random() < 0.7], columns=["source", "lang", "topic", "tokens"])
    targets = mixing.targets_of(cells, None, mixing.ALPHA)
    fitted = mixing.rake(cells, targets)
    for d in mixing.DIMENSIONS:
        assert np.allclose(fitted.groupby(d)["fitted"].sum(), targets[d], atol=mixing.TOLERANCE)
    apart = pd.DataFrame([("a", "l", "x", 1), ("b", "l", "y", 1)], columns=cells.columns)
    fitted = mixing.rake(apart, mixing.targets_of(apart, {"source": {"a": 0.9, "b": 0.1}, "topic": {"x": 0.4, "y": 0.6}}, mixing.ALPHA), most=80)
    assert np.allclose(fitted.fitted, [0.4, 0.6])


def test_topics_against_brute_force(docs_of, prose):
    texts = [" ".join(f"longword{r.randrange(30)}" if r.random() < 0.2 else "ÉTÉS" for _ in range(r.randrange(40))) for r in map(random.Random, range(80))] + [None, "", "short words", prose(1, 200_000)]
    docs = docs_of(texts)
    said = [[w for w in re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (t or "").lower()) if len(w) >= mixing.TOPIC_CHARS] for t in texts]
    total = Counter(w for ws in said for w in ws)
    words = sorted(total, key=lambda w: (-total[w], w.encode()))[: mixing.TOPICS]
    assert mixing.topic_words(docs) == words and len(words) == mixing.TOPICS
    got = {r.doc_id: (r.topic, r.tokens) for r in mixing.with_topics(docs, words, "topic", "tokens").collect()}
    for k, ws in enumerate(said):
        n = Counter(w for w in ws if w in words)
        assert got[k] == (min(n, key=lambda w: (-n[w], w.encode())) if n else "", len((texts[k] or "").split()))


def test_mixing_of_odd_rows(odd, none):
    odd = odd.select("*", *(F.lit(k).alias(n) for k, n in enumerate(("__p", "__w", "__source", "mix_p", "MIX_W", "mix_said", "mix_topic", "share", "fitted", "sample_PROB"))))
    out = mixing.mix(odd, rate=100.0)
    assert out.columns == [*odd.columns[:-1], "sample_prob", "sample_weight"]
    assert out.count() == odd.filter("trim(translate(text, '\n\t', '')) <> ''").count()
    assert mixing.mix(out, rate=100.0).columns == out.columns
    assert mixing.mix(none).count() == 0
    assert mixing.mix(odd, {"source": {"c": 1.0}}, rate=100.0).filter("source <> 'c' or source is null").count() == 0


TREE = "tree long, msg long, parent long, role string, text string, score double"


def brute_trees(rows, best=1):
    out = {}
    for t in {r[0] for r in rows}:
        msgs = {r[1]: r for r in rows if r[0] == t}
        kids = {m: [x for x in msgs if msgs[x][2] == m] for m in msgs}
        found = []
        stack = [[m] for m in msgs if msgs[m][2] not in msgs]
        while stack:
            p = stack.pop()
            if not kids[p[-1]]:
                found.append(p)
            stack += [[*p, k] for k in kids[p[-1]]]
        found.sort(key=lambda p: (-sum(msgs[m][5] for m in p) / len(p), -len(p), p[-1]))
        for n, p in enumerate(found[:best], 1):
            out[t, n] = "\n".join(f"<|{msgs[m][3]}|>\n{msgs[m][4]}\n<|end|>" for m in p)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_reply_trees(spark, seed):
    r = random.Random(seed)
    rows = [(t, m, r.choice([None, *range(m), 99]) if m else None, r.choice(("user", "assistant")), f"t{t}m{m}", float(r.randrange(3))) for t in range(6) for m in range(r.randrange(1, 12))]
    got = {(x.conv_id, x.branch): x.conversation for x in replytrees.format_trees(spark.createDataFrame(rows, TREE), best=3).collect()}
    assert got == brute_trees(rows, 3)


def test_deep_and_wide_trees(spark):
    """10,000 replies in a row beside 3,000 rival replies; a handful of written rounds, not one for each reply."""
    deep = [(1, m, m - 1 if m else None, "user", f"m{m}", 1.0) for m in range(10_000)]
    wide = [(1, 20_000 + k, 5000, "assistant", f"r{k}", float(k)) for k in range(3000)]
    got = {x.branch: x for x in replytrees.format_trees(spark.createDataFrame(deep + wide, TREE), best=2).collect()}
    assert [got[k].n_messages for k in (1, 2)] == [5002, 5002] and got[1].score > got[2].score > 1
    assert got[1].conversation.endswith("r2999\n<|end|>") and got[1].conversation.count("<|user|>") == 5001
    (only,) = replytrees.format_trees(spark.createDataFrame(deep, TREE), best=2).collect()
    assert only.conversation == "\n".join(f"<|user|>\nm{k}\n<|end|>" for k in range(10_000))


def test_rivals_are_ranked(spark, data):
    turns = spark.read.parquet(f"{data}/conversations.parquet")
    rows = replytrees.format_turns(replytrees.with_rivals(turns)).collect()
    assert {r.conv_id for r in rows} == {r.conv_id for r in turns.select("conv_id").distinct().collect()}
    second = [r for r in rows if r.branch == 2]
    first = {r.conv_id: r for r in rows if r.branch == 1}
    assert len(second) > 5 and all(first[r.conv_id].score >= r.score and first[r.conv_id].conversation != r.conversation for r in second)


def test_reply_trees_of_odd_rows(spark):
    rows = [(1, 1, None, None, None, None), (1, 1, 5, "user", "twin", 9.0), (1, 2, 1, "assistant", "two", 1.0), (None, 1, None, "user", "x", 1.0), (1, None, 1, "user", "x", 1.0), (2, 1, 2, "user", "loop", 1.0), (2, 2, 1, "user", "loop", 1.0), (3, 7, 3, "user", "é" * 100_000, 1.0)]
    df = spark.createDataFrame(rows, TREE).withColumn("path", F.lit(1)).withColumn("leaf", F.lit("x"))
    got = {x.conv_id: (x.n_messages, x.conversation) for x in replytrees.format_trees(df).collect()}
    assert got == {1: (2, "<|unknown|>\n\n<|end|>\n<|assistant|>\ntwo\n<|end|>"), 3: (1, "<|user|>\n" + "é" * 100_000 + "\n<|end|>")}
    assert replytrees.format_trees(df.limit(0)).count() == 0
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "short"), (1, 1, "assistant", "longer one"), (1, None, "user", "?"), (None, 0, "user", "?"), (2, 4, None, None)], "conv_id long, turn long, role string, text string")
    got = {x.conv_id: x.conversation for x in replytrees.format_turns(turns).collect()}
    assert got == {1: "<|user|>\nhi\n<|end|>\n<|assistant|>\nlonger one\n<|end|>", 2: "<|unknown|>\n\n<|end|>"}


def pixels(seed, h, w, spp):
    r = np.random.default_rng(seed)
    return np.repeat(r.integers(0, 256, (h, (w + 3) // 4, spp), dtype=np.uint8), 4, axis=1)[:, :w].copy()


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("compression", [tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.OLD_DEFLATE, tiff.PACKBITS])
def test_tiff_round_trips(order, compression):
    pages = []
    for k, (h, w, spp, extra) in enumerate([(1, 1, 1, {}), (37, 50, 3, {"rows": 8}), (70, 33, 1, {"tile": 16}), (20, 20, 4, {"predictor": 2}), (33, 17, 3, {"predictor": 2, "tile": 32})]):
        pages.append({"data": pixels(k, h, w, spp).tobytes(), "width": w, "height": h, "samples": spp, "compression": compression} | extra)
    got = list(tiff.pages_of(tiff.write_tiff(pages, order)))
    assert len(got) == 5
    for p, g in zip(pages, got):
        assert g["error"] is None and g["pixels"] == p["data"] and (g["width"], g["height"], g["samples"]) == (p["width"], p["height"], p["samples"])


def hand_made(tags, order="<", big=False, data=b""):
    """A file of one directory, made without the module's writer; data begins at byte 16 (8 if not big)."""
    start = 16 if big else 8
    count, word, entry = ("Q", "Q", 8) if big else ("H", "I", 4)
    at = start + len(data)
    fields, extra = b"", b""
    size = struct.calcsize(order + count) + len(tags) * (4 + 2 * entry) + entry
    for tag, kind, values in tags:
        code = {1: "B", 3: "H", 4: "I", 16: "Q"}[kind]
        body = struct.pack(f"{order}{len(values)}{code}", *values)
        if len(body) > entry:
            where, extra = at + size + len(extra), extra + body
            body = struct.pack(order + word, where)
        fields += struct.pack(order + "HH" + word, tag, kind, len(values)) + body.ljust(entry, b"\0")
    head = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at))
    return head + data + struct.pack(order + count, len(tags)) + fields + b"\0" * entry + extra


@pytest.mark.parametrize("order", "<>")
def test_tiff_samples_that_are_not_bytes(order):
    r = np.random.default_rng(1)
    wide = r.integers(0, 65536, (5, 7), dtype=np.uint16)
    differences = np.diff(wide, axis=1, prepend=np.zeros((5, 1), np.uint16)).astype(f"{order}u2")
    raw = zlib.compress(differences.tobytes())
    base = lambda bits, n, comp, at=8, w=7, h=5: [(256, 3, [w]), (257, 3, [h]), (258, 3, [bits]), (259, 3, [comp]), (273, 4, [at]), (277, 3, [1]), (278, 3, [h]), (279, 4, [n])]
    (p,) = tiff.pages_of(hand_made([*base(16, len(raw), 8), (317, 3, [2])], order, data=raw))
    assert p["error"] is None and p["pixels"] == wide.astype("<u2").tobytes()
    big = zlib.compress(differences.tobytes())
    (p,) = tiff.pages_of(hand_made([*base(16, len(big), 8, 16), (317, 3, [2])], order, True, big))
    assert p["pixels"] == wide.astype("<u2").tobytes()
    floats = r.normal(size=(5, 7)).astype(np.float32)
    planes = np.frombuffer(floats.astype(">f4").tobytes(), np.uint8).reshape(5, 7, 4).transpose(0, 2, 1).reshape(5, 28)
    raw = zlib.compress(np.diff(planes, axis=1, prepend=np.zeros((5, 1), np.uint8)).tobytes())
    (p,) = tiff.pages_of(hand_made([*base(32, len(raw), 8), (317, 3, [3])], order, data=raw))
    assert p["pixels"] == floats.astype("<f4").tobytes()
    bits = r.integers(0, 2, (5, 7), dtype=np.uint8)
    raw = np.packbits(bits, axis=1).tobytes()
    (p,) = tiff.pages_of(hand_made(base(1, len(raw), 1), order, data=raw))
    assert p["pixels"] == bits.tobytes()
    rgb = r.integers(0, 256, (3, 2, 2), dtype=np.uint8)  # three planes
    tags = [(256, 3, [2]), (257, 3, [2]), (258, 3, [8, 8, 8]), (259, 3, [1]), (273, 4, [8, 12, 16]), (277, 3, [3]), (278, 3, [2]), (279, 4, [4, 4, 4]), (284, 3, [2])]
    (p,) = tiff.pages_of(hand_made(tags, order, data=rgb.tobytes()))
    assert p["pixels"] == rgb.transpose(1, 2, 0).tobytes()


def test_codecs():
    # the example of the format's specification for packed bits
    packed = bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA])
    assert tiff.unpack_bits(packed) == bytes.fromhex("aaaaaa80002aaaaaaaaa80002a22aaaaaaaaaaaaaaaaaaaa")
    r = random.Random(1)
    for n in (0, 1, 2, 127, 128, 129, 300, 70_000):
        for raw in (r.randbytes(n), bytes(r.choices(b"ab", k=n)), b"z" * n):
            assert tiff.unpack_bits(tiff.pack_bits(raw)) == raw and tiff.lzw_decode(tiff.lzw_encode(raw)) == raw
    # 7 7 7 8 8 7 7 6 6 of the specification: Clear 7 258 8 8 258 6 6 End, 9 bits each
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    assert tiff.lzw_decode(int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_damaged_files_never_raise():
    """20,000 files with bytes changed or cut off: an error in a row, never an exception; all fields fit their columns."""
    r = random.Random(3)
    files = []
    for comp in (tiff.PLAIN, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS):
        for order in "<>":
            one = {"data": pixels(1, 9, 7, 3).tobytes(), "width": 7, "height": 9, "samples": 3, "compression": comp, "rows": 4}
            files.append(tiff.write_tiff([one, {"data": pixels(2, 20, 18, 1).tobytes(), "width": 18, "height": 20, "compression": comp, "tile": 16, "predictor": 2}], order))
    files += [hand_made([(256, 3, [2]), (257, 3, [2]), (258, 3, [8]), (259, 3, [1]), (273, 16, [16]), (279, 16, [4])], o, True, b"abcd") for o in "<>"]
    failed = 0
    for _ in range(20_000):
        f = bytearray(r.choice(files))
        for _ in range(r.randrange(1, 6)):
            f[r.randrange(len(f))] = r.choice((0, 1, 2, 5, 11, 12, 255, r.randrange(256)))
        for page in tiff.pages_of(bytes(f[: r.randrange(len(f))] if r.random() < 0.2 else f)):
            failed += bool(page["error"])
            assert all(page.get(c) is None or 0 <= page[c] < 1 << 31 for c in ("width", "height", "samples", "bits", "predictor"))
            assert page["error"] or len(page["pixels"]) == page["width"] * page["height"] * page["samples"] * max(1, page["bits"] // 8)
    assert failed > 5000


def test_ill_typed_tags():
    for kind, value in ((2, b"\x02"), (11, 2.0), (6, -2)):
        code = tiff._TYPES[kind]
        f = bytearray(hand_made([(256, 3, [2]), (257, 3, [2]), (259, 3, [1]), (273, 4, [8]), (279, 4, [4])], data=b"abcd"))
        at = 8 + 4 + 2
        struct.pack_into("<HHI4s", f, at, 256, kind, 1, struct.pack("<" + code, value).ljust(4, b"\0"))
        (page,) = tiff.pages_of(bytes(f))
        assert page["width"] is None and "256" in page["error"]


def test_tiff_of_odd_rows(spark):
    good = tiff.write_tiff([{"data": b"abcd", "width": 2, "height": 2}] * 2)
    loop = bytearray(good)
    struct.pack_into("<I", loop, good.rindex(b"\0\0\0\0"), struct.unpack_from("<I", good, 4)[0])
    rows = [(1, None), (2, b""), (3, b"not a tiff"), (4, good), (4, good), (5, good[:-30]), (6, bytes(loop)), (None, good), (7, hand_made([(256, 3, [2]), (257, 3, [2]), (259, 3, [7])]))]
    df = spark.createDataFrame([(k, None if t is None else bytearray(t), 1) for k, t in rows], "media_id long, tiff binary, pixels int")
    got = tiff.decode_column(df).collect()
    by = {}
    for r in got:
        by.setdefault(r.media_id, []).append(r)
    assert set(by) == {3, 4, 5, 6, 7, None} and len(by[4]) == 4 and len(by[None]) == 2
    assert all(r.error is None and bytes(r.pixels) == b"abcd" for r in by[4])
    assert by[3][0].error and by[5][-1].error and "loop" in by[6][-1].error and by[7][0].error and by[7][0].pixels is None and by[7][0].width == 2
    assert tiff.decode_column(df.limit(0)).count() == 0
