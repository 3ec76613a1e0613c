"""Decontamination, repeated passages and line dedup against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import decontaminate as dc
from palimpsest.llm import linededup as ld
from palimpsest.llm import suffixdedup as sd
from palimpsest.llm.queries import oracle_sql


def merged(starts, n):
    out = []
    for a in sorted(starts):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n)
        else:
            out.append([a, a + n])
    return out


def words(text):
    return re.findall(r"[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())


def benchmark_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def brute_contaminated(docs, items, n=dc.N_WORDS, least=dc.MIN_WORDS):
    phrases = set()
    for t in items:
        w = words(t)
        if len(w) >= n:
            phrases |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        elif len(w) >= least:
            phrases.add(tuple(w))
    out = []
    for k, t in docs:
        w, cover = words(t), set()
        for p in {len(p) for p in phrases}:
            for i in range(len(w) - p + 1):
                if tuple(w[i : i + p]) in phrases:
                    cover |= set(range(i, i + p))
        out += [(k, a, b) for a, b in merged(cover, 1)]
    return sorted(out)


def corpus(seed, n=60, vocabulary=12):
    r = random.Random(seed)
    return [(k, " ".join(r.choice(("Foo", "bar,", "é", "x1", "—", "qux")) + str(r.randrange(vocabulary)) for _ in range(r.randrange(60)))) for k in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_contaminated_spans(spark, docs_of, seed, monkeypatch):
    docs = corpus(seed)
    r = random.Random(seed)
    items = [" ".join((t or "").split()[i : i + r.randrange(3, 30)]).upper() for _, t in r.sample(docs, 12) for i in (0, 5)] + [None, "", "one two"]
    want = brute_contaminated(docs, items)
    assert want
    for shard, a_pass in ((dc.SHARD_WORDS, dc.PASS_WORDS), (100, 60)):  # many shards and passes give the same
        monkeypatch.setattr(dc, "SHARD_WORDS", shard)
        monkeypatch.setattr(dc, "PASS_WORDS", a_pass)
        got = dc.contaminated_spans(docs_of(docs), benchmark_of(spark, items)).collect()
        assert sorted(tuple(x) for x in got) == want


def test_decontaminated_texts(spark, docs_of, prose):
    item = prose(9, 40)
    docs = docs_of([("a " * 9) + item.upper() + "! tail", prose(2, 50), item, None])
    got = {r.doc_id: r for r in dc.decontaminate(docs, benchmark_of(spark, [item])).collect()}
    assert got[0].text == "a " * 9 + "! tail" and got[0].n_chars == len(got[0].text)
    assert got[1].text == prose(2, 50) and got[2].text == "" and got[3].text is None
    assert dc.contaminated_spans(dc.decontaminate(docs, benchmark_of(spark, [item])), benchmark_of(spark, [item])).count() == 0


def test_passes_cut_the_same_texts(spark, docs_of, prose, data, monkeypatch):
    """Many passes over the same texts give what one pass gives: on made-up rows, and on the whole table."""
    items = [prose(900 + k, 30) for k in range(4)]
    shared = items[0].split()
    items += [" ".join([*shared[5:20], "end"]), "only five words of it"]  # overlaps of items in different passes
    rows = [f"{prose(k, 20)} {items[k % 6]} {prose(50 + k, 20)}" for k in range(8)] + [prose(1, 3) + " only five words of it " + items[0]]
    made = docs_of(rows).unionByName(docs_of([(0, items[1]), (0, items[2] + " x"), (None, items[3])]))
    real = [spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "benchmark")]
    for docs, bench, few in ((made, benchmark_of(spark, items), 30), (*real, 1000)):
        monkeypatch.setattr(dc, "PASS_WORDS", 2_000_000)
        assert len(list(dc.passes(bench))) == 1
        cut = sorted(dc.decontaminate(docs, bench).collect(), key=repr)
        spans = sorted(dc.contaminated_spans(docs, bench).collect(), key=repr)
        monkeypatch.setattr(dc, "PASS_WORDS", few)
        assert len(list(dc.passes(bench))) > 2
        assert sorted(dc.decontaminate(docs, bench).collect(), key=repr) == cut
        assert sorted(dc.contaminated_spans(docs, bench).collect(), key=repr) == spans and spans


def test_short_items_against_sql(spark, docs_of):
    items = ["one two three four five", "a b c d e f g", "p q r s", "k1 k2 k3 k4 k5 k6 k7 k8 k9"]
    texts = ["x One two, three four five a b c d e f g h", "p q r s t", "a b c d e f", "k1 k2 k3 k4 k5 k6 k7 k8 one two three four five", "b c d e f g a b c d e f g k2 k3 k4 k5 k6 k7 k8 k9 k9"]
    con = duckdb.connect()
    con.register("documents", docs_of(texts).toPandas())
    con.register("benchmark", benchmark_of(spark, items).toPandas())
    want = sorted(con.execute(oracle_sql()["op1_decontaminate"]).fetchall())
    assert want == brute_contaminated(list(enumerate(texts)), items) and len(want) == 3
    assert sorted(tuple(r) for r in dc.contaminated_spans(docs_of(texts), benchmark_of(spark, items)).collect()) == want


def test_decontamination_of_odd_rows(spark, odd, none, prose):
    bench = benchmark_of(spark, [prose(1, 80), None, ""])
    spans = sorted((x.doc_id is not None, x.doc_id or 0, x.word_start, x.word_end) for x in dc.contaminated_spans(odd, bench).collect())
    assert spans == [(False, 0, 0, 80), (True, -9, 0, 80), (True, 1, 0, 80)]
    out = dc.decontaminate(odd, bench)
    assert out.columns == odd.columns and out.count() == odd.count() and out.filter("doc_id = 1 and text = '' and n_chars = 0 and h = 0").count() == 2
    assert dc.decontaminate(odd, bench.limit(0)).count() == odd.count() and dc.contaminated_spans(odd, bench.limit(0)).count() == 0
    assert dc.contaminated_spans(none, bench).count() == 0 and dc.decontaminate(none, bench).count() == 0


@pytest.mark.parametrize("seed", range(5))
def test_fm_index(seed):
    r = np.random.default_rng(seed)
    seq = r.integers(1, 5, 300).astype(np.int32)
    assert dc.suffix_array(np.concatenate([seq, [0]])).tolist() == sorted(range(301), key=lambda i: [*seq[i:].tolist(), 0])
    index = dc.FMIndex(seq, 5)
    phrases = r.integers(1, 5, (50, 3)).astype(np.int32)
    found, lo, hi = index.search(phrases)
    at, of = index.locate(lo, hi)
    want = {(k, i) for k, p in enumerate(phrases) for i in range(298) if (seq[i : i + 3] == p).all()}
    assert {(int(found[o]), int(i)) for o, i in zip(of, at)} == want


def brute_repeats(docs, n):
    places = defaultdict(list)
    for row, (_, t) in enumerate(docs):
        w = re.findall(r"[^ \t\n\r\f\x0b]+", t or "")
        for i in range(len(w) - n + 1):
            places[tuple(w[i : i + n])].append((row, i))
    by = defaultdict(set)
    for at in places.values():
        if len({docs[row] for row, _ in at}) > 1:
            for row, i in at:
                by[docs[row]].add(i)
    return sorted((k, a, b) for (k, _), s in by.items() for a, b in merged(s, n))


@pytest.mark.parametrize("seed,n,gram,window", [(0, 12, 4, 6), (1, 9, 9, 5), (2, 15, 1, 30), (3, 50, 8, 24)])
def test_repeated_passages(docs_of, seed, n, gram, window):
    r = random.Random(seed)
    parts = [" ".join(f"t{r.randrange(300)}" for _ in range(r.randrange(5, 70))) for _ in range(25)]
    docs = [(k, "\n".join(r.choices(parts, k=r.randrange(4)))) for k in range(40)]
    docs += [(40, "x " * 100), (41, None), (41, ""), (3, docs[3][1])]  # a run of one word, and a repeated row
    got = sd.repeated_passages(docs_of(docs), n, gram, window).collect()
    assert sorted(tuple(x) for x in got) == brute_repeats(docs, n)


def test_repeats_in_every_document(docs_of, prose, monkeypatch):
    """A passage of all rows, decided in runs of a few suffixes and across them; rows of one doc_id with texts of their own."""
    shared = prose(77, 60)
    docs = [(k // 2 if k < 20 else k, f"{prose(k, 5 + 7 * (k % 9))} {shared} {prose(100 + k, 9)}") for k in range(60)] + [(None, shared), (None, "a " + shared), (0, "b " * 30)]
    want = sorted((docs[k][0] is None, docs[k][0] or 0, a, b) for k, a, b in brute_repeats([(k, t) for k, (_, t) in enumerate(docs)], 50))
    assert len(want) == 62
    for run in (sd.RUN, 40, 1):
        monkeypatch.setattr(sd, "RUN", run)
        got = sd.repeated_passages(docs_of(docs).repartition(5)).collect()
        assert sorted((x.doc_id is None, x.doc_id or 0, x.token_start, x.token_end) for x in got) == want
    zeros = np.zeros(1000, np.int64)
    sources = sd._sorted_runs(lambda _: iter([(np.full(1000, 7, np.uint64), np.arange(1000) // 10, np.arange(1000), zeros, zeros > 0)]))
    monkeypatch.setattr(sd, "RUN", 1 << 19)
    sent = pa.Table.from_batches(sources(iter([])))
    assert Counter(sent["kind"].to_pylist()) == {sd._DECIDED: 100, sd._STANDS: 1} and len(set(sent["suffix"].to_pylist())) == 101
    assert sorted(x for m in sent["more"].to_pylist() for x in m or ()) == list(range(1000))


def test_repeated_passages_of_odd_rows(odd, none):
    got = {x.doc_id: (x.token_start, x.token_end) for x in sd.repeated_passages(odd).collect()}
    assert got == {1: (0, 80), None: (0, 80), -9: (0, 80)}  # not 6, which repeats itself alone
    assert sd.repeated_passages(none).count() == 0


def brute_lines(rows, least=ld.MIN_CHARS):
    """Rows of (doc_id, text) without the repeated long lines, kept in the first place of the smallest doc_id."""
    n, first = Counter(), {}
    for k, t in rows:
        if k is not None:
            for x in (t or "").split("\n"):
                if len(x) >= least:
                    n[x] += 1
                    first[x] = min(first.get(x, k), k)
    out = []
    for k, t in rows:
        if t is None or k is None:
            out.append((k, t))
            continue
        seen, left = set(), []
        for x in t.split("\n"):
            if len(x) < least or n[x] == 1 or (first[x] == k and x not in seen):
                left.append(x)
            seen.add(x)
        out.append((k, "\n".join(left)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed,shard_lines,hot_lines", [(0, 1, 1), (1, 5, 20), (2, ld.SHARD_LINES, ld.HOT_LINES)])
def test_line_dedup(docs_of, seed, shard_lines, hot_lines):
    """Whatever the number of shards, and with no line, some or all repeated ones hot."""
    r = random.Random(seed)
    lines = ["", "short", "é" * 20, "x" * 19] + [f"line number {r.random()} of some length" for _ in range(30)]
    docs = [(k, "\n".join(r.choices(lines, k=r.randrange(12)))) for k in range(80)] + [(5, "short\n" + lines[7]), (5, "short\n" + lines[7]), (None, lines[7]), (200, None)]
    got = ld.dedup_lines(docs_of(docs), drop_emptied=False, shard_lines=shard_lines, hot_lines=hot_lines).collect()
    assert sorted(((x.doc_id, x.text) for x in got), key=repr) == brute_lines(docs)
    assert all(x.n_chars == len(x.text) for x in got if x.text is not None)


def test_a_line_of_every_document(docs_of):
    """A line that all documents hold is answered where they are read, not sent to its shard."""
    line = "the same line stands in every document"
    docs = docs_of([f"{line}\nown line of the document number {k}\n{line}" for k in range(300)])
    got = {r.doc_id: r.text for r in ld.dedup_lines(docs).collect()}
    assert got == {k: (f"{line}\n" if not k else "") + f"own line of the document number {k}" for k in range(300)}
    base = pa.RecordBatch.from_pydict({"d": pa.array([3, 4]), "t": pa.array([line, line + "\n" + line]), "x": pa.array([0, 0])})
    (h,) = (b.column(0).to_numpy()[:1].view(np.uint64) for b in ld._lines(20)(iter([base])))
    hot = h, ld.dump_shard(h, np.array([9]), np.array([3]))
    sent = [r for b in ld._lines(20, hot, 4)(iter([base])) for r in b.to_pylist()]
    assert [(r["kind"], r["doc_id"], r["place"]) for r in sent] == [(ld._ANSWERED, 4, 0), (ld._ANSWERED, 4, 1)]


def test_line_dedup_of_odd_rows(odd, none):
    odd = odd.withColumn("__drops", F.lit(1)).withColumn("Drops_", F.lit(2)).withColumn("text_hash", F.lit(3))
    out = ld.dedup_lines(odd, drop_emptied=False)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert out.columns == odd.columns
    assert sorted(((x.doc_id, x.text) for x in out.collect()), key=repr) == brute_lines(rows)
    assert ld.dedup_lines(none).count() == 0
    assert ld.dedup_lines(odd).filter("text is null").count() == 2


def test_perfect_hash():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 2**63, 20_000, dtype=np.uint64))
    h = ld.PerfectHash(keys)
    assert sorted(h(keys).tolist()) == list(range(len(keys)))
    n, first = r.integers(1, 400, len(keys)), r.integers(0, 99, len(keys))
    shard = ld.Shard(ld.dump_shard(keys, n, first))
    count, doc = shard.probe(keys)
    assert (count == np.minimum(n, 255)).all() and (doc[n > 1] == first[n > 1]).all()
    others = r.integers(2**63, 2**64, 20_000, dtype=np.uint64)
    assert (shard.probe(others)[0] > 0).mean() < 0.001
    assert len(ld.Shard(ld.dump_shard(keys[:0], n[:0], first[:0])).probe(keys)[0]) == len(keys)


def test_chunked_buffers():
    from palimpsest.llm import textops as tx

    texts = [None, "", "Ünï cödé", "a\nb", "x" * 100]
    column = pa.array(texts)
    got = [bytes(d[o[i] : o[i + 1] - 1]).decode() for _, _, d, o in tx.chunks(column, 10) for i in range(len(o) - 1)]
    assert got == [t or "" for t in texts]
    assert tx.hash_words("Été ONE")[1] == tx.hash_words("one")[0]
