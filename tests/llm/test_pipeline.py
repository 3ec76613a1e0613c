"""The corpus pipeline against each operator's brute-force version, stage by stage."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from palimpsest.llm import mixing, toxicity
from palimpsest.llm.common import shared_dir

from .test_groups import closure, jaccard_pairs, word_sets
from .test_spans import brute_contaminated, brute_lines, words


def test_stages(spark, data):
    tables = {t: spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels", "benchmark")}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_duplicates", "decontamination", "mixing"]
    before = tables["documents"]
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, before, data)
        assert df.columns[: len(tables["documents"].columns)] == tables["documents"].columns
        assert (name == "mixing") == (len(df.columns) > 5)
        before = after[name] = spark.createDataFrame(df.toPandas(), df.schema)
    rows = {n: {r.doc_id: r for r in df.collect()} for n, df in after.items()}
    start = {r.doc_id: r for r in tables["documents"].collect()}
    # toxicity: what its scores reject goes, and nothing else
    scored = toxicity.score_documents(tables["documents"], tables["labels"]).collect()
    assert set(rows["toxicity"]) == {r.doc_id for r in scored if r.score < toxicity.CUTOFF}
    assert all(rows["toxicity"][k] == start[k] for k in rows["toxicity"])
    # line dedup
    want = [(k, t) for k, t in brute_lines([(k, r.text) for k, r in rows["toxicity"].items()]) if t.strip() or t == start[k].text]
    assert sorted((k, r.text) for k, r in rows["line_dedup"].items()) == sorted(want)
    # near-duplicates: one document of each group stays
    ids = sorted(rows["line_dedup"])
    sets = word_sets([rows["line_dedup"][k].text for k in ids])
    gone, left = {ids[k] for k in closure(jaccard_pairs(sets), len(ids))}, set(ids) - set(rows["near_duplicates"])
    assert left <= gone and len(left) >= 0.97 * len(gone)
    # decontamination: nothing of the benchmark is left that was there, the rest of each text stays
    items = [r.text for r in tables["benchmark"].collect()]
    docs = [(k, r.text) for k, r in rows["near_duplicates"].items()]
    hit = {k for k, _, _ in brute_contaminated(docs, items)}
    assert hit == {k for k, t in docs if rows["decontamination"][k].text != t} and len(rows["decontamination"]) == len(docs)
    for k, a, b in brute_contaminated(docs, items):
        assert len(words(rows["decontamination"][k].text)) <= len(words(dict(docs)[k])) - (b - a)
    # mixing: the same rows as its SQL over what came before
    con = duckdb.connect()
    con.register("documents", after["decontamination"].toPandas())
    said = {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, sample_prob, sample_weight FROM ({mixing.mix_sql()})").fetchall()}
    got = {k: (r.sample_prob, r.sample_weight) for k, r in rows["mixing"].items()}
    assert set(said) == set(got) and 0 < len(got) < len(docs)
    assert all(np.allclose(said[k], got[k], atol=1e-6) for k in got)


def test_run(spark, data):
    """run() is the stages one after the other, and leaves no table behind but its result."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, data).toPandas(), stage(spark, docs, data).schema)
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    out = corpus_pipeline.run(spark, data)
    assert sorted(out.collect(), key=lambda r: r.doc_id) == sorted(docs.collect(), key=lambda r: r.doc_id)
    assert corpus_pipeline.ORACLE_SQL is None
    left = [x for x in set(os.listdir(folder)) - before if "text" in spark.read.parquet(f"{folder}/{x}").columns]
    assert len(left) == 1


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows(spark, data, odd, none, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    added = ["sample_prob", "sample_weight"] if name == "mixing" else []
    out = stage(spark, odd, data)
    assert out.columns == [*odd.columns, *added]
    got = Counter(r.doc_id for r in out.collect())
    everything = Counter(r.doc_id for r in odd.collect())
    if name == "mixing":  # no text without tokens
        assert got <= everything and not {2, 3, 4} & set(got)
    elif name == "near_duplicates":  # -9 says what 1 says
        assert got == Counter({k: n for k, n in everything.items() if k != 1})
    elif name == "line_dedup":  # the only line of 1 stands in -9
        assert got == Counter({k: n for k, n in everything.items() if k != 1})
    else:
        assert got == everything
    empty = stage(spark, none, data)
    assert empty.columns == [*none.columns, *added] and empty.count() == 0


def test_tables_without_rows(spark, tmp_path, docs_of, prose):
    """No labels, no benchmark, no documents."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = docs_of([prose(k, 30) for k in range(6)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert sorted(stage(spark, docs, str(tmp_path)).collect()) == sorted(docs.collect()), name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() <= 6
    docs.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
