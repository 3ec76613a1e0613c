"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic); a cell's tokens are counted over all documents. The
fitting rakes the cell weights to the target marginals of source, language and topic in turn, `ROUNDS` rounds
at a time, until every marginal is within `TOLERANCE` of its target or `MOST_ROUNDS` are over. Every document
is then kept with its cell's probability min(1, rate * fitted share / observed share) and carries the weight
that makes up for a probability cut at 1, so weighted sums of kept tokens reproduce the raked marginals. The
draw is a hash of seed and doc_id: repeatable, and the same on any cluster.

Targets are shares for each value of a dimension. Where none is given, the target is the observed share
to the power `ALPHA` of the dimension, normalised: small sources and languages are lifted without a list of
them, and topics keep their shares. Values absent from a
given target get target 0 and are not sampled; targets for values that do not occur are spread over the
others by the normalisation. Marginals that no weights can meet (the cells that would be needed do not occur)
end after MOST_ROUNDS with the last dimension, the topic, as it should be.

A topic is taken from the column that `topic` names. Without one it is learned: the topic words are the
`TOPICS` words of `TOPIC_CHARS` or more characters that occur most often in all documents (the first in order
of bytes where they occur equally often), and a text's topic is the topic word that it holds most often (again
the first), or '' if it holds none.

Cells are a summary: sources x languages x topics. Up to `MAX_CELLS` of them are raked in one task and
broadcast; with more, the same rounds run as distributed aggregations, and the join is left to Spark.

Defined results: a null source, language or topic is a value of its own; a null text counts as empty; a text
without tokens has no weight and is not sampled; repeated rows count each and are drawn alike; a null doc_id
is drawn as doc_id -1; extra columns pass; very long texts are read whole; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as tx
from .common import Scratch, free_name, stored

ALPHA = {"source": 0.5, "lang": 0.5, "topic": 1.0}
RATE = 0.5
ROUNDS = 40
MOST_ROUNDS = 2000
TOLERANCE = 1e-9
SEED = 17
MAX_CELLS = 200_000
TOPICS = 8
TOPIC_CHARS = 7
DIMENSIONS = ("source", "lang", "topic")
_NULL = "␀"


def _long_words(data: np.ndarray, offs: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Folded bytes, row, start, end and hash of the words of at least `least` characters."""
    data = tx.fold(data)
    s, e, first = tx.runs(data, offs, tx.WORD)
    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    long = chars[e] - chars[s] >= least
    return data, tx.row_of(first)[long], s[long], e[long], tx.hashes(data, s[long], e[long])


def topic_words(docs: DataFrame, topics: int = TOPICS, least: int = TOPIC_CHARS) -> list[str]:
    """The most frequent long words of all documents, the most frequent first."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offs in tx.chunks(b.column(0)):
                data, _, s, e, h = _long_words(data, offs, least)
                if not len(h):
                    continue
                _, f, n = np.unique(h, return_index=True, return_counts=True)
                size = e[f] - s[f]
                at = np.concatenate([[0], np.cumsum(size)])
                flat = np.arange(at[-1]) + np.repeat(s[f] - at[:-1], size)
                words = pa.StringArray.from_buffers(len(f), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data[flat]))
                yield pa.RecordBatch.from_arrays([words, pa.array(n)], names=["word", "n"])

    words = docs.select(F.col("text").cast("string")).mapInArrow(counts, "word string, n long")
    return [r["word"] for r in words.groupBy("word").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "word").limit(topics).collect()]


def _topics_of(column: pa.Array, words: list[str], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of the topic word (len(words) for none) and number of tokens of each text."""
    names = tx.hash_words("\n".join(words)) if words else np.zeros(0, np.uint64)
    order = np.argsort(names)
    rank = np.argsort(np.argsort(np.array([w.encode() for w in words], object))) if words else np.zeros(0, np.int64)
    topic, tokens = np.full(len(column), len(words)), np.zeros(len(column), np.int64)
    for row0, end, data, offs in tx.chunks(column):
        tokens[row0:end] = np.diff(tx.runs(data, offs, tx.TOKEN)[2])
        if not len(names):
            continue
        _, row, _, _, h = _long_words(data, offs, least)
        at = np.minimum(np.searchsorted(names[order], h), len(names) - 1)
        known = names[order][at] == h
        held = np.bincount(row[known] * len(names) + order[at[known]], minlength=(end - row0) * len(names)).reshape(-1, len(names))
        best = (held * len(names) - rank).argmax(1)  # the most, then the first in order of bytes
        topic[row0:end] = np.where(held.any(1), best, len(words))
    return topic, tokens


def with_topics(docs: DataFrame, words: list[str] | None, topic: str, tokens: str, least: int = TOPIC_CHARS) -> DataFrame:
    """docs (it has a column text) with two more columns: the learned topic, if words are given, and the number of tokens."""
    schema = T.StructType([*docs.schema.fields, *([T.StructField(topic, T.StringType())] if words is not None else []), T.StructField(tokens, T.LongType())])
    at, names = docs.columns.index("text"), schema.names
    said = pa.array([*(words or []), ""])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, n = _topics_of(b.column(at).cast(pa.large_string()), words or [], least)
            yield pa.RecordBatch.from_arrays([*b.columns, *([said.take(pa.array(of))] if words is not None else []), pa.array(n)], names=names)

    return docs.mapInArrow(run, schema)


def _key(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(_NULL))


def cells(docs: DataFrame, words: list[str] | None, topic: str | None) -> DataFrame:
    """(source, lang, topic, tokens) of the cells that have tokens."""
    own = docs.select(_key("source").alias("source"), _key("lang").alias("lang"), F.col("text").cast("string").alias("text"), *([_key(topic).alias("topic")] if topic else []))
    return with_topics(own, words, "topic", "tokens").groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")).filter("tokens > 0")


def targets_of(table: pd.DataFrame, given: dict[str, dict[str, float]] | None, alpha: dict[str, float]) -> dict[str, pd.Series]:
    """Target share of each value of each dimension."""
    out = {}
    for d in DIMENSIONS:
        own = table.groupby(d, sort=True)["tokens"].sum()
        t = pd.Series({v: float(given[d].get(v, 0.0)) for v in own.index}) if given and d in given else (own / own.sum()) ** alpha[d]
        out[d] = t / t.sum() if t.sum() > 0 else t
    return out


def rake(table: pd.DataFrame, targets: dict[str, pd.Series], rounds: int = ROUNDS, tolerance: float = TOLERANCE, most: int = MOST_ROUNDS) -> pd.DataFrame:
    """The cells with share, the observed, and fitted, the raked share of tokens."""
    table = table.sort_values(list(DIMENSIONS), ignore_index=True)
    table["share"] = table["tokens"] / table["tokens"].sum()
    w = table["share"].to_numpy(float)
    group = {d: np.unique(table[d].to_numpy(object), return_inverse=True) for d in DIMENSIONS}
    target = {d: targets[d].reindex(names).to_numpy(float) for d, (names, _) in group.items()}
    for done in range(1, most + 1):
        for d, (names, of) in group.items():
            held = np.bincount(of, weights=w, minlength=len(names))
            w = w * np.where(held > 0, target[d] / np.where(held > 0, held, 1), 0.0)[of]
        if done % rounds == 0 and all(np.abs(np.bincount(of, weights=w, minlength=len(names)) - target[d]).max() <= tolerance for d, (names, of) in group.items()):
            break
    table["fitted"] = w
    return table


def rake_distributed(table: DataFrame, given: dict[str, dict[str, float]] | None, alpha: dict[str, float], scratch: Scratch, rounds: int = ROUNDS, tolerance: float = TOLERANCE, most: int = MOST_ROUNDS) -> DataFrame:
    """rake() as Spark aggregations, for cell tables too large for one task; each step is written, so plans and their size estimates stay small."""
    spark = table.sparkSession
    everything = table.agg(F.sum("tokens")).first()[0] or 1
    table = scratch.stored(table.withColumn("share", F.col("tokens") / F.lit(everything)).withColumn("fitted", F.col("share")))
    targets = {}
    for d in DIMENSIONS:
        if given and d in given:
            g = spark.createDataFrame([(k, float(v)) for k, v in given[d].items()], f"{d} string, t double")
            t = table.select(d).distinct().join(g, d, "left").fillna(0.0, ["t"])
        else:
            t = table.groupBy(d).agg(F.pow(F.sum("share"), F.lit(alpha[d])).alias("t"))
        t = scratch.stored(t)
        norm = t.agg(F.sum("t")).first()[0] or 1.0
        targets[d] = scratch.stored(t.withColumn("t", F.col("t") / F.lit(norm)))
    held = lambda d: table.groupBy(d).agg(F.sum("fitted").alias("held")).join(targets[d], d)
    for done in range(1, most + 1):
        for d in DIMENSIONS:
            factor = held(d).select(d, F.when(F.col("held") > 0, F.col("t") / F.col("held")).otherwise(0.0).alias("factor"))
            table = scratch.stored(table.join(factor, d).withColumn("fitted", F.col("fitted") * F.col("factor")).drop("factor"))
        if done % rounds == 0 and all((held(d).agg(F.max(F.abs(F.col("held") - F.col("t")))).first()[0] or 0.0) <= tolerance for d in DIMENSIONS):
            break
    return table


def fitted_cells(docs: DataFrame, words: list[str] | None, topic: str | None, targets: dict[str, dict[str, float]] | None = None, alpha: dict[str, float] = ALPHA, rounds: int = ROUNDS, most: int = MOST_ROUNDS, max_cells: int = MAX_CELLS) -> tuple[DataFrame, bool]:
    """The raked cells, stored, and whether they are few enough to broadcast."""
    schema = "source string, lang string, topic string, tokens long, share double, fitted double"

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[[*DIMENSIONS, "tokens"]]
        return rake(pdf, targets_of(pdf, targets, alpha), rounds, most=most)

    with Scratch(docs.sparkSession) as scratch:
        table = scratch.stored(cells(docs, words, topic))
        few = table.count() <= max_cells
        return stored(table.groupBy().applyInPandas(fit, schema) if few else rake_distributed(table, targets, alpha, scratch, rounds, most=most)), few


def draw(doc_id: Column, seed: int) -> Column:
    """A uniform number in [0, 1) for each document."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("long"), F.lit(-1)).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, topic: str | None = None, rate: float = RATE, alpha: dict[str, float] = ALPHA, rounds: int = ROUNDS, most: int = MOST_ROUNDS, seed: int = SEED, max_cells: int = MAX_CELLS) -> DataFrame:
    """The sampled documents, with sample_prob and sample_weight added (any columns of these names are replaced)."""
    words = None if topic else topic_words(docs)
    table, few = fitted_cells(docs, words, topic, targets, alpha, rounds, most, max_cells)
    docs = docs.drop("sample_prob", "sample_weight")
    names = docs.columns
    said, tokens, p, w, *on = (free_name(names, f"mix_{x}") for x in ("said", "tokens", "p", "w", *DIMENSIONS))
    ratio = F.col("fitted") / F.col("share")
    prob = F.least(F.lit(1.0), F.lit(rate) * ratio)
    rates = table.filter("fitted > 0").select(*(F.col(d).alias(k) for d, k in zip(DIMENSIONS, on)), F.round(prob, 9).alias(p), F.round(ratio / prob, 9).alias(w))
    small = F.broadcast if few else lambda x: x
    match = lambda keys: reduce(lambda a, b: a & b, keys)
    keys = [_key("source") == F.col(on[0]), _key("lang") == F.col(on[1]), (_key(topic) if topic else F.col(said)) == F.col(on[2])]
    # documents that no topic of their source and language would keep need not be read for their topic
    most_p = rates.groupBy(*on[:2]).agg(F.max(p).alias(p))
    maybe = docs.join(small(most_p), match(keys[:2])).filter(draw(F.col("doc_id"), seed) < F.col(p)).select(*names)
    joined = with_topics(maybe, words, said, tokens).join(small(rates), match(keys))
    kept = joined.filter((draw(F.col("doc_id"), seed) < F.col(p)) & (F.col(tokens) > 0))
    return kept.select(*names, F.col(p).alias("sample_prob"), F.col(w).alias("sample_weight"))


def mix_sql(rounds: int = ROUNDS, rate: float = RATE, alpha: dict[str, float] = ALPHA, seed: int = SEED) -> str:
    """mix() of the table documents as SQL, one common table expression for each raking step of the first ROUNDS."""
    out = [
        f"""WITH d AS (SELECT *, row_number() OVER () AS id, coalesce(source, '{_NULL}') AS s, coalesce(lang, '{_NULL}') AS l,
  len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\x0B]+')) AS n FROM documents),
u AS (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')) AS word FROM d),
c AS (SELECT id, word, count(*) AS k FROM u WHERE length(word) >= {TOPIC_CHARS} GROUP BY id, word),
v AS (SELECT word FROM c GROUP BY word ORDER BY sum(k) DESC, word LIMIT {TOPICS}),
m AS (SELECT id, word AS t FROM c JOIN v USING (word) QUALIFY row_number() OVER (PARTITION BY id ORDER BY k DESC, word) = 1),
e AS (SELECT d.*, coalesce(m.t, '') AS t FROM d LEFT JOIN m USING (id)),
w0 AS (SELECT s, l, t, sum(n) / sum(sum(n)) OVER () AS share, sum(n) / sum(sum(n)) OVER () AS w FROM e GROUP BY s, l, t HAVING sum(n) > 0)"""
    ]
    for c, d in zip("slt", DIMENSIONS):
        out.append(f"g{c} AS (SELECT {c}, pow(sum(share), {alpha[d]}) / sum(pow(sum(share), {alpha[d]})) OVER () AS g FROM w0 GROUP BY {c})")
    step = 0
    for _ in range(rounds):
        for c in "slt":
            out.append(f"w{step + 1} AS MATERIALIZED (SELECT s, l, t, share, w * g / sum(w) OVER (PARTITION BY {c}) AS w FROM w{step} JOIN g{c} USING ({c}))")
            step += 1
    p = f"least(1.0, {rate} * w / share)"
    return (
        ",\n".join(out)
        + f"""
SELECT doc_id, text, lang, source, n_chars, round({p}, 9) AS sample_prob, round(w / share / {p}, 9) AS sample_weight
FROM e JOIN w{step} USING (s, l, t)
WHERE n > 0 AND CAST('0x' || substr(md5('{seed}:' || CAST(coalesce(doc_id, -1) AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < round({p}, 9)"""
    )
