"""The queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, langid, linededup, mixing, replytrees, simhash, suffixdedup, tiff, toxicity, urlfilter
from .common import table


def op1_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.contaminated_spans(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op2_suffix_dedup(spark: SparkSession, d: str) -> DataFrame:
    return suffixdedup.repeated_passages(table(spark, d, "documents"))


def op3_mix_sources(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"))


def op4_toxicity(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its score and the neighbours that voted."""
    return toxicity.score_documents(table(spark, d, "documents"), table(spark, d, "labels"))


def op5_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    return linededup.dedup_lines(table(spark, d, "documents"), drop_emptied=False)


def op6_url_filter(spark: SparkSession, d: str) -> DataFrame:
    return urlfilter.score_urls(table(spark, d, "pages"))


def op7_chat_trees(spark: SparkSession, d: str) -> DataFrame:
    """The best branches of every conversation; the table has one message a turn, so rival replies are made for it."""
    return replytrees.format_turns(replytrees.with_rivals(table(spark, d, "conversations")))


def op8_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, d, "documents"))


def op9_language_id(spark: SparkSession, d: str) -> DataFrame:
    return langid.identify(table(spark, d, "documents"))


def op10_tiff(spark: SparkSession, d: str) -> DataFrame:
    pages = tiff.decode_column(tiff.tiff_of_pages(table(spark, d, "pages")))
    # the pixels without the zeros that fill the last row are the text again
    text = F.regexp_replace(F.decode("pixels", "UTF-8"), "\\x00+$", "")
    return pages.select("media_id", "page", "width", "height", "samples", "bits", F.md5(text).alias("content_md5"), F.octet_length(text).alias("content_bytes"), "error")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_decontaminate, op2_suffix_dedup, op3_mix_sources, op4_toxicity, op5_line_dedup, op6_url_filter, op7_chat_trees, op8_simhash, op9_language_id, op10_tiff)}


_SPANS = """, r AS (SELECT doc_id, i, CASE WHEN i <= max(i + {n}) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM hit),
g AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM r)
SELECT doc_id, min(i) AS {a}, max(i) + {n} AS {b} FROM g GROUP BY doc_id, span"""


def oracle_sql() -> dict[str, str]:
    n, m = decontaminate.N_WORDS, suffixdedup.MIN_WORDS
    word = "regexp_extract_all(lower(text), '[a-z0-9\\x{80}-\\x{10FFFF}]+')"
    raw = "regexp_extract_all(text, '[^ \\t\\n\\r\\f\\x0B]+')"
    gram = lambda k: "".join(f" || ' ' || w[i + {j}]" for j in range(1, k + 1))[4:]
    least = decontaminate.MIN_WORDS
    short = "".join(
        f"""
  UNION SELECT doc_id, i, i + {k} AS e FROM (SELECT doc_id, w, unnest(range(CAST(len(w) - {k - 1} AS BIGINT))) AS i FROM d WHERE len(w) >= {k})
  WHERE {gram(k)} IN (SELECT ' ' || array_to_string(w, ' ') FROM b WHERE len(w) = {k})"""
        for k in range(least, n)
    )
    contaminated = f"""WITH d AS (SELECT doc_id, {word} AS w FROM documents), b AS (SELECT {word} AS w FROM benchmark),
p AS (SELECT DISTINCT {gram(n)} AS g FROM (SELECT w, unnest(range(CAST(len(w) - {n - 1} AS BIGINT))) AS i FROM b WHERE len(w) >= {n})),
y AS (SELECT doc_id, w, unnest(range(CAST(len(w) - {n - 1} AS BIGINT))) AS i FROM d WHERE len(w) >= {n}),
hit AS (SELECT DISTINCT doc_id, i, i + {n} AS e FROM y WHERE {gram(n)} IN (SELECT g FROM p){short}),
r AS (SELECT doc_id, i, e, CASE WHEN i <= max(e) OVER (PARTITION BY doc_id ORDER BY i, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM hit),
g AS (SELECT doc_id, i, e, sum(new) OVER (PARTITION BY doc_id ORDER BY i, e ROWS UNBOUNDED PRECEDING) AS span FROM r)
SELECT doc_id, min(i) AS word_start, max(e) AS word_end FROM g GROUP BY doc_id, span"""
    return {
        "op1_decontaminate": contaminated,
        "op2_suffix_dedup": f"""WITH d AS (SELECT doc_id, {raw} AS w FROM documents),
y AS (SELECT doc_id, w, unnest(range(CAST(len(w) - {m - 1} AS BIGINT))) AS i FROM d WHERE len(w) >= {m}),
h AS MATERIALIZED (SELECT doc_id, i, md5({gram(m)}) AS g FROM y),
hit AS (SELECT doc_id, i FROM h WHERE g IN (SELECT g FROM h GROUP BY g HAVING min(doc_id) < max(doc_id)))"""
        + _SPANS.format(n=m, a="token_start", b="token_end"),
        "op3_mix_sources": mixing.mix_sql(),
        "op5_line_dedup": f"""WITH d AS (SELECT *, string_split(text, chr(10)) AS s FROM documents),
l AS (SELECT doc_id, unnest(s) AS line, unnest(range(len(s))) AS i FROM d),
c AS (SELECT line, count(*) AS n, min(doc_id) AS first_doc FROM l WHERE length(line) >= {linededup.MIN_CHARS} GROUP BY line),
k AS (SELECT l.doc_id, l.line, l.i FROM l LEFT JOIN c USING (line)
  WHERE c.line IS NULL OR n = 1 OR (l.doc_id = first_doc AND l.i = (SELECT min(o.i) FROM l o WHERE o.doc_id = l.doc_id AND o.line = l.line))),
t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM k GROUP BY doc_id)
SELECT d.doc_id, coalesce(t.text, '') AS text, d.lang, d.source, CAST(length(coalesce(t.text, '')) AS BIGINT) AS n_chars FROM d LEFT JOIN t USING (doc_id)""",
        "op7_chat_trees": replytrees.FORMAT_SQL,
        "op10_tiff": """WITH p AS (SELECT page_id, 0 AS page, 64 AS width, html AS x FROM pages UNION ALL SELECT page_id, 1, 16, url FROM pages)
SELECT page_id AS media_id, CAST(page AS INTEGER) AS page, CAST(width AS INTEGER) AS width,
  CAST(greatest(1, ceil(octet_length(encode(x)) / width)) AS INTEGER) AS height, CAST(1 AS INTEGER) AS samples, CAST(8 AS INTEGER) AS bits,
  md5(x) AS content_md5, CAST(octet_length(encode(x)) AS INTEGER) AS content_bytes, CAST(NULL AS VARCHAR) AS error FROM p""",
    }
