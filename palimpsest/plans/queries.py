"""One query for each operator over the whole driver tables, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions import text as tx
from ..functions.delta import delta_apply, delta_encode, delta_ops, fnv1a
from ..operators.cut import cut, last_of_group
from ..operators.merge import ascending_only, merge
from ..operators.pack import pack, quarantined, unpack
from ..operators.reference import best_reference, changed_pages
from ..runtime import local_path, shared_dir, small_batches
from ..sources import blocks, container, dump, sinks
from ..streaming import daily
from . import dumps
from .tables import namespace, page_markup, segments, snapshots, table, thread_markup, whole_dump


def _folder(spark: SparkSession) -> str:
    return local_path(f"{shared_dir(spark)}/{uuid.uuid4().hex}")


def _dump_file(spark: SparkSession, d: str, compression: str, where: str = "true") -> str:
    path = _folder(spark) + ".xml" + ("" if compression == "none" else f".{compression}")
    sinks.write_dump(whole_dump(spark, d, where), path, compression)
    return path


def _scan(compression: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        rows = dump.read_dump(spark, _dump_file(spark, d, compression))
        return rows.select("key", "ns", "start", "length", F.md5("text").alias("text_md5"))

    return query


def suffix_probing(spark: SparkSession, d: str) -> DataFrame:
    """A dump asked for by its name without the codec's suffix."""
    path = _dump_file(spark, d, "bz2")
    return dump.read_dump(spark, path.removesuffix(".bz2")).select("key", "ns", "start", "length", F.md5("text").alias("text_md5"))


def stdin_scan(spark: SparkSession, d: str) -> DataFrame:
    """A dump that comes as a stream of bytes."""
    with open(_dump_file(spark, d, "none"), "rb") as stream:
        path = dump.spool(spark, stream)
    return dump.read_dump(spark, path).select("key", "ns", "start", "length", F.md5("text").alias("text_md5"))


def bz2_random_access(spark: SparkSession, d: str) -> DataFrame:
    """Every segment of a packed dump by its place, through the index of the dump's blocks."""
    path = _dump_file(spark, d, "bz2")
    places = dump.read_dump(spark, path).select("key", "start", "length")
    got = blocks.read_at(path, blocks.block_index(spark, path), places.select(F.col("start").alias("offset"), "length"))
    return places.join(got, (F.col("start") == F.col("offset")) & (places["length"] == got["length"])).select("key", "start", F.md5("bytes").alias("text_md5"))


def scan_to_any(spark: SparkSession, d: str) -> DataFrame:
    found = tx.scan_to_any(F.col("html"), ["<h1>", "<p>", "</nav>", "é"], inclusive=True)
    return table(spark, d, "pages").select("page_id", found.alias("f")).select("page_id", "f.off", "f.which")


def limited_scan(spark: SparkSession, d: str) -> DataFrame:
    found = tx.limited_scan(F.col("text"), "é", 40)
    return table(spark, d, "documents").select("doc_id", found.alias("f")).select("doc_id", "f.off", "f.found")


def merge_files(spark: SparkSession, d: str) -> DataFrame:
    """Two dumps from files, the newer one without a source."""
    paths = [_dump_file(spark, d, "none", "source <> 'src7'"), _dump_file(spark, d, "gz")]
    return dumps.merge_dumps(spark, paths).select("key", F.md5("text").alias("text_md5"))


def pack_files(spark: SparkSession, d: str) -> DataFrame:
    """A dump packed against an older one and unpacked from the pack file, under the name that the pack gives it."""
    paths = [_dump_file(spark, d, "none"), _dump_file(spark, d, "bz2", "lang <> 'de'")]
    rows, named = dumps.unpack_dump(spark, dumps.pack_dump(spark, paths, compression="gz"))
    sinks.write_dump(rows, f"{named}.unpacked")
    return dump.read_dump(spark, f"{named}.unpacked").select("key", "ns", "start", "length", F.md5("text").alias("text_md5"))


def quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Deltas whose checksums were damaged, as the report of them has it."""
    new, refs = snapshots(spark, d)
    damaged = pack(new, refs).withColumn("out_cksum", F.when(F.col("ord") % 7 == 0, F.col("out_cksum").bitwiseXOR(F.lit(1))).otherwise(F.col("out_cksum")))
    return quarantined(damaged, refs).select("ord", "src_ok", "out_ok", "text")


def ns_filter(spark: SparkSession, d: str) -> DataFrame:
    return cut(snapshots(spark, d)[0], ns=0).select("key", "ns", "text")


def last_revision(spark: SparkSession, d: str) -> DataFrame:
    return last_of_group(table(spark, d, "conversations"), ["conv_id"], ["turn"])


def last_revision_text(spark: SparkSession, d: str) -> DataFrame:
    return thread_markup(table(spark, d, "conversations")).select("key", tx.last_revision(F.col("text")).alias("text"))


def cut_meta(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select((F.col("doc_id") + 1).alias("key"), tx.cut_meta(page_markup()).alias("text"))


def cut_meta_all(spark: SparkSession, d: str) -> DataFrame:
    return thread_markup(table(spark, d, "conversations")).select("key", tx.cut_meta_everywhere(F.col("text")).alias("text"))


def cut_between(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.cut_between(F.col("html"), "<nav>", "</nav>").alias("html"))


def peek_int(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", tx.peek_int(tx.after(F.col("url"), "page=")).alias("page_no"), tx.peek_int(F.col("html")).alias("html_no"))


def page_fields(spark: SparkSession, d: str) -> DataFrame:
    text = page_markup()
    return table(spark, d, "documents").select("doc_id", tx.page_key(text).alias("key"), tx.page_ns(text).alias("ns"))


def _four(spark: SparkSession, d: str) -> list[DataFrame]:
    threads = last_revision(spark, d)
    return [
        segments(table(spark, d, "benchmark"), F.col("item_id") + 1, F.lit(0), F.col("text"), 0),
        segments(table(spark, d, "pages"), F.col("page_id") + 1, F.lit(1), F.col("html"), 1),
        segments(threads, F.col("conv_id") + 1, F.lit(2), F.col("text"), 2),
        segments(table(spark, d, "documents"), F.col("doc_id") + 1, namespace(F.col("lang")), F.col("text"), 3),
    ]


def merge_leftmost(spark: SparkSession, d: str) -> DataFrame:
    return merge(_four(spark, d)).select("key", "source", "ns", "text")


def merge_namespace(spark: SparkSession, d: str) -> DataFrame:
    return merge(_four(spark, d), ns=2).select("key", "source", "ns", "text")


def merge_monotonic(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.lit(0).alias("rank"), F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("start"), F.lit(1).alias("length"))
    return ascending_only(rows, stride=4096).select("key", "start")


def best_reference_query(spark: SparkSession, d: str) -> DataFrame:
    new, refs = snapshots(spark, d)
    return best_reference(new, refs).select("key", "ref_source", "ref_start", "ref_length", F.md5("ref_text").alias("ref_md5"))


def best_reference_strict(spark: SparkSession, d: str) -> DataFrame:
    new, refs = snapshots(spark, d)
    return best_reference(new, refs, strict=True).select("key", "ref_source", "ref_start", "ref_length", F.md5("ref_text").alias("ref_md5"))


def changed(spark: SparkSession, d: str) -> DataFrame:
    return changed_pages(*snapshots(spark, d)).select("key", "ns", "text")


def pack_unpack(spark: SparkSession, d: str) -> DataFrame:
    new, refs = snapshots(spark, d)
    return unpack(pack(new, refs), refs)


def change_dump(spark: SparkSession, d: str) -> DataFrame:
    new, refs = snapshots(spark, d)
    return unpack(pack(new, refs), refs, changed_only=True)


def pack_table(spark: SparkSession, d: str) -> DataFrame:
    new, refs = snapshots(spark, d)
    return pack(new, refs).select("ord", "source_number", "start", "length", "src_cksum", "out_cksum")


def pack_file(spark: SparkSession, d: str) -> DataFrame:
    new, refs = snapshots(spark, d)
    path = _folder(spark) + ".pack.bz2"
    container.write_pack(pack(new, refs), path, ["new.xml", "ref1.xml.gz", "ref2.xml.bz2"], "bz2")
    return unpack(container.read_pack(spark, path), refs).select(F.col("key").alias("frame"), "text")


def delta_functions(spark: SparkSession, d: str) -> DataFrame:
    """Each page's html as a delta from its url: nothing in common, or little."""
    small_batches(spark)
    p = table(spark, d, "pages")
    return p.select("page_id", delta_apply(F.col("url"), delta_encode(F.col("url"), F.col("html"))).cast("string").alias("html"))


def delta_stats(spark: SparkSession, d: str) -> DataFrame:
    new, refs = snapshots(spark, d)
    ops = pack(new, refs).select(F.col("ord").alias("key"), delta_ops(F.col("delta")).alias("ops"))
    return ops.select("key", F.aggregate("ops", F.lit(0).cast("bigint"), lambda n, o: n + o["len"]).alias("bytes"))


def fnv1a_query(spark: SparkSession, d: str) -> DataFrame:
    small_batches(spark)
    return table(spark, d, "documents").select("doc_id", fnv1a(F.col("text")).alias("checksum"))


def file_names(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    name = names.base_name(url)
    return table(spark, d, "pages").select(
        "page_id", name.alias("base"), names.unzipped_name(F.concat(url, F.lit(".gz.bz2"))).alias("unzipped"),
        names.canonical_format(F.element_at(F.array(F.lit("bzip2"), F.lit("gzip"), F.lit("xz")), (F.length(url) % 3 + 1).cast("int"))).alias("codec"), names.safe_name(name).alias("safe"),
    )


def size_guard(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(tx.usable_source(F.col("text"), 1500)).alias("text_md5"))


def cut_pipeline(spark: SparkSession, d: str) -> DataFrame:
    return cut(dump.read_dump(spark, _dump_file(spark, d, "gz")), lastrev=True, ns=0, cutmeta=True).select("key", "text")


def daily_merge(spark: SparkSession, d: str) -> DataFrame:
    """The four tables arrive as four files of one stream; the newest version of a page stays."""
    base = _folder(spark)
    for rows in reversed(_four(spark, d)):
        # of one batch, the higher source is the newer one
        rows.withColumn("source", 3 - F.col("source")).write.mode("append").parquet(f"{base}/in")
    daily.follow(spark, f"{base}/in", f"{base}/out", f"{base}/state").awaitTermination()
    return daily.snapshot(spark, f"{base}/out").select("key", (3 - F.col("source")).alias("source"), "ns", "text")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (ns_filter, last_revision, last_revision_text, cut_meta, cut_meta_all, cut_between, peek_int, page_fields, merge_leftmost, merge_namespace, merge_monotonic, best_reference_strict, pack_table, pack_file, delta_functions, delta_stats, file_names, size_guard, cut_pipeline, daily_merge, suffix_probing, stdin_scan, bz2_random_access, scan_to_any, limited_scan, merge_files, pack_files, quarantine)
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in own}
    out |= {f"segment_scan_{c}": _scan(c) for c in ("none", "gz", "bz2", "xz", "lzo")}
    return out | {"best_reference": best_reference_query, "changed_pages": changed, "pack_unpack_roundtrip": pack_unpack, "change_dump": change_dump, "fnv1a": fnv1a_query}


_NS = "CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 1 WHEN 'de' THEN 2 WHEN 'es' THEN 3 ELSE 4 END"
_BYTES = "CAST(octet_length(encode({})) AS BIGINT)"
_NEW = f"new AS (SELECT doc_id + 1 AS key, {_NS} AS ns, CASE WHEN n_chars > 2000 THEN text || ' [edited]' ELSE text END AS text FROM documents)"
_REFS = """r1 AS (SELECT doc_id + 1 AS key, text FROM documents WHERE source <> 'src7'),
r2 AS (SELECT doc_id + 1 AS key, CASE WHEN lang = 'es' THEN text || ' [old]' ELSE text END AS text FROM documents WHERE lang <> 'de')"""
_BEST = f"""WITH {_NEW}, {_REFS},
b AS (SELECT n.key, n.ns, n.text, CASE WHEN r1.text <> '' THEN 1 WHEN r2.text <> '' THEN 2 ELSE -1 END AS src,
  CASE WHEN r1.text <> '' THEN r1.text WHEN r2.text <> '' THEN r2.text END AS ref FROM new n LEFT JOIN r1 USING (key) LEFT JOIN r2 USING (key))"""
_POINTS = f"CAST(src AS BIGINT) AS ref_source, CASE WHEN src > 0 THEN key ELSE 0 END AS ref_start, coalesce({_BYTES.format('ref')}, 0) AS ref_length, md5(ref) AS ref_md5"
_STRICT = f"""WITH {_NEW}, {_REFS},
k1 AS (SELECT key, w, lag(w) OVER (ORDER BY key) AS p FROM (SELECT n.key AS nk, coalesce(n.key, r1.key) AS key, r1.key IS NOT NULL AS w FROM new n FULL JOIN r1 USING (key))),
h1 AS (SELECT k1.key FROM k1 JOIN r1 USING (key) JOIN new USING (key) WHERE w AND coalesce(p, true) AND r1.text <> ''),
q2 AS (SELECT key FROM new WHERE key NOT IN (SELECT key FROM h1)),
k2 AS (SELECT key, w, lag(w) OVER (ORDER BY key) AS p FROM (SELECT coalesce(q2.key, r2.key) AS key, r2.key IS NOT NULL AS w FROM q2 FULL JOIN r2 USING (key))),
h2 AS (SELECT k2.key FROM k2 JOIN r2 USING (key) JOIN q2 USING (key) WHERE w AND coalesce(p, true) AND r2.text <> ''),
b AS (SELECT n.key, CASE WHEN h1.key IS NOT NULL THEN 1 WHEN h2.key IS NOT NULL THEN 2 ELSE -1 END AS src,
  CASE WHEN h1.key IS NOT NULL THEN r1.text WHEN h2.key IS NOT NULL THEN r2.text END AS ref
  FROM new n LEFT JOIN h1 ON h1.key = n.key LEFT JOIN h2 ON h2.key = n.key LEFT JOIN r1 ON r1.key = n.key LEFT JOIN r2 ON r2.key = n.key)"""
_FNV = """list_reduce(list_prepend(CAST(2166136261 AS UBIGINT), list_transform(regexp_extract_all(hex(encode({t})), '..'), lambda b: CAST('0x' || b AS UBIGINT))), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"""
_FOUR = f"""f AS (SELECT item_id + 1 AS key, 0 AS source, 0 AS ns, text FROM benchmark
UNION ALL SELECT page_id + 1, 1, 1, html FROM pages
UNION ALL SELECT conv_id + 1, 2, 2, text FROM (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1)
UNION ALL SELECT doc_id + 1, 3, {_NS}, text FROM documents)"""
_MARKUP = f"""'<page>' || chr(10) || '    <title>' || source || '</title>' || chr(10) || '    <ns>' || {_NS} || '</ns>' || chr(10) || '    <id>' || (doc_id + 1) || '</id>' || chr(10) || '    <revision>' || chr(10) || '      <id>' || n_chars || '</id>' || chr(10) || """
_META = """'      <contributor>' || chr(10) || '        <username>' || lang || '</username>' || chr(10) || '      </contributor>' || chr(10) || '      <minor />' || chr(10) || '      <comment>of ' || source || '</comment>' || chr(10) || """
_REST = "'      <text>' || text || '</text>' || chr(10) || '    </revision>' || chr(10) || '  </page>'"
_THREAD = """t AS (SELECT conv_id + 1 AS key, '  <page>' || chr(10) || '    <id>' || (conv_id + 1) || '</id>' || chr(10) AS head,
  list('    <revision>' || chr(10) || '      <id>' || turn || '</id>' || chr(10) || {comment} || '      <text>' || text || '</text>' || chr(10) || '    </revision>' || chr(10) ORDER BY turn) AS revs FROM conversations GROUP BY conv_id)"""
_COMMENT = "'      <comment>' || role || '</comment>' || chr(10)"
_DUMP = f"""WITH p AS (SELECT doc_id + 1 AS key, {_NS} AS ns, CASE WHEN doc_id = (SELECT min(doc_id) FROM documents) THEN '' ELSE chr(10) || '  ' END || {_MARKUP}{_META}{_REST} AS text FROM documents
UNION ALL SELECT 0, NULL, '<mediawiki>' || chr(10) || '  ' UNION ALL SELECT 9223372036854775807, NULL, chr(10) || '</mediawiki>' || chr(10))"""
_SCAN = f"""{_DUMP} SELECT key, ns, CAST(coalesce(sum({_BYTES.format("text")}) OVER (ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
{_BYTES.format("text")} AS length, md5(text) AS text_md5 FROM p"""


def oracle_sql() -> dict[str, str]:
    leftmost = "SELECT key, source, ns, text FROM {} QUALIFY row_number() OVER (PARTITION BY key ORDER BY source) = 1"
    return {
        "ns_filter": f"WITH {_NEW} SELECT key, ns, text FROM new WHERE ns = 0",
        "last_revision": "SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
        "last_revision_text": f"WITH {_THREAD.format(comment=_COMMENT)} SELECT key, head || revs[-1] || '  </page>' AS text FROM t",
        "cut_meta": f"SELECT doc_id + 1 AS key, {_MARKUP}{_REST} AS text FROM documents",
        "cut_meta_all": "WITH " + _THREAD.format(comment="''") + " SELECT key, head || array_to_string(revs, '') || '  </page>' AS text FROM t",
        "cut_between": "SELECT page_id, CASE WHEN strpos(html, '<nav>') > 0 AND strpos(html, '</nav>') >= strpos(html, '<nav>') THEN substr(html, 1, strpos(html, '<nav>') - 1) || substr(html, strpos(html, '</nav>') + 6) ELSE html END AS html FROM pages",
        "peek_int": r"""SELECT page_id, CASE WHEN strpos(url, 'page=') > 0 THEN coalesce(TRY_CAST(nullif(regexp_extract(split_part(url, 'page=', 2), '^(\d+)', 1), '') AS BIGINT), -1) END AS page_no,
coalesce(TRY_CAST(nullif(regexp_extract(html, '^(\d+)', 1), '') AS BIGINT), -1) AS html_no FROM pages""",
        "page_fields": f"SELECT doc_id, doc_id + 1 AS key, {_NS} AS ns FROM documents",
        "merge_leftmost": f"WITH {_FOUR} " + leftmost.format("f"),
        "merge_namespace": f"WITH {_FOUR}, g AS (SELECT * FROM f WHERE ns = 2) " + leftmost.format("g"),
        "merge_monotonic": """WITH m AS (SELECT o_custkey AS key, o_orderkey AS start, max(o_custkey) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM orders)
SELECT key, start FROM m WHERE held IS NULL OR key > held""",
        "best_reference": f"{_BEST} SELECT key, {_POINTS} FROM b",
        "best_reference_strict": f"{_STRICT} SELECT key, {_POINTS} FROM b",
        "changed_pages": f"{_BEST} SELECT key, ns, text FROM b WHERE text IS DISTINCT FROM ref",
        "change_dump": f"{_BEST} SELECT key, text FROM b WHERE text IS DISTINCT FROM ref OR key = (SELECT max(key) FROM b)",
        "pack_unpack_roundtrip": f"WITH {_NEW} SELECT key, text FROM new",
        "pack_table": f"{_BEST} SELECT key AS ord, CAST(src AS BIGINT) AS source_number, CASE WHEN src > 0 THEN key ELSE 0 END AS start, coalesce({_BYTES.format('ref')}, 0) AS length, CAST({_FNV.format(t="coalesce(ref, '')")} AS BIGINT) AS src_cksum, CAST({_FNV.format(t='text')} AS BIGINT) AS out_cksum FROM b",
        "pack_file": f"WITH {_NEW} SELECT row_number() OVER (ORDER BY key) - 1 AS frame, text FROM new",
        "delta_functions": "SELECT page_id, html FROM pages",
        "delta_stats": f"WITH {_NEW} SELECT key, {_BYTES.format('text')} AS bytes FROM new",
        "fnv1a": f"SELECT doc_id, CAST({_FNV.format(t='text')} AS BIGINT) AS checksum FROM documents",
        "file_names": """SELECT page_id, split_part(url, '/', -1) AS base, regexp_replace(url || '.gz.bz2', '(\\.(lzo|gz|bz2|xz))+$', '') AS unzipped,
CASE length(url) % 3 WHEN 0 THEN 'bz2' WHEN 1 THEN 'gz' ELSE 'xz' END AS codec, regexp_full_match(split_part(url, '/', -1), '[-a-zA-Z0-9_.]*') AS safe FROM pages""",
        "size_guard": f"SELECT doc_id, CASE WHEN {_BYTES.format('text')} <= 1500 THEN md5(text) END AS text_md5 FROM documents",
        "cut_pipeline": f"{_DUMP.replace(_META, '')} SELECT key, text FROM p WHERE ns = 0 OR ns IS NULL",
        "daily_merge": f"WITH {_FOUR} " + leftmost.format("f"),
        "suffix_probing": _SCAN,
        "stdin_scan": _SCAN,
        "pack_files": _SCAN,
        "bz2_random_access": f"SELECT key, start, text_md5 FROM ({_SCAN})",
        "scan_to_any": f"""WITH m AS (SELECT * FROM (VALUES ('<h1>', 0), ('<p>', 1), ('</nav>', 2), ('é', 3)) v(mark, which)),
h AS (SELECT page_id, html, mark, which, strpos(html, mark) AS pos FROM pages, m WHERE strpos(html, mark) > 0),
f AS (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos, which) = 1)
SELECT p.page_id, coalesce({_BYTES.format("substr(f.html, 1, pos - 1)")} + {_BYTES.format("mark")}, -1) AS off, coalesce(which, -1) AS which FROM pages p LEFT JOIN f USING (page_id)""",
        "limited_scan": f"""WITH s AS (SELECT doc_id, CASE WHEN strpos(text, 'é') > 0 THEN {_BYTES.format("substr(text, 1, strpos(text, 'é') - 1)")} END AS reach, {_BYTES.format('text')} AS size FROM documents)
SELECT doc_id, CASE WHEN reach <= 40 THEN reach ELSE least(size, 40) END AS off, coalesce(reach <= 40, false) AS found FROM s""",
        "merge_files": f"""{_DUMP.replace("doc_id = (SELECT min(doc_id) FROM documents)", "doc_id = (SELECT min(doc_id) FROM documents) AND source = 'src7' OR doc_id = (SELECT min(doc_id) FROM documents WHERE source <> 'src7')")} SELECT key, md5(text) AS text_md5 FROM p""",
        "quarantine": f"WITH {_NEW} SELECT key AS ord, true AS src_ok, false AS out_ok, text FROM new WHERE key % 7 = 0",
        **{f"segment_scan_{c}": _SCAN for c in ("none", "gz", "bz2", "xz", "lzo")},
    }
