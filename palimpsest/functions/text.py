"""Column functions over page markup. All of them are built-in expressions, so they stay inside generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import MAX_SOURCE_BYTES, PREAMBLE, TRAILER

REVISION = "<revision>"
#: (start, end) of the parts of a revision that cut_meta removes, in this order
META = (
    ("      <comment>", "</comment>\n"),
    ("      <contributor>", "      </contributor>\n"),
    ("      <minor />\n", "      <minor />\n"),
)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used: nested uses would multiply the expression."""
    return F.element_at(F.transform(F.array(value), use), 1)


def peek_int(text: Column) -> Column:
    """The unsigned decimal that a text begins with, -1 if there is none or if it exceeds 64 bits; null for null."""
    digits = F.regexp_extract(text, r"^(\d+)", 1)
    return F.when(text.isNotNull(), F.coalesce(digits.try_cast("bigint"), F.lit(-1).cast("bigint")))


def after(text: Column, mark: str) -> Column:
    """What follows the first occurrence of a mark; null if there is none."""
    at = F.instr(text, mark)
    return F.when(at > 0, F.substring(text, at + len(mark), F.length(text)))


def _bytes_before(text: Column, at: Column) -> Column:
    return F.octet_length(F.substring(text, F.lit(1), at - 1)).cast("bigint")


def scan_to_any(text: Column, marks: list[str], inclusive: bool = False) -> Column:
    """(off, which): the byte offset of the earliest of several marks, or behind it, and its place in the list; of marks that begin together the first; -1 and -1 if there is none."""
    found = F.array_min(F.filter(F.array(*(F.struct(F.instr(text, m).alias("at"), F.lit(k).alias("which"), F.lit(len(m.encode())).alias("size")) for k, m in enumerate(marks))), lambda s: s["at"] > 0))
    return bound(
        found,
        lambda s: F.when(text.isNull(), F.lit(None)).otherwise(
            F.struct(F.coalesce(_bytes_before(text, s["at"]) + (s["size"] if inclusive else 0), F.lit(-1)).cast("bigint").alias("off"), F.coalesce(s["which"], F.lit(-1)).alias("which"))
        ),
    )


def limited_scan(text: Column, mark: str, most: int, inclusive: bool = False) -> Column:
    """(off, found): how many bytes a scan to a mark goes that may not go further than `most`; found if it ends at the mark."""
    size = len(mark.encode()) if inclusive else 0
    reach = F.when(F.instr(text, mark) > 0, _bytes_before(text, F.instr(text, mark)) + size)
    return bound(
        reach,
        lambda r: F.when(text.isNotNull(), F.struct(F.coalesce(F.when(r <= most, r), F.least(F.octet_length(text), F.lit(most))).cast("bigint").alias("off"), F.coalesce(r <= most, F.lit(False)).alias("found"))),
    )


def page_key(text: Column) -> Column:
    """The page's number: the first <id>, which precedes those of its revisions; -1 if it has none."""
    return F.coalesce(peek_int(after(text, "<id>")), F.lit(-1).cast("bigint"))


def page_ns(text: Column) -> Column:
    """The page's namespace, sign included; null if it has none."""
    return F.regexp_extract(text, r"<ns>(-?\d+)", 1).try_cast("int")


def is_page(key: Column) -> Column:
    return ~key.isin(PREAMBLE, TRAILER)


def in_namespace(key: Column, ns: Column, wanted: int) -> Column:
    """Pages of one namespace, and the rows that are not pages."""
    return F.coalesce(ns == wanted, F.lit(False)) | ~is_page(key)


def last_revision(text: Column) -> Column:
    """The page's head up to its first revision, then its last revision by position; as it is if it has none."""
    newest = F.concat(F.substring_index(text, REVISION, 1), F.lit(REVISION), F.substring_index(text, REVISION, -1))
    return F.when(F.contains(text, F.lit(REVISION)), newest).otherwise(text)


def cut_between(text: Column, start: str, end: str) -> Column:
    """Without the part from the first start mark through the first end mark, unless the end mark comes first."""

    def one(t: Column) -> Column:
        s, e = F.instr(t, start), F.instr(t, end)
        rest = F.substring(t, e + len(end), F.length(t))
        return F.when((s > 0) & (e >= s), F.concat(F.substring(t, F.lit(1), s - 1), rest)).otherwise(t)

    return bound(text, one)


def cut_meta(text: Column) -> Column:
    """Without the comment, contributor and minor mark that precede the first <text."""

    def one(t: Column) -> Column:
        at = F.instr(t, "<text")
        head = F.substring(t, F.lit(1), at - 1)
        for start, end in META:
            head = cut_between(head, start, end)
        return F.when(at > 0, F.concat(head, F.substring(t, at, F.length(t)))).otherwise(t)

    return bound(text, one)


def cut_meta_everywhere(text: Column) -> Column:
    """cut_meta of each revision on its own."""
    parts = F.split(text, REVISION)
    return F.array_join(F.transform(parts, cut_meta), REVISION)


def usable_source(text: Column, most: int = MAX_SOURCE_BYTES) -> Column:
    """A source text, null if it is longer than a delta may refer to."""
    return F.when(F.octet_length(text) <= most, text)


def changed(key: Column, text: Column, source_text: Column) -> Column:
    """True for pages whose text is not that of their source, and for rows that are not pages."""
    return ~text.eqNullSafe(source_text) | ~is_page(key)
