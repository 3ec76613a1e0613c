"""Media columns: TIFF and BigTIFF files to one row per page.

Every image directory of a file is walked in both byte orders; strips and tiles that are stored plain or
packed by PackBits, LZW or deflate are decoded, horizontal (2) and floating-point (3) predictors undone,
planes joined, and edge tiles cropped. Samples of 1, 2 and 4 bits are unpacked to a byte each; wider
samples come in little-endian order, rows top down, samples interleaved. Rows are decoded where they
lie: one map, no shuffle.

A page may take up to `MAX_PAGE_BYTES`, which is what one value of a binary column can hold.

Defined results: a null or empty value gives no row; a file whose header or directory chain cannot be
read gives its pages so far and then one row with `error`; a page that cannot be decoded keeps its
header fields, has null pixels and an `error`; a chain that comes back to a directory ends there with an
error; missing strips or short data are an error, surplus data is ignored; a tag whose type is not that of a
count, size, place or code counts as unreadable and makes an error of the page; a null key is carried as null;
repeated rows give their pages again; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
NAMES = {PLAIN: "none", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}
_TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
MAX_PAGE_BYTES = (1 << 31) - (1 << 16)
SCHEMA = "media_id long, page int, width int, height int, samples int, bits int, compression string, predictor int, tiled boolean, pixels binary, error string"


#: Tags that must be whole numbers: sizes, codes, places and counts.
_WHOLE = (256, 257, 258, 259, 266, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325)


class TiffError(ValueError):
    pass


def unpack_bits(raw: bytes) -> bytes:
    out, at, n = [], 0, len(raw)
    while at < n:
        c = raw[at]
        at += 1
        if c < 128:
            out.append(raw[at : at + c + 1])
            at += c + 1
        elif c > 128:
            out.append(raw[at : at + 1] * (257 - c))
            at += 1
    return b"".join(out)


def pack_bits(raw: bytes) -> bytes:
    a = np.frombuffer(raw, np.uint8)
    out, n = [], len(a)
    starts = np.concatenate([[0], np.flatnonzero(a[1:] != a[:-1]) + 1]) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([starts, [n]]))
    lit = 0
    for s, k in [(int(starts[i]), int(sizes[i])) for i in np.flatnonzero(sizes > 2)] + [(n, 0)]:
        while lit < s:
            m = min(128, s - lit)
            out += [bytes([m - 1]), raw[lit : lit + m]]
            lit += m
        while k:
            m = min(128, k)
            out += [bytes([257 - m & 255 if m > 1 else 0]), raw[s : s + 1]]
            s, k = s + m, k - m
        lit = s
    return b"".join(out)


def _lzw_widths() -> np.ndarray:
    """Bit places of the codes after a clear code: widths grow with the table, one code early."""
    size = np.arange(258, 258 + 4096)  # entries when the code is read; the first makes none
    size[1:] -= 1
    width = np.where(size < 511, 9, np.where(size < 1023, 10, np.where(size < 2047, 11, 12)))
    return np.concatenate([[0], np.cumsum(width)])


_LZW_AT = _lzw_widths()
_BYTES = [bytes([i]) for i in range(256)]


def _lzw_copied(codes: np.ndarray) -> bytes:
    """What the codes from one clear code to the next give; entry 258 + j is what code j gave and the byte after it."""
    n, literal, j = len(codes), codes < 256, codes - 258
    if (j >= np.arange(n)).any():
        raise TiffError("LZW code out of range" if n and literal[0] else "LZW stream does not begin with a literal")
    steps, back = (~literal).astype(np.int64), np.where(literal, np.arange(n), j)
    while steps[back].any():  # pointers doubled: how many copies a code is from its literal
        steps, back = steps + steps[back], back[back]
    at = np.concatenate([[0], np.cumsum(steps + 1)])
    if at[-1] > 64 * n:  # long copies are better made one by one
        out = bytearray()
        for i, code in enumerate(codes.tolist()):
            if code < 256:
                out.append(code)
            else:
                p, z = int(at[code - 258]), int(at[code - 257]) + 1
                out += out[p:z] if z <= len(out) else out[p : z - 1] + out[p : p + 1]
        return bytes(out)
    of = np.arange(at[-1]) - np.repeat(np.where(literal, 0, at[:-1] - at[np.where(literal, 0, j)]), steps + 1)
    while True:  # every byte back to the literal that it copies
        further = of[of]
        if (further == of).all():
            break
        of = further
    value = np.zeros(at[-1], np.uint8)
    value[at[:-1][literal]] = codes[literal]
    return value[of].tobytes()


def lzw_decode(raw: bytes) -> bytes:
    """Most significant bit first, codes of 9 to 12 bits that widen one code early.

    The codes from one clear code to the next are at known bit places, so they are read all at once. An entry of
    the table is what its code gave and one byte more: a code over 257 copies from the output so far.
    """
    data = np.frombuffer(raw + b"\0\0\0\0", np.uint8).astype(np.uint32)
    total, bit = 8 * len(raw), 0
    out = bytearray()
    while True:
        n = int(np.searchsorted(_LZW_AT, total - bit, "right")) - 1
        more = n == len(_LZW_AT) - 1  # a table that grows past its end goes on at 12 bits
        if more:
            n = max(n, (total - bit - int(_LZW_AT[-1])) // 12 + n)
        place = _LZW_AT[: n + 1] if not more else np.concatenate([_LZW_AT, _LZW_AT[-1] + 12 * np.arange(1, n - len(_LZW_AT) + 2)])
        at, width = place[:-1] + bit, np.diff(place)
        k = at >> 3
        word = (data[k] << 24) | (data[k + 1] << 16) | (data[k + 2] << 8) | data[k + 3]
        codes = (word << (at & 7).astype(np.uint32)) >> (32 - width).astype(np.uint32)
        ends = np.flatnonzero((codes == 256) | (codes == 257))
        stop = int(ends[0]) if len(ends) else n
        out += _lzw_copied(codes[:stop].astype(np.int64))
        if stop == n or codes[stop] == 257 or n == 0:
            return bytes(out)
        bit = int(place[stop + 1]) + bit


def lzw_encode(raw: bytes) -> bytes:
    codes: dict[int, int] = {}
    nxt, width, held, bits = 258, 9, 256, 9
    out = bytearray()
    prefix = -1
    for byte in raw:
        if prefix < 0:
            prefix = byte
            continue
        key = prefix << 8 | byte
        code = codes.get(key)
        if code is not None:
            prefix = code
            continue
        held = held << width | prefix
        bits += width
        codes[key] = nxt
        nxt += 1
        prefix = byte
        if nxt == 4094:
            held, bits = held << width | 256, bits + width
            codes, nxt, width = {}, 258, 9
        elif nxt > (1 << width) - 1:
            width += 1
        if bits >= 512:
            rest = bits & 7
            out += (held >> rest).to_bytes(bits >> 3, "big")
            held &= (1 << rest) - 1
            bits = rest
    if prefix >= 0:
        held, bits = held << width | prefix, bits + width
        nxt += 1
        if nxt > (1 << width) - 1 and width < 12:
            width += 1
    held, bits = held << width | 257, bits + width
    pad = -bits % 8
    return bytes(out + (held << pad).to_bytes((bits + pad) // 8, "big"))


def inflate(raw: bytes, need: int) -> bytes:
    """The first `need` bytes; what comes after them is not unpacked."""
    try:
        return zlib.decompressobj().decompress(raw, max(1, need))
    except zlib.error as e:
        raise TiffError(f"deflate: {e}") from None


def _decode(raw: bytes, compression: int, need: int) -> bytes:
    if compression == PLAIN:
        return raw
    if compression == PACKBITS:
        return unpack_bits(raw)
    if compression == LZW:
        return lzw_decode(raw)
    if compression in (DEFLATE, OLD_DEFLATE):
        return inflate(raw, need)
    raise TiffError(f"compression {compression} is not supported")


def _samples(raw: bytes, rows: int, cols: int, spp: int, bits: int, order: str, predictor: int) -> np.ndarray:
    """rows x cols x spp x bytes of a sample, little-endian."""
    line = (cols * spp * bits + 7) // 8
    if len(raw) < rows * line:
        raise TiffError(f"{len(raw)} bytes of {rows * line}")
    a = np.frombuffer(raw, np.uint8, rows * line).reshape(rows, line)
    if bits < 8:
        if predictor != 1:
            raise TiffError("predictor with samples under 8 bits")
        u = np.unpackbits(a, axis=1)[:, : cols * spp * bits].reshape(rows, cols, spp, bits)
        return (u << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(-1, dtype=np.uint8)[..., None]
    wide = bits // 8
    if predictor == 3:
        a = np.cumsum(a.reshape(rows, -1, spp), axis=1, dtype=np.uint8).reshape(rows, wide, cols, spp)
        return np.ascontiguousarray(a[:, ::-1].transpose(0, 2, 3, 1))  # planes of bytes, most significant first
    v = a.view(np.dtype(f"{order}u{wide}")).reshape(rows, cols, spp).astype(f"<u{wide}")
    if predictor == 2:
        v = np.cumsum(v, axis=1, dtype=f"<u{wide}")
    elif predictor != 1:
        raise TiffError(f"predictor {predictor} is not supported")
    return np.ascontiguousarray(v).view(np.uint8).reshape(rows, cols, spp, wide)


def directories(raw: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and tags of each image directory."""
    order = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if not order or len(raw) < 8:
        raise TiffError("not a TIFF file")
    (version,) = struct.unpack_from(order + "H", raw, 2)
    if version == 42:
        count, entry, word, inline, (at,) = "H", 12, "I", 4, struct.unpack_from(order + "I", raw, 4)
    elif version == 43 and len(raw) >= 16:
        count, entry, word, inline, (at,) = "Q", 20, "Q", 8, struct.unpack_from(order + "Q", raw, 8)
    else:
        raise TiffError(f"version {version}")
    seen: set[int] = set()
    while at:
        if at in seen:
            raise TiffError("the directory chain is a loop")
        seen.add(at)
        try:
            (n,) = struct.unpack_from(order + count, raw, at)
            at += struct.calcsize(order + count)
            tags = {}
            for k in range(n):
                tag, kind = struct.unpack_from(order + "HH", raw, at + k * entry)
                (m,) = struct.unpack_from(order + word, raw, at + k * entry + 4)
                code = _TYPES.get(kind)
                if not code:
                    continue
                size = struct.calcsize(order + code) * m
                where = at + k * entry + 4 + struct.calcsize(order + word)
                if size > inline:
                    (where,) = struct.unpack_from(order + word, raw, where)
                if where + size > len(raw):
                    raise TiffError(f"tag {tag} lies outside the file")
                tags[tag] = struct.unpack_from(f"{order}{m}{code}", raw, where)
            (nxt,) = struct.unpack_from(order + word, raw, at + n * entry)
        except (struct.error, OverflowError):
            raise TiffError("a directory lies outside the file") from None
        yield order, tags
        at = nxt


def page_of(raw: bytes, order: str, tags: dict[int, tuple]) -> dict:
    """The fields of one page."""
    wrong = [t for t in _WHOLE if any(type(v) is not int or v < 0 for v in tags.get(t, ()))]
    tags = {t: v for t, v in tags.items() if t not in wrong}
    one = lambda tag, default: (tags.get(tag) or (default,))[0]
    page = {"width": one(256, None), "height": one(257, None), "samples": one(277, 1), "bits": one(258, 1), "compression": NAMES.get(one(259, 1), str(one(259, 1))), "predictor": one(317, 1), "tiled": 322 in tags, "pixels": None, "error": None}
    page |= {k: None for k in ("width", "height", "samples", "bits", "predictor") if page[k] is not None and page[k] >= 1 << 31}
    try:
        w, h, spp, bits = page["width"], page["height"], page["samples"], page["bits"]
        if wrong:
            raise TiffError(f"tag {wrong[0]} is not a whole number")
        if not w or not h or not spp:
            raise TiffError("no size")
        if len(set(tags.get(258, (bits,)))) > 1 or bits not in (1, 2, 4, 8, 16, 32, 64):
            raise TiffError(f"bits {tags.get(258)}")
        planes = spp if one(284, 1) == 2 and spp > 1 else 1
        per = spp // planes
        if w * h * spp * max(1, bits // 8) > MAX_PAGE_BYTES:
            raise TiffError("page over the size of a value")
        if page["tiled"]:
            bw, bh, at, size = one(322, 0), one(323, 0), tags.get(324, ()), tags.get(325, ())
        else:
            bw, bh, at, size = w, min(one(278, h), h), tags.get(273, ()), tags.get(279, ())
        if not bw or not bh:
            raise TiffError("no block size")
        across, down = -(-w // bw), -(-h // bh)
        if len(at) < across * down * planes or len(size) < len(at):
            raise TiffError("blocks are missing")
        line = (bw * per * bits + 7) // 8
        if line * bh > MAX_PAGE_BYTES:
            raise TiffError("block over the size of a value")
        out = None
        for p in range(planes):
            for k in range(across * down):
                i = p * across * down + k
                block = raw[at[i] : at[i] + size[i]]
                if len(block) < size[i]:
                    raise TiffError("a block lies outside the file")
                if one(266, 1) == 2:
                    block = np.packbits(np.unpackbits(np.frombuffer(block, np.uint8), bitorder="little")).tobytes()
                y, x = k // across * bh, k % across * bw
                rows = bh if page["tiled"] else min(bh, h - y)
                a = _samples(_decode(block, one(259, 1), rows * line), rows, bw, per, bits, order, one(317, 1))
                if out is None:  # not before there is data: a size alone takes no memory
                    out = np.zeros((h, w, spp, max(1, bits // 8)), np.uint8)
                out[y : y + bh, x : x + bw, p * per : (p + 1) * per] = a[: h - y, : w - x]
        page["pixels"] = out.tobytes()
    except (TiffError, ValueError, struct.error) as e:
        page["error"] = str(e)
    return page


def pages_of(raw: bytes) -> Iterator[dict]:
    """One dict for each page, and one with only an error where the walk broke off."""
    try:
        for order, tags in directories(raw):
            yield page_of(raw, order, tags)
    except TiffError as e:
        yield {"error": str(e)}


def write_tiff(pages: list[dict], order: str = "<") -> bytes:
    """A TIFF file of pages given as data (bytes, 8-bit samples), width, height, samples, compression, predictor and rows or tile."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for p in pages:
        w, h, spp, comp, pred = p["width"], p["height"], p.get("samples", 1), p.get("compression", PLAIN), p.get("predictor", 1)
        a = np.frombuffer(p["data"], np.uint8).reshape(h, w, spp)
        blocks = []
        if tile := p.get("tile"):
            for y in range(0, h, tile):
                for x in range(0, w, tile):
                    b = np.zeros((tile, tile, spp), np.uint8)
                    part = a[y : y + tile, x : x + tile]
                    b[: part.shape[0], : part.shape[1]] = part
                    blocks.append(b)
        else:
            rows = p.get("rows", h)
            blocks = [a[y : y + rows] for y in range(0, h, rows)]
        at, size = [], []
        for b in blocks:
            if pred == 2:
                b = np.concatenate([b[:, :1], b[:, 1:] - b[:, :-1]], axis=1)
            raw = {PLAIN: lambda x: x, LZW: lzw_encode, DEFLATE: zlib.compress, OLD_DEFLATE: zlib.compress}.get(comp, lambda x: b"".join(pack_bits(r.tobytes()) for r in b))(b.tobytes())  # noqa: B023
            at.append(len(out))
            size.append(len(raw))
            out += raw + b"\0" * (len(raw) & 1)
        tags = {256: (4, [w]), 257: (4, [h]), 258: (3, [8] * spp), 259: (3, [comp]), 262: (3, [2 if spp == 3 else 1]), 277: (3, [spp]), 284: (3, [1]), 317: (3, [pred])}
        tags |= {322: (3, [tile]), 323: (3, [tile]), 324: (4, at), 325: (4, size)} if tile else {273: (4, at), 278: (4, [rows]), 279: (4, size)}
        fields = b""
        for tag, (kind, values) in sorted(tags.items()):
            body = struct.pack(f"{order}{len(values)}{_TYPES[kind]}", *values)
            if len(body) > 4:
                where = len(out)
                out += body + b"\0" * (len(body) & 1)
                body = struct.pack(order + "I", where)
            fields += struct.pack(order + "HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + fields
        link = len(out)
        out += struct.pack(order + "I", 0)
    return bytes(out)


def decode_column(media: DataFrame, key: str = "media_id", column: str = "tiff") -> DataFrame:
    """(media_id, page, width, height, samples, bits, compression, predictor, tiled, pixels, error) of every page of every file."""
    fields = [f.split()[0] for f in SCHEMA.split(", ")][2:]
    types = [pa.int32()] * 4 + [pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            held = 0
            for k, raw in zip(b.column(0).to_pylist(), b.column(1)):
                raw = raw.as_py()
                for n, page in enumerate(pages_of(raw) if raw else ()):
                    rows.append((k, n, *(page.get(f) for f in fields)))
                    held += len(page.get("pixels") or b"")
                if held > 1 << 24:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64(), pa.int32(), *types])], names=["media_id", "page", *fields])

    return media.select(F.col(key).cast("long").alias("media_id"), F.col(column).cast("binary").alias("tiff")).mapInArrow(run, SCHEMA)


def tiff_of_pages(pages: DataFrame) -> DataFrame:
    """(media_id, tiff): each web page as a two-page TIFF, its html and its url as rows of grey pixels.

    The data has no images, so this makes the media column: the storage (PackBits, LZW, deflate, plain;
    strips, tiles; predictor; byte order) goes round by page_id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                made = []
                for k, url, html in zip(*(part.column(i).to_pylist() for i in range(3))):
                    ways = []
                    for raw, width, n in ((html, 64, k or 0), (url, 16, (k or 0) + 1)):
                        raw = (raw or "").encode()
                        height = max(1, -(-len(raw) // width))
                        comp = (PACKBITS, LZW, DEFLATE, PLAIN)[n % 4]
                        ways.append({"data": raw.ljust(width * height, b"\0"), "width": width, "height": height, "compression": comp, "predictor": 2 if comp in (LZW, DEFLATE) and n // 4 % 2 else 1, "rows": 128} | ({"tile": 64} if n % 3 == 0 else {}))
                    made.append(write_tiff(ways, "<>"[(k or 0) % 2]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.binary())], names=["media_id", "tiff"])

    return pages.select(F.col("page_id").cast("long").alias("media_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(run, "media_id long, tiff binary")
