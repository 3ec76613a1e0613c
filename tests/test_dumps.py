from __future__ import annotations

import bz2
import functools
import gzip
import http.server
import io
import os
import lzma
import threading

import pytest
from pyspark.sql import functions as F

from palimpsest import __main__ as cli
from palimpsest.functions import names
from palimpsest.functions import text as tx
from palimpsest.operators.cut import cut
from palimpsest.plans import dumps
from palimpsest.schema import PREAMBLE, TRAILER
from palimpsest.sources import container, dump, lzo, sinks


def page(key, ns=0, revisions=("one",), lead="\n  "):
    revs = "".join(f"    <revision>\n      <id>9{k}</id>\n      <contributor>\n        <username>u</username>\n      </contributor>\n      <minor />\n      <comment>c</comment>\n      <text>{r}</text>\n    </revision>\n" for k, r in enumerate(revisions))
    return f"{lead}<page>\n    <title>t{key}</title>\n    <ns>{ns}</ns>\n    <id>{key}</id>\n{revs}  </page>"


def whole(*pages, tail="\n</mediawiki>\n"):
    return "<mediawiki>\n  " + "".join(pages).removeprefix("\n  ") + tail


def read(spark, path, **kw):
    return [(r.key, r.ns, r.text, r.start, r.length) for r in dump.read_dump(spark, str(path), **kw).orderBy("start", "length").collect()]


PACK = {"": lambda b: b, ".gz": gzip.compress, ".bz2": lambda b: bz2.compress(b[:3000]) + bz2.compress(b[3000:]), ".xz": lzma.compress, ".lzo": lzo.compress}


@pytest.mark.parametrize("suffix", PACK)
@pytest.mark.parametrize("tail", ["\n</mediawiki>\n", "", "\n  <page>\n    <id>77</id>\n    <rev"])
def test_scan_gives_every_byte_back(spark, tmp_path, suffix, tail):
    text = whole(*(page(k, k % 3, ("é" * k, "b\r\n")) for k in range(1, 60)), tail=tail)
    path = tmp_path / f"d.xml{suffix}"
    path.write_bytes(PACK[suffix](text.encode()))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = read(spark, tmp_path / "d.xml")  # the suffix is found
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert "".join(r[2] for r in rows) == text
    last = 77 if "page" in tail else TRAILER
    assert [r[0] for r in rows] == [PREAMBLE, *range(1, 60), last]
    assert [r[1] for r in rows[1:60]] == [k % 3 for k in range(1, 60)]
    raw = text.encode()
    assert all(raw[s : s + n] == t.encode() for _, _, t, s, n in rows)


@pytest.mark.parametrize("text,keys", [("", [0]), ("no pages", [0]), ("<page><id>5</id></page>", [0, 5, TRAILER]), ("<page></page>x", [0, -1, TRAILER]), ("<page><id>x</id><ns>-2</ns></page>", [0, -1, TRAILER]), ("a<page><id>3", [0, 3])])
@pytest.mark.parametrize("suffix", PACK)
def test_scan_of_odd_files(spark, tmp_path, text, keys, suffix):
    p = tmp_path / f"odd.xml{suffix}"
    p.write_bytes(PACK[suffix](text.encode()))
    rows = read(spark, p)
    assert [r[0] for r in rows] == keys and "".join(r[2] for r in rows) == text


def test_bytes_that_are_no_utf8_stay(spark, tmp_path):
    raw = b"<m>\n  <page><id>1</id>\xff\xfe\x80</page>\n</m>"
    (tmp_path / "b.xml").write_bytes(raw)
    sinks.write_dump(dump.read_dump(spark, str(tmp_path / "b.xml")), str(tmp_path / "c.xml"))
    assert (tmp_path / "c.xml").read_bytes() == raw


def test_missing_and_unreadable_sources(spark, tmp_path):
    with pytest.raises(dump.SourceError):
        dump.resolve(spark, str(tmp_path / "none.xml"))
    (tmp_path / "x.xml.gz").write_bytes(b"")
    (tmp_path / "x.xml.lzo").write_bytes(b"no lzop file")
    assert dump.resolve(spark, str(tmp_path / "x.xml")) == str(tmp_path / "x.xml.lzo")  # the first suffix in order
    with pytest.raises(Exception, match="not an lzop file"):
        dump.read_dump(spark, str(tmp_path / "x.xml"))


def test_http_source(spark, tmp_path):
    (tmp_path / "www").mkdir()
    text = whole(page(1), page(2))
    (tmp_path / "www/d.xml.gz").write_bytes(gzip.compress(text.encode()))
    handler = functools.partial(http.server.SimpleHTTPRequestHandler, directory=str(tmp_path / "www"))
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}"
        assert "".join(r[2] for r in read(spark, f"{url}/d.xml.gz")) == text
        with pytest.raises(Exception):
            dump.fetch(spark, [f"{url}/none.xml"])
        with pytest.raises(dump.SourceError):
            dump.fetch(spark, [f"{url}/"])
        with pytest.raises(dump.SourceError):
            dump.fetch(spark, ["https://127.0.0.1/d.xml"])
    finally:
        server.shutdown()


def test_typed_pages(spark, tmp_path):
    (tmp_path / "d.xml").write_text(whole(page(4, 1, ("a &lt; b", "c"))))
    (r,) = dump.read_pages(spark, str(tmp_path / "d.xml")).collect()
    assert (r.id, r.ns, r.title, [v.text._VALUE for v in r.revision]) == (4, 1, "t4", ["a < b", "c"])


def model_cut_between(t, start, end):
    s, e = t.find(start), t.find(end)
    return t[:s] + t[e + len(end) :] if s >= 0 and e >= s else t


def test_cut_functions_against_a_model(spark):
    import random

    r = random.Random(5)
    bits = ["      <comment>", "</comment>\n", "      <contributor>", "      </contributor>\n", "      <minor />\n", "<text", "<revision>", "é", "xy\n"]
    texts = ["".join(r.choices(bits, k=r.randrange(14))) for _ in range(1500)] + ["", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", tx.cut_meta(F.col("t")).alias("m"), tx.last_revision(F.col("t")).alias("v")).collect()
    for row in got:
        if row.t is None:
            assert row.m is None and row.v is None
            continue
        head, mark, rest = row.t.partition("<text")
        for s, e in tx.META if mark else ():
            head = model_cut_between(head, s, e)
        assert row.m == head + mark + rest
        parts = row.t.split("<revision>")
        assert row.v == (parts[0] + "<revision>" + parts[-1] if len(parts) > 1 else row.t)


def test_peek_int_and_ns(spark):
    df = spark.createDataFrame([("12x",), ("x",), ("",), ("9" * 30,), (None,), ("-3",)], "t string")
    assert [r[0] for r in df.select(tx.peek_int(F.col("t"))).collect()] == [12, -1, -1, -1, None, -1]
    ns = spark.createDataFrame([("<ns>-2</ns><ns>4</ns>",), ("none",)], "t string").select(tx.page_ns(F.col("t"))).collect()
    assert [r[0] for r in ns] == [-2, None]


def test_cut_plan(spark, tmp_path):
    (tmp_path / "d.xml").write_text(whole(page(1, 0, ("a", "b", "c")), page(2, 1), page(3, 0, ())))
    rows = dumps.cut_dump(spark, str(tmp_path / "d.xml"), lastrev=True, ns=0, cutmeta=True).orderBy("key").collect()
    assert [r.key for r in rows] == [0, 1, 3, TRAILER]
    assert rows[1].text.count("<revision>") == 1 and "<text>c</text>" in rows[1].text and "username" not in rows[1].text
    assert rows[1].source == -3 and rows[2].text == page(3, 0, ())
    with pytest.raises(ValueError):
        dumps.cut_dump(spark, str(tmp_path / "d.xml"))
    strict = dumps.cut_dump(spark, str(tmp_path / "d.xml"), ns=1, strict=True)
    assert [r.key for r in strict.orderBy("key").collect()] == [0, 2]
    everywhere = cut(dump.read_dump(spark, str(tmp_path / "d.xml")), cutmeta=True, all_revisions=True)
    assert everywhere.filter("text like '%<comment>%'").count() == 0


def test_names():
    assert names.unzipped("a.xml.gz.bz2") == "a.xml" and names.unzipped("a.gz.xml") == "a.gz.xml"
    assert names.canonical("bzip2") == "bz2" and names.canonical("xz") == "xz"
    assert names.is_known("lzo") and not names.is_known("zip")
    assert names.basename("http://h/x/y.xml") == "y.xml" and names.basename(r"c:\d\e.xml") == "e.xml"
    assert names.is_safe("a-b_c.1") and not names.is_safe("a/b") and not names.is_safe("a\n")
    assert names.codec_of("gz") == "" and names.codec_of("a.xz") == "xz"


@pytest.mark.parametrize("codec", ["none", "gzip", "bz2", "xz", "lzo"])
def test_pack_and_unpack_files(spark, tmp_path, codec):
    old = whole(page(1, revisions=("alpha " * 50,)), page(2), page(4))
    new = whole(page(1, revisions=("alpha " * 50 + "omega",)), page(2), page(3), page(4), tail="\n</mediawiki> new\n")
    (tmp_path / "new.xml").write_text(new)
    (tmp_path / "ref.xml.bz2").write_bytes(bz2.compress(old.encode()))
    out = dumps.pack_dump(spark, [str(tmp_path / "new.xml"), str(tmp_path / "ref.xml.bz2")], compression=codec)
    rows, name = dumps.unpack_dump(spark, out)
    assert name == str(tmp_path / "new.xml")
    buffer = io.BytesIO()
    sinks.stream_dump(rows, buffer)
    assert buffer.getvalue().decode() == new
    few, _ = dumps.unpack_dump(spark, out, changed_only=True)
    assert "".join(r.text for r in few.orderBy("key").collect()) == "<mediawiki>\n  " + page(1, revisions=("alpha " * 50 + "omega",), lead="") + page(3) + "\n</mediawiki> new\n"


def test_a_wrong_reference_is_found(spark, tmp_path):
    (tmp_path / "new.xml").write_text(whole(page(1, revisions=("a" * 100,))))
    (tmp_path / "ref.xml").write_text(whole(page(1, revisions=("a" * 99 + "b",))))
    out = dumps.pack_dump(spark, [str(tmp_path / "new.xml"), str(tmp_path / "ref.xml")], compression="none")
    (tmp_path / "ref.xml").write_text(whole(page(1, revisions=("a" * 50 + "c" + "a" * 48 + "b",))))
    with pytest.raises(Exception, match="not the one that was packed against"):
        dumps.unpack_dump(spark, out)[0].collect()
    from palimpsest.operators.pack import quarantined

    refs = [dump.read_dump(spark, str(tmp_path / "ref.xml"), 1)]
    assert [r.ord for r in quarantined(container.read_pack(spark, out), refs).collect()] == [1]


def test_container_format():
    head = container.header(["x/new.xml.bz2", "ref.xml"])
    assert container.read_header(io.BytesIO(head)) == ["new.xml", "ref.xml"]
    other = container.header(["a", "b"], magic="Other", address="http://v2")
    for raw, said in ((other, "first line"), (container.header(["a", "b"], address="http://v2"), "newer format"), (head[:-1], "cut short"), (head.replace(b"ref.xml", b"../etc"), "unsafe")):
        with pytest.raises(container.PackError, match=said):
            container.read_header(io.BytesIO(raw))
    assert container.read_header(io.BytesIO(other), "Other", "http://v2") == ["a", "b"]
    one = container.frame(1, 37, 44, 7, b"\x57\x00\x00", 9)
    assert one[:3].hex() == "02252c" and container.frame(-1, 0, 0, 0, b"\0", 0)[:3].hex() == "010000"
    assert list(container.frames(io.BytesIO(one * 2 + b"\0\0\0"))) == [(1, 37, 44, 7, b"\x57\x00\x00", 9)] * 2
    for raw in (one, one[:-3], b"\x03\0\0"):
        with pytest.raises(container.PackError):
            list(container.frames(io.BytesIO(raw)))
    with pytest.raises(container.PackError):
        container.header(["one"])


def test_paths_that_no_node_mounts(spark):
    with pytest.raises(ValueError, match="mounted"):
        sinks.write_dump(spark.createDataFrame([], "key long, text string"), "hdfs://somewhere/x.xml")


def test_scans_in_a_text(spark):
    rows = [("abcéXdef",), ("",), (None,), ("X",), ("éé",), ("YX" * 40_000,)]
    got = spark.createDataFrame(rows, "t string").select(tx.scan_to_any(F.col("t"), ["Y", "X"]).alias("a"), tx.scan_to_any(F.col("t"), ["d", "X"], True).alias("b"), tx.limited_scan(F.col("t"), "X", 5).alias("c"), tx.limited_scan(F.col("t"), "X", 5, True).alias("d")).collect()
    assert [r.a and tuple(r.a) for r in got] == [(5, 1), (-1, -1), None, (0, 1), (-1, -1), (0, 0)]
    assert [r.b and tuple(r.b) for r in got] == [(6, 1), (-1, -1), None, (1, 1), (-1, -1), (2, 1)]
    assert [r.c and tuple(r.c) for r in got] == [(5, True), (0, False), None, (0, True), (4, False), (1, True)]
    assert [r.d and tuple(r.d) for r in got] == [(5, False), (0, False), None, (1, True), (4, False), (2, True)]


def test_one_scan_of_a_packed_file(spark, tmp_path):
    path = tmp_path / "x.xml.bz2"
    path.write_bytes(bz2.compress(whole(page(1), page(2)).encode()))
    plan = dump.read_dump(spark, str(path))._jdf.queryExecution().toString()
    assert "x.xml.bz2" not in plan  # it was read and stored; what is left reads Parquet
    (tmp_path / "y.xml").write_text(whole(page(1), page(2)))
    plan = dump.read_dump(spark, str(tmp_path / "y.xml"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan text") == 1


def test_command_line(spark, tmp_path, monkeypatch):
    a, b = whole(page(1), page(3)), whole(page(1, revisions=("older",)), page(2))
    (tmp_path / "a.xml").write_text(a)
    (tmp_path / "b.xml").write_text(b)
    out = tmp_path / "m.xml"
    assert cli.main(["merge", str(tmp_path / "a.xml"), str(tmp_path / "b.xml"), "--out", str(out)]) == 0
    assert out.read_text() == whole(page(1), page(2), page(3))
    assert cli.main(["cut", str(tmp_path / "a.xml"), "--ns", "7", "--out", str(out)]) == 0
    assert out.read_text() == "<mediawiki>\n  \n</mediawiki>\n"
    assert cli.main(["pack", str(tmp_path / "a.xml"), str(tmp_path / "b.xml"), "--zip", "gz"]) == 0
    assert cli.main(["unpack", str(tmp_path / "a.xml.pack.gz"), "--out", str(out)]) == 0
    assert out.read_text() == a
    # a pack file is unpacked to the dump it names, standard input to standard output, unless it is told otherwise
    (tmp_path / "a.xml").unlink()
    assert cli.main(["unpack", str(tmp_path / "a.xml.pack.gz"), "--debug"]) == 0
    assert (tmp_path / "a.xml").read_text() == a
    said = io.BytesIO()
    monkeypatch.setattr(cli.sys, "stdout", io.TextIOWrapper(said))
    assert cli.main(["unpack", "-c", str(tmp_path / "a.xml.pack.gz"), "--cpuprofile", str(tmp_path / "profile")]) == 0
    assert said.getvalue().decode() == a and os.path.isdir(tmp_path / "profile")
    spark.conf.unset("spark.sql.pyspark.udf.profiler")
    with pytest.raises(SystemExit):
        cli.main(["pack", str(tmp_path / "a.xml"), "--zip", "zip"])
    assert cli.main(["pack", str(tmp_path / "a.xml"), str(tmp_path / "b.xml"), "--zip", "lzo"]) == 0
    assert cli.main(["unpack", str(tmp_path / "a.xml.pack.lzo"), "--out", str(out)]) == 0 and out.read_text() == a
