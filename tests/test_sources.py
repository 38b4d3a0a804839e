import json
import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from cairn.operators import fulltext, scan
from cairn.plans.policy import ExcludePolicy, Marker, TextPolicy, ignore_patterns, journal_probe, missing_prefixes, source_for
from cairn.sources import documents, fs, shared
from cairn.sources.pdf import Pdf, PdfError, text_string
from cairn.sources.store import Conflict, Store, behind
from cairn.streaming import changes

CMAP = b"""begincmap 1 begincodespacerange <0000> <ffff> endcodespacerange
2 beginbfchar <0001> <0048> <0002> <00690021> endbfchar
1 beginbfrange <0003> <0005> <65E5> endbfrange endcmap"""


def _pdf(packed=False):
    """Two pages: Windows Latin text with kerning, and a font with its own map; with objects in an object stream if packed."""
    stream = lambda body, more=b"": b"<< /Length %d /Filter /FlateDecode %s >> stream\n%s\nendstream" % (len(zlib.compress(body)), more, zlib.compress(body))
    one = b"BT /F1 12 Tf 10 10 Td (Hello \\(old\\) ) Tj [(wor) -20 (ld) -400 (again)] TJ 0 -14 Td (caf\\351) Tj ET"
    two = b"BT /F2 9 Tf <000100020003> Tj T* <0005> Tj ET"
    plain = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /Resources << /Font << /F1 7 0 R /F2 8 0 R >> >> >>",
        3: b"<< /Type /Page /Parent 2 0 R /Contents 5 0 R >>", 4: b"<< /Type /Page /Parent 2 0 R /Contents [6 0 R] >>", 7: b"<< /Type /Font /Subtype /Type1 >>",
        8: b"<< /Type /Font /ToUnicode 9 0 R >>", 10: b"<< /Title <FEFF65E5672C> /Author (A \\\n Writer) /CreationDate (D:20240315101010Z) >>",
    }
    streams = {5: stream(one), 6: stream(two), 9: stream(CMAP)}
    out = b"%PDF-1.7\n"
    if packed:
        bodies = [plain[k] for k in sorted(plain)]
        at = [sum(len(b) + 1 for b in bodies[:i]) for i in range(len(bodies))]
        head = b" ".join(b"%d %d" % (k, a) for k, a in zip(sorted(plain), at, strict=True)) + b" "
        streams[11] = stream(head + b" ".join(bodies), b"/Type /ObjStm /N %d /First %d" % (len(plain), len(head)))
        streams[12] = stream(b"", b"/Type /XRef /Root 1 0 R /Info 10 0 R")
    else:
        streams |= plain
    for k, body in streams.items():
        out += b"%d 0 obj\n%s\nendobj\n" % (k, body)
    return out + (b"%%EOF" if packed else b"trailer << /Root 1 0 R /Info 10 0 R >>\n%%EOF")


@pytest.mark.parametrize("packed", [False, True])
def test_pdf(packed):
    p = Pdf(_pdf(packed))
    assert p.text() == "Hello (old) world again\ncafé\nHi!日\n\u65e7"
    assert p.info() == {"Title": "日本", "Author": "A  Writer", "CreationDate": "D:20240315101010Z"}


def test_pdf_that_cannot_be_read():
    for bad in (b"", b"nothing", _pdf().replace(b"trailer <<", b"trailer << /Encrypt 5 0 R")):
        with pytest.raises(PdfError):
            Pdf(bad)
    bomb = zlib.compress(b"0" * (64 << 20))
    data = b"%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Type /Page /Contents 3 0 R >> endobj 3 0 obj << /Filter /FlateDecode /Length " + str(len(bomb)).encode() + b" >> stream\n" + bomb + b"\nendstream endobj"
    with pytest.raises(PdfError):
        Pdf(data).text()
    assert Pdf(_pdf()[:400]).text() is not None  # a torn file gives what it has
    assert text_string(b"\xff\xfe") == "ÿþ" and text_string("é".encode()) == "é" and text_string(b"\xe9") == "é"


def test_pdf_in_extract(spark):
    from cairn.sources.documents import extract

    rows = [(1, "pdf", bytearray(_pdf())), (2, "pdf", bytearray(b"x"))]
    got = {r.file_id: r for r in extract(spark.createDataFrame(rows, "file_id long, ext string, content binary")).collect()}
    assert got[1].body.startswith("Hello") and got[1].authors == ["A Writer"] and got[1].title == "日本" and got[2].error


def test_store_pointers(spark, tmp_path):
    root = str(tmp_path / "s")
    a = Store(spark, root)
    a.commit({"t": spark.range(3)}, {"k": "1"})
    b = Store(spark, root)
    assert b.table("t").count() == 3 and b.meta("k") == "1"
    a.commit({"t": spark.range(5), "u": lambda new: new("t").where("id > 2")})
    with pytest.raises(Conflict):  # b began before a's second commit
        b.commit({"t": spark.range(9)})
    (tmp_path / "s" / "CURRENT.7.json").write_text('{"version": 3, "gen')  # a writer stopped here
    c = Store(spark, root)
    assert c.generation == 2 and c.table("t").count() == 5 and c.table("u").count() == 2
    os.remove(tmp_path / "s" / "CURRENT.7.json")
    assert len(c.vacuum()) == 1 and Store(spark, root).table("u").count() == 2  # the loser's folder
    for _ in range(6):
        c.commit({}, {"k": None})
    assert c.meta("k") is None and len([n for n in os.listdir(root) if n.startswith("CURRENT")]) == 5
    (tmp_path / "s" / "CURRENT.99.json").write_text(json.dumps({"version": 99}))
    with pytest.raises(ValueError):
        Store(spark, root)
    old = tmp_path / "old"
    spark.range(2).write.parquet(str(old / "gen=4" / "t"))
    (old / "CURRENT.json").write_text(json.dumps({"version": 2, "generation": 4, "tables": {"t": 4}, "meta": {}}))
    m = Store(spark, str(old))
    assert m.table("t").count() == 2 and m.scan_generation == 4
    assert behind(3, 1) == 2 and behind(1, None) == 1


def test_crawl_deals_folders(spark, tmp_path):
    for i in range(3):
        for j in range(4):
            d = tmp_path / "top" / f"a{i}" / f"b{j}" / "c"
            d.mkdir(parents=True)
            (d / "x.txt").write_text("x")
            (d.parent / "y.txt").write_text("y")
    (tmp_path / "z.txt").write_text("z")
    reader = fs.CrawlReader({"path": str(tmp_path)})
    parts = reader.partitions()
    assert sum(p.deep for p in parts) == 12  # one top folder, and still twelve tasks
    paths = sorted(r[0] for p in parts for r in reader.read(p))
    assert len(paths) == 25 and len(set(paths)) == 25
    assert sorted(r.path for r in fs.crawl(spark, str(tmp_path)).select("path").collect()) == paths


def test_exclusions_of_the_system(spark):
    rows = spark.createDataFrame([("/r/a.txt", 0), ("/r/b.txt", 2), ("/r/db/gen=1/x", 0), ("/r/dbx/y", 0), ("/r/out/z", 0)], "path string, attributes int")
    reason = scan.exclusion(F.substring("path", 4, 99), F.col("path"), [], [], ignore_patterns("# c\nout/\n"), F.col("attributes"), "/r/db")
    assert [r.reason for r in rows.select(reason.alias("reason")).collect()] == [None, "hidden", "store", None, "gitignore"]
    files = spark.createDataFrame([(1, None), (2, 5)], "file_id long, deleted_at long")
    assert [tuple(r) for r in scan.mark_deleted(scan.mark_deleted(files, 1, 7), 2, 7).orderBy("file_id").collect()] == [(1, 7), (2, 5)]


def test_prefixes():
    p = ExcludePolicy.build(prefixes=["/a//b/../c/", "/x/", "//y"], defaults=False)
    assert p.prefixes == ("/a/c", "/x", "/y")
    assert missing_prefixes(["/no/such/dir", "/", "rel"]) == ["/no/such/dir"]


def test_change_sources():
    usn, mtime = Marker("usn", 1, 2, 3, 4, "C:"), Marker("mtime", 5)
    assert [source_for(m, j, f) for m, j, f in ((None, True, None), (usn, True, None), (usn, False, None), (mtime, True, None), (usn, True, "mtime"))] == ["none", "usn", "mtime", "mtime", "mtime"]
    with pytest.raises(ValueError):
        source_for(usn, True, "what")
    assert [journal_probe(*x)[0] for x in ((False, usn, True), (True, usn, False), (True, None, True), (True, mtime, True), (True, usn, True))] == [False] * 4 + [True]
    assert TextPolicy.from_config('[text]\ntext = [".LOG"]\nbinary = ["dat"]\n') == TextPolicy(("log",), ("dat",))
    with pytest.raises(ValueError):
        TextPolicy.from_config("[text]\nwhat = []\n")


def test_kept_index(spark, tmp_path):
    source = str(tmp_path / "docs")
    rows = [(1, "the cat the hat"), (2, "a hat"), (3, None), (4, "")]
    spark.createDataFrame(rows, "file_id long, body string").write.parquet(source)
    docs = spark.read.parquet(source)
    kept = shared.kept_index(spark, source, docs)
    assert kept.corpus.first().n == 4 and kept.corpus.first().avgdl == 1.5
    for q in ("hat", "the OR a", '"the hat"', "+hat -cat"):
        assert sorted(map(tuple, fulltext.search(kept, q).collect())) == sorted(map(tuple, fulltext.search(fulltext.build(docs), q, None).collect()))
    assert shared.fingerprint(spark, source) == shared.fingerprint(spark, source)
    gone = spark.createDataFrame([(1,)], "file_id long")
    new = spark.createDataFrame([(2, "the new hat")], "file_id long, body string")
    assert sorted((r.term, r.file_id) for r in fulltext.updated(kept.postings, gone, new).collect()) == [("hat", 2), ("new", 2), ("the", 2)]


def _tiff(model):
    text = model.encode() + b"\0"
    return b"II*\0\x08\0\0\0\x01\0" + struct.pack("<HHII", 0x0110, 2, len(text), 26) + b"\0\0\0\0" + text


def _box(kind, body):
    return struct.pack(">I4s", 8 + len(body), kind) + body


def test_exif_of_every_container():
    tiff = _tiff("Model X")
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4s", 2, b"IHDR") + b"xx" + b"crc0" + struct.pack(">I4s", len(tiff), b"eXIf") + tiff + b"crc1"
    webp = b"RIFF\0\0\0\0WEBP" + struct.pack("<4sI", b"VP8 ", 3) + b"abc\0" + struct.pack("<4sI", b"EXIF", len(tiff)) + tiff
    item = b"\0\0\0\x06Exif\0\0" + tiff
    ftyp = _box(b"ftyp", b"heic\0\0\0\0")
    infe = _box(b"infe", b"\2\0\0\0" + struct.pack(">HH", 7, 0) + b"Exif\0")
    iinf = _box(b"iinf", b"\0\0\0\0" + struct.pack(">H", 1) + infe)

    def heif(begin):
        iloc = _box(b"iloc", b"\0\0\0\0" + struct.pack(">HH", 0x4400, 1) + struct.pack(">HHHII", 7, 0, 1, begin, len(item)))
        return ftyp + _box(b"meta", b"\0\0\0\0" + iinf + iloc) + _box(b"mdat", item)

    begin = len(heif(0)) - len(item)
    for data in (tiff, b"\xff\xd8\xff\xe1..Exif\0\0" + tiff, png, webp, heif(begin)):
        assert documents.exif(data)["camera"] == "Model X"
    for data in (b"", png[:20], webp[:14], ftyp, b"RIFF\0\0\0\0WEBPEXIF"):
        assert documents.exif(data) == {}


def test_followed_table_is_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(changes, "COMPACT_EVERY", 2)
    src, target = str(tmp_path / "src"), str(tmp_path / "t")
    for n in range(5):
        rows = [(f"/{c}", 10 * n + k, "delete" if (n + k) % 3 == 0 else "create") for k, c in enumerate("abc"[: n + 1])]
        spark.createDataFrame(rows, changes.JOURNAL).write.mode("append").parquet(src)
        changes.follow(changes.journal_stream(spark, src, -1, -1), target, str(tmp_path / "ck")).awaitTermination()
    assert sorted(d for d in os.listdir(target) if d.startswith("base")) == ["base=1", "base=3"]
    assert {(r.path, r.usn, r.exists) for r in changes.latest(spark, target).collect()} == {("/a", 40, True), ("/b", 41, True), ("/c", 42, False)}
    with pytest.raises(changes.RescanRequired):
        changes.journal_stream(spark, src, 3, 9)
