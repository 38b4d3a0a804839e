import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn import adapters
from cairn.operators import browse, fresh, fulltext, scan, tags
from cairn.plans.policy import DeltaCache, ExcludePolicy, Marker, TextPolicy, stale_notice
from cairn.plans.rules import Rule, glob_regex, matching, parse_rules, parse_tag
from cairn.plans.search import Clauses, Terms, live_terms, parse


def test_query_parser():
    assert parse("a b") == Clauses((("should", Terms(("a",))), ("should", Terms(("b",)))))
    assert parse("a AND b OR c").parts[0][0] == "must"
    assert parse('"New York"') == Terms(("new", "york"))
    assert parse("+a -(b c)").parts[1][0] == "must_not"
    for bad in ("", "  ", '"open', "(a", "a)", "..."):
        with pytest.raises(ValueError):
            parse(bad)


def test_live_terms():
    t = live_terms(parse('a -(b "c d") +e'))
    assert (t.required, t.optional, t.excluded) == (("e",), ("a",), ("b", "c", "d"))
    assert live_terms(parse("x")).required == ("x",)
    assert live_terms(parse("x")).body_terms == ("x",)


def test_rules():
    rules, digest = parse_rules('[[tags.rule]]\npath = "**/clients/*/**"\ntags = ["Client: Acme"]\n[[tags.rule]]\next = ["MD"]\nfile = "read*"\ntags = "doc:readme"\n')
    assert len(digest) == 64 and rules[0].tags == (("client", "acme"),)
    assert [r.name for r in matching(rules, "a/clients/x/y.txt", "y.txt", "txt")] == ["rule 1"]
    assert [r.name for r in matching(rules, "readme.md", "readme.md", "md")] == ["rule 2"]
    for bad in ('[[rule]]\ntags = "a:b"\n', '[[rule]]\npath = "*"\n', '[[rule]]\npath = "*"\ntags = "nocolon"\n', '[[rule]]\nwhat = 1\ntags = "a:b"\n'):
        with pytest.raises(ValueError):
            parse_rules(bad)
    assert parse_tag(" NS : a:b ") == ("ns", "a:b")
    assert glob_regex("*.md") == r"(?s)^[^/]*\.md$"


def _files(spark, rows):
    return spark.createDataFrame(rows, "file_id long, path string, ext string, magic binary")


def test_tag_generation_and_cap(spark):
    deep = "/r/" + "/".join(f"alpha{i}-beta{i}-gamma{i}-delta{i}" for i in range(12)) + "/plan_v2_2024-05.md"
    files = _files(spark, [(1, "/r/clients/acme-corp/invoice-2024-03-15_v2.txt", "txt", None), (2, "/r/photo.png", "png", bytearray(b"%PDF-1.4")), (3, deep, "md", None), (4, "/r/.gitignore", None, None)])
    rules = [Rule("all", (("project", "zeta"),), path="**/plan*")]
    rows = {(r.file_id, r.namespace, r.value): r.sources for r in tags.generate(files, "/r", rules).collect()}
    assert rows[1, "path", "acme-corp"] == 4 and rows[1, "date", "2024-03"] == 8 and rows[1, "version", "v2"] == 8 and rows[1, "kind", "text"] == 1
    assert rows[2, "format", "pdf"] == 2 and rows[2, "anomaly", "format-mismatch"] == 2
    assert rows[3, "project", "zeta"] == 16 and rows[4, "pattern", "dotfile"] == 8
    kept, dropped = tags.cap(tags.generate(files, "/r", rules))
    k3 = {(r.namespace, r.value) for r in kept.where("file_id = 3").collect()}
    assert len(k3) == 64 or dropped.where("file_id = 3").count() == 0
    assert ("project", "zeta") in k3 and ("version", "v2") in k3
    assert tags.generate(files, "/r", rules).count() == kept.count() + dropped.count()


def test_selection_needs_tags(spark, sf_dir):
    t = adapters.part_tags(spark, sf_dir)
    with pytest.raises(ValueError):
        tags.files_with(t, [])
    assert tags.select_all(t, []).count() == t.select("file_id").distinct().count()
    assert tags.select_all(t, [("type", "economy"), ("type", "economy")]).count() == t.where("value = 'economy'").count()


def test_browse_keeps_its_promises(spark, sf_dir):
    t = adapters.part_tags(spark, sf_dir)
    chosen: list = []
    before = None
    for _ in range(4):
        view = browse.browse(t, chosen)
        assert before is None or view.matched == before
        assert not {(v.namespace, v.value) for v in view.values} & set(chosen)
        if view.recommended is None:
            break
        shown = {(v.namespace, v.value): v.n_files for v in view.values}
        assert view.recommended in shown and shown[view.recommended] < view.matched
        before = shown[view.recommended]
        chosen = [*chosen, view.recommended]
    assert browse.browse(t, chosen) == browse.browse(t, chosen)


def test_rescan(spark):
    fields = "file_id long, path string, ext string, size long, mtime_ns long, ctime_ns long, fs_id binary, magic binary, content_hash binary, last_seen_scan long, deleted_at long"
    h = bytearray(b"h")
    stored = spark.createDataFrame(
        [(1, "/a", "t", 1, 1, 1, bytearray(b"1"), h, h, 1, None), (2, "/b", "t", 2, 2, 2, bytearray(b"2"), h, h, 1, None), (3, "/c", "t", 3, 3, 3, bytearray(b"3"), h, h, 1, None), (4, "/d", "t", 4, 4, 4, None, h, h, 1, None), (5, "/e", "t", 5, 5, 5, None, h, h, 1, None), (9, "/z", "t", 9, 9, 9, None, h, h, 1, 1)], fields
    )
    found = spark.createDataFrame(
        [("/a", "t", 1, 1, 1, bytearray(b"1")), ("/b", "t", 20, 2, 2, bytearray(b"2")), ("/c2", "t", 3, 3, 3, bytearray(b"3")), ("/d2", "t", 4, 4, 4, None), ("/new", "t", 7, 7, 7, None)], "path string, ext string, size long, mtime_ns long, ctime_ns long, fs_id binary"
    )
    c = {r.path: (r["class"], r.file_id) for r in scan.classify(found, stored).collect()}
    assert c == {"/a": ("unchanged", 1), "/b": ("changed", 2), "/c2": ("renamed", 3), "/d2": ("renamed", 4), "/new": ("added", None)}
    after = {r.path: r for r in scan.apply_rescan(found, stored, 2, 100).collect()}
    assert after["/b"].content_hash is None and after["/c2"].content_hash is not None and after["/c2"].file_id == 3
    assert after["/e"].deleted_at == 2 and after["/z"].deleted_at == 1 and after["/new"].file_id >= 100 and after["/a"].last_seen_scan == 2


def test_merge_page_halves(spark):
    rows = lambda side: spark.createDataFrame([(f"/{side}{i}", i, float(i), 10 - i) for i in range(6)], "path string, file_id long, score double, mtime_ns long")
    got = [(r.origin, r.path) for r in fresh.merge_page(rows("l"), rows("i"), 4).orderBy("place").collect()]
    assert got == [("live", "/l5"), ("live", "/l4"), ("index", "/i5"), ("index", "/i4")]
    none = rows("i").limit(0)
    assert [r.origin for r in fresh.merge_page(rows("l"), none, 4).collect()] == ["live"] * 4
    few = fresh.merge_page(rows("l"), rows("i").limit(1), 4).orderBy("place").collect()
    assert [r.origin for r in few] == ["live", "live", "index", "live"]


def test_fresh_search_sees_edits(spark):
    files = spark.createDataFrame([(1, "/a.md", 1, 1, None), (2, "/b.md", 1, 1, None)], "file_id long, path string, size long, mtime_ns long, deleted_at long")
    docs = spark.createDataFrame([(1, "old words"), (2, "old words")], "file_id long, body string")
    changes = spark.createDataFrame([("/a.md", 5, 9, True), ("/c.md", 5, 9, True)], "path string, size long, mtime_ns long, exists boolean")
    bodies = spark.createDataFrame([("/a.md", "new text"), ("/c.md", "Old old words")], "path string, body string")
    hits = fulltext.search(fulltext.build(docs), "old", None)
    got = [(r.origin, r.path) for r in fresh.search(hits, files, changes, bodies, "old", 10).orderBy("place").collect()]
    assert got == [("live", "/c.md"), ("index", "/b.md")]


def test_policies_round_trip():
    p = ExcludePolicy.build(["Build"], ["/mnt/x/"], ignored=["^vendor$"])
    assert ExcludePolicy.decode(p.encode()) == p and "/mnt/x" in p.prefixes
    assert ExcludePolicy.decode("v1\nname=a").prefixes == ()
    for bad in ("v9\n", "v2\nwhat=1", "v1\nprefix=/x"):
        with pytest.raises(ValueError):
            ExcludePolicy.decode(bad)
    with pytest.raises(ValueError):
        ExcludePolicy.build(prefixes=["relative"])
    t = TextPolicy().with_text([".Foo", "foo", "bar"])
    assert t.text == ("foo", "bar") and TextPolicy.decode(t.encode()) == t
    assert TextPolicy(("txt",)).agrees_with(TextPolicy()) and not t.agrees_with(TextPolicy())
    assert TextPolicy.resolve(None, t.encode()) == (t, None)
    assert TextPolicy.resolve(TextPolicy(("q",)), t.encode())[1] and TextPolicy.resolve(None, "zzz")[1]


def test_markers():
    for m in (Marker("mtime", 5), Marker("usn", 9, 7, 8, 100, "C:")):
        assert Marker.decode(m.encode()) == m
    assert [Marker.decode(x) for x in ("", "mtime|x", "usn|1", "what|1")] == [None] * 4
    assert stale_notice("bad", None, True, "complete").startswith("policy") and stale_notice(None, None, True, "complete")
    assert stale_notice(None, Marker("mtime", 1), True, "complete") is None and stale_notice(None, Marker("mtime", 1), True, "truncated")


def test_delta_cache(spark):
    c = DeltaCache()
    make = lambda: spark.range(3)
    m = Marker("mtime", 1)
    c.get(m, 0.0, make), c.get(m, 0.5, make), c.get(m, 2.0, make), c.get(Marker("mtime", 2), 2.1, make)
    assert (c.hits, c.misses, c.invalidations) == (1, 3, 1)
    c.drop()


def _zip(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return bytearray(b.getvalue())


def test_document_parsers(spark):
    from cairn.sources.documents import extract

    w = "xmlns:w='w'"
    docx = _zip({"word/document.xml": f"<w:d {w}><w:p><w:r><w:t>Hello </w:t><w:t>world</w:t></w:r></w:p><w:p><w:t>Two</w:t></w:p></w:d>", "docProps/core.xml": "<c><creator>Bo</creator><lastModifiedBy>Al</lastModifiedBy><title> My  title </title><created>2024-02-03T00:00:00Z</created></c>"})
    pptx = _zip({f"ppt/slides/slide{n}.xml": f"<s xmlns:a='a'><a:p><a:t>S{n}</a:t></a:p></s>" for n in (10, 2, 1)})
    xlsx = _zip({"xl/sharedStrings.xml": "<s><si><t>one</t></si></s>", "xl/worksheets/sheet1.xml": "<w><row><c t='s'><v>0</v></c><c><v>5</v></c></row><row><c t='inlineStr'><is><t>in</t></is></c></row></w>"})
    tiff = b"II*\0\x08\0\0\0" + b"\x02\0" + b"\x0f\x01\x02\0\x04\0\0\0Can\0" + b"\x10\x01\x02\0\x04\0\0\0CanX"[:12] + b"\0\0\0\0"
    rows = [(1, "docx", docx), (2, "pptx", pptx), (3, "xlsx", xlsx), (4, "docx", bytearray(b"broken")), (5, "pdf", bytearray(b"%PDF")), (6, "jpg", bytearray(b"\xff\xd8Exif\0\0" + tiff)), (7, "docx", None)]
    got = {r.file_id: r for r in extract(spark.createDataFrame(rows, "file_id long, ext string, content binary")).collect()}
    assert got[1].body == "Hello world\nTwo" and got[1].authors == ["Al", "Bo"] and got[1].title == "My title" and got[1].date == "2024-02-03"
    assert got[2].body == "S1\nS2\nS10" and got[3].body == "one\t5\nin"
    assert got[4].error and got[5].error and got[7].error == "not read" and got[6].camera == "CanX"


def test_crawl(spark, tmp_path):
    from cairn.sources.fs import crawl

    for p in ("a/x.TXT", "a/.hidden/y.md", "_under/z", "top.tar.gz", "skip/deep/no.txt"):
        f = tmp_path / p
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text("hi")
    got = {r.path[len(str(tmp_path)) + 1 :]: r for r in crawl(spark, str(tmp_path), [str(tmp_path / "skip")]).collect()}
    assert set(got) == {"a/x.TXT", "a/.hidden/y.md", "_under/z", "top.tar.gz"}
    assert got["a/x.TXT"].ext == "txt" and got["a/x.TXT"].mtime_ns == (tmp_path / "a/x.TXT").stat().st_mtime_ns and len(got["_under/z"].fs_id) == 16
    assert crawl(spark, str(tmp_path), since_ns=2**62).count() == 0


def test_store(spark, tmp_path):
    from cairn.sources.store import Store, behind

    s = Store(spark, str(tmp_path / "s"))
    assert s.generation == 0 and s.commit({"t": spark.range(3)}, {"k": "v"}) == 1
    assert s.commit({"u": spark.range(2)}, {"k": None, "j": "w"}) == 2
    again = Store(spark, str(tmp_path / "s"))
    assert again.table("t").count() == 3 and again.table("u").count() == 2 and again.meta("k") is None and again.meta("j") == "w"
    assert behind(5, 3) == 2 and behind(1, None) == 1 and behind(1, 4) == 0


def test_change_stream(spark, tmp_path):
    from cairn.streaming.changes import RescanRequired, check_marker, follow, journal_stream, latest

    src, target, ckpt = (str(tmp_path / x) for x in ("src", "out", "ckpt"))
    cols = "path string, usn bigint, reason string"
    spark.createDataFrame([("/a", 1, "create"), ("/a", 2, "security"), ("/b", 3, "create")], cols).write.parquet(src)
    follow(journal_stream(spark, src), target, ckpt).awaitTermination()
    spark.createDataFrame([("/a", 5, "delete"), ("/c", 6, "create")], cols).write.mode("append").parquet(src)
    follow(journal_stream(spark, src), target, ckpt).awaitTermination()
    assert {(r.path, r.usn, r.exists) for r in latest(spark, target).collect()} == {("/a", 5, False), ("/b", 3, True), ("/c", 6, True)}
    check_marker(5, 5)
    with pytest.raises(RescanRequired):
        check_marker(4, 5)


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "file_id long, namespace string, value string, sources int")
    assert browse.axes(none).count() == 0 and tags.namespace_counts(none).count() == 0
    docs = spark.createDataFrame([], "file_id long, body string")
    assert fulltext.search(fulltext.build(docs), "x").count() == 0
    nulls = spark.createDataFrame([(1, None)], "file_id long, body string")
    assert fulltext.postings(nulls).count() == 0
    with pytest.raises(ValueError):
        scan.find_paths(spark.createDataFrame([], "file_id long, path string, deleted_at long"), " ")
    assert F is not None


def test_cjk_words_are_found(spark):
    docs = spark.createDataFrame([(1, "東京都庁の会議 meeting"), (2, "京都の会議"), (3, "meeting notes v2データ"), (4, "都")], "file_id long, body string")
    assert [r.t for r in docs.where("file_id in (2, 3)").orderBy("file_id").select(fulltext.tokens(F.col("body")).alias("t")).collect()] == [["京都", "都の", "の会", "会議"], ["meeting", "notes", "v2", "デー", "ータ"]]
    index = fulltext.build(docs)
    find = lambda q: {r.file_id for r in fulltext.search(index, q, None).collect()}
    assert find("会議") == {1, 2} and find("京都の") == {2} and find("東京都") == {1} and find("会議 AND meeting") == {1}
    assert find("データ") == {3} and find("都") == {4} and parse("京都の") == Terms(("京都", "都の"))


def test_postings_come_in_runs_of_words_and_documents(spark, monkeypatch):
    from cairn.operators import fulltext

    rows = [(k, " ".join(f"w{(k * 7 + j) % 11}" for j in range(k % 5 + 1))) for k in (5, 3, 9, 1, 12, 7)]
    docs = spark.createDataFrame(rows, "file_id long, body string").coalesce(1)
    got = [(r.term, r.file_id, r.tf, r.dl, r.positions) for r in fulltext.postings(docs).collect()]
    want = []
    for k, body in rows:
        words = body.split()
        want += [(w, k, words.count(w), len(words), [i for i, x in enumerate(words) if x == w]) for w in set(words)]
    assert got == sorted(want)
    assert not fulltext.postings(docs)._jdf.queryExecution().executedPlan().toString().count("Exchange")
    assert list(fulltext._bounds(np.array([2_000_000, 3_000_000, 9_000_000, 1], np.int32))) == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_a_row_group_is_dealt_over_all_cores(spark, tmp_path):
    from cairn import adapters

    rows = spark.range(4000).selectExpr("id AS doc_id", "repeat(sha2(cast(id AS string), 512), 4) AS text")
    rows.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        t = adapters.table(spark, str(tmp_path), "documents")
        assert t.rdd.getNumPartitions() > 4 and adapters.row_groups(t, 4) == 1
        sizes = adapters.spread(t).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
        assert max(sizes) < 4000 // 4 + 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def _nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))


def test_live_search_shuffles_no_texts(spark):
    files = spark.createDataFrame([(1, "/a", 5, None), (2, "/b", 5, None)], "file_id long, path string, mtime_ns long, deleted_at long")
    changes = spark.createDataFrame([("/a", 1, 9, True), ("/b", 1, 9, True)], "path string, size long, mtime_ns long, exists boolean")
    bodies = spark.createDataFrame([("/a", "The cat"), ("/b", "a dog")], "path string, body string")
    got = fresh.search(spark.createDataFrame([(2, 1.0)], "file_id long, score double"), files, changes, bodies, "cat", 10)
    assert [(r.origin, r.path, r.file_id, r.score) for r in got.collect()] == [("live", "/a", 1, 1.0)]
    joins = [n for n in _nodes(got._jdf.queryExecution().optimizedPlan()) if n.nodeName() == "Join"]
    assert joins and not any("body#" in n.output().toString() for n in joins)


def test_parts_of_one_row_group_are_dealt_over_all_cores(spark, tmp_path):
    rows = spark.range(4000).selectExpr("id AS p_partkey", "'Brand#1' AS p_brand", "'SMALL' AS p_type", "1 AS p_size", "concat('big ', sha2(cast(id AS string), 512)) AS p_name")
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for made in (adapters.named_files(spark, str(tmp_path)), adapters.part_tags(spark, str(tmp_path))):
        sizes = made.select("file_id").distinct().count(), made.rdd.mapPartitions(lambda rows: [len({r.file_id for r in rows})]).collect()
        assert sizes[0] == 4000 and max(sizes[1]) <= 1001


def test_coverage_counts_a_tasks_own_files(spark):
    rows = [(1, "project", "a"), (1, "project", "b"), (1, "ext", "txt"), (2, "ext", "txt"), (3, "ext", "md"), (3, "state", "new")]
    tagged = spark.createDataFrame(rows, "file_id long, namespace string, value string")
    got = tags.coverage(spark.range(4), tagged)
    assert sorted(map(tuple, got.collect())) == [("", 3, 5, 6, 0.75), ("(semantic)", 2, 3, 3, 0.5), ("ext", 3, 2, 3, 0.75), ("project", 1, 2, 2, 0.25), ("state", 1, 1, 1, 0.25)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(file_id#" in plan and "hashpartitioning(namespace#" in plan
    assert not any("file_id#" in line and "namespace#" in line for line in plan.split("\n") if "Exchange hashpartitioning" in line)


def test_long_runs_are_broken_in_one_pass(spark, tmp_path):
    import time

    from cairn.queries_rows import lattice_breaks

    begin = time.monotonic()
    text, n = fulltext.long_runs_broken("語x" * 500_000, 512)
    assert (n, len(text)) == (3906, 1_000_000 + 3906) and time.monotonic() - begin < 5  # a copy of the rest for each piece makes it quadratic
    spark.createDataFrame([(1, "a b" * 400), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = lattice_breaks(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [(1, 2, 511), (2, 0, 0), (3, 0, 0)]
    assert "MapInPandas" not in got._jdf.queryExecution().executedPlan().toString()
