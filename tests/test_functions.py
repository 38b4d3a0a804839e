import pytest
from pyspark.sql import functions as F

from cairn.functions import formats, names, paths, ranking
from cairn.operators import fulltext


def _values(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.select("i", make(F.col("x")).alias("y")).orderBy("i").collect()]


def test_dates(spark):
    got = _values(spark, ["report-2024-03-15", "IMG_20240315_120000", "id1234567890", "18990101", "2024-13", "2024_07", "a202402b", ""], names.dates)
    assert got == [["2024", "2024-03"], ["2024", "2024-03"], [], [], ["2024"], ["2024", "2024-07"], ["2024", "2024-02"], []]


def test_versions(spark):
    got = _values(spark, ["plan_v2_final", "提案書_最終", "service", "v20240315", "report (3)", "edit-copy", "x rev007", "報告書 のコピー", "旧資料"], names.versions)
    assert got == [["final", "v2"], ["final"], [], [], ["copy"], [], ["rev7"], ["copy"], ["old"]]


def test_patterns(spark):
    files = ["report.xlsx.bak", "notes.txt~", "pg_basebackup", "screenshotannotationdialog.ui", "IMG_4821.JPG", "~$plan.docx", ".gitignore", "image1.png", "P1010123.jpg", "Screenshot 2024.png"]
    got = _values(spark, files, lambda c: names.patterns(c, paths.stem(c), paths.extension(c)))
    assert got == [["backup"], ["backup"], [], [], ["camera"], ["temp"], ["dotfile"], [], ["camera"], ["screenshot"]]


def test_paths(spark):
    raw = ["/data/A/b.txt", "\\\\?\\C:\\x\\y.md", "/DATA", "/database/x", "C:/q/w.e"]
    assert _values(spark, raw, lambda c: paths.relative_path(c, "/data/")) == ["A/b.txt", "x/y.md", "", "database/x", "q/w.e"]
    assert _values(spark, [".bashrc", "a.tar.gz", "noext", "x."], paths.stem) == [".bashrc", "a.tar", "noext", "x"]
    assert _values(spark, ["Acme-Corp 2024", "x", "12", "a_b"], paths.component_tokens) == [["acme-corp 2024", "acme", "corp"], [], [], ["a_b"]]


def test_iso_dates_and_cleaning(spark):
    assert _values(spark, ["2024-03-15T10:00:00Z", "2024:03:15 10:00:00", "D:20240315100000", "0000:00:00", "x"], names.iso_date) == ["2024-03-15"] * 3 + [None, None]
    assert _values(spark, [" a \t\n b　c ", "\x00", None], names.cleaned) == ["a b c", None, None]


@pytest.mark.parametrize(
    ("sample", "text", "fmt"),
    [
        (b"", False, None),
        (b"hello\n", True, "text"),
        (b"\xef\xbb\xbfhi", True, "text"),
        (b"\xff\xfeh\0", False, "utf16"),
        (b"ab\0cd", False, "binary"),
        (b"\x1b[31mred\x1b[0m" * 20, True, "text"),
        (b"\x01" * 6, False, "binary"),
        (b"\x01" * 5, True, "text"),
        ("日本語".encode()[:-1], True, "text"),
        ("日本語".encode()[:-2], True, "text"),
        (b"\xe3\x81x", False, "binary"),
        (b"RIFF\0\0\0\0WEBP", False, "webp"),
        (b"\0\0\0\x18ftypisom", False, "mp4"),
        (b"%PDF-1.7", True, "pdf"),
        (b"%!x", True, "postscript"),
    ],
)
def test_sniff_and_magic(spark, sample, text, fmt):
    df = spark.createDataFrame([(bytearray(sample),)], "x binary")
    row = df.select(formats.sniff_is_text(F.col("x")).alias("t"), formats.format_from_magic(F.col("x")).alias("f")).first()
    assert (row.t, row.f) == (text, fmt)


def test_kinds_and_verdicts(spark):
    assert _values(spark, ["pdf", "rs", "md", "zzz", None], formats.kind_from_ext) == ["document", "code", "text", None, None]
    assert _values(spark, ["txt", "docx", "zip", "weird", None], formats.ext_verdict) == ["text", "extract", "binary", "unknown", "unknown"]
    assert _values(spark, ["zip", "txt"], lambda c: formats.ext_verdict(c, ["zip"], ["txt"])) == ["text", "binary"]


def test_step_bits_and_labels(spark):
    df = spark.createDataFrame([(5, 10), (0, 10), (10, 10), (9998, 10000)], "a long, b long")
    got = [r.x for r in df.select(ranking.step_bits(F.col("a"), F.col("b")).alias("x")).collect()]
    assert got[0] == pytest.approx(1.0) and got[1] == got[2] == 0.0 and got[3] < 0.005
    w = spark.range(1).select(ranking.label_weight(F.lit(10.0), F.lit(10), F.lit(10000), F.lit(10)).alias("r"), ranking.label_weight(F.lit(10.0), F.lit(10), F.lit(10000), F.lit(10000)).alias("c"), ranking.label_weight(F.lit(0.0), F.lit(0), F.lit(0), F.lit(0)).alias("z")).first()
    assert w.r > w.c and w.z == 0


def test_snippet(spark):
    text = "あ" * 100 + "目印" + "い" * 100
    got = _values(spark, [text, "short", None], lambda c: fulltext.snippet(c, ["目印"], 30))
    assert "目印" in got[0] and len(got[0]) == 32 and got[0][0] == got[0][-1] == "…" and got[1:] == ["short", None]


def test_kerning_blanks(spark):
    assert _values(spark, ["日 本 語 text here", "a 日 b"], fulltext.without_kerning_blanks) == ["日本語 text here", "a 日 b"]


def test_long_runs():
    assert fulltext.long_runs_broken("short text") == ("short text", 0)
    out, n = fulltext.long_runs_broken("word " * 20000)
    assert n > 0 and len(out) == 100000 and max(map(len, out.split("\n"))) <= 32 << 10
    out, n = fulltext.long_runs_broken("語" * 40000)
    assert n > 0 and out.replace("\n", "") == "語" * 40000
