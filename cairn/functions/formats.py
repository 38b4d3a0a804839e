"""Formats and kinds of files, text or not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions import fixed


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), key)


def _by_value(table: dict[str, str]) -> dict[str, str]:
    return {x: name for name, words in table.items() for x in words.split()}


def sniff_is_text(sample: Column) -> Column:
    """Whether the first bytes are text: a UTF-8 mark is, a UTF-16 mark, a zero byte or over one control byte in a hundred of at least 512 is not; else it must be UTF-8, save for a character cut at the end."""
    begins = lambda b: F.startswith(sample, F.lit(b))
    latin = F.decode(sample, "ISO-8859-1")
    controls = F.regexp_count(latin, F.lit(r"[\x00-\x08\x0E-\x1A\x1C-\x1F\x7F]"))
    n = F.octet_length(sample)
    whole = F.is_valid_utf8(sample.cast("string"))
    cut = F.lit(False)
    for k, lead in ((1, "[\\xC2-\\xF4]$"), (2, "[\\xE0-\\xF4][\\x80-\\xBF]$"), (3, "[\\xF0-\\xF4][\\x80-\\xBF]{2}$")):
        cut = cut | ((n >= k) & latin.rlike(lead) & F.is_valid_utf8(F.substr(sample, F.lit(1), n - k).cast("string")))
    return (
        F.when(n == 0, F.lit(False))
        .when(begins(b"\xef\xbb\xbf"), F.lit(True))
        .when(begins(b"\xff\xfe") | begins(b"\xfe\xff"), F.lit(False))
        .when(F.contains(latin, F.lit("\0")), F.lit(False))
        .when(controls * 100 > F.greatest(n, F.lit(fixed.SNIFF_BYTES)), F.lit(False))
        .otherwise(whole | cut)
    )


def format_from_magic(sample: Column) -> Column:
    """The format that the first bytes state; null for no bytes."""
    begins = lambda b: F.startswith(sample, F.lit(b))
    word = lambda at: F.substring(sample, at + 1, 4)
    out = F.when(F.octet_length(sample) == 0, F.lit(None).cast("string"))
    for sig, name in fixed.SIGNATURES:
        out = out.when(begins(sig), F.lit(name))
    riff = begins(b"RIFF")
    for kind, name in ((b"WAVE", "wav"), (b"AVI ", "avi"), (b"WEBP", "webp")):
        out = out.when(riff & (word(8) == F.lit(kind)), F.lit(name))
    out = out.when(riff, F.lit("riff"))
    boxed = word(4) == F.lit(b"ftyp")
    out = out.when(boxed & word(8).isin(b"heic", b"heix", b"mif1"), F.lit("heif")).when(boxed, F.lit("mp4"))
    out = out.when(begins(b"\xff\xfe") | begins(b"\xfe\xff"), F.lit("utf16")).when(begins(b"<?xml") | begins(b"\xef\xbb\xbf<?xml"), F.lit("xml"))
    return out.when(sniff_is_text(sample), F.lit("text")).when(sample.isNotNull(), F.lit("binary"))


def format_from_ext(ext: Column) -> Column:
    return F.coalesce(_lookup(fixed.EXT_FORMATS, ext), F.when(ext.isin(fixed.TEXT_EXTS), F.lit("text")))


def format_mismatch(ext: Column, magic_format: Column) -> Column:
    """Whether the content is none of the formats that the extension may have."""
    expected = F.split(_lookup(fixed.EXPECTED_FORMATS, ext), " ")
    return F.coalesce(~F.array_contains(expected, magic_format), F.lit(False))


def kind_from_ext(ext: Column) -> Column:
    return F.coalesce(_lookup(_by_value(fixed.EXT_KINDS), ext), F.when(ext.isin(fixed.TEXT_EXTS), F.lit("code")))


def kind_from_format(fmt: Column) -> Column:
    return _lookup(_by_value(fixed.FORMAT_KINDS), fmt)


def ext_verdict(ext: Column, user_text: list[str] = (), user_binary: list[str] = ()) -> Column:
    """text, binary, extract or unknown; the user's lists come first, an extension that is missing is unknown."""
    e = F.lower(ext)
    out = F.when(e.isNull() | (e == ""), F.lit("unknown"))
    for verdict, words in (("text", user_text), ("binary", user_binary), ("text", fixed.TEXT_EXTS), ("extract", fixed.BODY_EXTS), ("binary", fixed.BINARY_EXTS)):
        if words:
            out = out.when(e.isin(list(words)), F.lit(verdict))
    return out.otherwise(F.lit("unknown"))


def body_verdict(size: Column, ext: Column, magic: Column, body: Column, max_bytes: int = fixed.MAX_BODY_BYTES, sniff: bool = True) -> Column:
    """indexed, or why a file has no indexed body: empty, too_large, unsupported, binary, blank."""
    verdict = ext_verdict(ext)
    unknown = F.when(F.lit(sniff) & sniff_is_text(magic), F.lit("text")).otherwise(F.lit("binary" if sniff else "unsupported"))
    kind = F.when(verdict == "unknown", unknown).otherwise(verdict)
    return (
        F.when(size == 0, F.lit("empty"))
        .when(size > max_bytes, F.lit("too_large"))
        .when(verdict == "binary", F.lit("unsupported"))
        .when(kind != "text", kind)
        .when(F.coalesce(F.trim(F.regexp_replace(body, r"(?U)\s+", " ")), F.lit("")) == "", F.lit("empty"))
        .otherwise(F.lit("indexed"))
    )
