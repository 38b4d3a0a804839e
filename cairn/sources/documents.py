"""Bodies and embedded metadata of office documents and pictures.

A parser that fails costs its own file only, which gets an error. Bodies are cut at a bound, whole characters.
"""

from __future__ import annotations

import io
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.sources.pdf import Pdf

MAX_INFLATED = 16
MAX_BODY_CHARS = 2 << 20
SCHEMA = "body string, authors array<string>, title string, camera string, date string, error string"


class TooLarge(ValueError):
    """A member that would inflate past the bound."""


def _member(z: zipfile.ZipFile, name: str, budget: int) -> ET.Element:
    if z.getinfo(name).file_size > budget:
        raise TooLarge(name)
    return ET.fromstring(z.read(name))


def _local(e: ET.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _paragraphs(root: ET.Element) -> str:
    """Text runs, a line for each paragraph."""
    lines = []
    for p in root.iter():
        if _local(p) == "p":
            lines.append("".join(t.text or "" for t in p.iter() if _local(t) == "t"))
    return "\n".join(lines)


def _number(name: str) -> int:
    return int(re.search(r"(\d+)\.xml$", name).group(1))


def _sheet(root: ET.Element, shared: list[str]) -> str:
    lines = []
    for row in (r for r in root.iter() if _local(r) == "row"):
        cells = []
        for c in (c for c in row if _local(c) == "c"):
            kind = c.get("t", "n")
            if kind == "inlineStr":
                cells.append("".join(t.text or "" for t in c.iter() if _local(t) == "t"))
                continue
            value = next((v.text or "" for v in c if _local(v) == "v"), "")
            cells.append(shared[int(value)] if kind == "s" and value.isdigit() and int(value) < len(shared) else value)
        lines.append("\t".join(cells))
    return "\n".join(lines)


def office_body(data: bytes, ext: str) -> str:
    """Text of a docx, pptx (slides by number) or xlsx (tabs between cells, a line for each row)."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        budget = MAX_INFLATED * max(len(data), 1 << 16)
        names = z.namelist()
        if ext in ("docx", "docm"):
            return _paragraphs(_member(z, "word/document.xml", budget))
        if ext in ("pptx", "pptm"):
            slides = sorted((n for n in names if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=_number)
            return "\n".join(_paragraphs(_member(z, n, budget)) for n in slides)
        shared = []
        if "xl/sharedStrings.xml" in names:
            root = _member(z, "xl/sharedStrings.xml", budget)
            shared = ["".join(t.text or "" for t in si.iter() if _local(t) == "t") for si in root if _local(si) == "si"]
        sheets = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=_number)
        return "\n".join(_sheet(_member(z, n, budget), shared) for n in sheets)


def office_properties(data: bytes) -> dict:
    """Authors (sorted, each once), title and date of creation; a file without properties has none."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        if "docProps/core.xml" not in z.namelist():
            return {}
        root = _member(z, "docProps/core.xml", MAX_INFLATED * max(len(data), 1 << 16))
    found = {_local(e): (e.text or "").strip() for e in root}
    authors = sorted({a for a in (_clean(found.get("creator")), _clean(found.get("lastModifiedBy"))) if a})
    return {"authors": authors, "title": _clean(found.get("title")), "date": (found.get("created") or "")[:10] or None}


def _clean(s: str | None) -> str | None:
    return re.sub(r"[\s\x00-\x1f\x7f-\x9f]+", " ", s or "").strip() or None


def _boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(kind, begin, end) of the boxes of an ISO media file."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        head = 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack_from(">Q", data, at + 8)[0], 16
        size = size or end - at
        if size < head:
            return
        yield kind, at + head, min(at + size, end)
        at += size


def _heif_exif(data: bytes) -> bytes | None:
    """The Exif item of a HEIF or AVIF: its number from the item information, its place from the item locations."""
    meta = next(((a + 4, b) for kind, a, b in _boxes(data, 0, len(data)) if kind == b"meta"), None)
    if meta is None:
        return None
    number, places = None, {}
    for kind, a, b in _boxes(data, *meta):
        if kind == b"iinf":
            wide = data[a] != 0
            for k, x, _ in _boxes(data, a + (8 if wide else 6), b):
                if k == b"infe" and data[x] >= 2:
                    long = data[x] > 2
                    if data[x + (10 if long else 8) :][:4] == b"Exif":
                        number = struct.unpack_from(">I" if long else ">H", data, x + 4)[0]
        elif kind == b"iloc":
            version, sizes = data[a], struct.unpack_from(">H", data, a + 4)[0]
            offset, length, base, index = sizes >> 12, sizes >> 8 & 15, sizes >> 4 & 15, sizes & 15 if version else 0
            at = a + 6

            def take(n: int) -> int:
                nonlocal at
                at += n
                return int.from_bytes(data[at - n : at])

            for _ in range(take(4 if version > 1 else 2)):
                item = take(4 if version > 1 else 2)
                if version:
                    take(2)
                take(2)
                begin = take(base)
                for extent in range(take(2)):
                    take(index)
                    found = begin + take(offset), take(length)
                    if extent == 0:
                        places[item] = found
    if number not in places:
        return None
    begin, size = places[number]
    item = data[begin : begin + size]
    return item[4 + int.from_bytes(item[:4]) :].removeprefix(b"Exif\0\0")


def exif_block(data: bytes) -> bytes | None:
    """The TIFF structure of a picture's EXIF, if it has one: of TIFF, JPEG, PNG (eXIf), WebP (EXIF), HEIF and AVIF."""
    if data[:4] in (b"II*\0", b"MM\0*"):
        return data
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            size, kind = struct.unpack_from(">I4s", data, at)
            if kind == b"eXIf":
                return data[at + 8 : at + 8 + size]
            at += 12 + size
        return None
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        at = 12
        while at + 8 <= len(data):
            kind, size = struct.unpack_from("<4sI", data, at)
            if kind == b"EXIF":
                return data[at + 8 : at + 8 + size].removeprefix(b"Exif\0\0")
            at += 8 + size + size % 2
        return None
    if data[4:8] == b"ftyp":
        return _heif_exif(data)
    at = data.find(b"Exif\0\0")
    return data[at + 6 :] if at >= 0 else None


def exif(data: bytes) -> dict:
    """Camera and date from a picture's EXIF; none if it has none."""
    tiff = exif_block(data)
    if tiff is None:
        return {}
    order = "<" if tiff[:2] == b"II" else ">"

    def entries(offset: int) -> dict[int, object]:
        out = {}
        (n,) = struct.unpack_from(order + "H", tiff, offset)
        for i in range(n):
            tag, kind, count, raw = struct.unpack_from(order + "HHI4s", tiff, offset + 2 + 12 * i)
            if kind == 2:
                start = offset + 10 + 12 * i if count <= 4 else struct.unpack(order + "I", raw)[0]
                out[tag] = tiff[start : start + count].split(b"\0")[0].decode("utf-8", "replace")
            elif kind == 4:
                out[tag] = struct.unpack(order + "I", raw)[0]
        return out

    first = entries(struct.unpack_from(order + "I", tiff, 4)[0])
    more = entries(first[0x8769]) if isinstance(first.get(0x8769), int) else {}
    make, model = _clean(first.get(0x010F)), _clean(first.get(0x0110))
    camera = model if not make or (model and make.split()[0].lower() in model.lower()) else " ".join(x for x in (make, model) if x)
    taken = more.get(0x9003) or first.get(0x0132) or ""
    m = re.match(r"(\d{4})[:-](\d{2})[:-](\d{2})", str(taken))
    return {"camera": camera, "date": "-".join(m.groups()) if m and m.group(1) != "0000" else None}


def _one(data: bytes | None, ext: str | None) -> dict:
    out: dict = {"body": None, "authors": [], "title": None, "camera": None, "date": None, "error": None}
    try:
        if data is None:
            out["error"] = "not read"
        elif ext in ("docx", "docm", "pptx", "pptm", "xlsx", "xlsm"):
            out["body"] = office_body(data, ext)[:MAX_BODY_CHARS]
            out |= office_properties(data)
        elif ext in ("jpg", "jpeg", "tif", "tiff", "png", "webp", "heic", "heif", "avif"):
            out |= exif(data)
        elif ext == "pdf":
            file = Pdf(data)
            info = file.info()
            out["body"] = file.text()[:MAX_BODY_CHARS]
            out |= {"authors": [a] if (a := _clean(info.get("Author"))) else [], "title": _clean(info.get("Title")), "date": info.get("CreationDate")}
    except Exception as e:  # a parser's failure is a fact about the file
        out["error"] = f"{type(e).__name__}: {e}"[:200]
    return out


def extract(files: DataFrame, with_content: bool = False) -> DataFrame:
    """files (with ext and content) with body, authors, title, camera, date and error; null content is an error row. The content goes, unless it is wanted beside what was found in it."""
    keep = [c for c in files.columns if with_content or c != "content"]

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            got = pd.DataFrame([_one(None if c is None else bytes(c), e) for c, e in zip(f["content"], f["ext"], strict=True)], columns=["body", "authors", "title", "camera", "date", "error"])
            yield pd.concat([f[keep].reset_index(drop=True), got], axis=1)

    fields = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in files.select(*keep).schema)
    return files.mapInPandas(work, f"{fields}, {SCHEMA}")


def read_contents(files: DataFrame, max_bytes: int) -> DataFrame:
    """Adds content: the bytes of each path, null for files over the bound or unreadable. Paths must be seen by all executors."""

    @F.pandas_udf("binary")
    def read(paths: pd.Series) -> pd.Series:
        out = []
        for p in paths:
            try:
                with open(p, "rb") as f:
                    data = f.read(max_bytes + 1)
                out.append(data if len(data) <= max_bytes else None)
            except OSError:
                out.append(None)
        return pd.Series(out, dtype=object)

    return files.withColumn("content", read("path"))


def decoded(content):
    """Bytes as text: without a UTF-8 mark, bytes that are no UTF-8 replaced."""
    bare = F.when(F.startswith(content, F.lit(b"\xef\xbb\xbf")), F.substr(content, F.lit(4))).otherwise(content)
    return F.make_valid_utf8(bare.cast("string"))
