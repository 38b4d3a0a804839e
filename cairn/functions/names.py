"""What a file's name tells: dates, versions, naming patterns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions import fixed

_NONE = F.array


def _either(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


def dates(s: Column) -> Column:
    """YYYY and YYYY-MM that maximal digit runs state (YYYYMMDD, YYYYMM, YYYY, or YYYY and MM around one separator), ascending."""
    runs = F.regexp_extract_all(s, F.lit("[0-9]+"), F.lit(0))
    pairs = F.regexp_extract_all(s, F.lit("(?<![0-9])([0-9]{4}[-_./][0-9]{2})(?![0-9])"), F.lit(1))
    year_ok = lambda r: F.substring(r, 1, 4).between(str(fixed.MIN_YEAR), str(fixed.MAX_YEAR))
    month_ok = lambda r, at: F.substring(r, at, 2).between("01", "12")
    day_ok = lambda r: F.substring(r, 7, 2).between("01", "31")
    full = F.filter(runs, lambda r: ((F.length(r) == 6) | ((F.length(r) == 8) & day_ok(r))) & year_ok(r) & month_ok(r, 5))
    apart = F.filter(pairs, lambda r: year_ok(r) & month_ok(r, 6))
    bare = F.filter(runs, lambda r: (F.length(r) == 4) & year_ok(r))
    months = F.concat(
        F.transform(full, lambda r: F.concat(F.substring(r, 1, 4), F.lit("-"), F.substring(r, 5, 2))),
        F.transform(apart, lambda r: F.concat(F.substring(r, 1, 4), F.lit("-"), F.substring(r, 6, 2))),
    )
    years = F.concat(F.transform(months, lambda m: F.substring(m, 1, 4)), bare)
    return F.array_sort(F.array_distinct(F.concat(years, months)))


def versions(stem: Column) -> Column:
    """Version words and numbers of a stem, ascending."""
    parts = F.transform(F.filter(F.split(stem, fixed.NAME_SEPARATORS), lambda p: p != ""), F.lower)
    words = F.filter(parts, lambda p: p.isin(fixed.VERSION_WORDS))
    number = lambda p: F.regexp_replace(F.regexp_extract(p, "([0-9]+)$", 1), "^0+(?=[0-9])", "")
    minor = F.transform(F.filter(parts, lambda p: p.rlike("^v(er)?[0-9]{1,3}$")), lambda p: F.concat(F.lit("v"), number(p)))
    revs = F.transform(F.filter(parts, lambda p: p.rlike("^r(ev)?[0-9]{1,3}$")), lambda p: F.concat(F.lit("rev"), number(p)))
    low = F.lower(F.regexp_replace(stem, r"(?U)\s+$", ""))
    marks = [F.when(F.contains(stem, F.lit(k)), F.lit(v)) for k, v in fixed.VERSION_PARTS.items()]
    copied = low.rlike(r"\([0-9]{1,9}\)$") | low.rlike(f"({_either(fixed.COPY_ENDINGS)})$")
    marks += [F.when(copied, F.lit("copy")), F.when(F.startswith(stem, F.lit(fixed.OLD_PREFIX)), F.lit("old"))]
    return F.array_sort(F.array_distinct(F.array_compact(F.concat(words, minor, revs, F.array(*marks)))))


def patterns(name: Column, stem: Column, ext: Column) -> Column:
    """Naming patterns: screenshot, camera, backup, temp, dotfile, ascending."""
    low_stem, low_name = F.lower(stem), F.lower(name)
    screenshot = low_stem.rlike(f"^({_either(fixed.SCREENSHOT_PREFIXES)})([0-9 _.(　-]|$)")
    camera = low_stem.rlike(f"^p[0-9]{{7}}$|^({_either(fixed.CAMERA_PREFIXES)})[0-9]{{4,}}([_.-]|$)")
    backup = F.lower(ext).isin(fixed.BACKUP_EXTS) | F.endswith(low_name, F.lit("~")) | F.endswith(stem, F.lit(fixed.BACKUP_ENDING))
    temp = F.lower(ext).isin(fixed.TEMP_EXTS) | low_name.rlike(r"^(~|\.~lock\.)")
    dot = name.rlike(r"(?s)^\..")
    found = [("backup", backup), ("camera", camera), ("dotfile", dot), ("screenshot", screenshot), ("temp", temp)]
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in found]))


def iso_date(s: Column) -> Column:
    """The date of an ISO, EXIF or PDF timestamp as YYYY-MM-DD; null if there is none or it is zero."""
    parts = [F.regexp_extract(s, r"^(?:D:)?([0-9]{4})[-:]?([0-9]{2})[-:]?([0-9]{2})", i) for i in (1, 2, 3)]
    ok = (parts[0] > "0000") & parts[1].between("01", "12") & parts[2].between("01", "31")
    return F.when(ok, F.concat_ws("-", *parts))


def cleaned(s: Column) -> Column:
    """Runs of white space and control characters as one space, trimmed; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(s, r"(?U)[\s\p{Cc}]+", " ")), F.lit(""))
