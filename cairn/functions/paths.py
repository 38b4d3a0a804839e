"""Paths and names: relative path, name, stem, extension, component tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.functions import fixed


def slashed(path: Column) -> Column:
    """Backslashes as slashes, without the verbatim prefix of Windows; a share's prefix becomes two slashes."""
    p = F.regexp_replace(path, r"\\", "/")
    p = F.regexp_replace(p, r"(?i)^//\?/unc/", "//")
    return F.regexp_replace(p, r"^//\?/", "")


def relative_path(path: Column, root: str | None = None) -> Column:
    """The path under a root that is compared without ASCII case on whole components; the root itself is empty. Otherwise without leading slashes and drive."""
    p = slashed(path)
    bare = F.regexp_replace(F.regexp_replace(p, "^/+", ""), "^[^/]:/", "")
    if root is None:
        return bare
    base = slashed(F.lit(root))
    base = F.regexp_replace(base, "/+$", "")
    low = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    below = (F.length(base) > 0) & F.startswith(low(p), F.concat(low(base), F.lit("/")))
    rest = F.regexp_replace(F.substr(p, F.length(base) + 2), "^/+", "")
    return F.when(below, rest).when(low(p) == low(base), F.lit("")).otherwise(bare)


def file_name(rel: Column) -> Column:
    return F.regexp_extract(rel, "([^/]*)$", 1)


def stem(name: Column) -> Column:
    """The name without its last extension; a leading dot belongs to the name."""
    return F.regexp_replace(name, r"(?s)(?<=.)\.[^.]*$", "")


def extension(name: Column) -> Column:
    """The last extension in lower case, null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(name, r"(?s).\.([^.]+)$", 1)), F.lit(""))


def folded_ext(ext: Column) -> Column:
    """Aliases of one format become one extension."""
    alias = F.create_map(*[F.lit(x) for pair in fixed.EXT_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(alias, ext), ext)


def ancestors(rel: Column) -> Column:
    """The directory names above a file, outermost first."""
    parts = F.filter(F.split(rel, "/"), lambda p: p != "")
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))


def useful_token(token: Column) -> Column:
    return F.length(token).between(2, fixed.MAX_VALUE_CHARS) & ~token.rlike("^[0-9]+$")


def component_tokens(component: Column) -> Column:
    """A directory name as a whole and, if it has several parts, its parts: lower case, useful ones, each once."""
    parts = F.filter(F.split(component, fixed.NAME_SEPARATORS), lambda p: p != "")
    parts = F.when(F.size(parts) > 1, parts).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.filter(F.transform(F.concat(F.array(component), parts), F.lower), useful_token))


def is_under(path: Column, root: str) -> Column:
    """On a whole-component boundary: /sys does not hold /system."""
    base = root.rstrip("/")
    return (path == F.lit(base or "/")) | F.startswith(path, F.lit(base + "/"))
