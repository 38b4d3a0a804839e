"""User tag rules: globs on path and name and a list of extensions; every rule that matches adds its tags."""

from __future__ import annotations

import hashlib
import re
import tomllib
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """A glob as a regular expression over lower case paths: ** crosses slashes, * and ? do not; {a,b} and [..] as usual."""
    out, i, depth = "", 0, 0
    g = glob.lower()
    while i < len(g):
        c = g[i]
        if g.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if g.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[":
            end = g.find("]", i + 2)
            if end < 0:
                raise ValueError(f"unclosed class in glob {glob!r}")
            body = g[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]"
            i = end + 1
            continue
        if c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c)
        i += 1
    if depth:
        raise ValueError(f"unclosed alternatives in glob {glob!r}")
    return f"(?s)^{out}$"


def parse_tag(text: str) -> tuple[str, str]:
    """namespace:value, split at the first colon, trimmed and lowered; an error if either part is invalid."""
    namespace, colon, value = text.partition(":")
    namespace, value = namespace.strip().lower(), value.strip().lower()
    if not colon or not re.fullmatch(r"[a-z0-9_-]+", namespace):
        raise ValueError(f"not a tag: {text!r}")
    if not value or len(value) > 128 or re.search(r"[\x00-\x1f\x7f-\x9f]", value):
        raise ValueError(f"not a tag value: {text!r}")
    return namespace, value


@dataclass(frozen=True)
class Rule:
    """Conditions are joined by and; a rule needs one at least."""

    name: str
    tags: tuple[tuple[str, str], ...]
    path: str | None = None
    file: str | None = None
    exts: tuple[str, ...] = field(default=())

    def matches(self, rel: Column, name: Column, ext: Column) -> Column:
        """rel and name in lower case."""
        out = F.lit(True)
        if self.path is not None:
            out = out & rel.rlike(glob_regex(self.path))
        if self.file is not None:
            out = out & name.rlike(glob_regex(self.file))
        if self.exts:
            out = out & F.coalesce(F.lower(ext).isin(list(self.exts)), F.lit(False))
        return out


_RULE_KEYS = {"name", "path", "file", "ext", "tags"}


def _rule(number: int, row: dict) -> Rule:
    if unknown := set(row) - _RULE_KEYS:
        raise ValueError(f"rule {number}: unknown keys {sorted(unknown)}")
    listed = lambda x: [x] if isinstance(x, str) else list(x or [])
    tags, exts = tuple(map(parse_tag, listed(row.get("tags")))), tuple(e.strip().lstrip(".").lower() for e in listed(row.get("ext")))
    if not tags:
        raise ValueError(f"rule {number}: no tags")
    if row.get("path") is None and row.get("file") is None and not exts:
        raise ValueError(f"rule {number}: no condition")
    for glob in (row.get("path"), row.get("file")):
        if glob is not None:
            glob_regex(glob)
    return Rule(row.get("name") or f"rule {number}", tags, row.get("path"), row.get("file"), exts)


def parse_rules(text: str) -> tuple[list[Rule], str]:
    """(rules, digest of the text) of a configuration ([[tags.rule]]) or of a bare rule file ([[rule]])."""
    data = tomllib.loads(text)
    rows = data.get("tags", {}).get("rule", []) + data.get("rule", [])
    return [_rule(i + 1, r) for i, r in enumerate(rows)], hashlib.sha256(text.encode()).hexdigest()


def matching(rules: list[Rule], rel: str, name: str, ext: str | None) -> list[Rule]:
    """The rules that match one file, in file order, decided on the driver."""
    hits = []
    for r in rules:
        ok = r.path is None or re.match(glob_regex(r.path), rel.lower())
        ok = ok and (r.file is None or re.match(glob_regex(r.file), name.lower()))
        if ok and (not r.exts or (ext or "").lower() in r.exts):
            hits.append(r)
    return hits
