"""What a scan leaves out and which bodies are text: policies, their text form, markers of change sources."""

from __future__ import annotations

import os
import posixpath
import re
import tomllib
from dataclasses import dataclass, field

from cairn.functions import fixed


def normalised_ext(ext: str) -> str:
    """An extension that a user wrote, as the tables have it."""
    return ext.strip().lstrip(".").lower()


def canonical_prefix(prefix: str) -> str:
    """A prefix as paths of a crawl begin: without a last slash, doubled slashes, `.` and `..`."""
    p = prefix.strip()
    return posixpath.normpath(p).replace("//", "/") if p.startswith("/") else p.rstrip("/")


def missing_prefixes(prefixes: list[str]) -> list[str]:
    """Prefixes that a user named and that are no directory here: they exclude nothing, which is said."""
    return [p for p in prefixes if p.startswith("/") and not os.path.isdir(p)]


@dataclass(frozen=True)
class ExcludePolicy:
    """Directory names, absolute prefixes, ignore patterns of a root file (directories only)."""

    names: tuple[str, ...] = tuple(fixed.EXCLUDED_NAMES)
    prefixes: tuple[str, ...] = tuple(fixed.EXCLUDED_PREFIXES)
    ignored: tuple[str, ...] = ()
    skip_hidden: bool = False

    @classmethod
    def build(cls, extra: list[str] = (), prefixes: list[str] = (), defaults: bool = True, ignored: list[str] = (), skip_hidden: bool = False) -> ExcludePolicy:
        names = dict.fromkeys([*(fixed.EXCLUDED_NAMES if defaults else []), *(e.strip() for e in extra)])
        paths = dict.fromkeys([*(fixed.EXCLUDED_PREFIXES if defaults else []), *map(canonical_prefix, prefixes)])
        out = cls(tuple(names), tuple(paths), tuple(ignored), skip_hidden)
        out.validate()
        return out

    def validate(self) -> None:
        for value in (*self.names, *self.prefixes, *self.ignored):
            if not value or "\n" in value or "\r" in value:
                raise ValueError(f"not an exclusion: {value!r}")
        for p in self.prefixes:
            if not (p.startswith("/") or re.match(r"^[A-Za-z]:[/\\]", p)):
                raise ValueError(f"a prefix must be absolute: {p!r}")

    def encode(self) -> str:
        lines = ["v2", f"hidden={int(self.skip_hidden)}"]
        for key, values in (("name", self.names), ("prefix", self.prefixes), ("ignore", self.ignored)):
            lines += [f"{key}={v}" for v in values]
        return "\n".join(lines)

    @classmethod
    def decode(cls, text: str) -> ExcludePolicy:
        """Version 1 knew no prefixes. Unknown versions and keys are errors: a policy half understood would show a stale answer as fresh."""
        head, *lines = text.split("\n")
        if head not in ("v1", "v2"):
            raise ValueError(f"unknown policy version {head!r}")
        found: dict[str, list[str]] = {"name": [], "prefix": [], "ignore": []}
        hidden = False
        for line in lines:
            key, _, value = line.partition("=")
            if key == "hidden":
                hidden = value == "1"
            elif key in found and (head == "v2" or key != "prefix"):
                found[key].append(value)
            else:
                raise ValueError(f"unknown policy line {line!r}")
        return cls(tuple(found["name"]), tuple(found["prefix"]), tuple(found["ignore"]), hidden)


def ignore_patterns(text: str) -> list[str]:
    """Directory patterns of an ignore file as regular expressions over single names; negations and patterns with inner slashes are not among them."""
    from cairn.plans.rules import glob_regex

    out = []
    for line in text.splitlines():
        line = line.strip()
        if line and not line.startswith(("#", "!")) and "/" not in line.strip("/"):
            out.append(glob_regex(line.strip("/")).replace("(?s)", "(?is)"))
    return out


@dataclass(frozen=True)
class TextPolicy:
    """Extensions that users call text or binary."""

    text: tuple[str, ...] = ()
    binary: tuple[str, ...] = ()

    def with_text(self, exts: list[str]) -> TextPolicy:
        known = list(map(normalised_ext, exts))
        return TextPolicy(tuple(dict.fromkeys([*self.text, *known])), self.binary)

    @classmethod
    def from_config(cls, text: str) -> TextPolicy:
        """The part [text] of a configuration: the lists `text` and `binary`."""
        found = tomllib.loads(text).get("text", {}) if text else {}
        if unknown := set(found) - {"text", "binary"}:
            raise ValueError(f"text: unknown keys {sorted(unknown)}")
        listed = lambda key: tuple(dict.fromkeys(map(normalised_ext, found.get(key, []))))
        return cls(listed("text"), listed("binary"))

    def verdict(self, ext: str | None) -> str:
        e = (ext or "").lower()
        for verdict, words in (("text", self.text), ("binary", self.binary), ("text", fixed.TEXT_EXTS), ("extract", fixed.BODY_EXTS), ("binary", fixed.BINARY_EXTS)):
            if e and e in words:
                return verdict
        return "unknown"

    def agrees_with(self, other: TextPolicy) -> bool:
        """By effect: whether every extension either names gets the same verdict."""
        return all(self.verdict(e) == other.verdict(e) for e in {*self.text, *self.binary, *other.text, *other.binary})

    def encode(self) -> str:
        return "\n".join(["v1", *(f"text={e}" for e in self.text), *(f"binary={e}" for e in self.binary)])

    @classmethod
    def decode(cls, text: str) -> TextPolicy:
        head, *lines = text.split("\n")
        if head != "v1":
            raise ValueError(f"unknown policy version {head!r}")
        pairs = [line.partition("=")[::2] for line in lines]
        if any(k not in ("text", "binary") for k, _ in pairs):
            raise ValueError("unknown policy key")
        return cls(tuple(v for k, v in pairs if k == "text"), tuple(v for k, v in pairs if k == "binary"))

    @staticmethod
    def resolve(asked: TextPolicy | None, stored: str | None) -> tuple[TextPolicy, str | None]:
        """(policy, notice): the stored one unless another is asked for; a disagreement or an unreadable one is said."""
        try:
            known = TextPolicy.decode(stored) if stored else TextPolicy()
        except ValueError:
            return asked or TextPolicy(), "the stored text policy cannot be read"
        if asked is None or asked == TextPolicy():
            return known, None
        return asked, None if asked.agrees_with(known) else "the text policy differs from the one that the index was built with"


@dataclass(frozen=True)
class Marker:
    """Where a change source stands: a time, or a journal's position."""

    kind: str
    recorded_ns: int
    journal: int = 0
    next_usn: int = 0
    maximum_size: int = 0
    volume: str = ""

    def encode(self) -> str:
        if self.kind == "mtime":
            return f"mtime|{self.recorded_ns}"
        return f"usn|{self.volume}|{self.journal}|{self.next_usn}|{self.maximum_size}|{self.recorded_ns}"

    @classmethod
    def decode(cls, text: str) -> Marker | None:
        """None for what is malformed: an unknown marker counts as stale."""
        parts = text.split("|")
        try:
            if parts[0] == "mtime" and len(parts) == 2:
                return cls("mtime", int(parts[1]))
            if parts[0] == "usn" and len(parts) == 6:
                return cls("usn", int(parts[5]), int(parts[2]), int(parts[3]), int(parts[4]), parts[1])
        except ValueError:
            pass
        return None


def source_for(marker: Marker | None, has_journal: bool, forced: str | None = None) -> str:
    """Where changes are looked for: mtime (a walk), usn (a journal), or none. A marker of a journal is of no use where there is none; `forced` is what the user asks for."""
    if forced == "mtime":
        return "mtime"
    if forced not in (None, "", "usn"):
        raise ValueError(f"unknown change source {forced!r}")
    if marker is None:
        return "none"
    return "usn" if marker.kind == "usn" and has_journal else "mtime"


def journal_probe(asked: bool, marker: Marker | None, has_journal: bool) -> tuple[bool, str | None]:
    """(whether the journal's state is to be read, why not)."""
    if not asked:
        return False, "not requested (--check-journal)"
    if not has_journal:
        return False, "this system has no change journal"
    if marker is None:
        return False, "no marker of the last scan"
    return (True, None) if marker.kind == "usn" else (False, "the last scan's marker is a time")


def stale_notice(policy_error: str | None, marker: Marker | None, merging: bool, status: str) -> str | None:
    """Why an answer may be out of date, the gravest reason first; None if it is fresh."""
    if policy_error:
        return f"policy: {policy_error}"
    if marker is None:
        return "no marker of the last scan: rescan"
    if not merging:
        return "changes since the last scan are not merged"
    return None if status == "complete" else f"changes are incomplete: {status}"


@dataclass
class DeltaCache:
    """Keeps a change set for a second, and only for the same marker."""

    ttl_s: float = 1.0
    hits: int = 0
    misses: int = 0
    invalidations: int = 0
    _kept: tuple = field(default=(), repr=False)

    def get(self, marker: Marker, now_s: float, make):
        if self._kept and self._kept[0] == marker and now_s - self._kept[1] < self.ttl_s:
            self.hits += 1
            return self._kept[2]
        if self._kept and self._kept[0] != marker:
            self.invalidations += 1
        self.misses += 1
        self.drop()
        made = make().persist()
        self._kept = (marker, now_s, made)
        return made

    def drop(self) -> None:
        if self._kept:
            self._kept[2].unpersist()
            self._kept = ()
