"""Reports: events as JSON lines, exit outcomes, status, next steps."""

from __future__ import annotations

import json
import shlex
from dataclasses import asdict, is_dataclass
from enum import IntEnum

SCHEMA = "v0"


class Outcome(IntEnum):
    """0: an answer; 1: an empty answer; 2: unusable or an error."""

    ANSWER = 0
    EMPTY = 1
    UNUSABLE = 2


def event(kind: str, **fields: object) -> str:
    """One JSON line. Values that can pass 2^53 go as strings."""
    plain = {k: asdict(v) if is_dataclass(v) and not isinstance(v, type) else v for k, v in fields.items()}
    large = lambda v: str(v) if isinstance(v, int) and not isinstance(v, bool) and abs(v) >= 2**53 else v
    return json.dumps({"schema": SCHEMA, "event": kind, **{k: large(v) for k, v in plain.items()}}, ensure_ascii=False, default=str)


def share_pct(part: int, whole: int) -> str:
    """Whole per cent; what is there but under one shows as such."""
    if whole <= 0 or part <= 0:
        return "0%"
    return "<1%" if part * 100 < whole else f"{part * 100 // whole}%"


def next_command(chosen: list[tuple[str, str]], step: tuple[str, str] | None, flags: dict[str, object] | None = None) -> str | None:
    """The drill-down command that takes the recommended step, with the flags that differ from the defaults."""
    if step is None:
        return None
    words = ["browse", *(f"{n}:{v}" for n, v in [*chosen, step])]
    for name, value in (flags or {}).items():
        words += [f"--{name}", str(value)]
    return " ".join(shlex.quote(w) for w in words)


def next_step_reason(has_layer: bool, matched: int, axes: int, step: tuple[str, str] | None) -> str | None:
    """Why no step is recommended."""
    if not has_layer:
        return "there is no tag layer: build it"
    if matched == 0:
        return "no file has all of these tags"
    if axes == 0:
        return "a leaf: no tag narrows this further"
    return None if step else "no axis is shown"


def ledger_holds(scanned: int, indexed: int, skipped: int, errors: int) -> bool:
    """Nothing is left out silently: what was scanned is indexed, skipped or an error."""
    return scanned == indexed + skipped + errors


def status_warnings(stats: dict, behind: int, policy: str, journal: str | None = None, remaining_h: float | None = None, warn_h: float = 24) -> list[str]:
    out = []
    if stats.get("n_live", 0) == 0:
        out.append("no live files: index first")
    if behind > 0:
        out.append(f"the tag layer is {behind} scans behind")
    if policy == "unreadable":
        out.append("the stored scan policy cannot be read")
    if journal in ("recreated", "rolled_off"):
        out.append(f"the change journal was {journal.replace('_', ' ')}: rescan")
    elif remaining_h is not None and remaining_h < warn_h:
        out.append(f"the change journal rolls over in about {remaining_h:.0f} h")
    return out
