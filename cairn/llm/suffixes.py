"""Suffix-array deduplication of bytes by a depth-limited radix sort.

In every shard, suffixes are ordered by most-significant-digit passes of eight bytes, through the threshold's bytes only;
a suffix alone in its group needs no further pass. Suffixes still in one group after the last pass are exactly the equal windows.
A window goes where a document with a smaller id has it too; what goes is judged on the input.

Nulls count as empty texts; texts under the width keep all; a null id counts as smaller than all others, and rows of one id are
one document to each other (they remove nothing from each other); extra columns are kept; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import windows
from cairn.llm.windows import Stretches, Units

WIDTH = 50
#: Bytes of the runs whose smallest hash is a window's anchor.
ANCHOR = 16
DIGIT = 8


def equal_windows(text: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """For each start, the number of its group among windows text[start : start + width]; windows that are alone get -1."""
    padded = np.r_[text, np.zeros(DIGIT, np.uint8)]
    digits = np.zeros(max(0, len(padded) - DIGIT + 1), np.uint64)
    for i in range(DIGIT):
        digits = digits << np.uint64(8) | padded[i : i + len(digits)]
    out = np.full(len(starts), -1, np.int64)
    alive, group = np.arange(len(starts)), np.zeros(len(starts), np.int64)
    for depth in range(0, width, DIGIT):
        digit = digits[starts[alive] + depth]
        if width - depth < DIGIT:
            digit = digit >> np.uint64(8 * (DIGIT - width + depth))
        order = np.lexsort((digit, group)) if depth else np.argsort(digit, kind="stable")
        alive, group, digit = alive[order], group[order], digit[order]
        new = np.r_[True, (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])] if len(alive) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        several = np.bincount(group)[group] > 1 if len(alive) else new
        alive, group = alive[several], group[several]
    out[alive] = group
    return out


def _decide(s: Stretches) -> Callable[[np.ndarray], np.ndarray]:
    sizes = np.array([len(c) for c in s.contents], np.int64)
    text = np.frombuffer(b"".join(s.contents), np.uint8)
    begin = np.cumsum(sizes) - sizes
    at = np.cumsum(s.windows) - s.windows
    inside = np.arange(int(s.windows.sum())) - np.repeat(at, s.windows)
    owner = np.repeat(np.arange(len(sizes)), s.windows)
    least = np.full(len(sizes), np.iinfo(np.int64).max)
    np.minimum.at(least, s.which, s.order)
    earliest = least[owner]
    group = equal_windows(text, begin[owner] + inside, WIDTH)
    some = np.flatnonzero(group >= 0)
    if len(some):
        low = np.full(int(group.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(low, group[some], earliest[some])
        earliest[some] = low[group[some]]

    def goes(i: np.ndarray) -> np.ndarray:
        n = s.windows[s.which[i]]
        k = np.repeat(at[s.which[i]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return earliest[k] < np.repeat(s.order[i], n)

    return goes


BYTES = Units(
    width=WIDTH,
    anchor=ANCHOR,
    parse=lambda text: np.frombuffer(text.encode(), np.uint8),
    values=lambda b: b.astype(np.uint64),
    content=lambda b, lo, hi: b[lo:hi].tobytes(),
    length=len,
    across=True,
)


def remove_repeated_bytes(docs: DataFrame) -> DataFrame:
    """docs with kept (the bytes that stay), n_total, n_removed, n_spans."""
    return windows.remove_repeats(docs, BYTES, _decide, lambda b, stays: b[stays].tobytes())


def digests(docs: DataFrame) -> DataFrame:
    out = remove_repeated_bytes(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("n_total").alias("n_bytes"), "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
