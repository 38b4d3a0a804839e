"""Substring deduplication of words with a compressed FM-index per shard.

A shard's stretches are indexed over super-symbols: one for each run of GRAM consecutive words, in as many interleaved
sequences as a super-symbol has words, so that a window of 35 words is five consecutive super-symbols wherever it starts. All
suffixes are ordered, and the Burrows-Wheeler transform is kept by its runs, which repeated passages make long: a wavelet matrix of packed
bits over the runs' symbols, a bit for each place where a run begins, and the runs' lengths summed symbol by symbol. A stretch that
stands in several places is indexed once, and a bit marks its places as several.

The documents' stretches are streamed through the index: backward search from every place at once gives the matching
statistic of each place, the number of super-symbols of the longest match that ends there and occurs elsewhere too, up to
the threshold. Windows whose statistic reaches the threshold are reported as intervals of the document.

Nulls count as empty texts; texts under 35 words keep all; equal rows are separate documents; extra columns are kept; an
empty table gives an empty table. What is removed is judged on the input.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import windows
from cairn.llm.shingles import word_hashes, words_of
from cairn.llm.windows import Stretches, Units

WIDTH = 35
ANCHOR = 6
#: Words of a super-symbol; WIDTH is a multiple.
GRAM = 7
STEPS = WIDTH // GRAM
#: Places streamed through an index at once: bounds memory alone.
STREAMED = 200_000


class Bits:
    """Packed bits that tell how many are set before a place: a count of 16 bits for each word of bits, of 32 for each BLOCK words."""

    BLOCK = 1024

    def __init__(self, bits: np.ndarray) -> None:
        self.packed = np.packbits(np.r_[bits, np.zeros(64 + -len(bits) % 64, bool)], bitorder="little").view(np.uint64)
        counts = np.cumsum(np.bitwise_count(self.packed), dtype=np.int64) - np.bitwise_count(self.packed)
        self.blocks = counts[:: self.BLOCK].astype(np.uint32)
        self.counts = (counts - np.repeat(counts[:: self.BLOCK], self.BLOCK)[: len(counts)]).astype(np.uint16)

    def rank(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.blocks[word >> 10].astype(np.int64) + self.counts[word] + np.bitwise_count(self.packed[word] & mask)


class WaveletMatrix:
    """Occurrences of a symbol before a position, for many symbols and positions at once."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.levels = []
        s = symbols
        for level in range(max(1, int(symbols.max(initial=0)).bit_length()) - 1, -1, -1):
            bit = (s >> level & 1).astype(bool)
            self.levels.append((level, Bits(bit), int(len(bit) - bit.sum())))
            s = np.r_[s[~bit], s[bit]]

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros(len(at), np.int64), at
        for level, bits, zeros in self.levels:
            one = (symbols >> level & 1).astype(bool)
            ones_lo, ones_hi = bits.rank(lo), bits.rank(hi)
            lo = np.where(one, zeros + ones_lo, lo - ones_lo)
            hi = np.where(one, zeros + ones_hi, hi - ones_hi)
        return hi - lo


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """The suffixes' places in order of the suffixes, each ordered through its whole length: groups of suffixes with equal beginnings are split by what their next beginnings are known to be, twice as far each time; suffixes alone in their group are done."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    first = np.r_[True, symbols[order][1:] != symbols[order][:-1]] if n else np.zeros(0, bool)
    group = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = group
    reach = 1
    while True:
        last = np.r_[first[1:], True] if n else first
        open_ = np.flatnonzero(~(first & last))
        if not len(open_):
            return order
        at, mine = order[open_], group[open_]
        ahead = at + reach
        key = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        by = np.lexsort((key, mine))
        at, key = at[by], key[by]
        order[open_] = at
        new = np.r_[True, (mine[1:] != mine[:-1]) | (key[1:] != key[:-1])]
        first[open_] = new
        group[open_] = open_[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
        rank[at] = group[open_]
        reach *= 2


class FMIndex:
    """Counts of patterns in a sequence of symbols from 0 on (0 separates and is never asked for). `several` marks places that stand for more than one."""

    def __init__(self, symbols: np.ndarray, several: np.ndarray | None = None) -> None:
        order = suffix_order(symbols)
        bwt = symbols[order - 1]
        self.first = np.r_[0, np.cumsum(np.bincount(symbols))]
        self.several = None if several is None or not several.any() else Bits(several[order])
        begins = np.r_[True, bwt[1:] != bwt[:-1]] if len(bwt) else np.zeros(0, bool)
        self.begins = Bits(begins)
        self.starts = np.flatnonzero(begins).astype(np.uint32)
        self.heads = bwt[self.starts].astype(np.uint32)
        self.matrix = WaveletMatrix(self.heads)
        lengths = np.diff(np.r_[self.starts.astype(np.int64), len(bwt)])
        self.sums = np.r_[0, np.cumsum(lengths[np.argsort(self.heads, kind="stable")])].astype(np.uint32)
        self.runs = np.r_[0, np.cumsum(np.bincount(self.heads, minlength=len(self.first) - 1))].astype(np.uint32)

    def whole(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of suffixes that start with each symbol."""
        return self.first[symbols], self.first[symbols + 1]

    def _rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands in the transform before a place: in whole runs, and in the run that is cut there."""
        cut = np.maximum(self.begins.rank(at) - 1, 0)
        first = self.runs[symbols]
        whole = self.sums[first + self.matrix.rank(symbols, cut)].astype(np.int64) - self.sums[first]
        return whole + np.where(self.heads[cut] == symbols, at - self.starts[cut], 0)

    def prepend(self, symbols: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One step of backward search."""
        base = self.first[symbols]
        return base + self._rank(symbols, lo), base + self._rank(symbols, hi)

    def occurrences(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """How many places an interval stands for, those that stand for several counted twice."""
        return hi - lo if self.several is None else hi - lo + self.several.rank(hi) - self.several.rank(lo)

    def matching_statistics(self, stream: np.ndarray, least: int, most: int, ends: np.ndarray | None = None) -> np.ndarray:
        """For each place of a stream of symbols (0 separates; symbols that the index does not know are -1), or for the places given, the length of the longest match that ends there, stays within its sequence and occurs `least` times or more in the index; `most` at most."""
        ends = np.arange(len(stream)) if ends is None else ends
        out = np.zeros(len(ends), np.int64)
        alive = np.flatnonzero(stream[ends] > 0)
        lo, hi = self.whole(stream[ends[alive]])
        for k in range(most):
            enough = self.occurrences(lo, hi) >= least
            alive, lo, hi = alive[enough], lo[enough], hi[enough]
            out[alive] = k + 1
            before = ends[alive] - k - 1
            inside = (before >= 0) & (stream[before] > 0)
            alive, lo, hi = alive[inside], lo[inside], hi[inside]
            if k + 1 == most or not len(alive):
                break
            lo, hi = self.prepend(stream[before[inside]], lo, hi)
        return out


def _ahead(rank: np.ndarray, by: int) -> np.ndarray:
    return np.r_[rank[by:], np.zeros(by, np.int64)]


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense numbers of pairs, in the pairs' order."""
    width = int(b.max(initial=0)) + 1
    return np.unique(a * width + b, return_inverse=True)[1]


def repeated_windows(words: np.ndarray, sizes: np.ndarray, several: np.ndarray) -> np.ndarray:
    """For sequences of word numbers, laid end to end (all of WIDTH words or more), some of which stand in several places: for each window, one sequence after another, whether it occurs elsewhere too."""
    gram = words
    reach = 1
    while reach < GRAM:  # numbers of runs of 2, 4, ... words, then of GRAM words; runs over an end are never asked for
        step = min(reach, GRAM - reach)
        gram = _joined(gram, _ahead(gram, step))
        reach += step
    begin = np.cumsum(sizes) - sizes
    inside = np.arange(len(words)) - np.repeat(begin, sizes)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    usable = np.flatnonzero(inside <= sizes[owner] - GRAM)
    phase = inside[usable] % GRAM
    laid = usable[np.lexsort((inside[usable], phase, owner[usable]))]
    # A separator after each sequence: symbol 0 occurs nowhere else.
    ends = np.flatnonzero(np.r_[(owner[laid][1:] != owner[laid][:-1]) | (inside[laid][1:] % GRAM != inside[laid][:-1] % GRAM), True])
    symbols = np.insert(np.unique(gram[laid], return_inverse=True)[1] + 1, ends + 1, 0)
    place = np.full(len(words), -1, np.int64)
    place[laid] = np.delete(np.arange(len(symbols)), ends + 1 + np.arange(len(ends)))
    index = FMIndex(symbols, np.insert(several[owner[laid]], ends + 1, False))
    asked = np.flatnonzero(inside <= sizes[owner] - WIDTH)
    at = place[asked] + STEPS - 1
    # What is streamed is in the index itself, so that a match occurs elsewhere from the second place on.
    return np.concatenate([np.zeros(0, bool), *(index.matching_statistics(symbols, 2, STEPS, at[k : k + STREAMED]) >= STEPS for k in range(0, len(at), STREAMED))])


def _decide(s: Stretches) -> Callable[[np.ndarray], np.ndarray]:
    numbers: dict[bytes, int] = {}
    split = [c.split(b" ") for c in s.contents]
    words = np.array([numbers.setdefault(w, len(numbers)) for c in split for w in c], np.int64)
    several = np.bincount(s.which, weights=s.weight, minlength=len(split)) > 1
    repeated = repeated_windows(words, np.array([len(c) for c in split], np.int64), several)
    at = np.cumsum(s.windows) - s.windows

    def goes(i: np.ndarray) -> np.ndarray:
        n = s.windows[s.which[i]]
        return repeated[np.repeat(at[s.which[i]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    return goes


WORDS = Units(
    width=WIDTH,
    anchor=ANCHOR,
    parse=words_of,
    values=word_hashes,
    content=lambda words, lo, hi: b" ".join(words[lo:hi]),
    length=len,
    across=False,
)


def _join(words: list[bytes], stays: np.ndarray) -> bytes:
    return b" ".join(words if stays.all() else [words[i] for i in np.flatnonzero(stays)])


def remove_repeated_words(docs: DataFrame) -> DataFrame:
    """docs with kept (the words that stay, joined by one space, as UTF-8), n_total, n_removed, n_spans."""
    return windows.remove_repeats(docs, WORDS, _decide, _join)


def digests(docs: DataFrame) -> DataFrame:
    out = remove_repeated_words(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("n_total").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
