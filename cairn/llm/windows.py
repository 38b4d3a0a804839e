"""Repeated windows of a corpus: the distributed part that the two substring operators share.

A window is `width` consecutive symbols (bytes or words) of one text. A hash of every short run of symbols is taken, and the
smallest in a window is the window's anchor; neighbouring windows mostly share theirs, so a text falls into few
stretches of windows with one anchor each, and equal windows have equal anchors wherever they stand. So

1. anchors of all texts meet by hash; one that occurs once has no repeated window, exactly;
2. the texts get their repeated anchors back and send only the stretches that have one, to the anchor's shard;
3. a shard decides about every window among its stretches with the operator's own method (suffix sorting, FM-index);
4. the texts get the decisions back.

What travels is packed into compressed arrays, a row for each task and destination. No step compares documents pairwise,
and equal stretches are decided once. A task decides what it can by itself: of an anchor or a stretch that it has seen
several times it sends one, and the answers for the others straight on, so that what is very common reaches its
shard once for each task and not once for each document.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import discard, give_back_memory, materialize
from cairn.llm.shingles import mixed, rolling

#: Bytes of all texts for each shard, at most: what a shard holds at once does not grow with the data.
SHARD_BYTES = 64 << 20
#: Bytes of stretches after which a task hands them on, and parts of a shard that are decided one after another.
FLUSH_BYTES = 4_000_000
PARTS = 32


@dataclass(frozen=True)
class Units:
    """How a text becomes symbols: values (64-bit, one for each symbol), and the content of a stretch of symbols."""

    width: int
    anchor: int
    parse: Callable[[str], object]
    values: Callable[[object], np.ndarray]
    content: Callable[[object, int, int], bytes]
    length: Callable[[object], int]
    #: Whether an anchor must occur in two documents (else: twice anywhere).
    across: bool


@dataclass
class Stretches:
    """Distinct stretches of a shard and where they occur. Occurrence i is stretch `which[i]` of document `rid[i]` (of order `order[i]`), whose first window starts at symbol `first[i]`; weight[i] is 2 if it stands for others too, about which is decided already."""

    contents: list[bytes]
    windows: np.ndarray
    which: np.ndarray
    rid: np.ndarray
    order: np.ndarray
    first: np.ndarray
    weight: np.ndarray


def stretches(values: np.ndarray, units: Units, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, number of windows) of each maximal run of windows with one anchor."""
    n = len(values) - units.width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = rolling(values, units.anchor) if hashes is None else hashes
    span, want = 1, units.width - units.anchor + 1
    while span * 2 <= want:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < want:
        low = np.minimum(low[: len(low) - (want - span)], low[want - span :])
    first = np.flatnonzero(np.r_[True, low[1:] != low[:-1]])
    # Smallest hashes crowd at the low end; spread again, they fill the shards evenly.
    return mixed(low[first]), first, np.diff(np.r_[first, n])


# --- packing ---------------------------------------------------------------------------------------------------------


def _pack(*arrays: np.ndarray) -> bytes:
    """Compressed arrays; 64-bit signed ones as differences."""
    parts = []
    for a in arrays:
        a = np.diff(a, prepend=np.int64(0)) if a.dtype == np.int64 else a
        parts.append(zstandard.compress(a.tobytes(), 1))
    return np.array([len(arrays[0]), *map(len, parts)], "<u4").tobytes() + b"".join(parts)


def _unpack(blob: bytes, *types: str) -> list[np.ndarray]:
    sizes = np.frombuffer(blob, "<u4", 1 + len(types))
    out, at = [], 4 * len(sizes)
    for t, n in zip(types, sizes[1:], strict=True):
        a = np.frombuffer(zstandard.decompress(blob[at : at + int(n)], max_output_size=int(sizes[0]) * np.dtype(t).itemsize + 1), t)
        out.append(np.cumsum(a) if t == "i8" else a)
        at += int(n)
    return out


def _by(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key with the indices that have it, in order."""
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(key[part[0]]), part


def _shard(anchor: np.ndarray, shards: int) -> np.ndarray:
    return (((anchor >> np.uint64(40)) * np.uint64(shards)) >> np.uint64(24)).astype(np.int64)


_BLOBS = "dest bigint, blob binary"
#: First byte of a blob: answers that only pass through, or what is still to be decided.
_DONE, _OPEN = b"D", b"O"


def _rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["dest", "blob"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[bytes]]:
    """The blobs of one destination after another, from rows sorted by destination."""
    last, held = None, []
    for batch in batches:
        for dest, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if dest != last and held:
                yield held
                held = []
            last = dest
            held.append(blob.as_py())
    if held:
        yield held


def _dealt(df: DataFrame, partitions: int, *more: str) -> DataFrame:
    return df.repartition(partitions, "dest").sortWithinPartitions("dest", *more)


# --- the four steps --------------------------------------------------------------------------------------------------


def _slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Batches of about FLUSH_BYTES of the column's bytes at most, or one row."""
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        begin = 0
        while begin < batch.num_rows:
            stop = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + FLUSH_BYTES, "right")))
            yield batch.slice(begin, stop - begin)
            begin = stop


def _anchors(units: Units, shards: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, 1):
            found, rids, numbers = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = units.values(units.parse(text.as_py() or ""))
                hashes = rolling(values, units.anchor)
                got = stretches(values, units, hashes)[0]
                number = np.arange(len(got), dtype=np.uint32)
                if not units.across and len(got):
                    # Windows of one stretch can be equal too, if its anchor stands in the text twice: such a stretch counts twice.
                    ordered = np.sort(hashes)
                    twice = np.isin(got, mixed(ordered[1:][ordered[1:] == ordered[:-1]]))
                    got, number = np.r_[got, got[twice]], np.r_[number, number[twice]]
                found.append(got)
                rids.append(np.full(len(got), rid))
                numbers.append(number)
            anchor, rid, number = np.concatenate(found), np.concatenate(rids), np.concatenate(numbers)
            order = np.argsort(anchor, kind="stable")
            anchor, rid, number = anchor[order], rid[order], number[order]
            known, first = _repeats(anchor, rid, np.ones(len(rid), np.uint8), units.across)
            out = [(dest, _DONE + _pack(rid[known][p], number[known][p])) for dest, p in _by(rid[known] % shards)]
            weight = np.where(known, np.uint8(2), np.uint8(1))
            sends = ~known | first
            anchor, rid, number, weight = anchor[sends], rid[sends], number[sends], weight[sends]
            low, mid = anchor.astype(np.uint32), (anchor >> np.uint64(32)).astype(np.uint8)
            out += [(dest, _OPEN + _pack(low[p], mid[p], rid[p], number[p], weight[p])) for dest, p in _by(_shard(anchor, shards))]
            for i in range(0, len(out), 256):
                yield _rows(out[i : i + 256])
            give_back_memory()

    return work


def _repeats(anchor: np.ndarray, rid: np.ndarray, weight: np.ndarray, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """For ascending anchors: whether each entry's anchor is repeated, and whether the entry is its anchor's first."""
    first = np.r_[True, anchor[1:] != anchor[:-1]] if len(anchor) else np.zeros(0, bool)
    if not len(anchor):
        return first, first
    starts = np.flatnonzero(first)
    if across:
        repeated = (np.minimum.reduceat(rid, starts) != np.maximum.reduceat(rid, starts)) | (np.maximum.reduceat(weight, starts) > 1)
    else:
        repeated = np.add.reduceat(weight.astype(np.int64), starts) > 1
    return np.repeat(repeated, np.diff(np.r_[starts, len(anchor)])), first


def _repeated(units: Units, homes: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]

        def flush() -> Iterator[pa.RecordBatch]:
            if sum(map(len, held[0])):
                rid, number = (np.concatenate(h) for h in held)
                order = np.lexsort((number, rid))
                rid, number = rid[order], number[order]
                once = np.r_[True, (rid[1:] != rid[:-1]) | (number[1:] != number[:-1])]
                rid, number = rid[once], number[once]
                yield _rows([(dest, _pack(rid[p], number[p])) for dest, p in _by(rid % homes)])
            held[0].clear()
            held[1].clear()

        for blobs in _groups(batches):
            give_back_memory()
            for b in blobs:
                if b[:1] == _DONE:
                    for h, x in zip(held, _unpack(b[1:], "i8", "u4"), strict=True):
                        h.append(x)
            parts = [_unpack(b[1:], "u4", "u1", "i8", "u4", "u1") for b in blobs if b[:1] == _OPEN]
            if parts:
                low, mid, rid, number, weight = (np.concatenate([p[k] for p in parts]) for k in range(5))
                anchor = low.astype(np.uint64) | mid.astype(np.uint64) << np.uint64(32)
                order = np.argsort(anchor, kind="stable")
                keep = order[_repeats(anchor[order], rid[order], weight[order], units.across)[0]]
                held[0].append(rid[keep])
                held[1].append(number[keep])
            if sum(map(len, held[0])) > 500_000:
                yield from flush()
        yield from flush()

    return work


def _sides(batches: Iterator[pa.RecordBatch], *types: str) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Batches of text rows, each with the arrays that its home has got (sorted by rid), from rows sorted by home, blobs first."""
    last, blobs, arrays = None, [], None
    for batch in batches:
        dest = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.r_[True, dest[1:] != dest[:-1], True])
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            part = batch.slice(a, b - a)
            if dest[a] != last:
                last, blobs, arrays = dest[a], [], None
            texts = np.asarray(part.column(1).is_null())
            blobs += [x.as_py() for x in part.column(1).drop_null()]
            part = part.filter(pa.array(texts))
            if part.num_rows:
                if arrays is None:
                    parts = [_unpack(x, "i8", *types) for x in blobs]
                    arrays = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in enumerate(("i8", *types))]
                    order = np.argsort(arrays[0], kind="stable")
                    arrays, blobs = [x[order] for x in arrays], []
                yield part, arrays


def _sent(units: Units, shards: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            rid, order = (np.array([h[k] for h in held], np.int64) for k in (0, 1))
            anchor = np.array([h[2] for h in held], np.uint64)
            first, windows = (np.array([h[k] for h in held], np.uint32) for k in (3, 4))
            sizes = np.array([len(h[5]) for h in held], np.uint32)
            part = (anchor >> np.uint64(32)).astype(np.uint8) % np.uint8(PARTS)
            known: dict[bytes, int] = {}
            which = np.array([known.setdefault(h[5], len(known)) for h in held], np.int64)
            # Of equal stretches, all but those of the smallest order have an earlier document; without orders, each has another.
            by = np.lexsort((order, which))
            head = np.r_[True, which[by][1:] != which[by][:-1]]
            least = order[by][head][which[by]] if units.across else None
            done = np.zeros(len(held), bool)
            done[by] = order[by] > least if units.across else ~head
            weight = np.ones(len(held), np.uint8)
            if not units.across:
                several = np.bincount(which)[which] > 1
                weight[several] = 2
                answered = several
            else:
                answered = done
            rows = [(dest, _DONE + _pack(rid[answered][p], first[answered][p], windows[answered][p])) for dest, p in _by(rid[answered] % shards)]
            i = np.flatnonzero(~done)
            for dest, p in _by(_shard(anchor[i], shards)):
                p = i[p]
                body = b"".join(held[k][5] for k in p)
                rows.append((dest, _OPEN + _pack(rid[p], order[p], first[p], windows[p], sizes[p], part[p], weight[p]) + zstandard.compress(body, 1)))
            yield _rows(rows)

        for part, (rids, numbers) in _sides(batches, "u4"):
            lo, hi = (np.searchsorted(rids, part.column(2).to_numpy(), side=s) for s in ("left", "right"))
            for i in np.flatnonzero(hi > lo):
                parsed = units.parse(part.column(4)[int(i)].as_py() or "")
                anchor, first, n = stretches(units.values(parsed), units)
                rid, order = part.column(2)[int(i)].as_py(), part.column(3)[int(i)].as_py()
                for k in np.unique(numbers[lo[i] : hi[i]]):
                    body = units.content(parsed, int(first[k]), int(first[k] + n[k]) + units.width - 1)
                    held.append((rid, order, anchor[k], first[k], n[k], body))
                    size += len(body) + 100
                if size > FLUSH_BYTES:
                    yield from flush()
                    held.clear()
                    size = 0
        if held:
            yield from flush()

    return work


def _read_stretches(blobs: list[bytes]) -> Iterator[Stretches]:
    """A shard's stretches, one part of its anchors after another, so that what a decision needs at once stays small."""
    known: list[dict[bytes, int]] = [{} for _ in range(PARTS)]
    windows: list[array] = [array("q") for _ in range(PARTS)]
    columns = []
    for blob in blobs:
        head = np.frombuffer(blob, "<u4", 8)
        end = int(32 + head[1:].sum())
        rid, order, first, n, sizes, part, weight = _unpack(blob[:end], "i8", "i8", "u4", "u4", "u4", "u1", "u1")
        body = zstandard.decompress(blob[end:], max_output_size=int(sizes.sum()) + 1)
        cuts = np.r_[0, np.cumsum(sizes)].tolist()
        which = array("q")
        for a, b, k, x in zip(cuts[:-1], cuts[1:], n.tolist(), part.tolist(), strict=True):
            at = known[x].setdefault(body[a:b], len(known[x]))
            if at == len(windows[x]):
                windows[x].append(k)
            which.append(at)
        columns.append((rid, order, first, part, np.frombuffer(which, np.int64), weight))
    if not columns:
        return
    rid, order, first, part, which, weight = (np.concatenate([c[k] for c in columns]) for k in range(6))
    for x in range(PARTS):
        mine = np.flatnonzero(part == x)
        if len(mine):
            yield Stretches(list(known[x]), np.frombuffer(windows[x], np.int64), which[mine], rid[mine], order[mine], first[mine].astype(np.int64), weight[mine])
        known[x] = {}


def _runs(s: Stretches, goes: Callable[[np.ndarray], np.ndarray], i: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rid, first window, number) of the runs of windows that go in occurrences i."""
    n = s.windows[s.which[i]]
    flags = goes(i)
    at = np.arange(len(flags)) - np.repeat(np.cumsum(n) - n, n)
    begins = np.flatnonzero(flags & ((at == 0) | ~np.r_[False, flags[:-1]]))
    ends = np.flatnonzero(flags & ((at == np.repeat(n, n) - 1) | ~np.r_[flags[1:], False]))
    owner = np.repeat(i, n)[begins]
    return s.rid[owner], (s.first[owner] + at[begins]).astype(np.uint32), (ends - begins + 1).astype(np.uint32)


def _decided(decide: Callable[[Stretches], Callable[[np.ndarray], np.ndarray]], homes: int):
    """decide() gets a shard's stretches and returns what tells, for occurrences given by index, which of their windows go: flags, window after window."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blobs in _groups(batches):
            give_back_memory()
            held = [(np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.uint32))]
            held += [tuple(_unpack(b[1:], "i8", "u4", "u4")) for b in blobs if b[:1] == _DONE]
            for s in _read_stretches([b[1:] for b in blobs if b[:1] == _OPEN]):
                goes = decide(s)
                for k in range(0, len(s.which), 20_000):
                    held.append(_runs(s, goes, np.arange(k, min(k + 20_000, len(s.which)))))
            rid, first, n = (np.concatenate([h[k] for h in held]) for k in range(3))
            order = np.lexsort((first, rid))
            rid, first, n = rid[order], first[order], n[order]
            if len(rid):
                yield _rows([(dest, _pack(rid[p], first[p], n[p])) for dest, p in _by(rid % homes)])

    return work


def _applied(units: Units, join: Callable[[object, np.ndarray], bytes], rest: list[str]):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*rest, "kept", "n_total", "n_removed", "n_spans"]
        for part, (rids, firsts, counts) in _sides(batches, "u4", "u4"):
            lo, hi = (np.searchsorted(rids, part.column(2).to_numpy(), side=s) for s in ("left", "right"))
            kept, numbers, begin, size = [], [], 0, 0
            for i in range(part.num_rows):
                parsed = units.parse(part.column(4)[i].as_py() or "")
                total = units.length(parsed)
                change = np.zeros(total + 1, np.int64)
                np.add.at(change, firsts[lo[i] : hi[i]].astype(np.int64), 1)
                np.add.at(change, firsts[lo[i] : hi[i]].astype(np.int64) + counts[lo[i] : hi[i]] + (units.width - 1), -1)
                stays = np.cumsum(change)[:total] == 0
                kept.append(join(parsed, stays))
                numbers.append((total, total - int(stays.sum()), int((np.diff(np.r_[True, stays].astype(np.int8)) < 0).sum())))
                size += len(kept[-1])
                if size > FLUSH_BYTES or i + 1 == part.num_rows:
                    struct = part.column(5).slice(begin, i + 1 - begin)
                    columns = [struct.field(k) for k in range(len(rest))]
                    counted = [pa.array([x[k] for x in numbers], pa.int64()) for k in range(3)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary()), *counted], names)
                    kept, numbers, begin, size = [], [], i + 1, 0

    return work


def remove_repeats(docs: DataFrame, units: Units, decide: Callable, join: Callable[[object, np.ndarray], bytes]) -> DataFrame:
    """Every row of docs, its columns followed by kept (binary), n_total, n_removed and n_spans (maximal removed runs). docs has doc_id and text."""
    spark = docs.sparkSession
    rest = docs.columns
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // (2 * SHARD_BYTES)))
    shards, homes = 2 * partitions, 2 * partitions
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**62)))
    if docs.where("doc_id is null").limit(1).count() or docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        # Rows that an id does not tell apart get numbers, written once so that they hold for all steps.
        docs = materialize(docs.withColumn("cairn_rid", F.monotonically_increasing_id()), "window-rows")
        rid = F.col("cairn_rid")
    else:
        rid = order
    none = F.lit(None)
    texts = docs.select(F.pmod(rid, F.lit(homes)).cast("long").alias("dest"), none.cast("binary").alias("blob"), rid.alias("rid"), order.alias("order"), "text", F.struct(*rest).alias("rest"))
    slim = texts.drop("rest")
    anchors = docs.select(rid.alias("rid"), "text").mapInArrow(_anchors(units, shards), _BLOBS)
    again = materialize(_dealt(anchors, partitions).mapInArrow(_repeated(units, homes), _BLOBS), "window-anchors", compression="none")

    def with_blobs(rows: DataFrame, blobs: DataFrame) -> DataFrame:
        typed = {f.name: f.dataType for f in rows.schema}
        filled = blobs.select(*[F.col(c) if c in ("dest", "blob") else none.cast(typed[c]).alias(c) for c in rows.columns])
        return _dealt(rows.unionByName(filled), partitions, "rid")

    sent = with_blobs(slim, again).mapInArrow(_sent(units, shards), _BLOBS)
    found = materialize(_dealt(sent, partitions).mapInArrow(_decided(decide, homes), _BLOBS), "window-decisions", compression="none")
    discard(again)
    fields = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in docs.select(*rest).schema)
    return with_blobs(texts, found).mapInArrow(_applied(units, join, rest), f"{fields}, kept binary, n_total bigint, n_removed bigint, n_spans bigint")
