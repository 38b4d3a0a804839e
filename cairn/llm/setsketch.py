"""MinHash near-duplicates with SetSketch registers.

Every shingle is a Poisson process of points, each of which falls to a random register; a register keeps its earliest
point, so that registers hold independent exponential minima, and stores it truncated to an exponential scale. Registers of
unions are the maxima of registers. Bands of registers are the cells in which documents meet. For two documents that
meet, the counts of larger, smaller and equal registers give the likelihood of every Jaccard similarity jointly; pairs
whose likelihood at the threshold is far below the best go. The rest are confirmed on their full sets.

Only what can change the components is confirmed. Texts of equal sets are one class. First each class is paired with the
best of its cells' smallest members. In cells that still hold different components, each member is then paired with one
member of another component, and at last every likely pair of different components is confirmed, block by block, by the
members' full sets. Pairs inside one component can change nothing, and no group's pairs are listed.

Null and blank texts have empty sets and link with nothing. Repeated rows, and rows of one id with different texts, are documents of
their own. Null ids are documents too; they are passed over where the smallest id is looked for (the component of null
ids alone is null). Extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import cells
from cairn.llm.common import discard, give_back_memory, materialize
from cairn.llm.components import connected_components
from cairn.llm.shingles import MULTIPLIER, mixed, shingle_set

#: Bands, registers of a band, and the base of the registers' scale.
BANDS = 25
ROWS = 5
BASE = 1.001
THRESHOLD = 0.8
#: How far, in units of log likelihood, the threshold may lie below the best similarity (five standard deviations).
SLACK = 12.5
REGISTERS = BANDS * ROWS
#: Turns in which each member of a cell with several components is compared with one member of another, before all likely pairs of different components are.
TURNS = 1
#: Bytes that a shingle of a text takes where full sets are compared, with its words (about).
SHINGLE_BYTES = 24
#: Shingles sketched at once.
AT_ONCE = 200_000


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (uint16, one row for each set). A register is floor(1 - log_BASE(earliest point)), held in 0 to 65535; an empty set's are 0."""
    n = np.array([len(s) for s in sets], np.int64)
    first = np.full((len(sets), REGISTERS), np.inf)
    flat = first.ravel()
    state = np.concatenate([np.zeros(0, np.uint64), *sets])
    owner = np.repeat(np.arange(len(sets)), n)
    at = np.zeros(len(state))
    late = np.full(len(sets), np.inf)
    while len(state):
        state = state + MULTIPLIER
        z = mixed(state)
        at = at - np.log1p(-(z >> np.uint64(11)).astype(np.float64) * 2.0**-53) / REGISTERS
        register = ((z & np.uint64(0x7FF)) * np.uint64(REGISTERS)) >> np.uint64(11)
        np.minimum.at(flat, owner * REGISTERS + register.astype(np.int64), at)
        # A later point of a shingle can matter only before the latest of its document's registers.
        held = np.unique(owner)
        late[held] = first[held].max(axis=1)
        alive = at < late[owner]
        state, owner, at = state[alive], owner[alive], at[alive]
    with np.errstate(divide="ignore"):
        k = np.floor(1 - np.log(first) / np.log(BASE)) + 30_000
    return np.where(np.isfinite(first), np.clip(k, 1, 65535), 0).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


_GRID = np.linspace(0, 1, 101)


def _log_likelihood(larger: np.ndarray, smaller: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, j: np.ndarray) -> np.ndarray:
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.minimum(np.atleast_2d(j), np.minimum(u / v, v / u))
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    return larger[:, None] * np.log(up + tiny) + smaller[:, None] * np.log(down + tiny) + equal[:, None] * np.log(np.maximum(1 - up - down, 0) + tiny)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """(likeliest similarity, whether the threshold or more is likely enough) of pairs of registers with known set sizes. Sizes alone rule out pairs whose smaller set is under threshold times the larger."""
    larger, smaller = (a > b).sum(axis=1), (a < b).sum(axis=1)
    equal = a.shape[1] - larger - smaller
    ll = _log_likelihood(larger, smaller, equal, n_a, n_b, _GRID)
    best = _GRID[ll.argmax(axis=1)]
    at = _log_likelihood(larger, smaller, equal, n_a, n_b, np.full((len(a), 1), threshold))[:, 0]
    possible = np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b)
    return best, possible & ((best >= threshold) | (ll.max(axis=1) - at <= SLACK))


def _sketched(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            begin = 0
            while begin < batch.num_rows:
                sets, total, stop = [], 0, begin
                while stop < batch.num_rows and total < AT_ONCE:
                    sets.append(shingle_set(batch.column(1)[stop].as_py(), k))
                    total += len(sets[-1])
                    stop += 1
                got = sketches(sets)
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(begin, stop - begin), batch.column(2).slice(begin, stop - begin), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([r.tobytes() for r in got], pa.binary())],
                    ["row", "doc_id", "n_shingles", "same", "registers"],
                )
                begin = stop
        give_back_memory()

    return work


def _band_cells(registers: np.ndarray) -> np.ndarray:
    r = registers.reshape(-1, BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), r.shape[:2])
    for i in range(ROWS):
        h = mixed(h * MULTIPLIER + r[:, :, i])
    return h.view(np.int64)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            h = _band_cells(cells.fixed_width(pa.chunked_array([batch.column(1)]), "u2"))
            yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(batch.column(k).to_numpy(), BANDS)) for k in (0, 2)), pa.array(h.ravel())], ["member", "n", "cell"])


def _likely(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """a, b, estimate of the pairs (a, n_a, registers_a, b, n_b, registers_b) that are likely enough."""
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (cells.fixed_width(pa.chunked_array([batch.column(c)]), "u2") for c in ("r_a", "r_b"))
        best, keep = estimate(x, y, *(batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b")), threshold)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(best)], ["a", "b", "estimate"]).filter(pa.array(keep))


def _across(threshold: float, turn: int | None):
    """Likely pairs of different components inside each group. With a turn: only one partner for each member, the one with most equal registers save for a small shift that differs from turn to turn."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in cells.each_group(batches):
            member, part, block, n = (g.column(c).to_numpy() for c in ("member", "component", "block", "n"))
            i, j = g.column("i")[0].as_py(), g.column("j")[0].as_py()
            ok = np.triu(part[:, None] != part[None, :], 1)
            ok &= np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :])
            if i != j:
                ok &= block[:, None] != block[None, :]
            a, b = np.nonzero(ok)
            if not len(a):
                continue
            r = cells.fixed_width(g.column("registers"), "u2")
            found, equals = [], []
            for k in range(0, len(a), 20_000):
                x, y = a[k : k + 20_000], b[k : k + 20_000]
                equal = (r[x] == r[y]).sum(axis=1)
                # Far below what the threshold gives; saves the likelihoods of pairs that are nowhere near.
                near = np.flatnonzero(equal >= REGISTERS // 2)
                if len(near) and turn is None:
                    near = near[estimate(r[x[near]], r[y[near]], n[x[near]].astype(float), n[y[near]].astype(float), threshold)[1]]
                found.append(near + k)
                equals.append(equal[near])
            found, equals = np.concatenate(found), np.concatenate(equals)
            x, y = member[a[found]], member[b[found]]
            if turn is not None and len(found):
                shift = (mixed(x.view(np.uint64) * MULTIPLIER + y.view(np.uint64) + np.uint64(turn)) >> np.uint64(58)).astype(np.int64)
                score, at, who = np.tile(16 * equals + shift, 2), np.tile(np.arange(len(x)), 2), np.r_[x, y]
                order = np.lexsort((-score, who))
                first = order[np.r_[True, who[order][1:] != who[order][:-1]]]
                chosen = np.unique(at[first])
                x, y = x[chosen], y[chosen]
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["a", "b"])

    return work


def _taking_part(threshold: float):
    """cell, i, j, member of the members of a group that have a likely partner in another component."""
    pairs = _across(threshold, None)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in cells.each_group(batches):
            found = [m for b in pairs(iter(g.combine_chunks().to_batches())) for c in ("a", "b") for m in b.column(c).to_pylist()]
            if found:
                rows = pa.array(sorted(set(found)), pa.int64())
                keys = [pa.array([g.column(k)[0].as_py()] * len(rows), pa.int64()) for k in cells.KEYS]
                yield pa.RecordBatch.from_arrays([*keys, rows], [*cells.KEYS, "member"])

    return work


def _linked(words: int, threshold: float):
    """a, b: the members of different components in a group that their full sets link; each pair is looked at in the smallest cell that both are in."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in cells.each_group(batches):
            member, part, block, n = (g.column(c).to_numpy() for c in ("member", "component", "block", "n"))
            cell, i, j = (g.column(k)[0].as_py() for k in cells.KEYS)
            ok = np.triu(part[:, None] != part[None, :], 1)
            ok &= np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :])
            if i != j:
                ok &= (block[:, None] != block[None, :]) & (member[:, None] != member[None, :])
            a, b = np.nonzero(ok)
            r = cells.fixed_width(g.column("registers"), "u2")
            home = _band_cells(r)
            sets: dict[int, np.ndarray] = {}
            text = g.column("text")
            for k in range(0, len(a), 20_000):
                x, y = a[k : k + 20_000], b[k : k + 20_000]
                near = np.flatnonzero((r[x] == r[y]).sum(axis=1) >= REGISTERS // 2)
                near = near[cells.owned(cell, home[x[near]], home[y[near]])]
                if len(near):
                    near = near[estimate(r[x[near]], r[y[near]], n[x[near]].astype(float), n[y[near]].astype(float), threshold)[1]]
                x, y = x[near], y[near]
                for m in np.unique(np.r_[x, y]).tolist():
                    if m not in sets:
                        sets[m] = shingle_set(text[m].as_py(), words)
                keep = np.array([_similar(sets[p], sets[q], threshold) for p, q in zip(x.tolist(), y.tolist(), strict=True)], bool)
                if keep.any():
                    yield pa.RecordBatch.from_arrays([pa.array(member[x[keep]]), pa.array(member[y[keep]])], ["a", "b"])
        give_back_memory()

    return work


def _similar(x: np.ndarray, y: np.ndarray, threshold: float) -> bool:
    """Whether two ascending sets have the Jaccard similarity; the larger is searched for the smaller's values."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return both >= threshold * (len(x) + len(y) - both) - 1e-9


def _confirmed(k: int, threshold: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for s, t in zip(batch.column("text_a"), batch.column("text_b"), strict=True):
                keep.append(_similar(shingle_set(s.as_py(), k), shingle_set(t.as_py(), k), threshold))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        give_back_memory()

    return work


def _confirm(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    one = texts.select(F.col("member").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("member").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    return materialize(both.mapInArrow(_confirmed(k, threshold), "a bigint, b bigint"), "setsketch-links")


def near_duplicates(docs: DataFrame, shingle_words: int, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    unique = not _has_repeats(rows)
    # Rows that an id does not tell apart get numbers, written once so that they hold for all steps.
    rows = rows.withColumn("row", F.col("doc_id")) if unique else materialize(rows.withColumn("row", F.monotonically_increasing_id()), "setsketch-rows")
    sketched = rows.select("row", "text", "doc_id").mapInArrow(_sketched(shingle_words), "row bigint, doc_id bigint, n_shingles bigint, same binary, registers binary")
    sketched = materialize(sketched, "setsketch-documents")
    classes = sketched.where("same is not null").groupBy("same")
    classes = classes.agg(F.min("row").alias("member"), F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers"))
    classes = materialize(classes, "setsketch-classes")
    members = materialize(classes.select("member", "registers", "n").mapInArrow(_bands, "member bigint, n bigint, cell bigint"), "setsketch-cells")
    sizes = members.groupBy("cell").agg(F.count("*").alias("n"), F.min("member").alias("leader")).where("n > 1")
    led = members.join(sizes, "cell").where("member != leader").select("member", "leader").distinct()
    side = lambda x: classes.select(F.col("member").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    met = led.select(F.col("member").alias("a"), F.col("leader").alias("b")).join(side("a"), "a").join(side("b"), "b")
    likely = met.mapInArrow(lambda batches: _likely(batches, threshold), "a bigint, b bigint, estimate double")
    best = likely.groupBy("a").agg(F.max_by("b", F.struct(F.col("estimate"), -F.col("b"))).alias("b"))
    # One text stands for each class: that of its smallest row.
    texts = rows.select(F.col("row").alias("member"), "text").join(classes.select("member"), "member", "left_semi")
    links = _confirm(best, texts, shingle_words, threshold)
    for turn in [*range(TURNS), None]:
        parts = connected_components(links)
        labelled = members.join(parts, members.member == parts.node, "left").select("cell", "member", F.col("n").alias("words"), F.coalesce("component", "member").alias("component"))
        open_cells = labelled.groupBy("cell").agg(F.count("*").alias("n"), (F.sum("words") * SHINGLE_BYTES).alias("bytes"), F.min("component").alias("least"), F.max("component").alias("most"))
        open_cells = open_cells.where("least != most").select("cell", cells.blocks("n", "bytes").alias("blocks"))
        opened = materialize(labelled.join(open_cells, "cell").select("cell", "member", "component", "blocks"), "setsketch-open")
        again = cells.groups_across(opened)
        again = again.join(classes.select("member", "n", "registers"), "member").select("cell", "i", "j", "block", "member", "component", "n", "registers")
        if turn is not None:
            pairs = materialize(cells.dealt(again).mapInArrow(_across(threshold, turn), "a bigint, b bigint").distinct(), "setsketch-pairs")
            more = _confirm(pairs, texts, shingle_words, threshold)
        else:
            pairs = materialize(cells.dealt(again).mapInArrow(_taking_part(threshold), "cell bigint, i bigint, j bigint, member bigint"), "setsketch-members")
            last = again.join(pairs, [*cells.KEYS, "member"], "left_semi").join(texts, "member")
            last = cells.dealt(last.select("cell", "i", "j", "block", "member", "component", "n", "registers", "text"))
            more = materialize(last.mapInArrow(_linked(shingle_words, threshold), "a bigint, b bigint"), "setsketch-links")
        both = materialize(links.unionByName(more), "setsketch-links")
        discard(links, more, pairs, parts, opened)
        links = both
    parts2 = connected_components(links)
    known = classes.select("same", "member", "least").join(parts2.withColumnRenamed("node", "member"), "member", "left")
    known = known.select("same", "least", F.coalesce("component", "member").alias("component"))
    if unique:
        known = known.select("same", F.col("component").alias("component_id"))
    else:
        least = known.groupBy("component").agg(F.min("least").alias("component_id"))
        known = known.join(least, "component").select("same", "component_id")
    out = sketched.select("doc_id", "n_shingles", "same").join(known, "same", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("same").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    discard(members, links)
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _has_repeats(rows: DataFrame) -> bool:
    """Whether an id is null or stands in several rows."""
    return bool(rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count())
