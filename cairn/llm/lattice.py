"""Embedding near-duplicates by lattice hashing.

Each of several tables projects a unit vector to eight random orthogonal directions, shifts and scales it, and decodes
it to the nearest point of the lattice E8. A vector is entered at that point's cell and at the neighbouring cells nearest to it,
so two vectors meet if either lies close to the other's cell. Vectors that meet are verified by cosine in double precision, block by block; a pair
that meets in several cells counts in the smallest of them. Equal vectors are one class, compared once.

Vectors that are null, empty, zero or hold null or non-finite components link with nothing; neither do vectors of
different lengths. Repeated rows, and rows of one id, are vectors of their own. Null ids are vectors too; they are passed over where the
smallest id is looked for (the component of null ids alone is null). Extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import cells
from cairn.llm.common import materialize
from cairn.llm.components import connected_components
from cairn.llm.vectors import matrices

#: Tables, neighbouring cells that a vector is entered at besides its own, the lattice's scale against unit vectors, and the seed of the projections.
TABLES = 6
PROBES = 1
SCALE = 0.6
SEED = 20_011
THRESHOLD = 0.95
#: Vectors hashed at once.
BLOCK = 4096

_MIX = np.uint64(0x9E3779B97F4A7C15)


def _minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for s, t in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


_NEIGHBOURS = _minimal_vectors()


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """The nearest points with whole coordinates of even sum."""
    p = np.rint(y)
    odd = np.flatnonzero(p.sum(axis=1).astype(np.int64) & 1)
    off = (y - p)[odd]
    worst = np.abs(off).argmax(axis=1)
    p[odd, worst] += np.where(off[np.arange(len(odd)), worst] >= 0, 1, -1)
    return p


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """The nearest points of E8: D8 or D8 moved by one half in every coordinate."""
    a, b = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1))[:, None], a, b)


def _cell(points: np.ndarray, table: int, length: int) -> np.ndarray:
    h = np.full(len(points), np.uint64(table * 1_000_003 + length))
    for c in np.rint(2 * points).astype(np.int64).astype(np.uint64).T:
        h = (h ^ c) * _MIX
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


@lru_cache(maxsize=256)
def _projection(table: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """A table's eight directions and shift for vectors of a length."""
    rng = np.random.Generator(np.random.PCG64([SEED, table, length]))
    wide = max(8, length)
    return np.linalg.qr(rng.standard_normal((wide, 8)))[0] * np.sqrt(wide / 8), rng.random(8)


def lattice_cells(x: np.ndarray, tables: int = TABLES, probes: int = PROBES, scale: float = SCALE) -> np.ndarray:
    """The cells of unit vectors, tables * (1 + probes) for each."""
    d = x.shape[1]
    wide = np.hstack([x, np.zeros((len(x), max(0, 8 - d)))])
    out = []
    for t in range(tables):
        basis, shift = _projection(t, d)
        y = wide @ basis / scale + shift
        p = nearest_e8(y)
        out.append(_cell(p, t, d))
        near = np.argsort(-((y - p) @ _NEIGHBOURS.T), axis=1, kind="stable")[:, :probes]
        out += [_cell(p + _NEIGHBOURS[near[:, k]], t, d) for k in range(probes)]
    return np.stack(out, axis=1)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows over their lengths, in doubles; rows of zeros stay."""
    top = np.abs(x).max(axis=1)
    z = x / np.where(top > 0, top, 1)[:, None]
    return z / np.maximum(np.linalg.norm(z, axis=1), np.finfo(float).tiny)[:, None] + 0.0


def _vectors(kind: str):
    """vec_id, vector (the components as they are given, in bytes; null where it takes no part), same (equal for vectors of one direction)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vector: list[bytes | None] = [None] * batch.num_rows
            same: list[bytes | None] = [None] * batch.num_rows
            for rows, x in matrices(batch.column(1)):
                some = x.any(axis=1)
                for r, v, u in zip(rows[some], x[some].astype(kind), unit_rows(x[some]), strict=True):
                    vector[r], same[r] = v.tobytes(), hashlib.blake2b(u.tobytes(), digest_size=16).digest()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vector, pa.binary()), pa.array(same, pa.binary())], ["vec_id", "vector", "same"])

    return work


def _hashed(kind: str):
    """Adds the cells of each vector."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            sizes = pc.binary_length(vectors).to_numpy()
            found: list[list[int]] = [[]] * batch.num_rows
            for n in np.unique(sizes):
                rows = np.flatnonzero(sizes == n)
                for k in range(0, len(rows), BLOCK):
                    some = rows[k : k + BLOCK]
                    got = lattice_cells(unit_rows(np.stack([np.frombuffer(vectors[int(r)].as_py(), kind) for r in some]).astype(float)))
                    for r, c in zip(some, got, strict=True):
                        found[r] = np.unique(c).tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], [*batch.schema.names, "cells"])

    return work


def _verified(threshold: float, kind: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def finish() -> Iterator[pa.RecordBatch]:
            # The cells of members with links are found again here, for many groups at once: so they need not travel with every member.
            found = lattice_cells(np.concatenate([h[-1] for h in held]))
            out: list[list[np.ndarray]] = [[], [], []]
            begin = 0
            for cell, member, n, a, b, x in held:
                keep = owned_pairs(cell, found[begin : begin + len(x)], a, b)
                begin += len(x)
                links = np.zeros(len(member), np.int64)
                np.add.at(links, a[keep], n[b[keep]])
                np.add.at(links, b[keep], n[a[keep]])
                root = member.copy()
                while True:  # the smallest member reachable inside the group
                    low = np.minimum(root[a], root[b])
                    new = root.copy()
                    np.minimum.at(new, a, low)
                    np.minimum.at(new, b, low)
                    if (new == root).all():
                        break
                    root = new
                some = (links > 0) | (root != member)
                for o, v in zip(out, (member[some], links[some], root[some]), strict=True):
                    o.append(v)
            held.clear()
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], ["member", "links", "root"])

        size = 0
        for g in cells.each_group(batches):
            if g.num_rows < 2:
                continue
            cell, i, j = (g.column(k)[0].as_py() for k in cells.KEYS)
            block, member, n = (g.column(k).to_numpy() for k in ("block", "member", "n"))
            x = unit_rows(cells.fixed_width(g.column("vector"), kind).astype(float))
            linked = np.triu(x @ x.T >= threshold, 1)
            if i != j:
                linked &= block[:, None] != block[None, :]
            a, b = np.nonzero(linked)
            if not len(a):
                continue
            if held and held[-1][-1].shape[1] != x.shape[1]:
                yield from finish()
                size = 0
            some = np.unique(np.r_[a, b])
            held.append((cell, member[some], n[some], np.searchsorted(some, a), np.searchsorted(some, b), x[some]))
            size += len(some) + len(a) // 100
            if size > BLOCK:
                yield from finish()
                size = 0
        if held:
            yield from finish()

    return work


def owned_pairs(cell: int, width: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a), bool)
    for k in range(0, len(a), 20_000):
        out[k : k + 20_000] = cells.owned(cell, width[a[k : k + 20_000]], width[b[k : k + 20_000]])
    return out


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    kind = "f4" if rows.schema["embedding"].dataType.simpleString() == "array<float>" else "f8"
    units = materialize(rows.mapInArrow(_vectors(kind), "vec_id bigint, vector binary, same binary"), "lattice-vectors")
    classes = units.where("same is not null").groupBy("same").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    # Ids may be null or repeated; classes have numbers of their own, written once so that they hold for all steps.
    classes = classes.select(F.monotonically_increasing_id().alias("member"), "vector", "n", "same", "least")
    hashed = classes.mapInArrow(_hashed(kind), "member bigint, vector binary, n bigint, same binary, least bigint, cells array<bigint>")
    hashed = materialize(hashed, "lattice-cells")
    light = hashed.select("member", F.explode("cells").alias("cell"))
    met = cells.groups(light, cells.crowded(light)).join(hashed.select("member", "vector", "n"), "member")
    met = cells.dealt(met.select("cell", "i", "j", "block", "member", "n", "vector"))
    found = materialize(met.mapInArrow(_verified(threshold, kind), "member bigint, links bigint, root bigint"), "lattice-links")
    links = found.groupBy("member").agg(F.sum("links").alias("links"))
    parts = connected_components(found.where("member != root").select(F.col("member").alias("a"), F.col("root").alias("b")))
    known = hashed.select("same", "member", "n", "least").join(links, "member", "left").join(parts.withColumnRenamed("node", "member"), "member", "left")
    known = known.select("same", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "member").alias("component"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(least, "component").select("same", "n_links", "component_id")
    out = units.select("vec_id", "same", F.col("same").isNull().alias("alone")).join(known, "same", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("alone"), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
