"""Exact top-k search by multi-resolution segment statistics.

Components are scaled to integers. Per vector, means and deviations of its segments are kept at several resolutions. For
two vectors q and c, the sum over segments of length * ((mean_q - mean_c)^2 + (dev_q - dev_c)^2) never exceeds their squared
distance, and the inner product is (|q|^2 + |c|^2 - distance^2) / 2: a lower bound of the distance bounds the score from
above. Coarse to fine, candidates whose bound is under the k-th score found so far go; the survivors' scores are computed
exactly, in integers.

A bounded number of queries is broadcast and meets every candidate block, each task keeping k rows a query, so that the
candidates are not shuffled. More queries are dealt into chunks and the candidates into ranges, both of bounded size; each chunk
meets each range in a group of its own, wherever there is room, and the driver handles no query. No pairs are stored either
way: the k best of each task or group are merged by query.

Vectors that are null, empty or hold null or non-finite components take no part; vectors of other lengths than the
query's are not compared; ties go to the smaller id; repeated rows are candidates of their own, and rows of the query's
own id are none; extra columns are ignored; an empty table gives an empty table. Scores beyond 64 bits are held at the
limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.llm.common import materialize
from cairn.llm.vectors import matrices

#: Queries in a broadcast or a chunk, rows of a candidate block and (about) of a candidate range, and segments at each resolution.
QUERIES_AT_ONCE = 4096
BLOCK = 4096
RANGE_ROWS = 1 << 18
SEGMENTS = (4, 16)
_MOST = float(2**63 - 1024)
_INTEGER = {"min": -(2**63), "max": 2**63 - 1}


def scaled(x: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as doubles that hold integers."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * x), -_MOST, _MOST)


def _segment_statistics(x: np.ndarray, n: int) -> np.ndarray:
    """Per row: the means and the deviations of n segments, each times the root of its length."""
    cuts = np.unique(np.linspace(0, x.shape[1], min(n, x.shape[1]) + 1).astype(int))
    size = np.diff(cuts).astype(float)
    mean = np.add.reduceat(x, cuts[:-1], axis=1) / size
    square = np.add.reduceat(x * x, cuts[:-1], axis=1) / size
    return np.hstack([mean, np.sqrt(np.maximum(square - mean * mean, 0))]) * np.sqrt(np.r_[size, size])


class _Search:
    """The queries of one chunk and one length, with the k best candidates of each so far."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int) -> None:
        self.ids, self.x, self.k = ids, x, k
        self.levels = [_segment_statistics(x, n) for n in SEGMENTS]
        self.best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
        self.floor = np.full(len(ids), -np.inf)

    def scores(self, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
        if len(rows) and np.abs(rows).max() * np.abs(q).max() * len(q) < 2**53:
            return (rows @ q).astype(np.int64)
        exact = [sum(int(a) * int(b) for a, b in zip(r, q, strict=True)) for r in rows]
        return np.array([min(max(s, _INTEGER["min"]), _INTEGER["max"]) for s in exact], np.int64)

    def meet(self, ids: np.ndarray, x: np.ndarray) -> None:
        levels = [_segment_statistics(x, n) for n in SEGMENTS]
        slack = 1 + 1e-9
        for i, own in enumerate(self.ids):
            alive = np.flatnonzero(ids != own)
            if np.isfinite(self.floor[i]):
                for mine, theirs in zip(self.levels, levels, strict=True):
                    # |q|^2 + |c|^2 - bound^2 comes to twice the product of the statistics.
                    bound = theirs[alive] @ mine[i]
                    alive = alive[bound * slack + slack >= self.floor[i]]
            if not len(alive):
                continue
            got_ids = np.r_[self.best[i][0], ids[alive]]
            got = np.r_[self.best[i][1], self.scores(x[alive], self.x[i])]
            top = np.lexsort((got_ids, -got.astype(np.float64) if np.abs(got).max() < 2**53 else [-int(g) for g in got]))[: self.k]
            self.best[i] = (got_ids[top], got[top])
            if len(top) == self.k:
                self.floor[i] = float(got[top[-1]])


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: float = 1024.0, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row of `vectors` that is_query chooses, its k highest inner products with the other rows."""
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    asking = rows.where("asks").select("vec_id", "embedding").where("vec_id is not null").distinct()
    n = asking.count()
    out = _local(rows, asking, k, scale) if n <= QUERIES_AT_ONCE else _dealt(rows, asking, n, k, scale)
    ranked = out.withColumn("rank", F.row_number().over(W.partitionBy("query_id", "vector").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _searches(table: pa.Table, k: int, scale: float) -> dict[int, tuple[np.ndarray, _Search]]:
    """For queries (vec_id, vector, embedding) of each length: their numbers and their search."""
    ids, numbers = (table.column(c).to_numpy() for c in ("vec_id", "vector"))
    found = matrices(table.column("embedding").combine_chunks()) if table.num_rows else []
    return {x.shape[1]: (numbers[r], _Search(ids[r], scaled(x, scale), k)) for r, x in found}


def _meet(searches: dict, batch: pa.RecordBatch, scale: float) -> None:
    """Candidates (vec_id, embedding) meet the queries."""
    batch = batch.filter(batch.column("vec_id").is_valid())
    names = batch.column("vec_id").to_numpy()
    for r, x in matrices(batch.column("embedding")):
        if x.shape[1] in searches:
            for i in range(0, len(r), BLOCK):
                searches[x.shape[1]][1].meet(names[r[i : i + BLOCK]], scaled(x[i : i + BLOCK], scale))


def _best(searches: dict) -> Iterator[pa.RecordBatch]:
    for numbers, s in searches.values():
        n = [len(b[0]) for b in s.best]
        columns = [np.repeat(s.ids, n), np.repeat(numbers, n), *(np.concatenate([b[j] for b in s.best]) for j in (0, 1))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vector", "vec_id", "score"])


_FOUND = "query_id bigint, vector bigint, vec_id bigint, score bigint"


def _local(rows: DataFrame, asking: DataFrame, k: int, scale: float) -> DataFrame:
    """Each task's k best rows for each query; `vector` numbers the queries. At most QUERIES_AT_ONCE queries come to the driver and are broadcast."""
    table = asking.orderBy("vec_id", "embedding").toArrow()
    table = table.append_column("vector", pa.array(np.arange(table.num_rows)))
    shared = rows.sparkSession.sparkContext.broadcast(table)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = _searches(shared.value, k, scale)
        for batch in batches:
            _meet(searches, batch, scale)
        yield from _best(searches)

    return rows.select("vec_id", "embedding").mapInArrow(work, _FOUND)


def _dealt(rows: DataFrame, asking: DataFrame, n: int, k: int, scale: float) -> DataFrame:
    """The k best rows of each range for each query of each chunk, queries first in a group."""
    queries = materialize(asking.withColumn("vector", F.monotonically_increasing_id()), "top-k-queries")
    chunks, ranges = -(-2 * n // QUERIES_AT_ONCE), max(1, -(-rows.count() // RANGE_ROWS))
    each = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    none = F.lit(None).cast("long")
    q = queries.select(F.pmod(F.xxhash64("vector"), F.lit(chunks)).alias("chunk"), each(ranges).alias("range"), F.lit(0).alias("side"), "vector", "vec_id", "embedding")
    # Dealt in turn, so that rows of one id are spread.
    c = rows.where("vec_id is not null").select("vec_id", "embedding", F.pmod(F.monotonically_increasing_id(), F.lit(ranges)).alias("range"))
    c = c.select(each(chunks).alias("chunk"), "range", F.lit(1).alias("side"), none.alias("vector"), "vec_id", "embedding")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, asked, searches = None, [], None
        for batch in batches:
            keys = np.stack([batch.column(x).to_numpy() for x in ("chunk", "range", "side")])
            cuts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0), True]) if batch.num_rows else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                group, side, part = tuple(keys[:2, a]), keys[2, a], batch.slice(a, b - a)
                if group != last:
                    if searches:
                        yield from _best(searches)
                    last, asked, searches = group, [], None
                if side == 0:
                    asked.append(part)
                    continue
                if searches is None:
                    searches = _searches(pa.Table.from_batches(asked), k, scale) if asked else {}
                _meet(searches, part, scale)
        if searches:
            yield from _best(searches)

    return q.unionByName(c).repartition("chunk", "range").sortWithinPartitions("chunk", "range", "side").mapInArrow(work, _FOUND)
