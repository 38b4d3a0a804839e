"""Members of hash cells compared block by block: what candidate search by locality-sensitive cells shares.

A cell of up to BLOCK members is one group. A larger one is dealt into blocks, and every pair of blocks is a group of its own, so no task
holds more than two blocks however many rows share a cell, and no pair is left out. Where only pairs of different
components matter, the blocks of all members meet only blocks of those outside the cell's largest component: a crowd that is one
component already costs a row for each member, and not one for each pair of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1024
#: Weight of a block at most (about), where members have weights: bytes of what is compared.
BLOCK_BYTES = 32 << 20
KEYS = ("cell", "i", "j")


def crowded(light: DataFrame) -> DataFrame:
    """cell, n of the cells with two members or more; light: cell, member."""
    return light.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1")


def groups(light: DataFrame, sizes: DataFrame) -> DataFrame:
    """cell, i, j, block, member: one row for each group that a member of a cell in `sizes` belongs to."""
    d = light.join(sizes, "cell").withColumn("blocks", F.ceil(F.col("n") / BLOCK))
    d = d.withColumn("block", F.pmod(F.xxhash64("member", F.lit(17)), F.col("blocks")))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return d.select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "member")


def blocks(n: str, size: str) -> Column:
    """How many blocks a cell of n members and so many bytes is dealt into."""
    return F.ceil(F.greatest(F.col(n) / BLOCK, F.col(size) / BLOCK_BYTES))


def groups_across(rows: DataFrame) -> DataFrame:
    """cell, i, j, block, member, component as groups() has them, for pairs of different components; rows: cell, member, component and the cell's blocks, from a table, as they are read several times."""
    zero = F.lit(0).cast("long")
    small = rows.where("blocks <= 1").select("cell", zero.alias("i"), zero.alias("j"), zero.alias("block"), "member", "component")
    large = rows.where("blocks > 1")
    per = large.groupBy("cell", "component", "blocks").agg(F.count("*").alias("c"))
    most = per.groupBy("cell", "blocks").agg(F.max_by("component", F.struct("c", "component")).alias("crowd"), F.max("c").alias("c"), F.sum("c").alias("n"))
    others = F.greatest(F.ceil((F.col("n") - F.col("c")) * F.col("blocks") / F.col("n")), F.lit(1)).cast("long")
    large = large.join(most.select("cell", "crowd", others.alias("minor")), "cell")
    mine = F.pmod(F.xxhash64("member", F.lit(17)), F.col("blocks"))
    upto = lambda c: F.explode(F.sequence(zero, F.col(c) - 1))
    all_of = large.withColumn("i", mine).withColumn("k", upto("minor")).select("cell", "i", (-1 - F.col("k")).alias("j"), F.col("i").alias("block"), "member", "component")
    few = large.where("component != crowd").withColumn("k", F.pmod(F.xxhash64("member", F.lit(29)), F.col("minor"))).withColumn("i", upto("blocks"))
    few = few.select("cell", "i", (-1 - F.col("k")).alias("j"), (-1 - F.col("k")).alias("block"), "member", "component")
    return small.unionByName(all_of).unionByName(few)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows with all of a group in one partition, one group after another."""
    return rows.repartition(*KEYS).sortWithinPartitions(*KEYS)


def each_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The groups of dealt() rows, whole, though batches cut them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(k).to_numpy() for k in KEYS])
        cuts = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1
        if last is not None and tuple(keys[:, 0]) != last and held:
            yield pa.Table.from_batches(held)
            held = []
        bounds = [0, *cuts.tolist(), batch.num_rows]
        for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if k and held:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(keys[:, -1])
    if held:
        yield pa.Table.from_batches(held)


def fixed_width(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    """A column of equally long binaries as a matrix."""
    return np.stack([np.frombuffer(x.as_py(), dtype) for x in column])


def owned(cell: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For pairs of members given by the sets of cells they are in (one row each): whether `cell` is the smallest they share. So a pair that meets in many cells counts in one."""
    out = np.zeros(len(a), bool)
    for k in range(0, len(a), 20_000):
        x, y = a[k : k + 20_000], b[k : k + 20_000]
        common = (x[:, :, None] == y[:, None, :]).any(axis=2)
        out[k : k + 20_000] = np.where(common, x, np.iinfo(np.int64).max).min(axis=1) == cell
    return out
