"""Connected components of a table of links, without collecting links or nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import discard, materialize


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first())


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the smallest node reachable) for every node that has a link and is not itself its component's smallest. Stars are contracted in turns: each node's larger, then its smaller neighbours are linked to its smallest neighbour, until nothing changes; every turn is written, so that the plan stays small and a lost executor costs one turn."""
    e = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    e = materialize(e, "components")
    before = _checksum(e)
    while before[0]:
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.least("m", "x").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = materialize(small.unionByName(small_least.select("u", F.col("m").alias("v"))).distinct(), "components")
        after = _checksum(new)
        discard(e)
        e = new
        if after == before:
            break
        before = after
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    out.cairn_path = e.cairn_path
    return out
