"""Numbers that rank axes, steps and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rank_key(x: Column) -> Column:
    """Scores compare on a grid of a millionth, so that sums taken in another order rank alike."""
    return F.round(x * 1e6).cast("bigint")


def bits(p: Column) -> Column:
    """-p log2 p, 0 where p is not positive."""
    return F.when(p > 0, -p * F.log2(p)).otherwise(F.lit(0.0))


def step_bits(part: Column, whole: Column) -> Column:
    """Entropy of being in a part or not; 0 at none and all."""
    p = F.try_divide(part.cast("double"), whole.cast("double"))
    return F.when((p > 0) & (p < 1), bits(p) + bits(1 - p)).otherwise(F.lit(0.0))


def label_weight(count: Column, selected: Column, corpus: Column, df: Column) -> Column:
    """Share in the selection times ln(1 + corpus / files with the tag in the corpus)."""
    return F.when((selected > 0) & (df > 0), count / selected * F.log(1 + corpus / df)).otherwise(F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
