"""Mixing sources to target weights by a low-discrepancy source schedule. DataFrame functions only.

Every source's documents are shuffled (by a digest of the id) into one stream of tokens that repeats as often as the
target asks, and the stream is cut into blocks of equal token counts (the last one may be shorter). Golden-ratio points, mapped through the
sources' cumulative shares of all blocks, say whose block each slot takes; a point's rank among its source's points is the block's
number. Only blocks that a slot takes are in the mix. There are twice as many points as blocks and some: N points leave no gap of 2 / N,
so that every stretch of the unit interval as long as k blocks' share is hit k times or more, and each source has all its blocks
taken; points of sources that have no blocks left take nothing. So each prefix of the slots is close to the target weights, up to
where the first source is used up, and the whole meets them.

No step sorts or sums a whole source in one task: positions in a stream and ranks of points come from sums of bounded
buckets, then of rows in a bucket. Nulls: a null text has no words, a null source is a source, the last one. Documents without
words and sources without words take nothing. Repeated rows are documents of their own. Empty tables give empty tables.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.llm.common import WORD, materialize

GOLDEN = 0.6180339887498949
#: Points ranked together, chunks of points numbered together and made in one task (at least), and what a step of so many points and chunks adds, reduced.
POINTS_IN_CHUNK = 8192
CHUNKS_IN_ROW = 8192
CHUNKS_IN_TASK = 16
_PHI = (Decimal(5).sqrt() - 1) / 2
CHUNK_STEP = float(_PHI * POINTS_IN_CHUNK % 1)
ROW_STEP = float(_PHI * POINTS_IN_CHUNK * CHUNKS_IN_ROW % 1)
#: Words of a source that are summed together (about); points beyond twice the blocks; sources up to which their stretches are broadcast.
BUCKET_WORDS = 1 << 20
SPARE_POINTS = 16
BROADCAST_SOURCES = 50_000
#: Cells of the unit interval by which points meet the sources that cover them, at least.
CELLS = 1024


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], repeats: int) -> DataFrame:
    """One row per source: source, source_size, weight, target. Sources in code point order, null last, get the weights in turn and share all words; no target exceeds `repeats` times its source's size, what is over is shared again by weight. That level is found in closed form: with sources in order of cap over weight, a source is capped if its cap is under its share of what the ones before it leave; the first that is not sets the level (levels fall from there on). The work is on one row per source."""
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = F.lit(1)
    by_name = W.partitionBy(one).orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    s = s.withColumn("weight", F.element_at(turn, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size").cast("double") * repeats)
    by_cap = W.partitionBy(one).orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    every = W.partitionBy(one)
    before = by_cap.rowsBetween(W.unboundedPreceding, -1)
    s = s.withColumn("left_words", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    s = s.withColumn("left_weight", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("level", F.col("left_words") / F.col("left_weight"))
    s = s.withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    s = s.withColumn("common", F.max(F.when(~F.col("capped"), F.col("level"))).over(every))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least(F.col("common") * F.col("weight"), F.col("cap")))
    return s.select("source", "source_size", "weight", target.alias("target"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def positions(sizes: DataFrame, digits: int) -> DataFrame:
    """Adds `start`: where a document's words begin in its source's shuffled stream. Its first `digits` hexadecimal digits name a digest's bucket."""
    d = sizes.withColumn("digest", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    d = d.withColumn("bucket", F.substring("digest", 1, digits))
    sums = d.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    inside = W.partitionBy("source", "bucket").orderBy("digest", "size", "tie").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(sums, _same(d.source, sums.s) & (d.bucket == sums.b))
    return d.withColumn("start", F.col("offset") + F.col("within")).drop("s", "b", "offset", "within", "bucket", "digest", "tie")


def schedule(targets: DataFrame, block_words: int) -> DataFrame:
    """slot, source, block: which source's next block each slot takes. Point s falls at the fraction of s times the golden ratio; a source owns the stretch of the unit interval that its blocks are of all blocks. targets must be written: it is read several times."""
    one = F.lit(1)
    order = W.partitionBy(one).orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    t = targets.where("target >= 1").withColumn("blocks", F.ceil(F.floor("target") / block_words))
    n, blocks = t.agg(F.count("*"), F.coalesce(F.sum("blocks"), F.lit(0))).first()
    n_cells = max(CELLS, n)
    t = t.withColumn("hi", F.sum("blocks").over(order) / F.lit(float(blocks or 1)))
    t = t.withColumn("lo", F.coalesce(F.lag("hi").over(order), F.lit(0.0)))
    cell = F.explode(F.sequence(F.floor(F.col("lo") * n_cells), F.least(F.floor(F.col("hi") * n_cells), F.lit(n_cells - 1))))
    stretches = t.select("source", "lo", "hi", "blocks", cell.alias("cell"))
    chunks = -(-(2 * blocks + SPARE_POINTS) // POINTS_IN_CHUNK) if blocks else 0
    points = targets.sparkSession.range(0, chunks, 1, max(1, min(chunks // CHUNKS_IN_TASK, 4096))).select(F.col("id").alias("chunk"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(POINTS_IN_CHUNK - 1).cast("long"))).alias("i"))
    # Rows of chunks, chunks and points are reduced apart, so that large slot numbers keep their fractions.
    row = F.floor(F.col("chunk") / CHUNKS_IN_ROW)
    u = row * ROW_STEP % 1 + F.col("chunk") % CHUNKS_IN_ROW * CHUNK_STEP % 1 + F.col("i") * GOLDEN
    points = points.withColumn("u", u - F.floor(u)).withColumn("cell", F.floor(F.col("u") * n_cells))
    # The stretches are at most cells and sources: broadcast while there are few sources, else both sides are dealt by cell.
    hit = points.join(F.broadcast(stretches), "cell") if n <= BROADCAST_SOURCES else points.hint("merge").join(stretches, "cell")
    hit = hit.where("u >= lo and u < hi")
    counts = hit.groupBy("source", "chunk").agg(F.count("*").alias("n"))
    before = W.partitionBy("source").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(F.col("source").alias("s"), F.col("chunk").alias("c"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(W.partitionBy("source", "chunk").orderBy("i")) - 1
    ranked = hit.withColumn("rank", rank).join(counts, _same(F.col("source"), F.col("s")) & (F.col("chunk") == F.col("c")))
    ranked = ranked.withColumn("block", F.col("offset") + F.col("rank")).where("block < blocks")
    return ranked.select((F.col("chunk") * POINTS_IN_CHUNK + F.col("i")).alias("slot"), "source", "block")


def mix(documents: DataFrame, weights: list[float], repeats: int, block_words: int, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(pieces, sizes). pieces: slot, source, block, doc_id, row, epoch, from_word, n_words: the words of each document that each slot takes, in which of the source's repeats. sizes: doc_id, source, size, start, row, source_size, target of every document; row tells repeated ids apart: the column of that name, if one is given, else a number of its own. Rows of one id are ordered by size and by a hash of the text."""
    own = [F.col(row).alias("row")] if row else []
    d = materialize(documents.select("doc_id", "source", word_count().alias("size"), F.xxhash64("text").alias("tie"), *own), "mix-sizes")
    targets = materialize(source_targets(d, weights, repeats), "mix-targets")
    t = targets.select(F.col("source").alias("s"), "source_size", "target")
    largest = targets.agg(F.coalesce(F.max("source_size"), F.lit(0))).first()[0]
    digits = max(1, math.ceil(math.log(max(1, largest / BUCKET_WORDS), 16)))
    sizes = positions(d, digits).join(t, _same(F.col("source"), F.col("s"))).drop("s")
    sizes = materialize(sizes if row else sizes.withColumn("row", F.monotonically_increasing_id()), "mix-positions")
    epochs = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("epoch")
    runs = sizes.where("size > 0").select("doc_id", "row", "source", "size", "start", "source_size", F.floor("target").alias("words"), epochs)
    runs = runs.withColumn("begin", F.col("epoch") * F.col("source_size") + F.col("start"))
    runs = runs.withColumn("end", F.least(F.col("begin") + F.col("size"), F.col("words"))).where("begin < end")
    block = F.explode(F.sequence(F.floor(F.col("begin") / block_words), F.floor((F.col("end") - 1) / block_words))).alias("block")
    parts = runs.select("doc_id", "row", "epoch", "source", "begin", "end", block)
    lo, hi = F.greatest("begin", F.col("block") * block_words), F.least("end", (F.col("block") + 1) * block_words)
    parts = parts.select("doc_id", "row", "epoch", "source", "block", (lo - F.col("begin")).alias("from_word"), (hi - lo).alias("n_words"))
    slots = schedule(targets, block_words).select("slot", F.col("source").alias("s"), F.col("block").alias("b"))
    # Spark takes the slots for as few as the chunks they come from and would broadcast them.
    pieces = parts.join(slots.hint("merge"), _same(F.col("source"), F.col("s")) & (F.col("block") == F.col("b"))).drop("s", "b")
    return pieces, sizes


def copies(pieces: DataFrame) -> DataFrame:
    """row, epoch, words, slot: each document's repeats in the mix with the words taken (its first ones) and the first slot that takes some; a mix in order of slot is interleaved as the schedule says."""
    return pieces.groupBy("row", "epoch").agg(F.sum("n_words").alias("words"), F.min("slot").alias("slot"))


def taken(pieces: DataFrame, sizes: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, row: the words that the mix takes of each document, repeats counted."""
    sums = pieces.groupBy("row").agg(F.sum("n_words").alias("words"))
    return sizes.join(sums, "row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("words", F.lit(0)).cast("long").alias("taken"), "row")
