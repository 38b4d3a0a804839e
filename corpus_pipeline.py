"""The corpus pipeline: quality classifier, MinHash near-dedup, substring dedup, mixing to target weights, byte-level BPE.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. Each stage works on all rows that its predecessor kept. All but the last return the
columns of documents. Nulls, empty texts, repeated rows and empty tables have the results that the operators' docstrings state;
a repeated row, or a row of a repeated or null id, is a document of its own in every stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, fmindex, mixing, quality, setsketch
from cairn.llm.common import Scope, materialize, shared_dir, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near-duplicates: similarity of sets of five-word shingles from 0.8 on.
SHINGLE_WORDS = 5
MIX_WEIGHTS = [5.0, 2.0, 1.0]
MIX_REPEATS = 3
MIX_BLOCK_WORDS = 64
TOKEN_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: No SQL states the scores of the classifier or the ids of the vocabulary.
ORACLE_SQL = None

#: Tables that a stage's operators wrote; they go when the next stage begins, whose input is written by then.
_scope = Scope()


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts label 1 for; the others go."""
    _scope.begin(spark)
    voters = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, voters).where(F.col("score") >= quality.CUT).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: that of the smallest id (null ids last). Rows are grouped, not ids: a row of a repeated id stays if nothing is like it."""
    _scope.begin(spark)
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if not ids.where("n > 1 or doc_id is null").limit(1).count():
        gone = setsketch.near_duplicates(docs, SHINGLE_WORDS).where("not kept").select("doc_id")
        return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)
    # Rows that an id does not tell apart get numbers, written once so that they hold for all steps.
    docs = materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("dedup_row")), "dedup-rows")
    found = setsketch.near_duplicates(docs.select(F.col("dedup_row").alias("doc_id"), "text"), SHINGLE_WORDS)
    found = found.select(F.col("doc_id").alias("dedup_row"), "component_id").join(docs.select("dedup_row", "doc_id"), "dedup_row")
    best = found.groupBy("component_id").agg(F.min_by("dedup_row", F.struct(F.col("doc_id").isNull(), "doc_id", "dedup_row")).alias("dedup_row"))
    return docs.join(best, "dedup_row", "left_semi").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that 35-word windows found elsewhere cover; the words that stay are joined by one space where any went. A text of which nothing stays is an empty document."""
    _scope.begin(spark)
    out = fmindex.remove_repeated_words(docs.select(*COLUMNS))
    text = F.when(F.col("n_removed") > 0, F.decode("kept", "UTF-8")).otherwise(F.col("text"))
    out = out.withColumn("text", text)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: whole repeats, and once more with its first words for the rest. Rows stand in the order of the slots that take their first words, so that the sources are interleaved as the schedule says: files and rows in them ascend by slot."""
    _scope.begin(spark)
    # Written, so that a row has one number for all that follows.
    docs = materialize(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("mix_row")), "mix-rows")
    pieces, _ = mixing.mix(docs, MIX_WEIGHTS, MIX_REPEATS, MIX_BLOCK_WORDS, "mix_row")
    rows = docs.join(mixing.copies(pieces).withColumnRenamed("row", "mix_row"), "mix_row")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    cut = F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), " ")
    part = F.col("words") < mixing.word_count()
    rows = rows.withColumn("part", part).withColumn("text", F.when(F.col("part"), cut).otherwise(F.col("text")))
    rows = rows.withColumn("n_chars", F.when(F.col("part"), F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.repartitionByRange("slot").sortWithinPartitions("slot", "mix_row", "epoch").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids (binary, little-endian unsigned 32-bit) of every row; ids decode to the text's bytes."""
    _scope.begin(spark)
    with open(TOKEN_RANKS, "rb") as f:
        ranks = f.read()
    out = bpe.encode_documents(docs.select("doc_id", "source", "text"), ranks, public_tokenizers.PATTERN)
    return out.select("doc_id", "source", F.expr("cast(octet_length(ids) div 4 AS bigint)").alias("n_tokens"), "ids")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", classify),
    ("minhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("source_mix", mix),
    ("bpe_encoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written to the shared folder and read again."""
    at = f"{shared_dir(spark)}/cairn-pipeline/{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{k}")
        docs = spark.read.parquet(f"{at}/{k}")
    _scope.end(spark)
    return docs
