"""The queries opN_<name> of the corpus operators and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import bpe, fmindex, lattice, licences, mixing, quality, setsketch, suffixes, token_store, topk
from cairn.llm.common import own_path, table

#: Production parameters.
TOKEN_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 2
DUPLICATE_SHINGLE_WORDS = 2
MIX_WEIGHTS = [5.0, 2.0, 1.0]
MIX_REPEATS = 3
MIX_BLOCK_WORDS = 64


def op1_segment_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_fm_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fmindex.digests(table(spark, sf_dir, "documents"))


def op3_bpe_prefix_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(TOKEN_RANKS, "rb") as f:
        ranks = f.read()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.token_digests(bpe.encode_documents(docs, ranks, public_tokenizers.PATTERN, decoded="decoded"))


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(WORD_VOCABULARY, encoding="utf-8") as f:
        vocabulary = f.read()
    path = own_path(spark, "tokens")
    token_store.write_tokens(table(spark, sf_dir, "documents"), vocabulary, END_ID, path)
    return token_store.token_digests(spark, path)


def op5_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(table(spark, sf_dir, "documents"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces, sizes = mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_REPEATS, MIX_BLOCK_WORDS)
    return mixing.taken(pieces, sizes).select("doc_id", "size", "source_size", "target", "taken")


def op8_lattice_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_documents(table(spark, sf_dir, "documents"))


def op10_setsketch_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setsketch.near_duplicates(table(spark, sf_dir, "documents"), DUPLICATE_SHINGLE_WORDS)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id AS query_id, e FROM v WHERE vec_id % 100 = 0),
s AS (
  SELECT q.query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q JOIN v ON q.query_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""

OP7_SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, source_size::DOUBLE * 3 AS cap FROM s),
l AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER b, 0.0) AS left_words,
         sum(weight) OVER () - coalesce(sum(weight) OVER b, 0.0) AS left_weight
  FROM w WINDOW b AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, left_words / left_weight AS level, cap <= left_words / left_weight * weight AS capped FROM l),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE least((max(CASE WHEN NOT capped THEN level END) OVER ()) * weight, cap) END AS target
  FROM c),
e AS (SELECT *, CAST(ceil(floor(target) / 64) AS BIGINT) AS blocks FROM t WHERE target >= 1),
i AS (
  SELECT source, blocks, sum(blocks) OVER (ORDER BY source NULLS LAST) / (sum(blocks) OVER ())::DOUBLE AS hi,
         coalesce(sum(blocks) OVER (ORDER BY source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / (sum(blocks) OVER ())::DOUBLE AS lo
  FROM e),
u AS (SELECT slot, slot * 0.6180339887498949::DOUBLE - floor(slot * 0.6180339887498949::DOUBLE) AS u FROM (SELECT unnest(range(2 * (SELECT coalesce(sum(blocks), 0) FROM e)::BIGINT + 16)) AS slot)),
h AS (SELECT source, least(count(*), any_value(blocks)) AS hits FROM u JOIN i ON u.u >= i.lo AND u.u < i.hi GROUP BY source),
p AS (
  SELECT d.*, t.source_size, t.target, least(floor(t.target), 64 * coalesce(h.hits, 0)) AS scheduled,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY digest, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN h ON d.source IS NOT DISTINCT FROM h.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(size, scheduled - start))
          + greatest(0, least(size, scheduled - source_size - start))
          + greatest(0, least(size, scheduled - 2 * source_size - start)) AS BIGINT) AS taken
FROM p
"""


def _op9_sql() -> str:
    rows = ",\n".join("('{}', [{}])".format(name, ", ".join(f"'{g}'" for g in grams)) for name, grams in licences.template_bigrams())
    return f"""
WITH t(licence, known) AS (VALUES
{rows}),
lines AS (
  SELECT doc_id, unnest(CASE WHEN contains(text, chr(10)) THEN list_prepend(text, string_split(text, chr(10))) ELSE [text] END) AS body,
         generate_subscripts(CASE WHEN contains(text, chr(10)) THEN list_prepend(text, string_split(text, chr(10))) ELSE [text] END, 1) AS unit
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, unit, string_split(trim(regexp_replace(lower(body), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ') AS ws FROM lines),
g AS (
  SELECT doc_id, unit, list_distinct([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) AS grams
  FROM w WHERE len(ws) >= 2),
m AS (
  SELECT doc_id, unit, licence, 2.0::DOUBLE * len(list_intersect(grams, known)) / (len(grams) + len(known)) AS dice
  FROM g JOIN t ON len(grams) BETWEEN len(known) * 0.8 / 1.2 AND len(known) * 1.2 / 0.8),
b AS (SELECT doc_id, unit, arg_min(licence, (-dice, licence)) AS licence, max(dice) AS dice FROM m WHERE dice >= 0.8 GROUP BY ALL),
s AS (SELECT doc_id, count(*) AS n_notices, string_agg(DISTINCT licence, ',' ORDER BY licence) AS licences, round(max(dice), 6) AS best_dice FROM b GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_notices, 0) AS n_notices, coalesce(licences, '') AS licences, coalesce(best_dice, 0.0)::DOUBLE AS best_dice
FROM documents d LEFT JOIN s USING (doc_id)
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_segment_top_k, op2_fm_index_dedup, op3_bpe_prefix_table, op4_token_store, op5_quality_neighbours, op6_suffix_dedup, op7_source_mix, op8_lattice_duplicates, op9_licence_scan, op10_setsketch_duplicates)
}
ORACLES: dict[str, str] = {"op1_segment_top_k": OP1_SQL, "op7_source_mix": OP7_SQL, "op9_licence_scan": _op9_sql()}
