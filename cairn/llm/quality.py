"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A text's terms are runs of one to three collapsed character shapes: every letter stands for its case, every digit for
"digit", every other ASCII character for itself, and repeats collapse, so the terms state how a text is written and not which words
it has. Hashed term shares are damped by a square root and projected to latent dimensions. Every document is compared by
cosine, in blocks, with all labelled vectors, which are broadcast: their number is a parameter and does not grow with the data. The labels of the nearest vote with
their similarity, raised to a power.

Fitting uses at most `examples` labelled rows, those with the smallest digests of their ids; scoring covers every row.
Nulls count as empty texts. A text without terms, or no labelled row at all, gets the share of label 1 among the
examples (0.5 if there is none). Repeated rows get one score each; of the rows of a labelled id the one of the smallest term vector is
the example; ties between neighbours go to the earlier example; labels that are null take
no part; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm.common import give_back_memory

#: Hashed terms, latent dimensions, labelled rows fitted on and compared with, voters, and the power of their similarity.
TERMS = 1024
DIMENSIONS = 32
EXAMPLES = 4096
NEIGHBOURS = 15
POWER = 8
#: Share of documents of each crc32 remainder: labels are learnt from remainders other than 0.
FOLDS = 5
#: A score from here on predicts label 1.
CUT = 0.3
BLOCK = 512

_SHAPE = np.array([ord("A") if 65 <= c <= 90 else ord("0") if 48 <= c <= 57 else ord("a") if c >= 128 or 97 <= c <= 122 else c for c in range(256)], np.uint8)


def terms(text: str | None) -> np.ndarray:
    """Square roots of the shares of a text's hashed terms."""
    out = np.zeros(TERMS, np.float32)
    shape = _SHAPE[np.frombuffer((text or "").encode(), np.uint8)]
    if not len(shape):
        return out
    s = shape[np.r_[True, shape[1:] != shape[:-1]]].astype(np.uint64)
    for k in (1, 2, 3):
        if len(s) >= k:
            code = sum(s[i : len(s) - k + 1 + i] << np.uint64(8 * i) for i in range(k)) + np.uint64(k << 24)
            out += np.bincount(((code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64), minlength=TERMS)
    return np.sqrt(out / out.sum())


@dataclass
class Voters:
    """What is broadcast: the projection, the labelled unit vectors and their labels."""

    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        out = np.full(len(x), prior)
        if not len(self.labels):
            return out
        z = x @ self.projection
        norm = np.linalg.norm(z, axis=1)
        k = min(NEIGHBOURS, len(self.labels))
        cosine = (z / np.maximum(norm, 1e-12)[:, None]) @ self.vectors.T
        near = nearest(cosine, k)
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** POWER
        total = weight.sum(axis=1)
        some = (norm > 0) & (total > 0)
        out[some] = (weight * self.labels[near]).sum(axis=1)[some] / total[some]
        return out


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """The columns of each row's k largest values, ascending; of equal ones the earlier column."""
    least = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, -k][:, None]
    chosen = cosine >= least
    for i in np.flatnonzero(chosen.sum(axis=1) > k):  # more that are equal to the last one than there is room for
        equal = np.flatnonzero(cosine[i] == least[i])
        chosen[i, equal[k - int((cosine[i] > least[i]).sum()) :]] = False
    return np.nonzero(chosen)[1].reshape(-1, k)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Voters:
    """Learns from at most `examples` labelled rows outside the held-out fold. The driver gets their vectors of TERMS shares alone."""
    chosen = labels.where(F.col("quality").isNotNull() & ~held_out()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id", "quality").limit(examples)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([terms(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], ["doc_id", "quality", "terms"])

    # One row per example, so that the rows of a repeated id do not take the place of other ids.
    one = rows.mapInArrow(vectors, "doc_id bigint, quality int, terms binary").groupBy("doc_id", "quality").agg(F.min("terms").alias("terms"))
    got = one.orderBy("doc_id", "terms", "quality").collect()
    if not got:
        return Voters(np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0))
    x = np.stack([np.frombuffer(r.terms, np.float32) for r in got])
    _, basis = np.linalg.eigh(x.T @ x)
    projection = np.ascontiguousarray(basis[:, ::-1][:, :DIMENSIONS]).astype(np.float32)
    z = x @ projection
    return Voters(projection, z / np.maximum(np.linalg.norm(z, axis=1), 1e-12)[:, None], np.array([r.quality for r in got], float))


def score_documents(docs: DataFrame, voters: Voters) -> DataFrame:
    """Adds score (0 to 1, to six digits) to every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(voters)
    docs = docs.drop("score")
    names = docs.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, BLOCK):
                b = batch.slice(begin, BLOCK)
                x = np.stack([terms(t.as_py()) for t in b.column(names.index("text"))])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.round(shared.value.score(x), 6))], [*names, "score"])
        give_back_memory()

    fields = ", ".join(f"`{c.name}` {c.dataType.simpleString()}" for c in docs.schema)
    return docs.mapInArrow(work, f"{fields}, score double")


def classify(docs: DataFrame, voters: Voters) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    out = score_documents(docs.select("doc_id", "text"), voters)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
