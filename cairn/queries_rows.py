"""Byte-exact text scans and document parsers in Python, over whole tables, and the SQL of their rows."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from cairn import adapters as A
from cairn.operators.fulltext import long_runs_broken
from cairn.sources.documents import extract

RUN_BYTES = 512
#: Texts that are Python strings at a time are one; rows whose results wait are as many.
ROWS_AT_ONCE = 1000


def lattice_breaks(spark: SparkSession, d: str) -> DataFrame:
    """file_id, n_breaks, longest (bytes of the longest run after) of every document, for runs of RUN_BYTES."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(begin, ROWS_AT_ONCE)
                got = [_broken(b.as_py() or "") for b in part.column("body")]
                columns = [part.column("file_id"), pa.array([n for n, _ in got], pa.int64()), pa.array([n for _, n in got], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["file_id", "n_breaks", "longest"])
            del batch, part
            pa.default_memory_pool().release_unused()

    return A.bodies(spark, d).mapInArrow(work, "file_id bigint, n_breaks bigint, longest bigint")


def _broken(text: str) -> tuple[int, int]:
    broken, n = long_runs_broken(text, RUN_BYTES)
    return n, max(len(r.encode()) for r in re.split("[\n\t。、]", broken))


def _docx(text: str, author: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        clean = "".join(c for c in text if c >= " " or c == "\n").replace("&", "&amp;").replace("<", "&lt;")
        body = "".join(f"<w:p><w:r><w:t>{line}</w:t></w:r></w:p>" for line in clean.split("\n"))
        z.writestr("word/document.xml", f"<w:document xmlns:w='w'>{body}</w:document>")
        z.writestr("docProps/core.xml", f"<c><creator>{author}</creator></c>")
    return out.getvalue()


def docmeta_extract(spark: SparkSession, d: str) -> DataFrame:
    """file_id, same (whether the body comes back as it was), authors: every conversation turn written as a document and read by the parser."""
    t = A.table(spark, d, "conversations").selectExpr("conv_id * 1000 + turn AS file_id", "coalesce(text, '') AS text", "role")

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(ext="docx", content=[_docx(x, r) for x, r in zip(f["text"], f["role"], strict=True)])

    packed = t.mapInPandas(pack, "file_id bigint, text string, role string, ext string, content binary")
    got = extract(packed)
    return got.selectExpr("file_id", "error IS NULL AND body = text AS same", "array_join(authors, ',') AS authors")


#: Each step breaks the first piece off what is left of a run that is too long.
LATTICE_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id AS file_id, unnest(regexp_extract_all(coalesce(text, ''), '[^\\n\\t。、]*[\\n\\t。、]|[^\\n\\t。、]+$')) AS run FROM documents),
steps AS (
  SELECT file_id, run, NULL::VARCHAR AS piece, 0 AS broken FROM runs
  UNION ALL
  SELECT file_id, CASE WHEN cut > 0 THEN substr(run, cut + 2) ELSE substr(run, length(head) + 1) END, CASE WHEN cut > 0 THEN substr(run, 1, cut) ELSE head END, 1
  FROM (
    SELECT *, length(regexp_extract(head, '^((?s).*)[ \\r]', 1)) AS cut
    FROM (SELECT file_id, run, substr(run, 1, list_max(list_filter(range(1, {RUN_BYTES + 1}), lambda k: strlen(substr(run, 1, k)) <= {RUN_BYTES}))) AS head FROM steps WHERE strlen(run) > {RUN_BYTES}))),
found AS (
  SELECT file_id, sum(broken) AS n, max(greatest(coalesce(strlen(piece), 0), CASE WHEN strlen(run) <= {RUN_BYTES} THEN strlen(regexp_replace(run, '[\\n\\t。、]$', '')) ELSE 0 END)) AS longest
  FROM steps GROUP BY file_id)
SELECT doc_id AS file_id, CAST(coalesce(n, 0) AS BIGINT) AS n_breaks, CAST(coalesce(longest, 0) AS BIGINT) AS longest FROM documents LEFT JOIN found ON file_id = doc_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"lattice_breaks": lattice_breaks, "docmeta_extract": docmeta_extract}
ORACLES: dict[str, str] = {"lattice_breaks": LATTICE_SQL, "docmeta_extract": "SELECT conv_id * 1000 + turn AS file_id, true AS same, role AS authors FROM conversations"}
