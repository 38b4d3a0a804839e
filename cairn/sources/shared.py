"""Tables that outlive a query: the cluster's shared folder, and text indexes kept in it by what they were built from."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from cairn.operators import fulltext
from cairn.operators.fulltext import TextIndex

#: Layout of postings: row groups small enough for the statistics of terms to leave most of a file unread.
LAYOUT = {"parquet.block.size": 8 << 20, "compression": "zstd"}


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A temporary one stands in for it only where all run in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: there is no folder that all executors share")
        found = tempfile.mkdtemp(prefix="cairn-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def fingerprint(spark: SparkSession, path: str) -> str:
    """A name for what stands at a path now: its place, size, number of files and time of change."""
    fs, p = _path(spark, path)
    sums, status = fs.getContentSummary(p), fs.getFileStatus(p)
    told = f"{status.getPath()}|{sums.getLength()}|{sums.getFileCount()}|{status.getModificationTime()}"
    return hashlib.sha256(told.encode()).hexdigest()[:24]


def write_index(docs: DataFrame, path: str) -> None:
    """Builds the index of documents (file_id, body) at a path; it is there whole or not at all."""
    spark = docs.sparkSession
    new = f"{path}-{uuid.uuid4().hex}"
    fulltext.postings(docs).write.options(**LAYOUT).parquet(f"{new}/postings")
    fulltext.terms_in_order(spark.read.parquet(f"{new}/postings")).write.options(**LAYOUT).parquet(f"{new}/terms")
    fulltext.corpus_row(docs, spark.read.parquet(f"{new}/terms")).write.parquet(f"{new}/corpus")
    fs, at = _path(spark, path)
    if not fs.rename(_path(spark, new)[1], at):
        fs.delete(_path(spark, new)[1], True)  # another one was faster


def read_index(spark: SparkSession, path: str) -> TextIndex:
    return TextIndex(*(spark.read.parquet(f"{path}/{t}") for t in ("postings", "terms", "corpus")))


def kept_index(spark: SparkSession, source: str, docs: DataFrame) -> TextIndex:
    """The index of docs, which come from the table at `source`: built the first time, read from then on until the table changes."""
    path = f"{shared_folder(spark)}/cairn-index/{fingerprint(spark, source)}"
    fs, p = _path(spark, path)
    if not fs.exists(p):
        fs.mkdirs(p.getParent())
        write_index(docs, path)
    return read_index(spark, path)
