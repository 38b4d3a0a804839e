"""What the corpus operators share: the cluster's shared folder, written intermediate tables, words."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: A word is a run of bytes other than ASCII blanks (space, tab to carriage return), unchanged.
WORD = r"[^\x20\x09-\x0D]+"

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary one stands in only if all run in one process (tests); elsewhere it is an error, as executors would not see it."""
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


def own_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted like the tables of materialize()."""
    path = f"{shared_dir(spark)}/cairn-tables/{tag}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_delete_all, spark)
    _written.append(path)
    return path


def materialize(df: DataFrame, tag: str, **options: object) -> DataFrame:
    """Writes df as Parquet to the shared folder and returns what reads it: a cut of the lineage that outlives executors. What nobody has discarded by then goes when the driver ends."""
    spark = df.sparkSession
    path = own_path(spark, tag)
    df.write.options(**{"compression": "zstd", **options}).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cairn_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that materialize() wrote and that no later step reads."""
    for t in tables:
        path = getattr(t, "cairn_path", None)
        if path in _written:
            _delete(t.sparkSession, path)
            _written.remove(path)


class Scope:
    """What a caller's operators wrote between begin() and begin(): deleted by the next begin(), when the caller's results stand elsewhere."""

    def __init__(self) -> None:
        self.mark: int | None = None

    def begin(self, spark: SparkSession) -> None:
        self.end(spark)
        self.mark = len(_written)

    def end(self, spark: SparkSession) -> None:
        if self.mark is not None:
            while len(_written) > self.mark:
                _delete(spark, _written.pop())
        self.mark = None


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _delete_all(spark: SparkSession) -> None:
    """At the driver's end, if its engine still runs."""
    try:
        while _written:
            _delete(spark, _written.pop())
    except Exception:  # the engine is gone; what is left are files in the cluster's folder for checkpoints
        return


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back_memory() -> None:
    """Hands freed memory of a worker back to the system: workers live on through tasks of all kinds."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass
