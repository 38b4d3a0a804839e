"""A change journal as a stream: each batch's last record of a path wins, and the store's delta is brought up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.operators.fresh import journal_last

JOURNAL = "path string, usn bigint, reason string"
#: Batches after which a base is written, so that what is read stays few folders.
COMPACT_EVERY = 16


class RescanRequired(RuntimeError):
    """The journal no longer holds what lies after the marker."""


def check_marker(marker_usn: int, first_usn: int, same_journal: bool = True) -> None:
    """Fails closed: a stream never starts past a gap."""
    if not same_journal or first_usn > marker_usn:
        raise RescanRequired("journal recreated" if not same_journal else "marker rolled off")


def journal_stream(spark: SparkSession, folder: str, after_usn: int = -1, first_usn: int | None = None, same_journal: bool = True) -> DataFrame:
    """Records after the marker, from files that arrive in a folder. first_usn is the oldest record that the journal still holds: what lies past it makes a rescan necessary, before anything is read."""
    if first_usn is not None:
        check_marker(after_usn, first_usn, same_journal)
    return spark.readStream.schema(JOURNAL).parquet(folder).where(F.col("usn") > after_usn)


def _last(rows: DataFrame) -> DataFrame:
    return rows.groupBy("path").agg(F.max_by(F.struct("usn", "reason", "exists"), "usn").alias("r")).select("path", "r.*")


def follow(stream: DataFrame, target: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Keeps the last record of each path in `target`: a batch writes its own paths alone, and every COMPACT_EVERY batches a base that holds all so far. A batch that is run again writes the same folders again."""

    def apply(batch: DataFrame, batch_id: int) -> None:
        journal_last(batch).write.mode("overwrite").parquet(f"{target}/batch={batch_id}")
        if batch_id % COMPACT_EVERY == COMPACT_EVERY - 1:
            latest(batch.sparkSession, target, batch_id).write.mode("overwrite").parquet(f"{target}/base={batch_id}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def latest(spark: SparkSession, target: str, upto: int | None = None) -> DataFrame:
    """The last record of each path, as of a batch or of the last one: the newest base before, and the batches since."""
    p = spark._jvm.org.apache.hadoop.fs.Path(target)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    found: dict[str, list[int]] = {"batch": [], "base": []}
    for s in fs.listStatus(p):
        kind, _, n = s.getPath().getName().partition("=")
        whole = fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))
        if kind in found and n.isdigit() and whole and (upto is None or int(n) <= upto):
            found[kind].append(int(n))
    base = max((n for n in found["base"] if upto is None or n < upto), default=-1)
    parts = [f"{target}/base={base}"] * (base >= 0) + [f"{target}/batch={n}" for n in sorted(found["batch"]) if n > base]
    schema = f"{JOURNAL}, exists boolean"
    return _last(spark.read.schema(schema).parquet(*parts)) if parts else spark.createDataFrame([], schema)
