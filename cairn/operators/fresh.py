"""Answers that hold what changed since the scan: change sets, journals, and the merge of index hits with live hits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.operators import scan
from cairn.operators.fulltext import grep_score
from cairn.plans.search import live_terms, parse

DELTA_LIMIT = 2000


def changed_since(now: DataFrame, marker_ns: int) -> DataFrame:
    """Entries written or changed strictly after the marker; who shows them orders them."""
    return now.where((F.col("mtime_ns") > marker_ns) | (F.col("ctime_ns") > marker_ns))


def delta(now: DataFrame, stored: DataFrame, marker_ns: int) -> DataFrame:
    """path, size, mtime_ns, exists: what changed since the marker, and stored live paths that are gone."""
    new = changed_since(now, marker_ns).select("path", "size", "mtime_ns", F.lit(True).alias("exists"))
    gone = scan.live(stored).join(now.select("path"), "path", "left_anti").select("path", "size", "mtime_ns", F.lit(False).alias("exists"))
    return new.unionByName(gone)


def truncated(changes: DataFrame, limit: int = DELTA_LIMIT) -> tuple[DataFrame, DataFrame]:
    """(the first `limit` changes by path, a row with status and n): a change set over the limit says so."""
    status = changes.agg(F.count("*").alias("n")).select(F.when(F.col("n") > limit, F.lit("truncated")).otherwise(F.lit("complete")).alias("status"), "n")
    return changes.orderBy("path").limit(limit), status


def journal_last(records: DataFrame) -> DataFrame:
    """The last record of each path by usn, with exists: a path whose last record deletes it is gone. Records about security, indexing and object ids alone do not count."""
    told = records.where(~F.col("reason").isin("security", "indexable", "object_id"))
    last = told.groupBy("path").agg(F.max_by(F.struct("usn", "reason"), "usn").alias("r"))
    return last.select("path", F.col("r.usn").alias("usn"), F.col("r.reason").alias("reason"), (F.col("r.reason") != "delete").alias("exists"))


def journal_range(records: DataFrame, after_usn: int, upto_usn: int | None = None) -> DataFrame:
    """Records past the marker, up to where the journal stood when the read began."""
    out = records.where(F.col("usn") > after_usn)
    return out if upto_usn is None else out.where(F.col("usn") <= upto_usn)


def journal_paths(records: DataFrame, folders: DataFrame) -> DataFrame:
    """Records (number, parent, name, usn, reason, code) with path and why there is none: their folder's path (folders: number, path) and name; where no folder has the parent's number, the code that the system gives for it says whether it is gone or unresolved. Folders are met by number, hot or not: AQE splits those with many records."""
    f = folders.select(F.col("number").alias("parent"), F.col("path").alias("folder")).dropDuplicates(["parent"])
    out = records.join(f, "parent", "left")
    path = F.concat(F.regexp_replace("folder", "/+$", ""), F.lit("/"), F.col("name"))
    return out.select("number", path.alias("path"), "usn", "reason", F.when(F.col("folder").isNull(), frn_class(F.col("code"))).alias("missing"))


def frn_class(code: Column) -> Column:
    """Why a parent directory's number does not resolve: gone, or unresolved."""
    return F.when(code.isin(2, 3, 87), F.lit("gone")).otherwise(F.lit("unresolved"))


def journal_verdict(marker_journal: Column, marker_usn: Column, journal: Column, first_usn: Column) -> Column:
    return F.when(marker_journal != journal, F.lit("recreated")).when(first_usn > marker_usn, F.lit("rolled_off")).otherwise(F.lit("valid"))


def marker_lifetime(markers: DataFrame, signed: bool = False) -> DataFrame:
    """consumed, headroom, rate (per second) and remaining seconds (null without a rate) of a journal marker's rows: next_usn, recorded_ns, live_next_usn, first_usn, maximum_size, now_ns. A marker recorded after now counts as recorded now, without a rate; signed leaves age, rate and remaining seconds as they divide: negative then, and at age 0 an infinite rate with 0 seconds (not a number if nothing is consumed)."""
    m = markers.withColumn("consumed", F.greatest(F.col("live_next_usn") - F.col("next_usn"), F.lit(0)))
    m = m.withColumn("headroom", F.greatest(F.col("maximum_size") - F.col("consumed"), F.lit(0)))
    m = m.withColumn("age_s", (F.col("now_ns") - F.col("recorded_ns")) / 1e9)
    if signed:
        at_once = F.when(F.col("consumed") > 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
        m = m.withColumn("rate", F.when(F.col("age_s") == 0, at_once).otherwise(F.try_divide(F.col("consumed").cast("double"), F.col("age_s"))))
        return m.withColumn("remaining_s", F.when(F.col("rate") != 0, F.col("headroom") / F.col("rate")))
    m = m.withColumn("age_s", F.greatest("age_s", F.lit(0.0)))
    m = m.withColumn("rate", F.coalesce(F.try_divide(F.col("consumed").cast("double"), F.col("age_s")), F.lit(0.0)))
    return m.withColumn("remaining_s", F.when(F.col("rate") > 0, F.col("headroom") / F.col("rate")))


def noise_ratio(changes: DataFrame, excluded: Column) -> DataFrame:
    """n_excluded, n_entries, ratio of a raw change set."""
    sums = changes.agg(F.count_if(excluded).alias("n_excluded"), F.count_if(~excluded).alias("n_entries"))
    return sums.withColumn("ratio", F.round(F.coalesce(F.try_divide(F.col("n_excluded").cast("double"), (F.col("n_excluded") + F.col("n_entries")).cast("double")), F.lit(0.0)), 6))


def drop_class(hits: DataFrame, changes: DataFrame, stored: DataFrame) -> DataFrame:
    """Index hits (file_id, path, score) with why each is dropped: deleted, changed, or null for what stays. Whether a file is on disk is looked at for a page alone (the engine)."""
    d = changes.select("path", F.col("exists").alias("there"))
    dead = stored.where(F.col("deleted_at").isNotNull()).select("file_id", F.lit(True).alias("dead"))
    out = hits.join(d, "path", "left").join(dead, "file_id", "left")
    reason = F.when(~F.col("there"), F.lit("deleted")).when(F.col("there"), F.lit("changed")).when(F.col("dead"), F.lit("deleted"))
    return out.withColumn("dropped", reason).drop("there", "dead")


def merge_page(live: DataFrame, index: DataFrame, limit: int) -> DataFrame:
    """The page of live and index hits (path, file_id, score, mtime_ns): live hits first, but only half of the page, rounded up, as long as there are index hits; then index hits; then what is left of live ones. A path occurs once. Each side is cut to the page before both meet, so that one task sees at most two pages."""
    order = [F.desc("score"), F.desc_nulls_last("mtime_ns"), F.asc("path")]
    cols = ["path", "file_id", "score", "mtime_ns"]
    one = lambda df, side, by: df.select(*cols).dropDuplicates(["path"]).orderBy(*by).limit(limit).withColumn("origin", F.lit(side))
    lhs = one(live, "live", order)
    rhs = one(index.join(live.select("path"), "path", "left_anti"), "index", [F.desc("score"), F.asc("path")])
    both = lhs.unionByName(rhs).withColumn("rn", F.row_number().over(W.partitionBy("origin").orderBy(F.desc("score"), F.desc_nulls_last(F.when(F.col("origin") == "live", F.col("mtime_ns"))), "path")))
    some = F.max(F.when(F.col("origin") == "index", 1).otherwise(0)).over(W.partitionBy(F.lit(1)))
    budget = F.when(some == 1, F.lit((limit + 1) // 2)).otherwise(F.lit(limit))
    both = both.withColumn("grp", F.when((F.col("origin") == "live") & (F.col("rn") <= budget), 0).when(F.col("origin") == "index", 1).otherwise(2))
    return both.orderBy("grp", "rn").limit(limit).withColumn("place", F.row_number().over(W.orderBy("grp", "rn"))).select("place", "origin", *cols)


def find(files: DataFrame, changes: DataFrame, text: str, limit: int = 20) -> DataFrame:
    """The page of paths that have the text, the index corrected by the change set."""
    hits = scan.find_paths(files, text, None).withColumn("score", F.lit(1.0))
    mtimes = scan.live(files).select("file_id", "mtime_ns")
    kept = drop_class(hits, changes, files).where("dropped is null").drop("dropped").join(mtimes, "file_id", "left")
    known = scan.live(files).select("path", "file_id")
    found = changes.where("exists").where(F.contains(F.lower("path"), F.lower(F.lit(text)))).join(known, "path", "left")
    return merge_page(found.withColumn("score", F.lit(1.0)), kept, limit)


def search(hits: DataFrame, files: DataFrame, changes: DataFrame, bodies: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """The page of a full-text query: index hits (file_id, score) without what changed, live hits from the changed files' present bodies (path, body)."""
    terms = live_terms(parse(query))
    now = files.select("file_id", "path", "mtime_ns")
    kept = drop_class(hits.join(now, "file_id"), changes, files).where("dropped is null").drop("dropped")
    known = scan.live(files).select("path", "file_id")
    scored = bodies.select("path", grep_score(F.col("body"), terms).cast("double").alias("score")).where("score > 0")  # texts are not shuffled
    found = changes.where("exists").join(scored, "path")
    return merge_page(found.join(known, "path", "left"), kept, limit)
