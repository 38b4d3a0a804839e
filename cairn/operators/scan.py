"""Crawl results against the stored files: what is new, changed, renamed, gone; ledgers, hashes, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import fixed, formats, paths


#: The attribute of hidden files.
HIDDEN = 2


def live(files: DataFrame) -> DataFrame:
    return files.where(F.col("deleted_at").isNull())


def classify(found: DataFrame, stored: DataFrame) -> DataFrame:
    """path, class, file_id, old_path of every found entry (path, size, mtime_ns, fs_id). By path: unchanged or changed. Else a stored file whose path was not found and that has the same fs_id, or alone has the size and time: renamed (changed if fs_id alone fits). Else added, without file_id. Claims are decided by smallest path and id, so the order of arrival plays no part."""
    old = live(stored).select("file_id", F.col("path").alias("old_path"), F.col("size").alias("o_size"), F.col("mtime_ns").alias("o_mtime"), F.col("fs_id").alias("o_fs"))
    same = (F.col("size") == F.col("o_size")) & (F.col("mtime_ns") == F.col("o_mtime"))
    by_path = found.join(old, found.path == old.old_path).select("path", F.when(same, F.lit("unchanged")).otherwise(F.lit("changed")).alias("class"), "file_id", "old_path")
    fresh = found.join(old, found.path == old.old_path, "left_anti")
    free = old.join(found.select("path"), F.col("path") == F.col("old_path"), "left_anti")

    # One entry and one file for each number, and for each size and time: aggregated before they meet, so that a number or a size that many share is no task of its own.
    entry = F.min(F.struct("path", "size", "mtime_ns")).alias("e")
    number = fresh.where("fs_id is not null").groupBy("fs_id").agg(entry)
    owner = free.where("o_fs is not null").groupBy("o_fs").agg(F.min(F.struct("file_id", "old_path", "o_size", "o_mtime")).alias("o"))
    moved = number.join(owner, F.col("fs_id") == F.col("o_fs")).select("e.*", "o.*")
    moved = moved.select("path", F.when(same, F.lit("renamed")).otherwise(F.lit("changed")).alias("class"), "file_id", "old_path")

    fresh2 = fresh.join(moved.select("path"), "path", "left_anti")
    free2 = free.join(moved.select("file_id"), "file_id", "left_anti")
    alone = free2.groupBy("o_size", "o_mtime").agg(F.count("*").alias("n"), F.min("file_id").alias("file_id"), F.min("old_path").alias("old_path")).where("n = 1")
    claims = fresh2.groupBy("size", "mtime_ns").agg(F.min("path").alias("path"))
    fit = claims.join(alone, (F.col("size") == F.col("o_size")) & (F.col("mtime_ns") == F.col("o_mtime")))
    fit = fit.select("path", F.lit("renamed").alias("class"), "file_id", "old_path")

    rest = fresh2.join(fit.select("path"), "path", "left_anti")
    rest = rest.select("path", F.lit("added").alias("class"), F.lit(None).cast("long").alias("file_id"), F.lit(None).cast("string").alias("old_path"))
    return by_path.unionByName(moved).unionByName(fit).unionByName(rest)


def tombstones(stored: DataFrame, classified: DataFrame, generation: int) -> DataFrame:
    """Live files that no entry claims, with deleted_at set to the generation."""
    seen = classified.where(F.col("file_id").isNotNull()).select("file_id")
    return live(stored).join(seen, "file_id", "left_anti").withColumn("deleted_at", F.lit(generation).cast("long"))


def mark_deleted(files: DataFrame, file_id: int, generation: int) -> DataFrame:
    """The files table with one file dead since a generation; one that is dead already stays as it is."""
    dies = (F.col("file_id") == file_id) & F.col("deleted_at").isNull()
    return files.withColumn("deleted_at", F.when(dies, F.lit(generation).cast("long")).otherwise(F.col("deleted_at")))


def ledger(classified: DataFrame, gone: DataFrame) -> DataFrame:
    """class, n of a rescan, with deleted."""
    rows = classified.select("class").unionByName(gone.select(F.lit("deleted").alias("class")))
    return rows.groupBy("class").agg(F.count("*").alias("n"))


def apply_rescan(found: DataFrame, stored: DataFrame, generation: int, first_new_id: int, classified: DataFrame | None = None) -> DataFrame:
    """The files table after a rescan; `classified` is what classify() gave, if it is kept. Unchanged and renamed files keep their hashes, changed ones lose them; new ids follow first_new_id in steps that need no single order (unique, not dense)."""
    c = classify(found, stored) if classified is None else classified
    both = c.join(found, "path").join(stored.select("file_id", "magic", "content_hash", F.col("ext").alias("o_ext")), "file_id", "left")
    keeps = F.col("class").isin("unchanged", "renamed")
    kept = both.withColumn("file_id", F.coalesce("file_id", F.lit(first_new_id) + F.monotonically_increasing_id())).select(
        "file_id", "path", F.when(F.col("class") == "renamed", F.col("o_ext")).otherwise(F.col("ext")).alias("ext"), "size", "mtime_ns", "ctime_ns", "fs_id",
        F.when(keeps, F.col("magic")).alias("magic"), F.when(keeps, F.col("content_hash")).alias("content_hash"),
        F.lit(generation).cast("long").alias("last_seen_scan"), F.lit(None).cast("long").alias("deleted_at"),
    )
    dead = stored.where(F.col("deleted_at").isNotNull())
    return kept.unionByName(tombstones(stored, c, generation).select(*kept.columns)).unionByName(dead.select(*kept.columns))


def exclusion(rel: Column, path: Column, names: list[str] = tuple(fixed.EXCLUDED_NAMES), prefixes: list[str] = tuple(fixed.EXCLUDED_PREFIXES), ignored: list[str] = (), attributes: Column | None = None, own: str | None = None) -> Column:
    """Why an entry is left out: name:<directory>, prefix:<path>, gitignore, hidden (by its file attributes, if they are given: where the system has such), store (below the engine's own folder), or null. The nearest named directory counts; .cargo counts above registry alone; names and ignore patterns concern directories."""
    dirs = paths.ancestors(rel)
    low = F.transform(dirs, F.lower)
    plain = [n.lower() for n in names if n.lower() != ".cargo"]
    hit = F.filter(low, lambda d: d.isin(plain)) if plain else F.array().cast("array<string>")
    near = F.try_element_at(hit, F.lit(-1))
    cargo = F.lit(".cargo" in [n.lower() for n in names]) & F.array_join(F.concat(F.array(F.lit("")), low, F.array(F.lit(""))), "/").rlike("/\\.cargo/registry/")
    out = F.when(near.isNotNull(), F.concat(F.lit("name:"), near)).when(cargo, F.lit("name:.cargo"))
    for p in prefixes:
        out = out.when(paths.is_under(path, p), F.lit("prefix:" + p))
    if ignored:
        any_of = "|".join(f"(?:{r})" for r in ignored)
        out = out.when(F.exists(dirs, lambda d: d.rlike(any_of)), F.lit("gitignore"))
    if attributes is not None:
        out = out.when(attributes.bitwiseAND(F.lit(HIDDEN)) != 0, F.lit("hidden"))
    if own:
        out = out.when(paths.is_under(path, own), F.lit("store"))
    return out


def exclusion_ledger(entries: DataFrame, root: str | None = None, **policy: list[str]) -> DataFrame:
    """reason ('' for what is indexed), n. Every entry is in one row, so the counts add up to what was scanned."""
    reason = exclusion(paths.relative_path(F.col("path"), root), F.col("path"), **policy)
    return entries.select(F.coalesce(reason, F.lit("")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


def verdict_ledger(files: DataFrame, **limits: object) -> DataFrame:
    """verdict, ext ('' for none; only for reasons of format), n of files (size, ext, magic, body)."""
    v = formats.body_verdict(F.col("size"), F.col("ext"), F.col("magic"), F.col("body"), **limits)
    rows = files.select(v.alias("verdict"), F.coalesce("ext", F.lit("")).alias("ext"))
    by_format = F.col("verdict").isin("unsupported", "binary", "extract_failed")
    return rows.select("verdict", F.when(by_format, F.col("ext")).otherwise(F.lit("")).alias("ext")).groupBy("verdict", "ext").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "ext", "verdict")


def hash_backfill(files: DataFrame, max_bytes: int) -> DataFrame:
    """Live files with a body, no hash and at most max_bytes get content_hash (SHA-256) and magic; the rest stay as they are."""
    due = F.col("deleted_at").isNull() & F.col("content_hash").isNull() & (F.col("size") <= max_bytes) & F.col("body").isNotNull()
    data = F.col("body").cast("binary")
    return files.withColumn("magic", F.when(due, F.substring(data, 1, fixed.SNIFF_BYTES)).otherwise(F.col("magic"))).withColumn("content_hash", F.when(due, F.unhex(F.sha2(data, 256))).otherwise(F.col("content_hash")))


def unhashed(files: DataFrame) -> DataFrame:
    return live(files).where(F.col("content_hash").isNull())


def find_paths(files: DataFrame, text: str, limit: int | None = 20, unicode_case: bool = False) -> DataFrame:
    """file_id, path of live files whose path has the text as it stands (% and _ are no wildcards), without case: of ASCII letters in the index, of all letters in live listings."""
    if not text.strip():
        raise ValueError("the query is blank")
    low = F.lower if unicode_case else (lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    out = live(files).where(F.contains(low(F.col("path")), low(F.lit(text)))).select("file_id", "path").orderBy("file_id")
    return out if limit is None else out.limit(limit)


def page(files: DataFrame, after: int, size: int) -> DataFrame:
    """The next live files by id."""
    return live(files).where(F.col("file_id") > after).orderBy("file_id").limit(size)


def index_stats(files: DataFrame, file_tags: DataFrame) -> DataFrame:
    """n_live, n_gone, n_unhashed, n_tag_rows, n_tags (rows and tags of live files)."""
    f = files.agg(F.count_if(F.col("deleted_at").isNull()).alias("n_live"), F.count("deleted_at").alias("n_gone"), F.count_if(F.col("deleted_at").isNull() & F.col("content_hash").isNull()).alias("n_unhashed"))
    per_tag = file_tags.join(live(files), "file_id", "left_semi").groupBy("tag_id").agg(F.count("*").alias("n"))
    t = per_tag.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_tag_rows"), F.count("*").alias("n_tags"))
    return f.join(F.broadcast(t))  # one row


def access_by_kind(history: DataFrame) -> DataFrame:
    return history.groupBy("kind").agg(F.count("*").alias("n"), F.max("ts").alias("last_ts"))


def error_samples(errors: DataFrame, most: int) -> DataFrame:
    """The first error messages by path."""
    return errors.orderBy("path").limit(most)
