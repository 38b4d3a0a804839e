"""The tag layer: what is derived for each file, and counts, selections and statistics over it.

tagged rows are (file_id, namespace, value, sources); one row for each file and tag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions import fixed, formats, names, paths
from cairn.plans.rules import Rule


def valid_tag(namespace: Column, value: Column) -> Column:
    return namespace.rlike("^[a-z0-9_-]+$") & F.length(value).between(1, fixed.MAX_VALUE_CHARS) & ~value.rlike(r"\p{Cc}")


def _tags(namespace: str, values: Column, source: str) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(namespace).alias("namespace"), F.lower(F.trim(v)).alias("value"), F.lit(fixed.SOURCE_BITS[source]).alias("source")))


def _one(value: Column) -> Column:
    return F.array_compact(F.array(value))


def generate(files: DataFrame, root: str | None = None, rules: list[Rule] = ()) -> DataFrame:
    """tagged rows (uncapped) of files (file_id, path, ext, magic; null magic: not read). Tags of one file from several generators are one row with their source bits joined."""
    f = files.withColumn("rel", paths.relative_path(F.col("path"), root)).withColumn("name", paths.file_name(F.col("rel"))).withColumn("stem", paths.stem(F.col("name")))
    f = f.withColumn("ext", F.nullif(F.lower("ext"), F.lit(""))).withColumn("folded", paths.folded_ext(F.col("ext")))
    f = f.withColumn("seen", formats.format_from_magic(F.col("magic"))).withColumn("implied", formats.format_from_ext(F.col("folded")))
    dirs = paths.ancestors(F.col("rel"))
    near = F.slice(dirs, F.greatest(F.size(dirs) - fixed.PATH_COMPONENTS + 1, F.lit(1)), fixed.PATH_COMPONENTS)
    kind = F.coalesce(formats.kind_from_ext(F.col("folded")), formats.kind_from_format(F.coalesce("seen", "implied")))
    sets = [
        _tags("ext", _one(F.col("folded")), "ext"),
        _tags("format", _one(F.col("seen")), "magic"),
        _tags("format", _one(F.when(F.col("seen").isNull(), F.col("implied"))), "ext"),
        _tags("anomaly", _one(F.when(formats.format_mismatch(F.col("folded"), F.col("seen")), F.lit("format-mismatch"))), "magic"),
        _tags("kind", _one(kind), "ext"),
        _tags("path", F.flatten(F.transform(near, paths.component_tokens)), "path"),
        _tags("date", F.flatten(F.transform(near, names.dates)), "path"),
        _tags("date", names.dates(F.col("stem")), "name"),
        _tags("version", names.versions(F.col("stem")), "name"),
        _tags("pattern", names.patterns(F.col("name"), F.col("stem"), F.col("ext")), "name"),
    ]
    for rule in rules:
        hit = rule.matches(F.lower("rel"), F.lower("name"), F.col("ext"))
        for namespace, value in rule.tags:
            sets.append(_tags(namespace, _one(F.when(hit, F.lit(value))), "rule"))
    if "embedded" in files.columns:  # struct<authors: array<string>, title, camera, date>
        e = F.col("embedded")
        sets += [_tags("author", F.coalesce(e["authors"], F.array().cast("array<string>")), "embedded"), _tags("title", _one(e["title"]), "embedded"), _tags("camera", _one(e["camera"]), "embedded")]
        sets.append(_tags("date", F.coalesce(names.dates(e["date"]), F.array().cast("array<string>")), "embedded"))
    rows = f.select("file_id", F.explode(F.concat(*sets)).alias("t")).select("file_id", "t.*").where(valid_tag(F.col("namespace"), F.col("value")))
    return rows.groupBy("file_id", "namespace", "value").agg(F.bit_or("source").alias("sources"))


def cap_priority(namespace: Column, sources: Column) -> Column:
    """Tags of rules first, then those about content, then structure, then path parts."""
    rule = sources.bitwiseAND(F.lit(fixed.SOURCE_BITS["rule"])) != 0
    return F.when(rule, 0).when(~namespace.isin(fixed.STRUCTURAL_NAMESPACES), 1).when(namespace != "path", 2).otherwise(3)


def ranked_for_cap(tagged: DataFrame) -> DataFrame:
    order = W.partitionBy("file_id").orderBy(cap_priority(F.col("namespace"), F.col("sources")), "namespace", "value")
    return tagged.withColumn("place", F.row_number().over(order))


def cap(tagged: DataFrame, most: int = fixed.MAX_TAGS) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): each file's first `most` tags by priority and order."""
    ranked = ranked_for_cap(tagged)
    return ranked.where(F.col("place") <= most).drop("place"), ranked.where(F.col("place") > most).drop("place")


def intern(tagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tags: tag_id, namespace, value; file_tags: file_id, tag_id, sources). Ids are 64-bit hashes of the tag, so that they need neither an order nor a pass over all tags, and stay from build to build."""
    tag_id = F.xxhash64("namespace", "value")
    tags = tagged.select(tag_id.alias("tag_id"), "namespace", "value").distinct()
    return tags, tagged.select("file_id", tag_id.alias("tag_id"), "sources")


def orphans(tags: DataFrame, file_tags: DataFrame) -> DataFrame:
    """Tags that no file has."""
    return tags.join(file_tags.select("tag_id").distinct(), "tag_id", "left_anti")


def namespace_counts(tagged: DataFrame) -> DataFrame:
    """namespace, n_tags, n_files, most files first. Counted from distinct pairs, so that a namespace that every file has is not one task."""
    per_tag = tagged.groupBy("namespace", "value").agg(F.count("*").alias("n")).groupBy("namespace").agg(F.count("*").alias("n_tags"))
    per_file = tagged.select("namespace", "file_id").distinct().groupBy("namespace").agg(F.count("*").alias("n_files"))
    return per_tag.join(per_file, "namespace").orderBy(F.desc("n_files"), "namespace")


def tag_counts(tagged: DataFrame, namespace: str | None = None, limit: int | None = None) -> DataFrame:
    """namespace, value, n_files, most files first."""
    if namespace is not None:
        tagged = tagged.where(F.col("namespace") == namespace)
    out = tagged.groupBy("namespace", "value").agg(F.count("file_id").alias("n_files")).orderBy(F.desc("n_files"), "namespace", "value")
    return out if limit is None else out.limit(limit)


def select_all(tagged: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """file_id of the files that have every wanted tag; with none wanted, of every tagged file. The wanted list filters the scan before rows are counted."""
    wanted = list(dict.fromkeys(wanted))
    if not wanted:
        return tagged.select("file_id").distinct()
    hit = F.lit(False)
    for namespace, value in wanted:
        hit = hit | ((F.col("namespace") == namespace) & (F.col("value") == value))
    return tagged.where(hit).groupBy("file_id").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("file_id")


def files_with(tagged: DataFrame, wanted: list[tuple[str, str]]) -> DataFrame:
    """Like select_all, but it needs a tag."""
    if not wanted:
        raise ValueError("name at least one tag")
    return select_all(tagged, wanted)


def describe_sources(sources: Column) -> Column:
    return F.array_compact(F.array(*[F.when(sources.bitwiseAND(F.lit(b)) != 0, F.lit(n)) for n, b in fixed.SOURCE_BITS.items()]))


def coverage(files: DataFrame, tagged: DataFrame) -> DataFrame:
    """namespace, n_files, n_tags, n_rows, share of all files; one row more, of namespace '', for files with any tag, and one of namespace '(semantic)' for files with a tag about content."""
    total = files.agg(F.count("*").alias("total"))
    semantic = ~F.col("namespace").isin(fixed.STRUCTURAL_NAMESPACES)
    # Files are dealt out before they are counted: what a task holds is its share of them, not all that its part of the table has.
    per_name = tagged.select("file_id", "namespace").repartition("file_id").groupBy("file_id", "namespace").agg(F.count("*").alias("n"))
    sums = per_name.groupBy("file_id").agg(F.sum("n").alias("n"), F.sum(F.when(semantic, F.col("n"))).alias("s"))
    counts = [F.count("*").alias("n_files"), F.sum("n").alias("n_rows")]
    per_file = per_name.groupBy("namespace").agg(*counts)
    groups = F.array_compact(F.array(F.struct(F.lit("").alias("namespace"), "n"), F.when(F.col("s") > 0, F.struct(F.lit("(semantic)").alias("namespace"), F.col("s").alias("n")))))
    per_file = per_file.unionByName(sums.select(F.inline(groups)).groupBy("namespace").agg(*counts))
    names = F.array_compact(F.array(F.col("namespace"), F.lit(""), F.when(semantic, F.lit("(semantic)"))))
    tags = tagged.groupBy("namespace", "value").agg(F.count("*").alias("n"))
    per_tag = tags.select(F.explode(names).alias("namespace")).groupBy("namespace").agg(F.count("*").alias("n_tags"))
    out = per_file.join(per_tag, "namespace").join(F.broadcast(total))  # one row
    return out.select("namespace", "n_files", "n_tags", "n_rows", F.round(F.coalesce(F.try_divide(F.col("n_files").cast("double"), F.col("total").cast("double")), F.lit(0.0)), 6).alias("share"))
