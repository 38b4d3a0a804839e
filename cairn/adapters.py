"""The given tables as the data model's files, tags, histories and scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the files table.
FILES = "file_id bigint, path string, ext string, size bigint, mtime_ns bigint, ctime_ns bigint, fs_id binary, magic binary, content_hash binary, last_seen_scan bigint, deleted_at bigint"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_groups(df: DataFrame, most: int) -> int:
    """The row groups of the Parquet files that are read, or `most` if there are as many files."""
    spark, files = df.sparkSession, df.inputFiles()
    if len(files) >= most:
        return most
    jvm, conf, found = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    for f in files:
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(f), conf))
        try:
            found += reader.getRowGroups().size()
        finally:
            reader.close()
    return found


def spread(df: DataFrame) -> DataFrame:
    """A table that a few row groups hold dealt over all cores: no more tasks than row groups have rows, however many parts a file is cut into. A table of as many parts and row groups as cores stays as it is."""
    cores, parts = df.sparkSession.sparkContext.defaultParallelism, df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if parts >= cores and row_groups(df, cores) >= cores else df.repartition(max(cores, parts))


def document_files(spark: SparkSession, sf_dir: str, body: bool = False) -> DataFrame:
    """documents as a text corpus in folders by source and language."""
    d = table(spark, sf_dir, "documents")
    d = spread(d) if body else d
    path = F.concat(F.lit("/corpus/"), "source", F.lit("/"), "lang", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    ns = F.col("doc_id") * 1_000_000_000
    out = d.select(
        F.col("doc_id").alias("file_id"), path.alias("path"), F.lit("txt").alias("ext"), F.octet_length("text").cast("long").alias("size"), ns.alias("mtime_ns"), ns.alias("ctime_ns"),
        F.lit(None).cast("binary").alias("fs_id"), F.lit(None).cast("binary").alias("magic"), F.lit(None).cast("binary").alias("content_hash"), F.lit(1).cast("long").alias("last_seen_scan"), F.lit(None).cast("long").alias("deleted_at"), F.col("text").alias("body"),
    )
    return out if body else out.drop("body")


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.col("text").alias("body")))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as files whose path is the url without scheme, query and fragment."""
    path = F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", ""))
    ext = F.nullif(F.regexp_extract(path, r"/[^/]+\.([a-z]+)$", 1), F.lit(""))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), path.alias("path"), ext.alias("ext"), F.octet_length("html").cast("long").alias("size"), F.substring(F.col("html").cast("binary"), 1, 512).alias("magic"), F.col("html").alias("body"))


def named_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parts as files whose names show dates, versions and patterns; every rule of names has its rows."""
    p, k = spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_name")), F.col("p_partkey")
    month, day = F.lpad((k % 13).cast("string"), 2, "0"), F.lpad((k % 32).cast("string"), 2, "0")
    year = (1968 + k % 134).cast("string")
    kinds = [
        F.concat(F.lit("report-"), year, F.lit("-"), month, F.lit("-"), day, F.lit(".xlsx")),
        F.concat(F.lit("IMG_"), year, month, day, F.lit("_120000.JPG")),
        F.concat(F.lit("plan_v"), (k % 1200).cast("string"), F.lit("_final.md")),
        F.concat(F.lit("notes "), F.lit("("), (k % 5).cast("string"), F.lit(").txt")),
        F.concat(F.lit("dump."), F.element_at(F.array(*map(F.lit, ["bak", "tmp", "old", "swp", "sql", "tgz", "jpeg"])), (k % 7 + 1).cast("int"))),
        F.concat(F.lit("提案書_最終 rev"), (k % 50).cast("string"), F.lit(".pdf")),
        F.concat(F.lit("Screenshot "), year, month, F.lit(".png")),
        F.concat(F.lit(".config"), (k % 3).cast("string")),
        F.concat(F.lit("~$draft copy - Copy.docx")),
        F.concat(F.lit("main"), (k % 9).cast("string"), F.lit(".rs")),
    ]
    name = F.element_at(F.array(*kinds), (k % 10 + 1).cast("int"))
    folder = F.concat(F.lit("/work/"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("/"), F.lower("p_type"), F.lit("/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(" "), year)
    path = F.concat(folder, F.lit("/"), name)
    ext = F.nullif(F.lower(F.regexp_extract(name, r".\.([^.]+)$", 1)), F.lit(""))
    return p.select(k.cast("long").alias("file_id"), path.alias("path"), name.alias("name"), ext.alias("ext"), F.lit(None).cast("binary").alias("magic"))


def part_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag layer of low-cardinality facets over parts."""
    p = spread(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size", "p_name"))
    facet = lambda ns, v: F.struct(F.lit(ns).alias("namespace"), F.lower(v.cast("string")).alias("value"))
    words = F.split("p_name", " ")
    facets = F.array(facet("brand", F.col("p_brand")), facet("type", F.col("p_type")), facet("size", F.col("p_size")), facet("word", words[0]), facet("word", words[1]), facet("source", F.lit("catalogue")))
    rows = p.select(F.col("p_partkey").cast("long").alias("file_id"), F.explode(F.array_distinct(facets)).alias("t"))
    return rows.select("file_id", "t.namespace", "t.value", F.lit(1).alias("sources"))


def second_listing(files: DataFrame) -> DataFrame:
    """What a later crawl of document_files finds: by the last digit of the id, 0 is gone, 1 has grown, 2 is renamed, 3 has a new copy besides; all else is as before."""
    digit = F.col("file_id") % 10
    later = F.lit(10**15)
    seen = files.where(digit != 0).select(
        F.when(digit == 2, F.concat(F.lit("/moved"), "path")).otherwise(F.col("path")).alias("path"), "ext", F.when(digit == 1, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
        F.when(digit == 1, F.col("mtime_ns") + later).otherwise(F.col("mtime_ns")).alias("mtime_ns"), F.when(digit == 1, F.col("mtime_ns") + later).otherwise(F.col("ctime_ns")).alias("ctime_ns"), "fs_id",
    )
    new = files.where(digit == 3).select(F.concat(F.lit("/new"), "path").alias("path"), "ext", (F.col("size") + 7).alias("size"), (F.col("mtime_ns") + later).alias("mtime_ns"), (F.col("ctime_ns") + later).alias("ctime_ns"), "fs_id")
    return seen.unionByName(new)


def numbered(files: DataFrame) -> DataFrame:
    """document_files on a file system that numbers its files."""
    return files.withColumn("fs_id", F.col("file_id").cast("string").cast("binary"))


def renumbered_listing(files: DataFrame) -> DataFrame:
    """What a later crawl of numbered files finds: by the last digit of the id, 0 is gone, 2 is renamed and has grown, 4 is renamed, 5 is gone but for two new links to it, 6 has got another number, 7 was renamed to where a new file has its number no more; all else is as before."""
    digit, later = F.col("file_id") % 10, F.lit(10**15)
    cols = ["path", "ext", "size", "mtime_ns", "ctime_ns", "fs_id"]
    at = lambda prefix: F.concat(F.lit(prefix), "path")
    seen = files.where(~digit.isin(0, 5)).withColumn("path", F.when(digit == 2, at("/grown")).when(digit == 4, at("/moved")).when(digit == 7, at("/fresh")).otherwise(F.col("path")))
    seen = seen.withColumn("size", F.when(digit == 2, F.col("size") + 9).otherwise(F.col("size"))).withColumn("mtime_ns", F.when(digit == 2, F.col("mtime_ns") + later).otherwise(F.col("mtime_ns")))
    seen = seen.withColumn("fs_id", F.when(digit.isin(6, 7), F.concat(F.lit(b"new"), "fs_id")).otherwise(F.col("fs_id")))
    links = [files.where(digit == 5).withColumn("path", at(p)) for p in ("/b", "/a")]
    return seen.select(*cols).unionByName(links[0].select(*cols)).unionByName(links[1].select(*cols))


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as records of a change journal."""
    reason = F.element_at(F.create_map(*map(F.lit, ["view", "security", "click", "overwrite", "purchase", "extend", "signup", "create", "error", "delete"])), F.col("event_type"))
    return table(spark, sf_dir, "events").select(F.concat(F.lit("/users/"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("usn"), reason.alias("reason"))


def access_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("file_id"), "ts", F.col("event_type").alias("kind"))
