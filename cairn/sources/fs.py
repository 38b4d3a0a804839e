"""Data source fs_crawl: the entries of a directory tree, dealt by folders found breadth first, so that one large folder is several tasks.

Unlike the built-in binary source it lists names that start with a dot or underscore, keeps nanoseconds, and does not
open files. Prefixes are pruned before they are entered; other exclusions only mark entries, so that every entry is counted.
It reads folders that all executors see under the same path. Options: path, prunedPrefixes (comma), sinceNs.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, ext string, size bigint, mtime_ns bigint, ctime_ns bigint, fs_id binary, attributes int, error string"
#: Folders to deal out, about: the tree is listed level by level until there are as many, or no deeper ones.
TASKS = 256


@dataclass
class Subtree(InputPartition):
    """One directory, whole or its files alone."""

    folder: str
    deep: bool


def _row(path: str, st: os.stat_result) -> tuple:
    name = path.rsplit("/", 1)[-1]
    dot = name.rfind(".")
    ext = name[dot + 1 :].lower() if 0 < dot < len(name) - 1 else None
    return path, ext, st.st_size, st.st_mtime_ns, st.st_ctime_ns, struct.pack(">QQ", st.st_dev, st.st_ino), getattr(st, "st_file_attributes", 0), None


class CrawlReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.root = os.path.abspath(options["path"])
        self.pruned = [p.rstrip("/") for p in options.get("prunedprefixes", options.get("prunedPrefixes", "")).split(",") if p]
        self.since = int(options.get("sincens", options.get("sinceNs", "-1")))

    def _is_pruned(self, path: str) -> bool:
        return any(path == p or path.startswith(p + "/") for p in self.pruned)

    def _folders(self, folder: str) -> list[str]:
        try:
            with os.scandir(folder) as it:
                return sorted(e.path for e in it if e.is_dir(follow_symlinks=False) and not self._is_pruned(e.path))
        except OSError:  # the task that lists it tells why
            return []

    def partitions(self) -> list[Subtree]:
        shallow, deep = [self.root], self._folders(self.root)
        while deep and len(deep) < TASKS:
            below = [(f, self._folders(f)) for f in deep]
            if not any(b for _, b in below):
                break
            shallow += [f for f, b in below if b]
            deep = [x for f, b in below for x in (b or [f])]
        return [*(Subtree(f, False) for f in shallow), *(Subtree(f, True) for f in deep)]

    def read(self, part: Subtree) -> Iterator[tuple]:
        stack = [part.folder]
        while stack:
            folder = stack.pop()
            try:
                entries = sorted(os.scandir(folder), key=lambda e: e.name)
            except OSError as e:
                yield folder, None, None, None, None, None, None, str(e)
                continue
            for e in entries:
                if self._is_pruned(e.path):
                    continue
                try:
                    if e.is_dir(follow_symlinks=False):
                        if part.deep:
                            stack.append(e.path)
                    elif e.is_file(follow_symlinks=False):
                        row = _row(e.path, e.stat(follow_symlinks=False))
                        if max(row[3], row[4]) > self.since:
                            yield row
                except OSError as err:
                    yield e.path, None, None, None, None, None, None, str(err)


class CrawlSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fs_crawl"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> CrawlReader:
        return CrawlReader(self.options)


def crawl(spark: SparkSession, root: str, pruned: list[str] = (), since_ns: int | None = None):
    """Entries below root; rows with an error tell what could not be read."""
    spark.dataSource.register(CrawlSource)
    reader = spark.read.format("fs_crawl").option("prunedPrefixes", ",".join(pruned))
    if since_ns is not None:
        reader = reader.option("sinceNs", str(since_ns))
    return reader.load(root)
