"""Tables as snapshots: a generation is written whole, then one small pointer file is added, so readers see either all of it or none."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

VERSION = 3
#: Pointers that are kept besides the current one.
OLD_POINTERS = 4

Made = DataFrame | Callable[[Callable[[str], DataFrame]], DataFrame]


class Conflict(RuntimeError):
    """Another writer has made the generation that this one wanted to make."""


class Store:
    """A catalogue folder on any file system that Spark writes: <root>/gen=<n>-<writer>/<table>, and a pointer CURRENT.<n>.json for each generation, which names the folder of each table and holds the descriptors. The highest pointer that is whole counts; none is ever written over, so that a writer that fails, or comes second, leaves the store as it was."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.state = self._read()

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _pointers(self) -> list[tuple[int, str]]:
        """(generation, path) of the pointers, highest first; 0 is the single pointer of version 2."""
        fs, p = self._fs(self.root)
        if not fs.exists(p):
            return []
        found = []
        for s in fs.listStatus(p):
            name = s.getPath().getName().split(".")
            if name[0] == "CURRENT" and name[-1] == "json" and (len(name) == 2 or name[1].isdigit()):
                found.append((int(name[1]) if len(name) == 3 else 0, s.getPath().toString()))
        return sorted(found, reverse=True)

    def _read(self) -> dict:
        for _, path in self._pointers():
            try:
                state = json.loads("\n".join(r.value for r in self.spark.read.text(path).collect()))
            except ValueError:  # a writer stopped while it wrote the pointer
                continue
            if not isinstance(state.get("version"), int):
                raise ValueError("the store's version cannot be read")
            if state["version"] > VERSION:
                raise ValueError(f"the store has version {state['version']}; this engine knows {VERSION}")
            return state if state["version"] == VERSION else _migrated(state)
        return {"version": VERSION, "generation": 0, "tables": {}, "meta": {}}

    @property
    def generation(self) -> int:
        return self.state["generation"]

    @property
    def scan_generation(self) -> int:
        """How many scans the store has seen; other commits do not count."""
        return int(self.meta("scan_generation") or 0)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{self.state['tables'][name]}/{name}")

    def has(self, name: str) -> bool:
        return name in self.state["tables"]

    def size(self, name: str) -> int:
        """Bytes of a table's files."""
        fs, p = self._fs(f"{self.root}/{self.state['tables'][name]}/{name}")
        return fs.getContentSummary(p).getLength()

    def meta(self, key: str) -> str | None:
        return self.state["meta"].get(key)

    def commit(self, tables: Mapping[str, Made], meta: dict[str, str | None] | None = None, options: dict | None = None) -> int:
        """Writes the tables as a new generation and makes it current; a failure on the way leaves the old one, and so does another writer's commit in between (Conflict). A table may be a function that gets what reads the tables before it. A descriptor set to None goes."""
        n = self.generation + 1
        folder = f"gen={n}-{uuid.uuid4().hex[:12]}"
        new = lambda name: self.spark.read.parquet(f"{self.root}/{folder}/{name}")
        for name, df in tables.items():
            (df(new) if callable(df) else df).write.options(**(options or {})).parquet(f"{self.root}/{folder}/{name}")
        kept = {k: v for k, v in {**self.state["meta"], **(meta or {})}.items() if v is not None}
        state = {"version": VERSION, "generation": n, "tables": {**self.state["tables"], **dict.fromkeys(tables, folder)}, "meta": kept}
        if any(g >= n for g, _ in self._pointers()):
            raise Conflict(f"generation {n} is there already")
        fs, current = self._fs(f"{self.root}/CURRENT.{n}.json")
        try:
            out = fs.create(current, False)
        except Exception as e:  # it appeared since
            raise Conflict(f"generation {n} is there already") from e
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        self.state = state
        for g, path in self._pointers():
            if g < n - OLD_POINTERS:
                fs.delete(self._fs(path)[1], False)
        return n

    def vacuum(self) -> list[str]:
        """Deletes the folders that no pointer names; not while another writer is at work."""
        named = set()
        for _, path in self._pointers():
            named |= set(json.loads("\n".join(r.value for r in self.spark.read.text(path).collect())).get("tables", {}).values())
        fs, p = self._fs(self.root)
        gone = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("gen=") and s.getPath().getName() not in named]
        for path in gone:
            fs.delete(path, True)
        return [g.getName() for g in gone]


def _migrated(state: dict) -> dict:
    """Version 2 named generations by number and counted every commit as a scan."""
    tables = {k: v if isinstance(v, str) else f"gen={v}" for k, v in state["tables"].items()}
    meta = {"scan_generation": str(state["generation"]), **state["meta"]}
    return {**state, "version": VERSION, "tables": tables, "meta": meta}


def behind(scans: int, built: int | None) -> int:
    """How many scans a layer is behind the crawl."""
    return max(0, scans - (built or 0))
