"""A project's tables as one snapshot: all of them appear together, or none."""

from __future__ import annotations

import uuid
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.errors import StoreError, StoreNotFoundError
from graphloom.operators import search
from graphloom.storage import together

# The tables' columns.
CALLS = "array<struct<callee:string,line:int,qualifier:string>>"
IMPORTS = "array<struct<module_path:string,names:array<string>,alias:string,line:int>>"
TABLES = {
    "project": "name string, root_path string, indexed_at string, schema_version int",
    "files": f"path string, language string, source string, line_count int, size_bytes bigint, imports {IMPORTS}",
    "file_hashes": "path string, sha256 string, mtime_ns bigint, size_bytes bigint",
    "symbols": f"qualified_name string, name string, label string, file_path string, start_line int, end_line int, signature string, source string, parent string, properties string, calls {CALLS}, imports {IMPORTS}, unsupported_calls int",
    "edges": "source_qn string, target_qn string, type string, confidence double, strategy string, line int, ord string",
}
SCHEMA_VERSION = 1
#: What a snapshot holds beside its tables, made from them: the index of the symbols' terms.
POSTINGS = "term string, qualified_name string, length int, places array<int>"
SEARCHED = ["name", "qualified_name", "signature", "source"]


def index_of(symbols: DataFrame) -> DataFrame:
    """The postings of symbols, which are names, signatures and sources."""
    named = symbols.select("qualified_name", *(F.col(c).alias(f"_{c}") for c in SEARCHED))
    return search.postings(named, "qualified_name", [f"_{c}" for c in SEARCHED])


class Store:
    """Snapshots ``v1``, ``v2``, ... below ``root/project``; readers take the highest."""

    def __init__(self, spark: SparkSession, root: str, project: str, read_only: bool = False):
        self.spark, self.root, self.project, self.read_only, self.bulk = spark, root.rstrip("/"), project, read_only, False
        self.path = f"{self.root}/{project}"
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self.fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if read_only:
            self.folder()  # refuses a store that is not there

    def versions(self) -> list[int]:
        if not self.fs.exists(self._path(self.path)):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(self._path(self.path))]
        return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit())

    def exists(self) -> bool:
        return bool(self.versions())

    def folder(self) -> str:
        versions = self.versions()
        if not versions:
            raise StoreNotFoundError(self.path)
        return f"{self.path}/v{versions[-1]}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.folder()}/{name}")

    def indexed(self) -> bool:
        """Whether the current snapshot has postings; those of earlier releases have none."""
        return self.fs.exists(self._path(f"{self.folder()}/postings"))

    def postings(self) -> DataFrame:
        if not self.indexed():
            return index_of(self.table("symbols"))
        return self.spark.read.schema(POSTINGS).parquet(f"{self.folder()}/postings")

    def commit(self, tables: dict[str, DataFrame], level: int = 3, postings: DataFrame | None = None) -> int:
        """Write a snapshot of all tables and make it the current one; ``postings`` are those of its symbols, where they are known."""
        if self.read_only:
            raise StoreError(f"{self.path} is open for reading")
        if set(tables) != set(TABLES):
            raise StoreError(f"tables {sorted(tables)}")
        version = (self.versions() or [0])[-1] + 1
        staged = f"{self.path}/_staged-{uuid.uuid4().hex}"
        try:
            rows = tables | {"postings": search.in_order(index_of(tables["symbols"]) if postings is None else postings, "qualified_name")}

            def written(name: str, schema: str) -> None:
                columns = [c.split()[0] for c in schema.replace(", ", "\n").split("\n")]
                rows[name].select(columns).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(f"{staged}/{name}")

            together(*(partial(written, *t) for t in TABLES.items()), partial(written, "postings", POSTINGS))
            if not self.fs.rename(self._path(staged), self._path(f"{self.path}/v{version}")):
                raise StoreError(f"{self.path}: version {version} exists")
        finally:
            self.fs.delete(self._path(staged), True)
        return version

    def begin_bulk(self) -> None:
        """Mark that many changes follow; snapshots need nothing else."""
        if self.bulk:
            raise StoreError("bulk mode is on already")
        self.bulk = True

    def end_bulk(self) -> None:
        if not self.bulk:
            raise StoreError("bulk mode is not on")
        self.bulk = False

    def checkpoint(self) -> None:
        """Nothing to do: a snapshot is complete when it appears."""

    def nodes(self, *condition: Column) -> DataFrame:
        """Symbols with ``id``, a hash of project and name that stays the same from snapshot to snapshot."""
        rows = self.table("symbols").withColumn("id", F.xxhash64(F.lit(self.project), "qualified_name"))
        for c in condition:
            rows = rows.where(c)
        return rows

    def node_by_name(self, qualified_name: str) -> DataFrame:
        return self.nodes(F.col("qualified_name") == qualified_name)

    def node_by_id(self, key: int) -> DataFrame:
        return self.nodes(F.col("id") == key)

    def nodes_of_file(self, path: str) -> DataFrame:
        return self.nodes(F.col("file_path") == path).orderBy("start_line", "qualified_name")

    def records(self) -> DataFrame:
        """All symbols in the order of their places."""
        return self.nodes().orderBy("file_path", "start_line", "qualified_name")

    def ids(self) -> DataFrame:
        return self.nodes().select("qualified_name", "id")

    def names_of_file(self, path: str) -> DataFrame:
        return self.nodes(F.col("file_path") == path).select("qualified_name")

    def file_source(self, path: str) -> str | None:
        row = self.table("files").where(F.col("path") == path).select("source").first()
        return row and row["source"]

    def hashes(self) -> DataFrame:
        return self.table("file_hashes")

    def skeleton(self, labels: tuple[str, ...] | None = None) -> DataFrame:
        """file_path, signature and name of definitions, or of the labels given, in order; ``toLocalIterator`` streams it."""
        chosen = F.col("label").isin(*labels) if labels is not None else F.col("label") != "File"
        return self.table("symbols").where(chosen).orderBy("file_path", "start_line", "qualified_name").select("file_path", "signature", "qualified_name")

    def counts(self) -> DataFrame:
        """One row: numbers of symbols, edges and files, and the greatest schema version."""
        one = lambda name, c, n: self.table(name).agg(c.alias(n))
        parts = [one(t, F.count("*"), f"n_{t}") for t in ("symbols", "edges", "files")]
        return parts[0].crossJoin(parts[1]).crossJoin(parts[2]).crossJoin(one("project", F.max("schema_version"), "schema_version"))  # one row each

    def languages(self) -> DataFrame:
        return self.table("files").where("language is not null").groupBy("language").agg(F.count("*").alias("n"))

    def size(self, folder: str) -> int:
        return self.fs.getContentSummary(self._path(folder)).getLength()

    def prune(self, keep: int = 2) -> None:
        """Delete all but the last snapshots; a reader of an older one must have ended."""
        for version in self.versions()[:-keep]:
            self.fs.delete(self._path(f"{self.path}/v{version}"), True)

    def drop(self) -> None:
        self.fs.delete(self._path(self.path), True)

    def check(self) -> dict[str, int]:
        """Counts of broken rows, all zero in a sound store: keys that repeat, edges without an end, a newer schema."""
        repeats = lambda name, key: self.table(name).groupBy(*key).count().where("count > 1").count()
        names = self.table("symbols").select("qualified_name")
        loose = sum(self.table("edges").join(names, F.col(end) == names.qualified_name, "left_anti").count() for end in ("source_qn", "target_qn"))
        return {
            "symbols": repeats("symbols", ["qualified_name"]), "files": repeats("files", ["path"]), "file_hashes": repeats("file_hashes", ["path"]), "edges": repeats("edges", ["source_qn", "target_qn", "type"]),
            "loose_edges": loose, "newer_schema": self.table("project").where(F.col("schema_version") > SCHEMA_VERSION).count(),
        }


class MemoryStore(Store):
    """A store whose tables are held by the session; nothing is written."""

    def __init__(self, spark: SparkSession, project: str):
        self.spark, self.root, self.path, self.project, self.read_only, self.bulk = spark, "", project, project, False, False
        self.held: list[dict[str, DataFrame]] = []

    def versions(self) -> list[int]:
        return list(range(1, len(self.held) + 1))

    def table(self, name: str) -> DataFrame:
        if not self.held:
            raise StoreNotFoundError(self.project)
        return self.held[-1][name]

    def indexed(self) -> bool:
        return False

    def commit(self, tables: dict[str, DataFrame], level: int = 3, postings: DataFrame | None = None) -> int:
        if set(tables) != set(TABLES):
            raise StoreError(f"tables {sorted(tables)}")
        self.held.append({n: t.select([c.split()[0] for c in TABLES[n].replace(", ", "\n").split("\n")]) for n, t in tables.items()})
        return len(self.held)

    def prune(self, keep: int = 2) -> None:
        pass

    def drop(self) -> None:
        self.held.clear()


def projects(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all projects below ``root``, by name."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path(root)) if s.isDirectory()] if fs.exists(path(root)) else []
    found = [st.table("project") for n in sorted(names) if (st := Store(spark, root, n)).exists()]
    rows = spark.createDataFrame([], TABLES["project"])
    for table in found:
        rows = rows.unionByName(table)
    return rows.orderBy("name")
