"""Continuous ingest: micro-batches of changed rows, upserted into a Parquet table by key."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.artifact import Folder
from graphloom.storage import upsert


class Snapshots:
    """A table in numbered snapshots below ``path``; readers take the highest.

    Rows are dealt to ``buckets`` by the hash of their keys.  A snapshot is a small
    file that names the folder of each bucket; a change writes the buckets
    it touches, and the others stay the folders they were.  The file appears
    under its name when all it names is complete.  The number of buckets is that
    of the first snapshot; it should grow with the table, not with a batch.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets
        self.folder = Folder(spark, self.path)
        taken = {c.lower() for c in spark.createDataFrame([], schema).columns}
        self.column = next(c for k in range(len(taken) + 1) if (c := f"bucket{k or ''}") not in taken)  # parts the folders, and is not in the table

    def versions(self) -> list[int]:
        if not self.folder.exists(""):
            return []
        names = [s.getPath().getName() for s in self.folder.fs.listStatus(self.folder.at(""))]
        return sorted(int(n[1:-5]) for n in names if n[:1] == "v" and n[1:-5].isdigit() and n.endswith(".json"))

    def manifest(self) -> dict:
        """The current snapshot: how many buckets, and the folder of each that has rows."""
        versions = self.versions()
        return json.loads(self.folder.get(f"v{versions[-1]}.json")) if versions else {"buckets": self.buckets, "folders": {}}

    def bucket(self, count: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(count)).cast("int")

    def read(self, only: set[int] | None = None) -> DataFrame:
        """The table, or these buckets of it."""
        folders = [f"{self.path}/{f}" for b, f in sorted(self.manifest()["folders"].items()) if only is None or int(b) in only]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame, only: set[int] | None = None) -> int:
        """Write the next snapshot, of these rows; with ``only``, they replace those buckets and the others stay."""
        now = self.manifest()
        version, fresh = (self.versions() or [0])[-1] + 1, f"data-{uuid.uuid4().hex}"
        dealt = rows.withColumn(self.column, self.bucket(now["buckets"]))
        dealt.repartition(self.column).write.partitionBy(self.column).option("compression", "zstd").parquet(f"{self.path}/{fresh}")
        made = [s.getPath().getName() for s in self.folder.fs.listStatus(self.folder.at(fresh)) if s.isDirectory()]
        kept = {b: f for b, f in now["folders"].items() if only is not None and int(b) not in only}
        now["folders"] = kept | {m.removeprefix(f"{self.column}="): f"{fresh}/{m}" for m in made if m.startswith(f"{self.column}=")}
        if self.folder.exists(f"v{version}.json"):
            raise RuntimeError(f"{self.path}: version {version} exists")
        self.folder.put(f"v{version}.json", json.dumps(now))
        return version

    def prune(self, keep: int = 2) -> None:
        """Delete all but the last snapshots and the folders that only they name; readers of older ones and writers must have ended."""
        versions = self.versions()
        for v in versions[:-keep]:
            self.folder.fs.delete(self.folder.at(f"v{v}.json"), False)
        named = {f for v in versions[-keep:] for f in json.loads(self.folder.get(f"v{v}.json"))["folders"].values()}
        parents = {f.split("/")[0] for f in named}
        for data in self.folder.fs.listStatus(self.folder.at("")) if versions else []:
            name = data.getPath().getName()
            if name.startswith("data-") and name not in parents:
                self.folder.fs.delete(data.getPath(), True)
            elif name in parents:
                for part in self.folder.fs.listStatus(data.getPath()):
                    if part.isDirectory() and f"{name}/{part.getPath().getName()}" not in named:
                        self.folder.fs.delete(part.getPath(), True)

    def upsert(self, rows: DataFrame, order: list[str]) -> int | None:
        """Replace rows of the same keys, the last by ``order`` of several; only buckets that the rows are in are read and written."""
        count = self.manifest()["buckets"]
        touched = {r[0] for r in rows.select(self.bucket(count)).distinct().collect()}  # no more than there are buckets
        return self.write(upsert(self.read(touched), rows, self.keys, order), touched) if touched else None


def stream_upserts(stream: DataFrame, table: Snapshots, order: list[str], checkpoint: str) -> StreamingQuery:
    """Each micro-batch replaces rows of the same keys; a batch that is repeated changes nothing more."""

    def merged(batch: DataFrame, _: int) -> None:
        held = batch.persist()
        try:
            table.upsert(held, order)
        finally:
            held.unpersist()

    return stream.writeStream.foreachBatch(merged).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
