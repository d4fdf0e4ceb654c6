"""A project's graph as a folder to keep beside its sources: compressed tables and a manifest."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from datetime import UTC, datetime

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from graphloom.errors import ArtifactError
from graphloom.store import SCHEMA_VERSION, TABLES, Store

# Names and version of the format.
FORMAT_VERSION, GRAPH, MANIFEST, LEVEL = 1, "graph", "artifact.json", 9
ATTRIBUTES = "# code graph artifact\ngraph/** binary merge=ours\n"


@dataclass
class Manifest:
    format_version: int = FORMAT_VERSION
    schema_version: int = SCHEMA_VERSION
    project: str = ""
    exported_at: str = ""
    compression_level: int = LEVEL
    uncompressed_bytes: int = 0
    compressed_bytes: int = 0
    compression_ratio: float = 0.0
    node_count: int = 0
    edge_count: int = 0
    file_count: int = 0
    language_counts: dict[str, int] = field(default_factory=dict)
    indexer_version: str = ""


class Folder:
    """Small files and renames in any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self.at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.at(name))

    def put(self, name: str, body: str) -> None:
        """Written under another name first, so that readers never see half of it."""
        out = self.fs.create(self.at(name + ".tmp"), True)
        try:
            out.write(bytearray(body.encode("utf-8")))
        finally:
            out.close()
        self.fs.delete(self.at(name), False)
        self.fs.rename(self.at(name + ".tmp"), self.at(name))

    def get(self, name: str) -> str:
        data = self.fs.open(self.at(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(data)).decode("utf-8")
        finally:
            data.close()


def export(store: Store, artifact_dir: str, level: int = LEVEL) -> Manifest:
    """Write the current snapshot; the manifest comes last, so a folder with one is complete."""
    spark, folder = store.spark, Folder(store.spark, artifact_dir)
    folder.fs.delete(folder.at(MANIFEST), False)
    folder.fs.delete(folder.at(GRAPH), True)
    for name in TABLES:
        store.table(name).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).parquet(f"{folder.path}/{GRAPH}/{name}")
    languages = store.table("files").where("language is not null").groupBy("language").count().collect()
    raw = sum(store.table(t).agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()[0] for t in TABLES)
    packed = store.size(f"{folder.path}/{GRAPH}")
    made = Manifest(
        project=store.project, exported_at=datetime.now(UTC).isoformat(timespec="seconds"), compression_level=level, uncompressed_bytes=raw, compressed_bytes=packed, compression_ratio=round(raw / packed, 2) if packed else 0.0,
        node_count=store.table("symbols").count(), edge_count=store.table("edges").count(), file_count=store.table("files").count(), language_counts={r["language"]: r["count"] for r in sorted(languages)}, indexer_version=spark.version,
    )
    folder.put(MANIFEST, json.dumps(asdict(made), indent=2))
    if not folder.exists(".gitattributes"):
        folder.put(".gitattributes", ATTRIBUTES)
    return made


def artifact_exists(spark: SparkSession, artifact_dir: str) -> bool:
    folder = Folder(spark, artifact_dir)
    return folder.exists(GRAPH) and folder.exists(MANIFEST)


def read_manifest(spark: SparkSession, artifact_dir: str) -> Manifest | None:
    """Unknown keys are left out, missing ones have their defaults; nothing where there is no readable manifest."""
    folder = Folder(spark, artifact_dir)
    if not folder.exists(MANIFEST):
        return None
    try:
        data = json.loads(folder.get(MANIFEST))
    except ValueError:
        return None
    known = {f.name for f in fields(Manifest)}
    return Manifest(**{k: v for k, v in data.items() if k in known}) if isinstance(data, dict) else None


def import_artifact(artifact_dir: str, store: Store) -> Manifest:
    """Make an artifact's tables the store's next snapshot."""
    if not artifact_exists(store.spark, artifact_dir):
        raise ArtifactError(f"no artifact in {artifact_dir}")
    manifest = read_manifest(store.spark, artifact_dir)
    if manifest is None:
        raise ArtifactError(f"{artifact_dir}/{MANIFEST} cannot be read")
    if manifest.format_version > FORMAT_VERSION:
        raise ArtifactError(f"format {manifest.format_version} is newer than {FORMAT_VERSION}")
    store.commit({name: store.spark.read.schema(schema).parquet(f"{artifact_dir.rstrip('/')}/{GRAPH}/{name}") for name, schema in TABLES.items()})
    return manifest
