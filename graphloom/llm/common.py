"""Shared machinery: tables in the cluster's shared folder, block pairs, components.

Intermediate results that are read more than once, or that would otherwise
grow a long lineage, are written as Parquet below ``spark.checkpoint.dir``.
An executor that is lost afterwards costs only the tasks it was running.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_own_folder: list[str] = []


def importable(spark: SparkSession) -> None:
    """Let Python workers that start from now on find this package."""
    env = spark.sparkContext.environment
    if PACKAGE_ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH", ""), PACKAGE_ROOT]))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` where it is set.  Else, on one machine, a folder of
    our own; on a cluster the warehouse, which is shared by definition.
    """
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not _own_folder:
        _own_folder.append(tempfile.mkdtemp(prefix="graphloom-"))
        atexit.register(shutil.rmtree, _own_folder[0], ignore_errors=True)
    return f"file://{_own_folder[0]}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/graphloom/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table that ``written`` made and nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def few_rows_a_batch(spark: SparkSession, rows: int) -> Iterator[None]:
    """While it lasts, actions hand rows to Python in batches this small; for rows that hold whole blocks."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def free(columns: Iterable[str], name: str) -> str:
    """``name`` with as many underscores before it as it takes to differ from all columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def with_group(rows: DataFrame, keys: list[str], own: list[str], sums: dict[str, tuple[Column, Callable[[str], Column]]], having: str = "true", salts: int = 64) -> DataFrame:
    """``rows`` with aggregates of their group by ``keys``, of the groups that pass ``having``.

    sums: name to (aggregate, how to merge aggregates of parts).  Rows stay
    dealt by ``keys`` and a salt, the hash of their columns ``own``, so a hot group
    is spread over ``salts`` tasks; its aggregates go to the salts that it has.
    Rows whose keys hold null are left out.
    """
    salt = free(rows.columns, "salt")
    dealt = rows.withColumn(salt, F.pmod(F.xxhash64(*own), F.lit(salts)))
    parts = dealt.groupBy(*keys, salt).agg(*(a.alias(n) for n, (a, _) in sums.items()))
    whole = parts.groupBy(*keys).agg(*(merge(n).alias(n) for n, (_, merge) in sums.items()), F.collect_list(salt).alias(salt)).where(having)
    return dealt.join(whole.withColumn(salt, F.explode(salt)), [*keys, salt]).drop(salt)


def slices(batches: Iterator[pa.RecordBatch], column: int, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the column at this place holds about ``most_bytes`` in each; a longer value stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(column)
        wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
        offsets = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1]
        begin = 0
        while begin < len(col):
            end = int(np.searchsorted(offsets, offsets[begin] + most_bytes, side="right")) - 1
            end = min(max(end, begin + 1), len(col))
            yield batch.slice(begin, end - begin)
            begin = end


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph on 0..n-1 whose edges arrive in arrays."""
    parent = np.arange(n)
    left: list[int] = []
    right: list[int] = []

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, j in pairs:
        while len(i):
            apart = parent[i] != parent[j]
            i, j = i[apart], j[apart]
            for a, b in zip(i[:4096].tolist(), j[:4096].tolist(), strict=True):
                x, y = find(a), find(b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    left.append(a)
                    right.append(b)
            i, j = i[4096:], j[4096:]
            while not np.array_equal(up := parent[parent], parent):
                parent[:] = up
    return np.array(left, np.int64), np.array(right, np.int64)


def local_roots(n: int, i: list[int], j: list[int]) -> list[int]:
    """The smallest member of each node's component in the graph on 0..n-1."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in zip(i, j, strict=True):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def contracted(edges: DataFrame, count: int, most_edges: int) -> DataFrame:
    """Edges (u > v) with the same components, no more than one a node in each part of about ``most_edges``."""
    kind = edges.schema["u"].dataType

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches), pa.schema([("u", to_arrow_type(kind)), ("v", to_arrow_type(kind))]))
        nodes, place = np.unique(np.concatenate([held.column(k).to_numpy(zero_copy_only=False) for k in (0, 1)]), return_inverse=True)
        roots = np.array(local_roots(len(nodes), place[: len(held)].tolist(), place[len(held) :].tolist()), np.int64)
        own = np.flatnonzero(roots != np.arange(len(nodes)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[k], to_arrow_type(kind)) for k in (own, roots[own])], names=["u", "v"])

    return edges.repartition(-(-count // most_edges)).mapInArrow(stars, edges.schema)


def connected_components(edges: DataFrame, most_rounds: int = 64, most_edges: int = 200_000) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v); root is the smallest node reachable.

    First, parts of at most about ``most_edges`` edges are each reduced to stars, then
    all of them together.  That alternates the large-star and small-star steps until nothing changes.  Every
    step is a partial aggregation and an equi-join whose streamed side adaptive
    execution can split, so a hub's links need not meet in one task.  Each
    round is written to the shared folder and the one before is deleted.
    Rows with a null end and loops are left out; an empty table gives an empty one.
    """
    graph = written(
        edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    count = graph.count()
    if count:
        fewer = written(contracted(graph, count, most_edges).distinct(), "edges")
        drop_written(graph)
        graph = fewer
    seen = None
    for _ in range(most_rounds):
        both = graph.unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct(), "edges")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        drop_written(graph)
        graph = after
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = graph.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return graph.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
