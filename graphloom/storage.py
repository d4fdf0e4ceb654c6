"""Tables in a folder that driver and executors share, and keyed changes to them."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster's folder where it names one; else the warehouse, which is shared; our own on one machine only, as in tests."""
    if spark.sparkContext.getCheckpointDir() is None:
        local = spark.sparkContext.master.startswith("local")
        own = tempfile.mkdtemp(prefix="graphloom-") if local else spark.conf.get("spark.sql.warehouse.dir")
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", "") or own)


def cut_lineage(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def together(*calls: Callable[[], object]) -> list:
    """What the calls give; they start jobs of their own, which run side by side."""
    with ThreadPoolExecutor(len(calls)) as pool:
        return [f.result() for f in [pool.submit(c) for c in calls]]


def last_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the last by ``order``.  A keyed aggregate, so a hot key is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``table`` with the rows added; a row of the same key is replaced, the last of several rows counts."""
    new = last_wins(rows, keys, order).select(table.columns)
    return table.join(new.select(keys), keys, "left_anti").unionByName(new)


def insert_edges(edges: DataFrame, nodes: DataFrame, order: list[str]) -> DataFrame:
    """Edges (source_qn, target_qn, type, ...) whose ends both exist, the first of each (source, target, type)."""
    known = nodes.select("qualified_name").distinct()
    alive = edges.join(known.withColumnRenamed("qualified_name", "source_qn"), "source_qn", "left_semi").join(known.withColumnRenamed("qualified_name", "target_qn"), "target_qn", "left_semi")
    return first_wins(alive.select(edges.columns), ["source_qn", "target_qn", "type"], order)


def inserted(edges: DataFrame, nodes: DataFrame, order: list[str]) -> int:
    """How many edges ``insert_edges`` gives."""
    return insert_edges(edges, nodes, order).count()


def named_nodes(nodes: DataFrame, strict: bool = True) -> DataFrame:
    """Nodes with a qualified name; ``strict`` refuses tables with others when they are read, else these are left out."""
    empty = F.coalesce(F.col("qualified_name"), F.lit("")) == ""
    if not strict:
        return nodes.where(~empty)
    checked = F.when(empty, F.raise_error(F.lit("a node without a qualified name"))).otherwise(F.col("qualified_name"))
    return nodes.withColumn("qualified_name", checked)


def deleted(table: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``table`` without the keys, and one row with ``n``, how many rows they took."""
    return delete_keys(table, keys), table.join(keys, keys.columns, "left_semi").agg(F.count("*").alias("n"))


def delete_keys(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys, keys.columns, "left_anti")


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the qualified names in ``gone``; edges go with either end."""
    keep = nodes.join(gone, "qualified_name", "left_anti")
    left = edges.join(gone.withColumnRenamed("qualified_name", "source_qn"), "source_qn", "left_anti")
    return keep, left.join(gone.withColumnRenamed("qualified_name", "target_qn"), "target_qn", "left_anti").select(edges.columns)


def classify_changes(stored: DataFrame, current: DataFrame) -> DataFrame:
    """path and change: added, removed, changed or unchanged, from rows (path, sha256, mtime_ns).

    A file whose time differs is changed without a look at its contents; with equal times the hashes decide.
    """
    s = stored.select("path", F.col("sha256").alias("old_hash"), F.col("mtime_ns").alias("old_time"))
    c = current.select("path", F.col("sha256").alias("new_hash"), F.col("mtime_ns").alias("new_time"))
    change = (
        F.when(F.col("old_time").isNull(), "added")
        .when(F.col("new_time").isNull(), "removed")
        .when(F.col("old_time") != F.col("new_time"), "changed")
        .when(F.col("old_hash") != F.col("new_hash"), "changed")
        .otherwise("unchanged")
    )
    return s.join(c, "path", "full_outer").select("path", change.alias("change"))
