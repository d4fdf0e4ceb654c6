"""Building a project's graph from its source files, at once or by what changed."""

from __future__ import annotations

import contextlib
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import storage
from graphloom.functions import naming, text
from graphloom.operators import extract, resolve
from graphloom.sources import repo
from graphloom.store import CALLS, IMPORTS, SCHEMA_VERSION, Store, index_of

#: Local imports come behind a file's own, in order of the lines they stand on.
LOCAL = 1_000_000


@dataclass
class Config:
    project: str = ""
    incremental: bool = True
    max_file_bytes: int = 2 << 20
    max_files: int = 0
    unknown_files: bool = True
    ignore_lines: list[str] = field(default_factory=list)
    follow_ignore_files: bool = True
    on_progress: Callable[[str, int], None] | None = None  # told each step's name and a count; what it raises is not passed on
    min_confidence: float = 0.0


@dataclass
class Result:
    project: str
    version: int
    files_added: int
    files_changed: int
    files_removed: int
    files_unchanged: int
    nodes_total: int
    edges_total: int
    calls_discovered: int
    calls_resolved: int
    calls_unresolved: int
    calls_unsupported: int
    errors: int
    elapsed_seconds: float


def stored_source(source: Column) -> Column:
    """Sources over the limit end at the last line break before it, with a mark.

    The cut is made in bytes; a character that it splits is dropped by decoding.
    """
    head = F.make_valid_utf8(F.substring(F.encode(source, "UTF-8"), 1, text.STORED_BYTES).cast("string"))
    at = F.length(head) - F.length(F.substring_index(head, "\n", -1))
    kept = F.when(at > 1, F.substr(head, F.lit(1), at - 1)).otherwise(F.regexp_replace(head, "�+$", ""))
    return F.when(F.octet_length(source) > text.STORED_BYTES, F.concat(kept, F.lit(text.TRUNCATED))).otherwise(source)


def symbol_rows(files: DataFrame, raw: DataFrame) -> DataFrame:
    """Symbols of (path, source), from what ``extract.extracted`` gave for them; a File row for each file without any."""
    looked = files.where(~F.coalesce(extract.skipped(F.col("path"), F.col("source")), F.lit(False)))
    named = raw.select("path", F.inline("symbols"))
    properties = F.to_json(
        F.struct(
            F.when(F.col("parent") != "", F.col("parent")).alias("parent"), F.when(F.col("is_async"), True).alias("async"), F.when(F.size("decorators") > 0, F.col("decorators")).alias("decorators"), F.nullif("receiver", F.lit("")).alias("receiver"),
            F.nullif("visibility", F.lit("")).alias("visibility"), F.when(F.col("is_static"), True).alias("static"), F.when(F.col("is_abstract"), True).alias("abstract"), F.nullif("return_type", F.lit("")).alias("return_type"),
        )
    )
    defined = named.select(
        naming.qualified(F.col("path"), F.col("name"), F.col("parent")).alias("qualified_name"), "name", "label", F.col("path").alias("file_path"), "start_line", "end_line", "signature", stored_source(F.col("source")).alias("source"), "parent",
        properties.alias("properties"), "calls", "imports", "unsupported_calls",
    )
    plain = looked.join(raw.where(F.size("symbols") > 0).select("path"), "path", "left_anti").join(raw.select("path", "error"), "path", "left")
    reason = F.when(naming.language(F.col("path")).isNull(), "no_language").when(F.col("error").isNotNull(), "parse_error").otherwise("no_definitions")
    stem = F.lower(F.substring_index("path", "/", -1))
    lone = plain.select(
        F.coalesce(F.nullif(naming.module(F.col("path")), F.lit("")), stem).alias("qualified_name"), stem.alias("name"), F.lit("File").alias("label"), F.col("path").alias("file_path"), F.lit(1).alias("start_line"),
        F.when(F.coalesce("source", F.lit("")) == "", 0).otherwise(F.size(text.split_lines(F.col("source")))).alias("end_line"), F.concat(F.lit("# "), "path").alias("signature"), stored_source(F.col("source")).alias("source"), F.lit("").alias("parent"),
        F.to_json(F.struct(reason.alias("reason"), naming.file_label(F.col("path")).alias("language"), F.octet_length("source").alias("size_bytes"), (F.octet_length("source") > text.STORED_BYTES).alias("was_truncated"), "error")).alias("properties"),
        F.array().cast(CALLS).alias("calls"), F.array().cast(IMPORTS).alias("imports"), F.lit(0).alias("unsupported_calls"),
    )
    return storage.last_wins(defined.unionByName(lone), ["qualified_name"], ["file_path", "start_line", "end_line"])


def call_rows(symbols: DataFrame) -> DataFrame:
    """One row for each distinct call of a file, in order of ``call_index``."""
    pad = lambda c: F.lpad(c.cast("string"), 9, "0")
    each = symbols.select("file_path", F.col("qualified_name").alias("in_function"), "start_line", F.posexplode("calls").alias("pos", "call"))
    one = each.select("file_path", "in_function", "call.*", F.concat_ws("#", "file_path", pad(F.col("start_line")), "in_function", pad(F.col("pos"))).alias("call_index"))
    return one.groupBy("file_path", "callee", "line", "qualifier", "in_function").agg(F.min("call_index").alias("call_index")).withColumn("module_qn", naming.module(F.col("file_path")))


def import_rows(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """A file's imports, and those inside definitions, which count there only."""
    top = files.select(F.col("path").alias("file_path"), F.lit("").alias("in_function"), F.posexplode("imports").alias("ordinal", "i"))
    local = symbols.select("file_path", F.col("qualified_name").alias("in_function"), F.explode("imports").alias("i")).withColumn("ordinal", F.col("i.line") + LOCAL)
    rows = top.unionByName(local).select("file_path", "in_function", "i.*", "ordinal")
    return rows.groupBy("file_path", "module_path", "names", "alias", "line", "in_function").agg(F.min("ordinal").alias("ordinal"))


def edge_rows(calls: DataFrame, resolved: DataFrame, symbols: DataFrame, min_confidence: float) -> DataFrame:
    found = resolved.where(F.col("target").isNotNull() & (F.col("confidence") >= min_confidence))
    lines = calls.select("file_path", "call_index", "line")
    edges = found.join(lines, ["file_path", "call_index"]).select(F.col("source").alias("source_qn"), F.col("target").alias("target_qn"), F.lit("CALLS").alias("type"), "confidence", "strategy", "line", F.col("call_index").alias("ord"))
    return storage.insert_edges(edges, symbols, ["ord"])


def run(spark: SparkSession, root: str, store_root: str, config: Config | None = None) -> Result:
    """Index the files below ``root`` into the project's store."""
    config = config or Config()
    current = repo.read_repository(spark, root, config.ignore_lines, config.max_file_bytes, config.max_files, config.unknown_files, config.follow_ignore_files)
    return update(Store(spark, store_root, config.project or naming.project_name(root)), current, root, config)


def update(store: Store, current: DataFrame, root: str = "", config: Config | None = None) -> Result:
    """Bring a store up to the files (path, source, sha256, mtime_ns, size_bytes).

    With ``incremental`` and a snapshot there, only files that are new or
    changed are parsed; symbols of the others are kept, and all edges are
    resolved anew from the calls stored with the symbols.
    """
    began, config, spark, project = time.monotonic(), config or Config(), store.spark, store.project

    def told(step: str, count: int) -> None:
        if config.on_progress:
            with contextlib.suppress(Exception):
                config.on_progress(step, count)

    known = config.incremental and store.exists()
    old = {name: store.table(name) for name in ("files", "file_hashes", "symbols")} if known else {}
    if known:
        changes = storage.cut_lineage(storage.classify_changes(old["file_hashes"], current))  # paths only
        counts = {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
        fresh = storage.cut_lineage(current.join(changes.where("change in ('added', 'changed')").select("path"), "path", "left_semi"))
    else:
        fresh = storage.cut_lineage(current)
        counts = {"added": fresh.count()}
    told("discovered", sum(n for change, n in counts.items() if change != "removed"))
    raw = storage.cut_lineage(extract.extracted(fresh.where(~F.coalesce(extract.skipped(F.col("path"), F.col("source")), F.lit(False)))))
    symbols = symbol_rows(fresh, raw)
    files = fresh.join(raw.select("path", "imports"), "path", "left").select(
        "path", naming.file_label(F.col("path")).alias("language"), stored_source(F.col("source")).alias("source"), text.line_count(F.col("source")).alias("line_count"), "size_bytes", F.coalesce("imports", F.array().cast(IMPORTS)).alias("imports")
    )
    hashes = fresh.select("path", "sha256", "mtime_ns", "size_bytes")
    if known:
        gone = changes.where("change in ('removed', 'changed')").select("path")
        kept = old["symbols"].join(gone.withColumnRenamed("path", "file_path"), "file_path", "left_anti")
        symbols = storage.last_wins(kept.unionByName(symbols), ["qualified_name"], ["file_path", "start_line", "end_line"])
        files = old["files"].join(gone, "path", "left_anti").unionByName(files)
        hashes = old["file_hashes"].join(gone, "path", "left_anti").unionByName(hashes)
    symbols, files = storage.together(lambda: storage.cut_lineage(symbols), lambda: storage.cut_lineage(files))
    postings = None
    if known and store.indexed():  # of symbols from files that did not change they stay
        parsed = fresh.select(F.col("path").alias("file_path"))
        same = symbols.join(parsed, "file_path", "left_anti").select("qualified_name")
        postings = store.postings().join(same, "qualified_name", "left_semi").unionByName(index_of(symbols.join(parsed, "file_path", "left_semi")))
    calls = call_rows(symbols)
    resolved = storage.cut_lineage(resolve.resolve(calls, import_rows(files, symbols), symbols, project))
    edges = storage.cut_lineage(edge_rows(calls, resolved, symbols, config.min_confidence))
    about = spark.range(1).select(F.lit(project).alias("name"), F.lit(root).alias("root_path"), F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("indexed_at"), F.lit(SCHEMA_VERSION).alias("schema_version"))
    version, hits, totals, n_edges, n_errors = storage.together(
        lambda: store.commit({"project": about, "files": files, "file_hashes": hashes, "symbols": symbols, "edges": edges}, postings=postings),
        lambda: resolved.agg(F.count("*").alias("n"), F.count("target").alias("hit")).first(),
        lambda: symbols.agg(F.count("*").alias("n"), F.coalesce(F.sum("unsupported_calls"), F.lit(0)).alias("unsupported")).first(),
        edges.count,
        lambda: raw.where("error is not null").count(),
    )
    result = Result(
        project, version, counts.get("added", 0), counts.get("changed", 0), counts.get("removed", 0), counts.get("unchanged", 0), totals["n"], n_edges, hits["n"], hits["hit"], hits["n"] - hits["hit"], totals["unsupported"],
        n_errors, time.monotonic() - began,
    )
    told("stored", result.nodes_total)
    return result


def run_incremental(spark: SparkSession, root: str, store_root: str, config: Config | None = None) -> Result:
    config = config or Config()
    config.incremental = True
    return run(spark, root, store_root, config)
