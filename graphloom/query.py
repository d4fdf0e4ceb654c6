"""Questions to a project's graph.  Answers are bounded: a page, a symbol, or at most a few hundred nodes."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text
from graphloom.operators import graph, search
from graphloom.store import SEARCHED, Store

# Bounds of the answers.
RELATED, MOST_HITS, TRACE_NODES = 20, 50, 200
REF = ("qualified_name", "label", "file_path", "start_line", "end_line", "signature")


@dataclass(frozen=True)
class Symbol:
    qualified_name: str
    label: str
    file_path: str
    start_line: int
    end_line: int
    signature: str
    hop: int = 0
    short: str = ""
    confidence: float | None = None


@dataclass(frozen=True)
class Source:
    symbol: Symbol
    source: str
    truncated: bool
    callers: list[Symbol] = field(default_factory=list)
    callees: list[Symbol] = field(default_factory=list)


@dataclass(frozen=True)
class Hits:
    query: str
    total: int
    matches: list[Symbol] = field(default_factory=list)


@dataclass(frozen=True)
class Trace:
    direction: str
    root: Symbol
    visited: list[Symbol] = field(default_factory=list)


def find(store: Store, qualified_name: str) -> DataFrame:
    return store.table("symbols").where(F.col("qualified_name") == qualified_name)


def symbols_of(store: Store, nodes: DataFrame) -> list[Symbol]:
    """The symbols of rows (node, hop, confidence), by hop and name."""
    rows = store.table("symbols").select(*REF).join(nodes, F.col("qualified_name") == F.col("node"))
    return [Symbol(*(r[c] for c in REF), hop=r["hop"], confidence=r["confidence"]) for r in rows.select(*REF, "hop", "confidence").orderBy("hop", "qualified_name").collect()]


def reached(store: Store, qualified_name: str, callers: bool, depth: int, most: int) -> list[Symbol]:
    """All nodes of a search, which stops beyond ``most``; each with the greatest confidence of the edges it was met by."""
    nodes = graph.bfs(store.table("edges"), qualified_name, callers=callers, max_depth=depth, max_nodes=most)
    return symbols_of(store, nodes.select("node", "hop", F.col("most").alias("confidence")))


def near(store: Store, qualified_name: str, callers: bool) -> list[Symbol]:
    """The first direct neighbours, no more than ``RELATED`` of them, whatever the node's degree."""
    nodes = graph.first_neighbours(store.table("edges"), qualified_name, callers, RELATED)
    return symbols_of(store, nodes.select("node", F.lit(1).alias("hop"), F.lit(None).cast("double").alias("confidence")))


def truncated(source: str, most: int = text.SHOWN_BYTES) -> tuple[str, bool]:
    """At most so many bytes, cut at a line's end if one is in the second half."""
    data = source.encode("utf-8")
    if len(data) <= most:
        return source, False
    head = data[:most]
    at = head.rfind(b"\n")
    return head[: at if at > most // 2 else most].decode("utf-8", "ignore"), True


def get_source(store: Store, qualified_name: str) -> Source | None:
    """The symbol with its source and direct neighbours; nothing for an unknown name."""
    row = find(store, qualified_name).select(*REF, F.coalesce("source", F.lit("")).alias("source")).first()
    if row is None:
        return None
    shown, cut = truncated(row["source"])
    return Source(Symbol(*(row[c] for c in REF)), shown, cut, near(store, qualified_name, True), near(store, qualified_name, False))


def matching(store: Store, query: str, label: str | None = None, file_pattern: str | None = None, name_pattern: str | None = None) -> tuple[DataFrame, list]:
    """All matches and their order: by rank for a query with terms, by name otherwise."""
    symbols = store.table("symbols")
    keep = F.lit(True)
    for column, value in (("file_path", file_pattern), ("name", name_pattern)):
        if value:
            keep = keep & F.col(column).ilike(value)
    if label:
        keep = keep & (F.col("label") == label)
    if not query.strip():
        return symbols.where(keep).select(*REF), [F.col("name"), F.col("qualified_name")]
    hits = search.looked_up(store.postings(), "qualified_name", query, SEARCHED)
    return symbols.where(keep).select(*REF).join(hits, "qualified_name").select(*REF, "score"), [F.col("score"), F.col("qualified_name")]


def find_symbols(store: Store, query: str, label: str | None = None, file_pattern: str | None = None, limit: int = 10, offset: int = 0, cap: int = MOST_HITS) -> Hits:
    """A page of matches, and how many there are in all."""
    rows, order = matching(store, query, label, file_pattern)
    page, total = search.page(rows, order, max(0, min(limit, cap)), max(0, offset))
    hits = [Symbol(*(r[c] for c in REF), short=r["short"]) for r in page.select(*REF, text.short_signature(F.coalesce("signature", F.lit(""))).alias("short")).collect()]
    return Hits(query, total.first()["total"], hits)


def trace(store: Store, qualified_name: str, callers: bool = True, depth: int = 3) -> Trace | None:
    """All that reaches a symbol, or that it reaches, within 1 to 10 hops."""
    row = find(store, qualified_name).select(*REF).first()
    if row is None:
        return None
    return Trace("callers" if callers else "callees", Symbol(*(row[c] for c in REF)), reached(store, qualified_name, callers, max(1, min(depth, graph.MOST_DEPTH)), TRACE_NODES))


def summary(store: Store) -> dict:
    """Totals, counts by label and edge type (largest first), and ten names."""
    by = lambda name, column: [(r[0], r[1]) for r in store.table(name).groupBy(column).count().orderBy(F.desc("count"), column).collect()]
    labels, types = by("symbols", "label"), by("edges", "type")
    names = [r[0] for r in store.table("symbols").select("qualified_name").orderBy("qualified_name").limit(10).collect()]
    return {"total_nodes": sum(n for _, n in labels), "total_edges": sum(n for _, n in types), "node_labels": labels, "edge_types": types, "sample_qns": names}
