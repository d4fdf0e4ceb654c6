"""Answers as text and as JSON values, and a project's context within a budget of tokens."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from graphloom import query
from graphloom.errors import InvalidContextError
from graphloom.functions import text
from graphloom.operators import context
from graphloom.store import Store

# Rulers and widths of the text form, version of the JSON form, modes.
RULE = "─" * 60
WIDE, NARROW, VERSION = 60, 52, 1
MODES = ("skeleton", "compact", "summary", "deps")
HOW_TO = '# Use search("query") or get_source("qn") to retrieve code.\n'


def tokens(body: str) -> int:
    return len(body) // text.CHARS_A_TOKEN


def fitted(name: str, width: int) -> str:
    return name.ljust(width) if len(name) <= width else "..." + name[3 - width :]


def plural(n: int, word: str) -> str:
    return f"{n} {word}{'' if n == 1 else 's'}"


def near_text(title: str, symbols: list[query.Symbol]) -> str:
    lines = [f"    {fitted(s.qualified_name, NARROW)}  {s.file_path.rpartition('/')[2]}:{s.start_line}" for s in sorted(symbols, key=lambda s: s.qualified_name)]
    return "\n".join([f"# {title} ({len(symbols)}):", *(lines or ["    (none)"])])


def source_text(found: query.Source) -> str:
    s = found.symbol
    note = f"\n# [source truncated at {text.SHOWN_BYTES} bytes — use a more specific QN to see the full body]" if found.truncated else ""
    head = [RULE, f"# {s.file_path}  lines {s.start_line}-{s.end_line}  [{s.label}]", f"# {s.qualified_name}", RULE, ""]
    body = "\n".join([*head, found.source + note, "", RULE, near_text("called by", found.callers), "", near_text("calls", found.callees)])
    return f"{body}\n\n# ~{tokens(body)} tokens\n{RULE}"


def search_text(hits: query.Hits) -> str:
    if not hits.total:
        return f"# search: {hits.query!r}  (0 results)\n\nNo nodes matched. Try a shorter or broader query."
    shown, rest = len(hits.matches), hits.total - len(hits.matches)
    count = f"showing {shown} of {hits.total}" if rest > 0 else str(hits.total)
    parts = [f"# search: {hits.query!r}  ({count} results)", RULE]
    for s in hits.matches:
        parts += [f"{s.qualified_name}\n  {s.label}  {s.file_path}:{s.start_line}\n  {s.short}", ""]
    if rest > 0:
        parts.append(f"# {plural(rest, 'more result')} — narrow the query or request a higher result limit")
    return "\n".join(parts)


def trace_text(found: query.Trace) -> str:
    noun, n = found.direction, len(found.visited)
    title = f"# trace_{noun}: {found.root.qualified_name}"
    if not n:
        why = "(no callers — this node is not called by any indexed code)" if noun == "callers" else "(no callees — this node calls no indexed code)"
        return "\n".join([title, f"# 0 {noun} found", RULE, why, RULE])
    hops = sorted({s.hop for s in found.visited})
    parts = [title, f"# {n} {noun} found across {plural(hops[-1], 'hop')}", RULE]
    for hop in hops:
        level = sorted((s for s in found.visited if s.hop == hop), key=lambda s: s.qualified_name)
        parts.append(f"\nhop {hop} — {'direct' if hop == 1 else 'indirect'} {noun} ({len(level)})")
        parts += [f"  {fitted(s.qualified_name, WIDE)}  {s.file_path}:{s.start_line}" for s in level]
    parts += ["", f"# {'blast radius' if noun == 'callers' else 'dependency set'}: {plural(n, 'node')} across {plural(hops[-1], 'hop')}"]
    body = "\n".join(parts)
    return f"{body}\n# ~{tokens(body)} tokens\n{RULE}"


def not_found_text(name: str) -> str:
    return f'Node not found: {name!r}\n\nHint: use search("{name.rpartition(".")[2]}") to find similarly named nodes.'


def with_tokens(payload: dict) -> dict:
    """The payload and the tokens of its compact form with sorted keys."""
    return payload | {"estimated_tokens": tokens(json.dumps(payload, ensure_ascii=False, separators=(",", ":"), sort_keys=True))}


def symbol_json(s: query.Symbol) -> dict:
    return {c: getattr(s, c) for c in query.REF}


def source_json(found: query.Source) -> dict:
    near = lambda kind, symbols: [{"relationship": kind, "confidence": 1.0, "strategy": "bfs", "symbol": symbol_json(s)} for s in symbols]
    return with_tokens(
        {"format_version": VERSION, "kind": "source", "symbol": symbol_json(found.symbol), "source": found.source, "source_truncated": found.truncated, "callers": near("caller", found.callers), "callees": near("callee", found.callees)}
    )


def search_json(hits: query.Hits) -> dict:
    return with_tokens({"format_version": VERSION, "kind": "search", "query": hits.query, "total": hits.total, "returned": len(hits.matches), "matches": [symbol_json(s) for s in hits.matches]})


def trace_json(found: query.Trace) -> dict:
    visited = [{"hop": s.hop, "symbol": symbol_json(s)} for s in found.visited]
    return with_tokens({"format_version": VERSION, "kind": "trace", "direction": found.direction, "root": symbol_json(found.root), "total": len(visited), "visited": visited})


def header(project: str, labels: dict[str, int], mode: str) -> str:
    schema = " ".join(f"{label}={n}" for label, n in sorted(labels.items())) or "(empty)"
    return f"# {project} — {labels.get('File', 0)} files, {sum(labels.values())} nodes  [{mode}]\n# schema: {schema}"


def build_context(store: Store, budget: int = context.BUDGET, mode: str | None = None) -> str:
    """The project as text.  Without a mode, the one whose reach covers the size of the full skeleton.

    The size is summed where the rows are; only the lines of the mode that is
    chosen come to the driver, a partition at a time.
    """
    if mode is not None and mode not in MODES:
        raise InvalidContextError(f"mode {mode!r}, not one of {', '.join(MODES)}")
    symbols, files = store.table("symbols"), store.table("files")
    labels = {r[0]: r[1] for r in symbols.groupBy("label").count().collect()}
    if mode is None:
        size = context.blocks(symbols, files, "skeleton").agg(F.coalesce(F.sum(F.char_length("block") + 1), F.lit(0))).first()[0]
        full = (len(header(store.project, labels, "skeleton")) + size) // text.CHARS_A_TOKEN
        mode = symbols.sparkSession.range(1).select(context.mode(F.lit(full), budget)).first()[0]
    parts = [header(store.project, labels, mode)]
    if mode == "summary":
        parts += [HOW_TO + "#", f"# {'path':<60}  cls   fn  meth   est.tokens", f"# {'-' * 60}  ---  ---  ----  ----------"]
    elif mode == "deps":
        parts += [HOW_TO, "# import graph"]
    rows = context.blocks(symbols, files, mode).orderBy("file_path").select("block")
    return "\n".join(parts + [r["block"] for r in rows.toLocalIterator()])
