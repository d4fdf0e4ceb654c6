"""Command line: index, skeleton, get-source, search, trace-callers, trace-callees."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from graphloom import artifact, index, query, render
from graphloom.errors import EngineError
from graphloom.operators.context import BUDGET
from graphloom.operators.search import QueryError
from graphloom.store import Store

ARTIFACT_DIR = ".code-graph"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="graphloom", description="A queryable code graph of source files.")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *positional: str, project: bool = True, shaped: bool = True) -> argparse.ArgumentParser:
        one = commands.add_parser(name, help=about)
        for word in positional:
            one.add_argument(word)
        one.add_argument("--store", default=os.path.expanduser("~/.cache/graphloom"), help="folder of the projects' tables")
        if project:
            one.add_argument("--project", "-p", required=True)
        if shaped:
            one.add_argument("--format", choices=("text", "json"), default="text")
        return one

    build = command("index", "index the files of a folder", project=False, shaped=False)
    build.add_argument("repo_path", nargs="?", default=".")
    build.add_argument("--project", "-p", default="")
    build.add_argument("--incremental", action=argparse.BooleanOptionalAction, default=True)
    build.add_argument("--export", action=argparse.BooleanOptionalAction, default=True)
    shape = command("skeleton", "the project within a budget of tokens", shaped=False)
    shape.add_argument("--mode", choices=render.MODES)
    shape.add_argument("--budget", type=int, default=BUDGET)
    command("get-source", "a symbol's source and neighbours", "qualified_name")
    find = command("search", "ranked search of symbols", "query")
    find.add_argument("--label")
    find.add_argument("--file", help="pattern with % and _")
    find.add_argument("--limit", "-n", type=int, default=10)
    for name in ("trace-callers", "trace-callees"):
        command(name, "what reaches a symbol, or what it reaches", "qualified_name").add_argument("--depth", type=int, default=3)
    return top


def answer(spark: SparkSession, args: argparse.Namespace) -> tuple[str, int]:
    """The text to print, and the exit status."""
    if args.command == "index":
        root = args.repo_path if "://" in args.repo_path else os.path.abspath(args.repo_path)
        done = index.run(spark, root, args.store, index.Config(project=args.project, incremental=args.incremental, ignore_lines=[ARTIFACT_DIR + "/"]))
        lines = [
            f"Project:  {done.project}", f"Store:    {args.store}/{done.project}/v{done.version}", f"Files:    {done.files_added + done.files_changed} extracted, {done.files_unchanged} unchanged, {done.files_removed} removed",
            f"Nodes:    {done.nodes_total}", f"Edges:    {done.edges_total}",
            f"Calls:    {done.calls_discovered} discovered, {done.calls_resolved} resolved, {done.calls_unresolved} unresolved, {done.calls_unsupported} unsupported",
        ]
        if args.export:
            artifact.export(Store(spark, args.store, done.project), f"{root}/{ARTIFACT_DIR}")
            lines.append(f"Artifact: {root}/{ARTIFACT_DIR}")
        return "\n".join([*lines, f"Elapsed:  {done.elapsed_seconds:.2f}s"]), 0
    store = Store(spark, args.store, args.project)
    if args.command == "skeleton":
        return render.build_context(store, args.budget, args.mode), 0
    if args.command == "search":
        found, forms = query.find_symbols(store, args.query, args.label, args.file, args.limit), (render.search_text, render.search_json)
    elif args.command == "get-source":
        found, forms = query.get_source(store, args.qualified_name), (render.source_text, render.source_json)
    else:
        found, forms = query.trace(store, args.qualified_name, args.command == "trace-callers", args.depth), (render.trace_text, render.trace_json)
    if found is None:
        return render.not_found_text(args.qualified_name), 1
    return forms[0](found) if args.format == "text" else json.dumps(forms[1](found), ensure_ascii=False, indent=2), 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("graphloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        said, status = answer(spark, args)
    except (EngineError, QueryError) as wrong:
        said, status = f"{type(wrong).__name__}: {wrong}", 1
    print(said, file=sys.stderr if status else sys.stdout)
    return status
