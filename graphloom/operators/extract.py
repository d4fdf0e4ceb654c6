"""Definitions, calls and imports of source files.

``extracted`` reads a file once and gives one row with arrays of definitions
and imports; ``symbols`` unfolds it.  Python files are parsed
with the standard library; where a file does not parse, the longest run of its
leading lines that does is used.  Sixteen other languages are scanned
(``scanners``).  All other files, and those without definitions, have one File row.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import naming, text
from graphloom.operators import scanners

IMPORTS = "array<struct<module_path:string,names:array<string>,alias:string,line:int>>"
SYMBOL = (
    "struct<name:string,label:string,parent:string,start_line:int,end_line:int,signature:string,source:string,decorators:array<string>,is_async:boolean,receiver:string,visibility:string,"
    f"is_static:boolean,is_abstract:boolean,return_type:string,calls:array<struct<callee:string,line:int,qualifier:string>>,imports:{IMPORTS},unsupported_calls:int>"
)
DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def parsed(source: str) -> tuple[ast.Module | None, bool]:
    """The tree, and whether all of the source is in it."""
    lines = source.split("\n")
    try:
        return ast.parse(source), True
    except (SyntaxError, ValueError):
        low, high = 0, len(lines)  # a prefix that parses; not every shorter one need parse, hence the walk below
        for n in range(high - 1, low, -1):
            if n < high - 200:
                break
            try:
                return ast.parse("\n".join(lines[:n])), False
            except (SyntaxError, ValueError):
                continue
    return None, False


def imports_of(nodes: list[ast.stmt]) -> list[dict]:
    found = []
    for node in nodes:
        if isinstance(node, ast.Import):
            found += [{"module_path": a.name, "names": [], "alias": a.asname or "", "line": node.lineno} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            plain = [a.name for a in node.names if not a.asname]
            if plain:
                found.append({"module_path": module, "names": plain, "alias": "", "line": node.lineno})
            found += [{"module_path": module, "names": [a.name], "alias": a.asname, "line": node.lineno} for a in node.names if a.asname]
    return found


def dotted(node: ast.expr) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


def inside(node: ast.AST) -> Iterator[ast.AST]:
    """Descendants outside nested definitions, in order."""
    for child in ast.iter_child_nodes(node):
        if not isinstance(child, DEFINITIONS):
            yield child
            yield from inside(child)


def scope_imports(tree: ast.Module) -> list[dict]:
    return imports_of([c for c in inside(tree) if isinstance(c, ast.stmt)])


def python_symbols(source: str) -> tuple[list[dict], list[dict]]:
    """Definitions in order, and the imports outside them."""
    tree, _ = parsed(source)
    rows: list[dict] = []
    lines = source.split("\n")

    def visit(node: ast.AST, parent: str) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, DEFINITIONS):
                is_class = isinstance(child, ast.ClassDef)
                body = list(inside(child))
                calls, unsupported = [], 0
                for c in body:
                    if isinstance(c, ast.Call):
                        name = dotted(c.func)
                        if name:
                            calls.append({"callee": name, "line": c.lineno, "qualifier": name.rpartition(".")[0]})
                        else:
                            unsupported += 1
                head = " ".join(" ".join(lines[child.lineno - 1 : max(child.lineno, child.body[0].lineno - 1)]).split())
                rows.append(
                    {
                        "name": child.name, "label": "Class" if is_class else "Function", "parent": parent, "start_line": child.lineno, "end_line": child.end_lineno,
                        "signature": head, "source": "\n".join(lines[child.lineno - 1 : child.end_lineno]), "receiver": "", "visibility": "", "is_static": False, "is_abstract": False,
                        "return_type": ast.unparse(child.returns) if not is_class and child.returns else "", "decorators": [ast.unparse(d) for d in child.decorator_list], "is_async": isinstance(child, ast.AsyncFunctionDef),
                        "calls": calls, "imports": imports_of([c for c in body if isinstance(c, ast.stmt)]), "unsupported_calls": unsupported,
                    }
                )
                visit(child, child.name if is_class else parent)
            else:
                visit(child, parent)

    if tree is None:
        return [], []
    visit(tree, "")
    return rows, scope_imports(tree)


def skipped(path: Column, source: Column) -> Column:
    """Files that are stored but never looked into: by name, extension, size or a line too long."""
    name = F.lower(F.substring_index(path, "/", -1))
    bundled = F.lit(False)
    for ending in naming.MINIFIED_NAMES:
        bundled = bundled | name.endswith(ending)
    return naming.extension(path).isin(*naming.OPAQUE_EXTENSIONS) | name.isin(*naming.LOCK_NAMES) | bundled | (F.octet_length(source) > text.FILE_BYTES) | text.minified(source)


Extractor = Callable[[str], tuple[list[dict], list[dict]]]
OWN: dict[str, Extractor] = {}


def register(language: str, extractor: Extractor) -> None:
    """Read files of a language by a function of one's own: from a source to definitions (as ``SYMBOL``) and imports.

    Queries that are planned afterwards use it; fields that a definition lacks are empty.
    """
    OWN[language] = extractor


EMPTY = {"parent": "", "start_line": 0, "end_line": 0, "signature": "", "source": "", "decorators": [], "is_async": False, "receiver": "", "visibility": "", "is_static": False, "is_abstract": False, "return_type": "", "calls": [], "imports": [], "unsupported_calls": 0}


def extracted(files: DataFrame) -> DataFrame:
    """path, symbols (array), imports (array) and error of each of (path, source) in a known language.

    A null source counts as empty.  Nothing that a source holds raises: a file
    whose extraction fails has no symbols, and the error's text.
    """

    own = dict(OWN)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, language, source in zip(frame["path"], frame["language"], frame["source"], strict=True):
                try:
                    if language in own:
                        found, imports = own[language](source or "")
                        rows.append((path, [EMPTY | f for f in found], imports, None))
                        continue
                    found = python_symbols(source or "") if language == "python" else scanners.symbols(source or "", language)
                    rows.append((path, *found, None))
                except (ValueError, RecursionError, MemoryError, KeyError, TypeError, AttributeError) as failed:
                    rows.append((path, [], [], f"{type(failed).__name__}: {failed}"))
            yield pd.DataFrame(rows, columns=["path", "symbols", "imports", "error"])

    known = files.select("path", naming.language(F.col("path")).alias("language"), "source").where("language is not null")
    return known.mapInPandas(run, f"path string, symbols array<{SYMBOL}>, imports {IMPORTS}, error string")


def symbols(files: DataFrame) -> DataFrame:
    """path and the fields of ``SYMBOL`` of each definition in (path, source)."""
    return extracted(files).select("path", F.inline("symbols"))


def file_rows(files: DataFrame) -> DataFrame:
    """One File row for each of (path, source): lower-cased name, signature, lines and sizes."""
    source = F.col("source")
    return files.select(
        "path", F.lower(F.substring_index("path", "/", -1)).alias("name"), F.lit("File").alias("label"), F.concat(F.lit("# "), "path").alias("signature"),
        F.lit(1).alias("start_line"), F.when(source == "", 0).otherwise(F.size(text.split_lines(source))).alias("end_line"),
        naming.file_label(F.col("path")).alias("language"), F.octet_length("source").cast("long").alias("size_bytes"), (F.octet_length("source") > text.STORED_BYTES).alias("was_truncated"),
    )
