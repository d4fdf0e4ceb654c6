"""Paths, modules and qualified names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.errors import InvalidNameError

# File stems that name their folder, and extensions of source files by language.
FOLDER_STEMS = ("__init__", "index", "main", "mod")
EXTENSIONS = {
    "python": (".py", ".pyi"),
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "typescript": (".ts", ".tsx"),
    "go": (".go",),
    "rust": (".rs",),
    "java": (".java",),
    "c": (".c", ".h"),
    "cpp": (".cpp", ".cc", ".cxx", ".hpp", ".hxx"),
    "ruby": (".rb",),
    "php": (".php",),
    "c_sharp": (".cs",),
    "bash": (".sh", ".bash"),
    "kotlin": (".kt", ".kts"),
    "swift": (".swift",),
    "scala": (".scala",),
    "lua": (".lua",),
    "elixir": (".ex", ".exs"),
}
BY_EXTENSION = {e: language for language, own in EXTENSIONS.items() for e in own}
# Files that are never looked into.
MINIFIED_NAMES = (".min.js", ".min.css", ".bundle.js", ".chunk.js")
LOCK_NAMES = tuple(".ds_store cargo.lock composer.lock flake.lock gemfile.lock package-lock.json pipfile.lock pnpm-lock.yaml poetry.lock thumbs.db yarn.lock".split())
OPAQUE_EXTENSIONS = tuple(
    ".7z .a .avi .bmp .bz2 .class .db .dll .doc .docx .eot .exe .gif .gz .ico .jar .jpeg .jpg .lib .map .mov .mp3 .mp4 .npy .npz .o .otf .pdf .pickle .pkl .png .pyc .pyd .pyo .so .sqlite .sqlite3 .svg .tar .ttf .war .wasm .wav .woff .woff2 .xls .xlsx .xz .zip .zst".split()
)
CONFIG_LABELS = {".yaml": "yaml", ".yml": "yaml", ".json": "json", ".toml": "toml", ".md": "markdown", ".sql": "sql", ".proto": "protobuf", ".graphql": "graphql", ".env": "dotenv"}


def extension(path: Column) -> Column:
    """The last suffix, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def mapped(key: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def language(path: Column) -> Column:
    """Null where the extension is unknown."""
    return mapped(extension(path), BY_EXTENSION)


def file_label(path: Column) -> Column:
    """A label for files without a parser, from name or extension."""
    name = F.lower(F.substring_index(path, "/", -1))
    return (
        F.when(name.startswith("dockerfile"), "dockerfile")
        .when(name.startswith("makefile"), "makefile")
        .otherwise(F.coalesce(mapped(extension(path), CONFIG_LABELS), language(path), F.lit("unknown")))
    )


def module(path: Column) -> Column:
    """``a/b/c.py`` is ``a.b.c``; a last stem that stands for its folder is left out."""
    parts = F.split(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"\.[^./]+$", ""), "/")
    named = F.filter(parts, lambda p: p != "")
    inner = F.slice(named, 1, F.greatest(F.size(named) - 1, F.lit(0)))
    return F.array_join(F.when(F.element_at(named, -1).isin(*FOLDER_STEMS), inner).otherwise(named), ".")


def folder(path: Column) -> Column:
    """``a/b`` is ``a.b``; the root is empty."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))
    return F.array_join(parts, ".")


def project_name(root: str) -> str:
    """The last part of a path; ``unknown`` where it names nothing."""
    name = root.replace("\\", "/").rstrip("/").rpartition("/")[2]
    return "unknown" if name in ("", ".", "..") else name


def compute(path: str, name: str, parent: str | None = None) -> str:
    """The qualified name of one definition; empty arguments are refused."""
    if not path or not name or parent == "":
        raise InvalidNameError(f"path {path!r}, name {name!r}, parent {parent!r}")
    stem, dot, ext = path.replace("\\", "/").rpartition(".")
    parts = [p for p in (stem if dot and "/" not in ext else path.replace("\\", "/")).split("/") if p]
    if parts and parts[-1] in FOLDER_STEMS:
        parts.pop()
    return ".".join([*parts, *([parent] if parent else []), name])


def supported_languages() -> list[str]:
    return sorted(EXTENSIONS)


def supported_extensions() -> list[str]:
    return sorted(BY_EXTENSION)


def capability(language: Column) -> Column:
    """``full`` for languages whose definitions and calls are read, else ``fallback``."""
    return F.when(language.isin(*EXTENSIONS), "full").otherwise("fallback")


def unavailable(paths: DataFrame, path: str = "path") -> DataFrame:
    """The labels of files whose language is not read in full, each once."""
    label = file_label(F.col(path))
    return paths.select(label.alias("language")).where(capability(F.col("language")) != "full").distinct()


def by_prefix(symbols: DataFrame) -> DataFrame:
    """(prefix, qualified_name): each symbol under each proper prefix of its name."""
    return symbols.select(F.explode(prefixes(F.col("qualified_name"))).alias("prefix"), "qualified_name").distinct()


def qualified(path: Column, name: Column, parent: Column) -> Column:
    return F.concat_ws(".", F.nullif(module(path), F.lit("")), F.nullif(parent, F.lit("")), name)


def bare(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def qualifier(name: Column) -> Column:
    return F.regexp_extract(name, r"^(.*)\.", 1)


def without_self(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"^self\.", ""), r"^cls\.", "")


def module_path(name: Column) -> Column:
    """An import's module as written, without leading dots and a source file's extension, dotted."""
    known = "|".join(e[1:] for e in sorted(BY_EXTENSION, key=lambda e: (-len(e), e)))
    return F.replace(F.regexp_replace(F.regexp_replace(name, r"^\.+", ""), rf"\.({known})$", ""), F.lit("/"), F.lit("."))


def prefixes(name: Column) -> Column:
    """All proper dotted prefixes, shortest first."""
    parts = F.split(name, r"\.")
    return F.when(F.size(parts) < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), ".")))
