"""Source files of a repository: listing, ignore rules and contents.

The listing is made on the driver, as Spark's own is, but goes down only into
folders that count, follows no symbolic links, and sees files whose names begin
with a dot or an underscore, which Spark's file sources leave out.  Contents are
read where the tasks run.
"""

from __future__ import annotations

import hashlib
import os
import re
import stat
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import naming

# Folders, extensions and names that are never read.
SKIPPED_FOLDERS = tuple(
    ".cache .coverage .env .git .hg .idea .mypy_cache .next .nuxt .output .pytest_cache .ruff_cache .serverless .svn .terraform .tmp .turbo .venv .vs .vscode __pycache__ bin bower_components build coverage dist env htmlcov node_modules obj out site-packages target temp tmp vendor venv".split()
)
SKIPPED_EXTENSIONS = tuple(
    ".7z .a .arrow .avi .bmp .bz2 .class .db .dll .dylib .ear .eot .exe .gif .gz .ico .jar .jpeg .jpg .lib .map .mov .mp3 .mp4 .npy .npz .o .otf .out .parquet .pdf .pickle .pkl .png .pyc .pyd .pyo .rar .so .sqlite .sqlite3 .tar .ttf .war .wasm .wav .webm .woff .woff2 .xz .zip .zst".split()
)

IGNORE_FILES = (".gitignore", ".cbmignore")
Rules = list[tuple[str, bool]]


def ignore_pattern(line: str) -> tuple[str, bool] | None:
    """(regular expression over relative paths, whether it includes again) of a line of an ignore file."""
    line = line.rstrip("\n")
    line = line.rstrip() if not line.endswith("\\ ") else line
    if not line or line.startswith("#"):
        return None
    again, line = line.startswith("!"), line.removeprefix("!")
    folder, line = line.endswith("/"), line.rstrip("/")
    anchored, line = "/" in line, line.lstrip("/")
    out = ""
    for token in re.findall(r"/\*\*/|\*\*/|/\*\*|\*\*|\*|\?|\[[^\]]*\]|.", line):
        out += {"/**/": "/(?:.*/)?", "**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(token) or (token.replace("[!", "[^") if len(token) > 1 else re.escape(token))
    return ("^" if anchored else "(?:^|/)") + out + ("/.*$" if folder else "(?:/.*)?$"), again


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether the rules of one ignore file leave the path out; the last rule that fits decides."""
    verdict = F.lit(False)
    for rule in filter(None, map(ignore_pattern, lines)):
        verdict = F.when(path.rlike(rule[0]), F.lit(not rule[1])).otherwise(verdict)
    return verdict


def ignored_below(path: Column, specs: list[tuple[str, list[str]]]) -> Column:
    """Whether one of the ignore files (folder, lines) leaves a file or a folder above it out.

    Each applies below its folder, to names from there; what is in a folder that is left out cannot come back.
    """
    verdict = F.lit(False)
    for folder, lines in specs:
        base = f"{folder.strip('/')}/" if folder.strip("/") else ""
        verdict = verdict | (path.startswith(base) & below(F.substr(path, F.lit(len(base) + 1)), lines))
    return verdict


def below(path: Column, lines: list[str]) -> Column:
    """Whether the rules leave out a path or a folder on the way to it, whose name ends with a slash."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.concat(F.array_join(F.slice(parts, 1, i), "/"), F.when(i < F.size(parts), "/").otherwise("")))
    return F.exists(above, lambda p: ignored(p, lines))


def compiled(lines: list[str]) -> Rules:
    return list(filter(None, map(ignore_pattern, lines)))


def left_out(rel: str, specs: list[tuple[str, Rules]]) -> bool:
    """Whether one of the specs (folder with a slash, rules) leaves out a path; a folder's ends with a slash."""
    for base, rules in specs:
        fit = [again for pattern, again in rules if re.search(pattern, rel[len(base) :])]
        if fit and not fit[-1]:
            return True
    return False


def walk(spark: SparkSession, root: str, enter: Callable[[str], bool], specs: list[tuple[str, Rules]], ignore_files: tuple[str, ...] = IGNORE_FILES) -> Iterator[tuple[str, str, int, int]]:
    """(relative path, address, bytes, mtime in ns) of the regular files that no rule leaves out, in no order."""
    scheme, _, rest = root.partition(":")
    if "://" in root or (rest.startswith("/") and len(scheme) > 1):
        if scheme == "file":
            yield from walk(spark, "/" + rest.lstrip("/"), enter, specs, ignore_files)
            return
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        fs = hadoop(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

        def listed(folder: str) -> list[tuple[str, bool, int, int]]:
            found = [(s.getPath().getName(), s) for s in fs.listStatus(hadoop(folder)) if not s.isSymlink()]
            return [(n, s.isDirectory(), s.getLen(), s.getModificationTime() * 1_000_000) for n, s in found]

        def text_of(address: str) -> str:
            return bytes(fs.open(hadoop(address)).readAllBytes()).decode("utf-8", "replace")
    else:

        def listed(folder: str) -> list[tuple[str, bool, int, int]]:
            with os.scandir(folder) as entries:
                known = [(e.name, e.stat(follow_symlinks=False)) for e in entries]
            return [(n, stat.S_ISDIR(s.st_mode), s.st_size, s.st_mtime_ns) for n, s in known if stat.S_ISDIR(s.st_mode) or stat.S_ISREG(s.st_mode)]

        def text_of(address: str) -> str:
            with open(address, encoding="utf-8", errors="replace") as f:
                return f.read()

    todo = [("", root.rstrip("/"), specs)]
    while todo:
        base, folder, rules = todo.pop()
        entries = listed(folder)
        names = {n for n, is_folder, _, _ in entries if not is_folder}
        rules = [*rules, *((base, compiled(text_of(f"{folder}/{n}").split("\n"))) for n in ignore_files if n in names)]
        for name, is_folder, size, mtime in entries:
            rel = f"{base}{name}"
            if is_folder:
                if enter(name) and not left_out(f"{rel}/", rules):
                    todo.append((f"{rel}/", f"{folder}/{name}", rules))
            elif not left_out(rel, rules):
                yield rel, f"{folder}/{name}", size, mtime


def wanted(path: Column, size: Column, max_bytes: int = 2 << 20, unknown: bool = True) -> Column:
    """By folders, name, extension and size."""
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    name, ext = F.lower(F.substring_index(path, "/", -1)), naming.extension(path)
    keep = ~F.exists(folders, lambda f: f.isin(*SKIPPED_FOLDERS)) & ~ext.isin(*SKIPPED_EXTENSIONS) & ~name.isin(*naming.LOCK_NAMES)
    keep = keep & ((size <= max_bytes) if max_bytes > 0 else F.lit(True))
    for ending in naming.MINIFIED_NAMES:
        keep = keep & ~name.endswith(ending)
    return keep if unknown else keep & naming.language(path).isNotNull()


def contents(address: str) -> bytes:
    if "://" not in address:
        with open(address, "rb") as f:
            return f.read()
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(address)
    with system.open_input_stream(path) as f:
        return f.read()


def read_files(infos: DataFrame, reader: Callable[[str], bytes] = contents, most_bytes: int = 8 << 20) -> DataFrame:
    """path, source, sha256, mtime_ns, size_bytes and error of rows (path, address, size_bytes, mtime_ns).

    ``reader`` gives a file's bytes; what it cannot read has no source, and the error's text.
    Bytes that are not UTF-8 are replaced.  Every file gives a row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "source", "sha256", "mtime_ns", "size_bytes", "error"]
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for path, address, size, mtime in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                try:
                    raw = reader(address)
                    rows.append((path, raw.decode("utf-8", "replace"), hashlib.sha256(raw).hexdigest(), mtime, len(raw), None))
                    held += len(raw)
                except (OSError, ValueError) as failed:
                    rows.append((path, None, None, mtime, size, f"{type(failed).__name__}: {failed}"))
                if held > most_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    return infos.select("path", "address", "size_bytes", "mtime_ns").mapInArrow(run, "path string, source string, sha256 string, mtime_ns long, size_bytes long, error string")


def read_repository(spark: SparkSession, root: str, ignore_lines: list[str] = [], max_bytes: int = 2 << 20, max_files: int = 0, unknown: bool = True, follow_ignore_files: bool = True, files_a_task: int = 500) -> DataFrame:  # noqa: B006
    """path, source, sha256, mtime_ns and size_bytes of the files below a folder, read where the tasks run.

    Ignore files of the root and of each folder below it apply, and ``ignore_lines``, to names from the root.
    Paths and sizes are looked at before any content is read.  With ``max_files`` the first ones by path are taken.
    """
    if "://" not in root and not root.startswith("file:") and not os.path.isdir(root):
        raise NotADirectoryError(root)
    found = walk(spark, root, lambda name: name not in SKIPPED_FOLDERS, [("", compiled(ignore_lines))], IGNORE_FILES if follow_ignore_files else ())
    listed = sorted(found)  # the listing, which the driver holds in any case
    schema = "path string, address string, size_bytes long, mtime_ns long"
    infos = spark.createDataFrame(pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*listed, strict=True) if listed else ([],) * 4, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "address", "size_bytes", "mtime_ns"]), schema)
    rows = infos.where(wanted(F.col("path"), F.col("size_bytes"), max_bytes, unknown))
    if max_files:
        rows = rows.orderBy("path").limit(max_files)
    parts = max(1, min(-(-len(listed) // files_a_task), 100_000))
    return read_files(rows.repartition(parts, "path") if parts > 1 else rows.coalesce(1)).where("error is null").drop("error")
