"""Sources to answers: listing, extraction, changes, search, traces, rendering, artifacts, the command line."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F

from graphloom import artifact, cli, index, query, render, storage
from graphloom.errors import ArtifactError, InvalidContextError, InvalidNameError, StoreError, StoreNotFoundError
from graphloom.functions import naming
from graphloom.operators import extract, graph, scanners, search
from graphloom.sources import repo
from graphloom.store import MemoryStore, Store, index_of, projects
from graphloom.streaming.ingest import Snapshots, stream_upserts

SERVICE = '''"""Payments."""
from src.payments.models import Payment as P


class Gateway:
    def send(self, cents):
        return charge(cents)


def charge(cents: int) -> int:
    P.save(cents)
    return refund(cents)


def refund(cents):
    return unknown(cents)
'''
VIEWS = '''import src.payments.service as svc


@decorated
def checkout(x):
    from src.payments.service import refund as give_back

    svc.charge(x)
    give_back(x)
'''


def put(root, files):
    for path, body in files.items():
        at = root / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(body if isinstance(body, bytes) else body.encode())


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("engine")
    put(
        top / "code",
        {
            "src/payments/service.py": SERVICE, "src/payments/models.py": "class Payment:\n    def save(self):\n        pass\n", "src/orders/views.py": VIEWS, "src/web/a.ts": "import { b } from './b';\nexport class Page {\n  show(): void { b(); }\n}\n",
            "node_modules/x.js": "function no() {}", "Dockerfile": "FROM x\n", "conf.yaml": "a: 1\n", "notes.zzz": "what", "empty.py": "", "bad.py": b"def ok():\n    return 1\n\xff\xfe(((\n", "build/gen.py": "def g(): pass",
            "yarn.lock": "x", "app.min.js": "function no(){}", "skip/me.py": "def no(): pass",
        },
    )
    done = index.run(spark, str(top / "code"), str(top / "store"), index.Config(project="shop", ignore_lines=["skip/", "# a comment", ""]))
    return top, Store(spark, str(top / "store"), "shop"), done


def test_listing(project):
    paths = {r["path"] for r in project[1].table("files").collect()}
    assert paths == {"src/payments/service.py", "src/payments/models.py", "src/orders/views.py", "src/web/a.ts", "Dockerfile", "conf.yaml", "notes.zzz", "empty.py", "bad.py"}


def test_graph(project):
    top, store, done = project
    edges = {(r["source_qn"], r["target_qn"], r["strategy"]) for r in store.table("edges").collect()}
    s, v = "src.payments.service.", "src.orders.views.checkout"
    assert (s + "Gateway.send", s + "charge", "same_module") in edges
    assert (s + "charge", "src.payments.models.Payment.save", "import_map") in edges
    assert (v, s + "charge", "import_map") in edges and (v, s + "refund", "import_map") in edges
    assert not any("unknown" in e[1] for e in edges)
    assert done.calls_unresolved >= 1 and done.errors == 0
    assert set(store.check().values()) == {0}


def test_file_rows(project):
    rows = {r["file_path"]: r for r in project[1].table("symbols").where("label = 'File'").collect()}
    reason = {p: json.loads(r["properties"])["reason"] for p, r in rows.items()}
    assert reason == {"Dockerfile": "no_language", "conf.yaml": "no_language", "notes.zzz": "no_language", "empty.py": "no_definitions"}
    assert rows["Dockerfile"]["name"] == "dockerfile" and rows["conf.yaml"]["signature"] == "# conf.yaml" and rows["empty.py"]["end_line"] == 0


def test_source_and_trace(project):
    store = project[1]
    found = query.get_source(store, "src.payments.service.charge")
    assert found.source.startswith("def charge") and {s.qualified_name for s in found.callers} == {"src.payments.service.Gateway.send", "src.orders.views.checkout"}
    said = render.source_text(found)
    assert "# called by (2):" in said and "lines 10-12  [Function]" in said
    assert render.source_json(found)["callees"][0]["strategy"] == "bfs"
    assert query.get_source(store, "no.such") is None and query.trace(store, "no.such") is None
    traced = query.trace(store, "src.payments.service.refund", depth=5)
    assert {(s.qualified_name.rpartition(".")[2], s.hop) for s in traced.visited} == {("charge", 1), ("checkout", 1), ("send", 2)}
    assert "# blast radius: 3 nodes across 2 hops" in render.trace_text(traced) and render.trace_json(traced)["total"] == 3
    assert "(no callees" in render.trace_text(query.trace(store, "src.payments.models.Payment.save", callers=False))


def test_search(project):
    store = project[1]
    hits = query.find_symbols(store, "charge", limit=1)
    assert hits.total >= 2 and len(hits.matches) == 1 and "showing 1 of" in render.search_text(hits)
    assert [s.qualified_name for s in query.find_symbols(store, "", label="Class").matches] == ["src.payments.service.Gateway", "src.web.a.Page", "src.payments.models.Payment"]
    assert query.find_symbols(store, "charge AND refund", file_pattern="SRC/payments/%").total >= 1
    assert render.search_json(query.find_symbols(store, "nothingofthis"))["total"] == 0


def test_context(project):
    store = project[1]
    full = render.build_context(store)
    assert full.startswith("# shop — 4 files, ") and "[skeleton]" in full
    assert "\n\n### src/orders/views.py\n# imports: payments.service\ndef checkout(x):  # src.orders.views.checkout" in full
    assert "    def send(self, cents):  # src.payments.service.Gateway.send" in full and "Dockerfile" not in full
    size = len(full) // 4
    assert "[compact]" in render.build_context(store, budget=size - 1) and "[summary]" in render.build_context(store, budget=size // 4) and "[deps]" in render.build_context(store, budget=1)
    assert "src/payments/service.py -> payments.models" in render.build_context(store, mode="deps")
    assert f"{'src/payments/service.py':<62}    1    3     0  (~" in render.build_context(store, mode="summary")
    with pytest.raises(InvalidContextError):
        render.build_context(store, mode="loud")


def test_changes(spark, tmp_path):
    put(tmp_path / "r", {"src/a.py": "from src.b import target\n\ndef caller():\n    target()\n", "src/b.py": "def stable():\n    pass\n\ndef target():\n    stable()\n", "src/removed.py": "def orphan():\n    pass\n"})
    config, at = index.Config(project="p"), str(tmp_path / "s")
    first = index.run(spark, str(tmp_path / "r"), at, config)
    assert (first.files_added, first.nodes_total, first.edges_total) == (3, 4, 2)
    put(tmp_path / "r", {"src/b.py": "def stable():\n    pass\n\ndef new_target():\n    stable()\n"})
    os.utime(tmp_path / "r/src/b.py", (2_000_000_000, 2_000_000_000))
    os.remove(tmp_path / "r/src/removed.py")
    second = index.run_incremental(spark, str(tmp_path / "r"), at, config)
    assert (second.files_added, second.files_changed, second.files_removed, second.files_unchanged) == (0, 1, 1, 1)
    store = Store(spark, at, "p")
    assert {r[0] for r in store.table("symbols").select("qualified_name").collect()} == {"src.a.caller", "src.b.stable", "src.b.new_target"}
    assert query.trace(store, "src.a.caller", callers=False).visited == []
    assert store.versions() == [1, 2]
    store.prune(1)
    assert store.versions() == [2]
    with pytest.raises(StoreNotFoundError):
        Store(spark, at, "other").table("edges")


def test_empty_repository(spark, tmp_path):
    (tmp_path / "r").mkdir()
    done = index.run(spark, str(tmp_path / "r"), str(tmp_path / "s"), index.Config(project="none"))
    assert (done.nodes_total, done.edges_total, done.calls_discovered) == (0, 0, 0)
    assert "# schema: (empty)" in render.build_context(Store(spark, str(tmp_path / "s"), "none"))


def test_artifact(spark, project, tmp_path):
    store, folder = project[1], str(tmp_path / "art")
    made = artifact.export(store, folder)
    assert made.node_count == store.table("symbols").count() and made.language_counts["python"] == 5 and made.compression_ratio > 0
    other = Store(spark, str(tmp_path / "s"), "copy")
    assert artifact.import_artifact(folder, other) == made
    for name in ("symbols", "edges", "files"):
        assert other.table(name).exceptAll(store.table(name)).count() == 0 and other.table(name).count() == store.table(name).count()
    manifest = tmp_path / "art" / "artifact.json"
    body = json.loads(manifest.read_text())
    os.remove(tmp_path / "art" / ".artifact.json.crc") if (tmp_path / "art" / ".artifact.json.crc").exists() else None
    manifest.write_text(json.dumps(body | {"format_version": 99, "odd": 1}))
    with pytest.raises(ArtifactError):
        artifact.import_artifact(folder, other)
    manifest.write_text("{")
    assert artifact.read_manifest(spark, folder) is None
    shutil.rmtree(folder)
    with pytest.raises(ArtifactError):
        artifact.import_artifact(folder, other)


def test_command_line(spark, project, tmp_path, capsys):
    put(tmp_path / "r", {"m.py": "def one():\n    two()\n\ndef two():\n    pass\n"})
    base = ["--store", str(tmp_path / "s"), "-p", "cli"]
    assert cli.main(["index", str(tmp_path / "r"), *base], spark) == 0
    assert cli.main(["index", str(tmp_path / "r"), *base], spark) == 0
    assert "0 extracted, 1 unchanged, 0 removed" in capsys.readouterr().out
    assert cli.main(["trace-callers", "m.two", *base, "--format", "json"], spark) == 0
    assert json.loads(capsys.readouterr().out)["visited"][0]["symbol"]["qualified_name"] == "m.one"
    assert cli.main(["get-source", "m.three", *base], spark) == 1
    assert cli.main(["search", "(", *base], spark) == 1
    assert cli.main(["skeleton", *base], spark) == 0
    assert "def one():  # m.one" in capsys.readouterr().out


def test_ignore_rules(spark):
    rules = ["*.log", "!keep.log", "/top.py", "docs/**/gen", "a/b", "cache/", "x[!0-9].py"]
    cases = {"a.log": True, "d/a.log": True, "keep.log": False, "top.py": True, "d/top.py": False, "docs/gen/a": True, "docs/x/y/gen/b": True, "a/b/c": True, "z/a/b": False, "cache/f": True, "d/cache/f": True, "cache": False, "xa.py": True, "x1.py": False}
    rows = spark.createDataFrame([(p,) for p in cases], "path string").select("path", repo.ignored(F.col("path"), rules).alias("out")).collect()
    assert {r["path"]: r["out"] for r in rows} == cases


def test_stored_source(spark):
    long = "x" * 99 + "\n"
    rows = spark.createDataFrame([("short",), (None,), (long * 6000,), ("é" * 300_000,)], "source string").select(index.stored_source(F.col("source")).alias("s")).collect()
    assert rows[0]["s"] == "short" and rows[1]["s"] is None
    assert rows[2]["s"] == (long * 5242)[:-1] + "\n# [truncated: file exceeded 512 KB]\n"
    assert rows[3]["s"].startswith("é" * 262_144 + "\n#")


def test_snapshots_and_stream(spark, tmp_path):
    table = Snapshots(spark, str(tmp_path / "t"), "k long, v string, n long, bucket string", ["k"], buckets=8)
    assert table.read().count() == 0 and table.versions() == []
    for part, rows in enumerate(([(k, "a", 1, "x") for k in range(40)] + [(1, "c", 2, "y")], [(2, "d", 3, None), (77, "e", 1, "z")])):
        spark.createDataFrame(rows, table.schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream_upserts(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")), table, ["n"], str(tmp_path / "cp")).awaitTermination(60)
        assert part + 1 <= table.versions()[-1]
    wanted = {k: (k, "a", 1, "x") for k in range(40)} | {1: (1, "c", 2, "y"), 2: (2, "d", 3, None), 77: (77, "e", 1, "z")}
    held = lambda: sorted(map(tuple, table.read().collect()))
    assert held() == sorted(wanted.values())
    before = table.manifest()["folders"]
    version = table.upsert(spark.createDataFrame([(5, "f", 9, "w")], table.schema), ["n"])
    after = table.manifest()["folders"]
    assert set(after) == set(before) and sum(after[b] != before[b] for b in after) == 1  # the other buckets stay as they are
    assert table.upsert(spark.createDataFrame([], table.schema), ["n"]) is None and table.versions()[-1] == version
    table.upsert(spark.createDataFrame([(5, "f", 9, "w")], table.schema), ["n"])
    table.prune(1)
    assert held() == sorted((wanted | {5: (5, "f", 9, "w")}).values()) and len(table.versions()) == 1
    named = set(table.manifest()["folders"].values())
    assert {f"{d.name}/{b.name}" for d in (tmp_path / "t").glob("data-*") for b in d.glob("bucket1=*")} == named


SOURCES = [
    ("typescript", "interface I {\n  pay(n: number): void;\n}\ntype Id = string;\nenum E { A }\nabstract class B {\n  abstract go(): void;\n}\nconst f = async (o: O): Promise<void> => {\n  await db.save(o);\n};", [("Interface", "I", ""), ("Method", "pay", "I"), ("Type", "Id", ""), ("Type", "E", ""), ("Class", "B", ""), ("Method", "go", "B"), ("Function", "f", "")]),
    ("javascript", "class C { m() {} }\nfunction* g() {}\nmodule.exports.q = function () { w(); };", [("Class", "C", ""), ("Method", "m", "C"), ("Function", "g", ""), ("Function", "q", "")]),
    ("go", "func (s *Pay) Charge(c int) error {\n\treturn svc.Do(c)\n}\ntype User struct {\n\tID int\n}\nfunc foo() {}", [("Method", "Charge", "Pay"), ("Type", "User", ""), ("Function", "foo", "")]),
    ("rust", "impl Pay {\n  pub fn new() -> Self { x() }\n}\npub trait T { fn t(&self) -> R<(), E>; }\npub enum S { A(String) }", [("Class", "Pay", ""), ("Function", "new", "Pay"), ("Interface", "T", ""), ("Function", "t", "T"), ("Type", "S", "")]),
    ("java", "public class Foo {\n  public Foo(int x) { this.x = x; }\n  private static void secret() {}\n}\ninterface I { P charge(U u, int c); }", [("Class", "Foo", ""), ("Function", "Foo", "Foo"), ("Function", "secret", "Foo"), ("Interface", "I", ""), ("Function", "charge", "I")]),
    ("c", "typedef struct { int a; } Pt;\nchar *get_name(int id)\n{\n  return names[id];\n}\nstruct Point {\n  int x;\n};\nint forward(int a);", [("Type", "Pt", ""), ("Function", "get_name", ""), ("Class", "Point", "")]),
    ("cpp", "namespace app {\nclass Foo : public Bar {\n public:\n  int run(int x) const { return h(x); }\n};\n}", [("Type", "app", ""), ("Class", "Foo", "app"), ("Function", "run", "Foo")]),
    ("ruby", "class Foo\n  def bar\n    while x do\n      y\n    end\n  end\n  def z; end\nend\nmodule M\n  def self.process(o)\n  end\nend", [("Class", "Foo", ""), ("Function", "bar", "Foo"), ("Function", "z", "Foo"), ("Type", "M", ""), ("Function", "process", "M")]),
    ("bash", "function deploy() {\n  echo \"a() {\"\n}\nbuild() {\n  make\n}", [("Function", "deploy", ""), ("Function", "build", "")]),
    ("php", "<?php\nclass Foo { private static function bar($x) { return baz($x); } }\nfunction top() {}", [("Class", "Foo", ""), ("Method", "bar", "Foo"), ("Function", "top", "")]),
    ("c_sharp", "class A : B { public A(int x) { R(); }\n void R() {}\n static async Task<int> Go(string s) => x.Do(s); }", [("Class", "A", ""), ("Function", "A", "A"), ("Function", "R", "A"), ("Function", "Go", "A")]),
    ("kotlin", "class A(val x: Int) {\n  fun one(x: Int) = two(x)\n  constructor(y: String) : this(1) {}\n}\nobject O {}", [("Class", "A", ""), ("Function", "one", "A"), ("Function", "constructor", "A"), ("Class", "O", "")]),
    ("swift", "struct A {\n  init(x: Int) {}\n  func run() { go() }\n}\nprotocol P { func a() }", [("Class", "A", ""), ("Function", "init", "A"), ("Function", "run", "A"), ("Interface", "P", ""), ("Function", "a", "P")]),
    ("scala", "class A {\n  def run(): Unit = { val y = 1 }\n  val x = 1\n}\ntrait T", [("Class", "A", ""), ("Function", "run", "A"), ("Type", "x", "A"), ("Interface", "T", "")]),
    ("lua", "local function a(x)\n  if x then b(x) end\nend\nM.d = function() return e() end", [("Function", "a", ""), ("Function", "d", "")]),
    ("elixir", "defmodule App.Pay do\n  def charge(a) do\n    if a do\n      foo(a)\n    end\n  end\n  defp one(x), do: two(x)\nend", [("Class", "Pay", ""), ("Function", "charge", "Pay"), ("Function", "one", "Pay")]),
]


@pytest.mark.parametrize("language,source,wanted", SOURCES, ids=[s[0] for s in SOURCES])
def test_scanned_definitions(language, source, wanted):
    rows, _ = scanners.symbols(source, language)
    assert [(r["label"], r["name"], r["parent"]) for r in rows] == wanted
    for broken in ("", "{", "}}}", source[: len(source) // 2], source.replace("}", ""), "\"'`/*" + source):
        scanners.symbols(broken, language)


IMPORTS = [
    ("typescript", "import * as svc from 'p/s';\nimport { c as d, e } from 'p/t';\n// import x from 'no';", [("p/s", [], "svc"), ("p/t", ["e"], ""), ("p/t", ["c"], "d")]),
    ("go", 'import svc "a/b/service"\nimport (\n\t"fmt"\n\t_ "x/y"\n)', [("a/b/service", ["service"], "svc"), ("fmt", ["fmt"], ""), ("x/y", [], "")]),
    ("java", "import java.util.List;\nimport static java.util.Collections.*;", [("java.util", ["List"], ""), ("java.util.Collections", [], "")]),
    ("c_sharp", "using SB = System.Text.StringBuilder;\nusing static System.Math;", [("System.Text", ["StringBuilder"], "SB"), ("System", ["Math"], "")]),
    ("rust", "use crate::p::{service::Charge as C, Refund};", [("crate::p::service", ["Charge"], "C"), ("crate::p", ["Refund"], "")]),
    ("kotlin", "import a.b.Charge as C\nimport a.b.*", [("a.b", ["Charge"], "C"), ("a.b", [], "")]),
    ("swift", "import struct Foundation.Date\nimport UIKit", [("Foundation", ["Date"], ""), ("UIKit", [], "")]),
    ("scala", "import p.s._\nimport p.m.{Charge => _, Refund => R}", [("p.s", [], ""), ("p.m", ["Refund"], "R")]),
]


@pytest.mark.parametrize("language,source,wanted", IMPORTS, ids=[s[0] for s in IMPORTS])
def test_scanned_imports(language, source, wanted):
    _, imports = scanners.symbols(source, language)
    assert [(i["module_path"], i["names"], i["alias"]) for i in imports] == wanted


def test_scanned_details():
    java = {r["name"]: r for r in scanners.symbols("class Foo {\n  private static void secret() { run(1); a(2).b(); }\n}", "java")[0]}
    assert (java["secret"]["visibility"], java["secret"]["is_static"]) == ("private", True) and [c["callee"] for c in java["secret"]["calls"]] == ["run", "a", "b"]
    script = scanners.symbols("// if (x) { no(); }\nfunction out() {\n  s.t(1);\n  function inner() { u(); }\n  f(1)(2);\n}", "javascript")[0]
    assert [[c["callee"] for c in r["calls"]] for r in script] == [["s.t", "f"], ["u"]] and script[0]["unsupported_calls"] == 1 and script[0]["calls"][0]["line"] == 3


def test_extraction_of_odd_files(spark):
    rows = [("a.py", None), ("b.py", "x = (" * 5), ("c.ts", ""), ("d.txt", "x"), ("e.py", "def f(:\n"), ("f.py", "\x00"), ("g.py", "(" * 5000)]
    found = extract.extracted(spark.createDataFrame(rows, "path string, source string")).collect()
    assert sorted(r["path"] for r in found) == ["a.py", "b.py", "c.ts", "e.py", "f.py", "g.py"] and all(r["symbols"] == [] for r in found)


def test_walk_layers_ignore_files(spark, tmp_path):
    """Ignore files of the root and of folders, hidden and underscored names, links, empty files and bytes that are no text."""
    files = {
        ".gitignore": "*.log\n/out1/\n!keep.log\n", ".cbmignore": "private*\n", "a.py": "x = 1\n", "keep.log": "k", "b.log": "b", "private.py": "", "out1/a.py": "x", "pkg/__init__.py": "", "pkg/_own.py": "y = 2\n",
        "pkg/.gitignore": "/gen/\n*.tmp.py\n!private2.py\n", "pkg/gen/g.py": "g", "pkg/sub/gen/g.py": "g", "pkg/c.tmp.py": "c", "pkg/private2.py": "p", "node_modules/x.py": "x", "d/a.py": "d",
    }
    for name, body in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    (tmp_path / "bytes.py").write_bytes(b"x = '\xff'\n")
    (tmp_path / "link.py").symlink_to(tmp_path / "a.py")
    (tmp_path / "linked").symlink_to(tmp_path / "d")
    found = {r["path"]: r for r in repo.read_repository(spark, str(tmp_path), ["d/"]).collect()}
    assert set(found) == {".gitignore", ".cbmignore", "a.py", "keep.log", "pkg/__init__.py", "pkg/_own.py", "pkg/.gitignore", "pkg/sub/gen/g.py", "bytes.py"}
    assert found["bytes.py"]["source"] == "x = '�'\n" and found["bytes.py"]["size_bytes"] == 8 and found["pkg/__init__.py"]["source"] == ""
    assert found["a.py"]["mtime_ns"] == (tmp_path / "a.py").stat().st_mtime_ns
    assert set(repo.read_repository(spark, f"file://{tmp_path}", ["d/"]).select("path").toPandas()["path"]) == set(found)
    assert "b.log" in {r["path"] for r in repo.read_repository(spark, str(tmp_path), follow_ignore_files=False).collect()}
    assert [r["path"] for r in repo.read_repository(spark, str(tmp_path), max_files=2).orderBy("path").collect()] == [".cbmignore", ".gitignore"]
    with pytest.raises(NotADirectoryError):
        repo.read_repository(spark, str(tmp_path / "a.py"))


def test_reader_of_ones_own(spark):
    def reader(address):
        if address == "bad":
            raise OSError("gone")
        return address.encode() * 2

    infos = spark.createDataFrame([("a", "xy", 2, 5), ("b", "bad", 2, 6), ("c", "z", 1, 7)], "path string, address string, size_bytes long, mtime_ns long")
    found = {r["path"]: (r["source"], r["error"]) for r in repo.read_files(infos, reader, most_bytes=1).collect()}
    assert found == {"a": ("xyxy", None), "b": (None, "OSError: gone"), "c": ("zz", None)}


def test_names_and_stores_out_of_order(spark, tmp_path):
    assert naming.compute("a/b/__init__.py", "f", "C") == "a.b.C.f" and naming.compute("x.py", "f") == "x.f"
    for bad in (("", "f", None), ("a.py", "", None), ("a.py", "f", "")):
        with pytest.raises(InvalidNameError):
            naming.compute(*bad)
    assert [naming.project_name(r) for r in ("/a/b/", "..", "/", "", "c")] == ["b", "unknown", "unknown", "unknown", "c"]
    store = Store(spark, str(tmp_path), "p")
    store.begin_bulk()
    with pytest.raises(StoreError):
        store.begin_bulk()
    store.end_bulk()
    with pytest.raises(StoreError):
        store.end_bulk()
    store.checkpoint()
    with pytest.raises(StoreNotFoundError):
        Store(spark, str(tmp_path), "p", read_only=True)
    with pytest.raises(StoreNotFoundError):
        MemoryStore(spark, "p").table("files")
    nodes = spark.createDataFrame([("a",), ("",)], "qualified_name string")
    assert storage.named_nodes(nodes, strict=False).count() == 1
    with pytest.raises(Exception, match="without a qualified name"):
        storage.named_nodes(nodes).collect()


def test_own_extractor_progress_and_projects(spark, tmp_path):
    source = tmp_path / "src"
    source.mkdir()
    (source / "a.lua").write_text("first\nsecond\n")
    extract.register("lua", lambda text: ([{"name": w, "label": "Function", "start_line": k + 1} for k, w in enumerate(text.split())], []))
    steps = []

    def progress(step, count):
        steps.append((step, count))
        raise ValueError("not passed on")

    try:
        done = index.run(spark, str(source), str(tmp_path / "store"), index.Config(on_progress=progress))
    finally:
        extract.OWN.clear()
    assert done.nodes_total == 2 and steps == [("discovered", 1), ("stored", 2)]
    store = Store(spark, str(tmp_path / "store"), "src", read_only=True)
    assert [r["name"] for r in store.records().collect()] == ["first", "second"]
    assert [r["name"] for r in projects(spark, str(tmp_path / "store")).collect()] == ["src"]
    with pytest.raises(StoreError):
        store.commit({})


def test_a_hub_is_cut_before_it_is_collected(spark):
    edges = spark.range(3000).selectExpr("concat('c', id) as source_qn", "'hub' as target_qn", "'CALLS' as type", "id as ord", "0.5 as confidence")
    assert [r["node"] for r in graph.first_neighbours(edges, "hub", True, 20).collect()] == [f"c{k}" for k in range(20)]
    assert graph.bfs(edges, "hub", callers=True, max_nodes=21).count() == 3000  # a node that is taken gives all its neighbours


def test_search_index(spark, tmp_path):
    put(tmp_path / "r", {"a.py": "def charge_card(x):\n    return 'Crème brûlée'\n", "b.py": "def refund(x):\n    return charge_card(x)\n", "c.py": "def other():\n    pass\n"})
    config, store = index.Config(project="p"), Store(spark, str(tmp_path / "s"), "p")
    index.run(spark, str(tmp_path / "r"), str(tmp_path / "s"), config)
    assert store.indexed()
    names = lambda q: [s.qualified_name for s in query.find_symbols(store, q).matches]
    assert sorted(names("charge_card")) == ["a.charge_card", "b.refund"]
    assert names("name: charge + card") == ["a.charge_card"] and names("source: charge NOT name: charge") == ["b.refund"]
    assert names("name: ^card") == [] and names("{name signature}: ^charge") == ["a.charge_card"] and names("-source: refund") == ["b.refund"]
    assert names('CREME "brulee"') == ["a.charge_card"] and names("bru*") == names("brûlée") == ["a.charge_card"]
    assert names("other NOT refund charge") == ["c.other"] and names('"..."') == [] and names("nothing") == []
    assert names("NEAR(def refund)") == ["b.refund"] and sorted(names("NEAR(charge x, 1)")) == ["a.charge_card", "b.refund"]
    assert names("source: NEAR(def charge, 0)") == ["a.charge_card"] and names("source: NEAR(refund charge, 1)") == [] and names("source: NEAR(refund charge, 2)") == ["b.refund"]
    assert names('NEAR(nothing x) OR NEAR("charge card" return brulee, 3)') == ["a.charge_card"] and names('NEAR("charge card" return brulee, 2)') == [] and names("x NOT NEAR(refund card)") == ["a.charge_card"]
    for bad in ("NEAR(a", "NEAR(a, b)", "NEAR()", "a.b", "color: red", "(a", "a AND", "name:", "{name: a", "^"):
        with pytest.raises(search.QueryError):
            query.find_symbols(store, bad)
    put(tmp_path / "r", {"b.py": "def refund(y):\n    return other()\n", "d.py": "def charge(z):\n    pass\n"})
    os.utime(tmp_path / "r/b.py", (2_000_000_000, 2_000_000_000))
    os.remove(tmp_path / "r/c.py")
    index.run_incremental(spark, str(tmp_path / "r"), str(tmp_path / "s"), config)
    rows = lambda df: sorted(map(tuple, df.select("term", "qualified_name", "length", "places").collect()))
    assert rows(store.postings()) == rows(index_of(store.table("symbols")))
    assert sorted(names("charge")) == ["a.charge_card", "d.charge"] and names("other") == ["b.refund"]
    store.fs.delete(store._path(f"{store.folder()}/postings"), True)  # as earlier releases left it
    assert not store.indexed() and sorted(names("charge")) == ["a.charge_card", "d.charge"]


def test_near_against_slow(spark):
    import random

    rand = random.Random(5)
    rows = [(k, *([sorted(rand.sample(range(60), rand.randint(1, 9))) for _ in range(3)])) for k in range(40)]
    sizes, most = (1, 2, 1), 4

    def slow(places):
        hits = [set(), set(), set()]
        for a in places[0]:
            for b in places[1]:
                for c in places[2]:
                    if max(a, b, c) - min(a + 1, b + 2, c + 1) <= most:
                        for k, x in enumerate((a, b, c)):
                            hits[k].add(x)
        return tuple(map(len, hits))

    df = spark.createDataFrame(rows, "k int, a array<int>, b array<int>, c array<int>")
    found = search.together_within(df, "k", [(c, n, f"n{c}") for c, n in zip("abc", sizes, strict=True)], most)
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == {r[0]: n for r in rows if any(n := slow(r[1:]))}
