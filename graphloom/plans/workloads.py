"""Queries over the driver's tables that exercise the engine's operators, each with SQL for comparison.

Documents play source files, suppliers and parts definitions, line items calls,
a user's consecutive events a chain of calls, conversations classes with methods.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom import index, storage
from graphloom import query as questions
from graphloom.functions import naming, text
from graphloom.operators import context, extract, graph, payload, resolve, search
from graphloom.sources import repo
from graphloom.store import MemoryStore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SUFFIXES = (".py", ".test.ts", ".go", ".md", "", ".min.js", "/index.tsx", "/__init__.py")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path and source: each document as a file below its source and language."""
    d = table(spark, sf_dir, "documents")
    suffix = F.element_at(F.array(*map(F.lit, SUFFIXES)), (F.col("doc_id") % len(SUFFIXES) + 1).cast("int"))
    return d.select("doc_id", "lang", F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), suffix).alias("path"), F.col("text").alias("source"))


FILES = "files AS (SELECT doc_id, lang, source || '/' || lang || '/doc_' || doc_id || [" + ", ".join(f"'{s}'" for s in SUFFIXES) + f"][doc_id % {len(SUFFIXES)} + 1] AS path, text AS source FROM documents)"


@query(f"""WITH {FILES} SELECT path, CAST(length(source) - length(replace(source, chr(10), '')) + CASE WHEN source <> '' AND NOT ends_with(source, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS line_count,
CAST(strlen(source) AS BIGINT) AS size_bytes, CAST(length(source) // 4 AS BIGINT) AS tokens, sha256(source) AS sha256 FROM files""")
def files_scan(spark, sf_dir):
    s = F.col("source")
    return files(spark, sf_dir).select("path", text.line_count(s).cast("long").alias("line_count"), F.octet_length(s).cast("long").alias("size_bytes"), text.tokens(s).cast("long").alias("tokens"), F.sha2("source", 256).alias("sha256"))


@query(f"""WITH {FILES} SELECT path, CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.ts' OR path LIKE '%.tsx' THEN 'typescript' WHEN path LIKE '%.go' THEN 'go' WHEN path LIKE '%.js' THEN 'javascript' END AS language,
CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.ts' OR path LIKE '%.tsx' THEN 'typescript' WHEN path LIKE '%.go' THEN 'go' WHEN path LIKE '%.js' THEN 'javascript' WHEN path LIKE '%.md' THEN 'markdown' ELSE 'unknown' END AS label,
NOT path LIKE '%.min.js' AND strlen(source) <= 2097152 AS wanted FROM files""")
def language_map(spark, sf_dir):
    p = F.col("path")
    return files(spark, sf_dir).select("path", naming.language(p).alias("language"), naming.file_label(p).alias("label"), repo.wanted(p, F.octet_length("source")).alias("wanted"))


@query("SELECT doc_id, len(list_filter(list_slice(string_split(text, chr(10)), 1, 10), lambda x: length(x) > 5000)) > 0 AS minified, strlen(text) > 32768 AS truncated FROM documents")
def skip_minified(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", text.minified(F.col("source")).alias("minified"), (F.octet_length("source") > text.SHOWN_BYTES).alias("truncated"))


@query("SELECT source, lang, CAST(count(*) AS BIGINT) AS n_files, CAST(sum(length(text) // 4) AS BIGINT) AS tokens FROM documents GROUP BY ALL")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n_files"), F.sum(text.tokens(F.col("text"))).cast("long").alias("tokens"))


@query(f"""WITH {FILES}, m AS (SELECT path, replace(regexp_replace(regexp_replace(path, '\\.[^./]+$', ''), '/(__init__|index|main|mod)$', ''), '/', '.') AS module FROM files)
SELECT path, module, module || '.Box.run' AS qualified_name FROM m""")
def qn_from_path(spark, sf_dir):
    p = F.col("path")
    return files(spark, sf_dir).select("path", naming.module(p).alias("module"), naming.qualified(p, F.lit("run"), F.lit("Box")).alias("qualified_name"))


@query(f"""WITH {FILES}, m AS (SELECT string_split(replace(regexp_replace(regexp_replace(path, '\\.[^./]+$', ''), '/(__init__|index|main|mod)$', ''), '/', '.'), '.') AS parts FROM files),
e AS (SELECT array_to_string(list_slice(parts, 1, i), '.') AS prefix FROM (SELECT parts, unnest(range(1, len(parts))) AS i FROM m)) SELECT prefix, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY prefix""")
def module_prefixes(spark, sf_dir):
    return files(spark, sf_dir).select(F.explode(naming.prefixes(naming.module(F.col("path")))).alias("prefix")).groupBy("prefix").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'self.' WHEN 1 THEN 'cls.' ELSE '' END || replace(p_type, ' ', '.') AS name FROM part),
s AS (SELECT *, regexp_replace(regexp_replace(name, '^self\\.', ''), '^cls\\.', '') AS own FROM n)
SELECT p_partkey, name, own, regexp_extract(own, '[^.]*$') AS bare, regexp_extract(own, '^(.*)\\.', 1) AS qualifier FROM s""")
def bare_qualifier(spark, sf_dir):
    mark = F.when(F.col("p_partkey") % 3 == 0, "self.").when(F.col("p_partkey") % 3 == 1, "cls.").otherwise("")
    own = naming.without_self(F.col("name"))
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(mark, F.replace("p_type", F.lit(" "), F.lit("."))).alias("name")).select("p_partkey", "name", own.alias("own"), naming.bare(own).alias("bare"), naming.qualifier(own).alias("qualifier"))


@query("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def node_upsert_last_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return storage.upsert(e.where("event_id % 2 = 0").transform(lambda t: storage.last_wins(t, ["user_id", "event_type"], ["event_id"])), e, ["user_id", "event_type"], ["event_id"])


CALLS = "CALLS"


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers call the parts they deliver; the order of line items is the order of calls."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat(F.lit("s."), F.col("l_suppkey").cast("string")).alias("source_qn"), F.concat(F.lit("p."), F.col("l_partkey").cast("string")).alias("target_qn"), F.lit(CALLS).alias("type"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("ord"), F.col("l_discount").alias("confidence"),
    )


SUPPLY = "supply AS (SELECT 's.' || l_suppkey AS source_qn, 'p.' || l_partkey AS target_qn, 'CALLS' AS type, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS ord, l_discount AS confidence FROM lineitem)"


@query(f"""WITH {SUPPLY} SELECT source_qn, target_qn, type, ord, confidence FROM supply WHERE target_qn IN (SELECT 'p.' || p_partkey FROM part WHERE p_size < 25) AND source_qn IN (SELECT 's.' || s_suppkey FROM supplier)
QUALIFY row_number() OVER (PARTITION BY source_qn, target_qn ORDER BY ord) = 1""")
def edge_insert_first_wins(spark, sf_dir):
    parts = table(spark, sf_dir, "part").where("p_size < 25").select(F.concat(F.lit("p."), F.col("p_partkey").cast("string")).alias("qualified_name"))
    suppliers = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s."), F.col("s_suppkey").cast("string")).alias("qualified_name"))
    return storage.insert_edges(supply_edges(spark, sf_dir), parts.unionByName(suppliers), ["ord"])


@query("SELECT o_orderstatus, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY o_orderstatus")
def orphan_edges(spark, sf_dir):
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return storage.delete_keys(table(spark, sf_dir, "orders"), known).groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("""WITH gone AS (SELECT s_suppkey FROM supplier WHERE s_nationkey < 5) SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n_edges, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS n_nodes
FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM gone) GROUP BY l_returnflag""")
def cascade_delete(spark, sf_dir):
    suppliers = table(spark, sf_dir, "supplier")
    name = lambda c: F.concat(F.lit("s."), F.col(c).cast("string"))
    edges = table(spark, sf_dir, "lineitem").select(name("l_suppkey").alias("source_qn"), F.concat(F.lit("p."), F.col("l_partkey").cast("string")).alias("target_qn"), "l_returnflag")
    _, left = storage.delete_nodes(suppliers.select(name("s_suppkey").alias("qualified_name")), edges, suppliers.where("s_nationkey < 5").select(name("s_suppkey").alias("qualified_name")))
    return left.groupBy("l_returnflag").agg(F.count("*").alias("n_edges"), F.countDistinct("source_qn").alias("n_nodes"))


@query("""SELECT 'type' AS kind, event_type AS label, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type UNION ALL SELECT 'language', lang, count(*) FROM documents WHERE lang IS NOT NULL GROUP BY lang
UNION ALL SELECT 'total', 'events', count(*) FROM events UNION ALL SELECT 'total', 'documents', count(*) FROM documents UNION ALL SELECT 'max', 'doc_id', max(doc_id) FROM documents""")
def schema_summary(spark, sf_dir):
    events, docs = table(spark, sf_dir, "events"), table(spark, sf_dir, "documents")
    count = lambda df, kind, label: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), F.lit(label).alias("label"), "n")
    parts = [
        events.groupBy(F.lit("type").alias("kind"), F.col("event_type").alias("label")).agg(F.count("*").alias("n")),
        docs.where("lang is not null").groupBy(F.lit("language").alias("kind"), F.col("lang").alias("label")).agg(F.count("*").alias("n")),
        count(events, "total", "events"), count(docs, "total", "documents"),
        docs.agg(F.max("doc_id").alias("n")).select(F.lit("max").alias("kind"), F.lit("doc_id").alias("label"), "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("""WITH old AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS h, doc_id % 7 AS t FROM documents WHERE doc_id % 5 <> 0),
new AS (SELECT CAST(doc_id AS VARCHAR) AS path, sha256(CASE WHEN doc_id % 11 = 0 THEN text || 'x' ELSE text END) AS h, CASE WHEN doc_id % 13 = 0 THEN -1 ELSE doc_id % 7 END AS t FROM documents WHERE doc_id % 3 <> 0)
SELECT coalesce(old.path, new.path) AS path, CASE WHEN old.path IS NULL THEN 'added' WHEN new.path IS NULL THEN 'removed' WHEN old.t <> new.t OR old.h <> new.h THEN 'changed' ELSE 'unchanged' END AS change
FROM old FULL JOIN new ON old.path = new.path""")
def change_classification(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    path = F.col("doc_id").cast("string").alias("path")
    old = d.where("doc_id % 5 <> 0").select(path, F.sha2("text", 256).alias("sha256"), (F.col("doc_id") % 7).alias("mtime_ns"))
    edited = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    new = d.where("doc_id % 3 <> 0").select(path, F.sha2(edited, 256).alias("sha256"), F.when(F.col("doc_id") % 13 == 0, -1).otherwise(F.col("doc_id") % 7).alias("mtime_ns"))
    return storage.classify_changes(old, new)


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def stale_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return storage.delete_keys(o.where("o_orderstatus = 'F'").select("o_custkey").distinct(), o.where("o_orderstatus = 'O'").select("o_custkey").distinct())


@query("""WITH merged AS (SELECT doc_id, lang, CASE WHEN doc_id % 4 = 0 THEN n_chars + 1 ELSE n_chars END AS n FROM documents WHERE doc_id % 9 <> 0 OR doc_id % 4 = 0)
SELECT lang, CAST(count(*) AS BIGINT) AS n_files, CAST(sum(n) AS BIGINT) AS n_chars FROM merged GROUP BY lang""")
def incremental_merge(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    stored = storage.delete_keys(d, d.where("doc_id % 9 = 0").select("doc_id"))
    merged = storage.upsert(stored, d.where("doc_id % 4 = 0").withColumn("n_chars", F.col("n_chars") + 1), ["doc_id"], ["n_chars"])
    return merged.groupBy("lang").agg(F.count("*").alias("n_files"), F.sum("n_chars").alias("n_chars"))


CALL_JSON = """CASE CAST(event_id % 6 AS INT)
WHEN 0 THEN '{"calls": ["charge", {"callee": "svc.refund", "line": 12, "qualifier": "svc"}]}'
WHEN 1 THEN '{"calls": [{"name": "f", "in_function": "m.g"}, {"line": 3}, "", 7]}'
WHEN 2 THEN '{"calls": "solo"}' WHEN 3 THEN '{"calls": []}' WHEN 4 THEN '{"other": 1}' ELSE '{"calls": [{"callee": "", "target": " t "}]}' END"""


@query("""WITH v(k, pos, callee, line, qual, in_function, malformed) AS (VALUES (0, 0, 'charge', 0, '', NULL, 0), (0, 1, 'svc.refund', 12, 'svc', NULL, 0), (1, 0, 'f', 0, '', 'm.g', 0), (1, 1, NULL, 3, '', NULL, 1), (1, 2, NULL, 0, '', NULL, 1), (1, 3, NULL, 0, '', NULL, 1),
(2, 0, 'solo', 0, '', NULL, 0), (5, 0, 't', 0, '', NULL, 0))
SELECT e.event_id, v.pos, v.callee, v.line, v.qual, coalesce(v.in_function, e.event_type) AS in_function, v.malformed FROM events e JOIN v ON e.event_id % 6 = v.k""")
def payload_normalise(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.expr(CALL_JSON).alias("payload"))
    return payload.call_rows(rows, "payload", "event_type").select("event_id", "pos", "callee", "line", "qual", "in_function", "malformed")


@query("""WITH h AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages) SELECT DISTINCT page_id, href FROM h""")
def import_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).distinct()


@query("""WITH c AS (SELECT page_id, unnest(regexp_extract_all(html, '([A-Za-z_][A-Za-z0-9_.]*)\\([0-9]*\\);', 1)) AS callee FROM pages) SELECT callee, CAST(count(DISTINCT page_id) AS BIGINT) AS n_pages, CAST(count(*) AS BIGINT) AS n_calls FROM c GROUP BY callee""")
def call_extract(spark, sf_dir):
    calls = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r"([A-Za-z_][A-Za-z0-9_.]*)\([0-9]*\);"), F.lit(1))).alias("callee"))
    return calls.groupBy("callee").agg(F.countDistinct("page_id").alias("n_pages"), F.count("*").alias("n_calls"))


# Resolution: definitions from parts, calls from line items, imports from suppliers ---------------------------------
def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    module, name = F.concat(F.lit("app.m"), (k % 50).cast("string")), F.concat(F.lit("f"), (k % 37).cast("string"), F.when(k % 400 == 7, F.concat(F.lit("x"), k.cast("string"))).otherwise(""))
    return table(spark, sf_dir, "part").select(F.concat(module, F.lit("."), name).alias("qualified_name"), name.alias("name"), F.lit("Function").alias("label")).distinct()


def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = F.concat(F.lit("app/m"), (F.col("l_orderkey") % 50).cast("string"), F.lit(".py"))
    extra = F.when(F.col("l_partkey") % 400 == 7, F.concat(F.lit("x"), F.col("l_partkey").cast("string"))).otherwise("")
    return table(spark, sf_dir, "lineitem").select(
        file.alias("file_path"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("call_index"), F.concat(F.lit("f"), (F.col("l_partkey") % 60).cast("string"), extra).alias("callee"),
        F.lit("").alias("qualifier"), F.when(F.col("l_quantity") > 2, F.concat(F.lit("caller"), (F.col("l_suppkey") % 5).cast("string"))).otherwise("").alias("in_function"), naming.module(file).alias("module_qn"),
    )


def import_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("app/m"), (k % 50).cast("string"), F.lit(".py")).alias("file_path"), k.alias("ordinal"), F.concat(F.lit("app.m"), (k * 7 % 50).cast("string")).alias("module_path"),
        F.array(F.concat(F.lit("f"), (k % 37).cast("string")), F.concat(F.lit("f"), (k % 11 + 30).cast("string"))).alias("names"), F.lit("").alias("alias"), F.when(k % 2 == 0, "caller1").otherwise("").alias("in_function"),
    )


RESOLUTION = """defs AS (SELECT DISTINCT 'app.m' || (p_partkey % 50) AS module, 'f' || (p_partkey % 37) || CASE WHEN p_partkey % 400 = 7 THEN 'x' || p_partkey ELSE '' END AS name FROM part),
calls AS (SELECT 'app/m' || (l_orderkey % 50) || '.py' AS file_path, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS call_index, 'f' || (l_partkey % 60) || CASE WHEN l_partkey % 400 = 7 THEN 'x' || l_partkey ELSE '' END AS callee,
  'caller' || (l_suppkey % 5) AS in_function, 'app.m' || (l_orderkey % 50) AS module FROM lineitem WHERE l_quantity > 2),
imports AS (SELECT 'app/m' || (s_suppkey % 50) || '.py' AS file_path, s_suppkey AS ordinal, 'app.m' || (s_suppkey * 7 % 50) AS module, unnest(['f' || (s_suppkey % 37), 'f' || (s_suppkey % 11 + 30)]) AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'caller1' ELSE '' END AS scope FROM supplier),
found AS (
  SELECT c.call_index, 10 AS rank, d.module || '.' || d.name AS target, 'same_module' AS strategy, 0.95 AS confidence FROM calls c JOIN defs d ON c.module = d.module AND c.callee = d.name
  UNION ALL SELECT c.call_index, 100 + i.ordinal, d.module || '.' || d.name, 'import_map', 0.85 FROM calls c JOIN imports i ON c.file_path = i.file_path AND c.callee = i.name AND i.scope IN ('', c.in_function) JOIN defs d ON d.module = i.module AND d.name = i.name
  UNION ALL SELECT c.call_index, 1000000000, u.target, 'fuzzy', 0.4 FROM calls c JOIN (SELECT name, min(module || '.' || name) AS target FROM defs GROUP BY name HAVING count(*) = 1) u ON c.callee = u.name),
best AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY call_index ORDER BY rank, target) = 1),
resolved AS (SELECT c.file_path, c.call_index, c.in_function AS source, b.target, coalesce(b.strategy, 'unresolved') AS strategy, CAST(coalesce(b.confidence, 0) AS DOUBLE) AS confidence FROM calls c LEFT JOIN best b ON c.call_index = b.call_index)"""


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.resolve(call_sites(spark, sf_dir), import_rows(spark, sf_dir), definitions(spark, sf_dir))


@query(f"WITH {RESOLUTION} SELECT * FROM resolved")
def resolve_chain(spark, sf_dir):
    return resolved(spark, sf_dir)


@query(f"WITH {RESOLUTION} SELECT DISTINCT call_index, target FROM found WHERE strategy = 'same_module'")
def resolve_same_module(spark, sf_dir):
    return resolve.same_module(resolve.prepared(call_sites(spark, sf_dir)), definitions(spark, sf_dir)).select("call_index", "target").distinct()


@query(f"WITH {RESOLUTION} SELECT DISTINCT call_index, rank, target FROM found WHERE strategy = 'import_map'")
def resolve_import_map(spark, sf_dir):
    return resolve.import_map(resolve.prepared(call_sites(spark, sf_dir)), import_rows(spark, sf_dir), definitions(spark, sf_dir)).select("call_index", "rank", "target").distinct()


@query(f"WITH {RESOLUTION} SELECT call_index, target FROM found WHERE strategy = 'fuzzy'")
def resolve_fuzzy(spark, sf_dir):
    return resolve.fuzzy(resolve.prepared(call_sites(spark, sf_dir)), definitions(spark, sf_dir)).select("call_index", "target")


@query(f"""WITH {RESOLUTION} SELECT CAST(count(*) AS BIGINT) AS discovered, CAST(count(*) FILTER (strategy <> 'unresolved') AS BIGINT) AS resolved, CAST(count(*) FILTER (strategy = 'unresolved') AS BIGINT) AS unresolved,
CAST(count(*) FILTER (confidence >= 0.8) AS BIGINT) AS edges FROM resolved""")
def call_stats(spark, sf_dir):
    c = F.col("strategy")
    return resolved(spark, sf_dir).agg(F.count("*").alias("discovered"), F.count_if(c != "unresolved").alias("resolved"), F.count_if(c == "unresolved").alias("unresolved"), F.count_if(F.col("confidence") >= 0.8).alias("edges"))


# Graph: suppliers and parts, and each user's events as a chain ------------------------------------------------------
@query(f"""WITH {SUPPLY}, once AS (SELECT source_qn AS node, target_qn AS other, min(ord) AS ord FROM supply GROUP BY ALL), r AS (SELECT node, other, CAST(row_number() OVER (PARTITION BY node ORDER BY ord, other) AS INTEGER) AS n FROM once) SELECT * FROM r WHERE n <= 20""")
def callees_1hop(spark, sf_dir):
    return graph.neighbours(supply_edges(spark, sf_dir), callers=False)


@query(f"""WITH {SUPPLY}, once AS (SELECT target_qn AS node, source_qn AS other, min(ord) AS ord FROM supply GROUP BY ALL), r AS (SELECT node, other, CAST(row_number() OVER (PARTITION BY node ORDER BY ord, other) AS INTEGER) AS n FROM once) SELECT * FROM r WHERE n <= 20""")
def callers_1hop(spark, sf_dir):
    return graph.neighbours(supply_edges(spark, sf_dir), callers=True)


def event_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    after = F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    linked = e.select("event_id", after.alias("next"), "value").where("next is not null")
    return linked.select(F.concat(F.lit("e."), F.col("event_id").cast("string")).alias("source_qn"), F.concat(F.lit("e."), F.col("next").cast("string")).alias("target_qn"), F.lit(CALLS).alias("type"), F.col("event_id").alias("ord"), (F.col("value") / 100).alias("confidence"))


CHAIN = "chain AS (SELECT 'e.' || event_id AS a, 'e.' || lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), steps AS (SELECT * FROM chain WHERE b IS NOT NULL)"


@query(f"WITH RECURSIVE {CHAIN}, walk AS (SELECT 'e.0' AS node, 0 AS hop UNION SELECT s.b, w.hop + 1 FROM walk w JOIN steps s ON s.a = w.node WHERE w.hop < 10) SELECT node, CAST(min(hop) AS INTEGER) AS hop FROM walk WHERE hop > 0 GROUP BY node")
def bfs_callees(spark, sf_dir):
    return graph.bfs(event_chain(spark, sf_dir), "e.0", callers=False, max_depth=10, max_nodes=None).select("node", "hop")


@query(f"WITH RECURSIVE {SUPPLY}, both_ways AS (SELECT source_qn AS a, target_qn AS b FROM supply UNION SELECT target_qn, source_qn FROM supply), walk AS (SELECT 's.1' AS node, 0 AS hop UNION SELECT s.b, w.hop + 1 FROM walk w JOIN both_ways s ON s.a = w.node WHERE w.hop < 2) SELECT node, CAST(min(hop) AS INTEGER) AS hop FROM walk WHERE node <> 's.1' GROUP BY node")
def bfs_cycle(spark, sf_dir):
    e = supply_edges(spark, sf_dir)
    both = e.unionByName(e.select(F.col("target_qn").alias("source_qn"), F.col("source_qn").alias("target_qn"), "type", "ord", "confidence"))
    return graph.bfs(both, "s.1", callers=True, max_depth=2, max_nodes=None).select("node", "hop")


@query(f"""WITH {SUPPLY}, once AS (SELECT source_qn AS node, min(ord) AS ord FROM supply WHERE target_qn = 'p.1' GROUP BY ALL) SELECT s.source_qn AS node, 1 AS hop, 'p.1' AS via, s.confidence FROM supply s JOIN once o ON s.source_qn = o.node AND s.ord = o.ord AND s.target_qn = 'p.1'""")
def blast_radius(spark, sf_dir):
    return graph.bfs(supply_edges(spark, sf_dir), "p.1", callers=True, max_depth=3, max_nodes=200).select("node", "hop", "via", "confidence")


# Full text ----------------------------------------------------------------------------------------------------------
WORDS = "words AS (SELECT doc_id, lang, n_chars, regexp_extract_all(strip_accents(lower(text)), '[\\p{L}\\p{N}]+') AS w FROM documents)"


def matching(text_query: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = search.indexed(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", ["text"])
        return docs.where(search.matches(F.col("words"), search.parse(text_query))).select("doc_id")

    return run


for _name, _query, _test in (
    ("fts_term", "idiot", "list_contains(w, 'idiot')"),
    ("fts_and", "licensed AND version", "list_contains(w, 'licensed') AND list_contains(w, 'version')"),
    ("fts_or_not", "(idiot OR moron) NOT scum", "(list_contains(w, 'idiot') OR list_contains(w, 'moron')) AND NOT list_contains(w, 'scum')"),
    ("fts_prefix", "disgust*", "len(list_filter(w, lambda x: starts_with(x, 'disgust'))) > 0"),
    ("fts_phrase", '"apache license version"', "contains(' ' || array_to_string(w, ' ') || ' ', ' apache license version ')"),
):
    QUERIES[_name] = matching(_query)
    ORACLE_SQL[_name] = f"WITH {WORDS} SELECT doc_id FROM words WHERE {_test}"

BM25 = f"""{WORDS}, counted AS (SELECT doc_id, lang, len(w) AS dl, len(list_filter(w, lambda x: x = 'idiot')) AS f0, len(list_filter(w, lambda x: x = 'licensed')) AS f1 FROM words),
facts AS (SELECT count(*) AS n, avg(dl) AS mean, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1 FROM counted),
scored AS (SELECT doc_id, lang, round(- greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * dl / mean)) - greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / mean)), 6) AS score FROM counted, facts WHERE f0 > 0 OR f1 > 0)"""


def scored(spark: SparkSession, sf_dir: str, keep=None) -> DataFrame:
    docs = search.indexed(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id", ["text"])
    return search.ranked(docs.select("doc_id", "lang", "words"), "idiot OR licensed", keep).select("doc_id", "lang", F.round("score", 6).alias("score"))


@query(f"WITH {BM25} SELECT doc_id, score FROM scored ORDER BY score, doc_id LIMIT 10")
def fts_bm25_topk(spark, sf_dir):
    return search.page(scored(spark, sf_dir), [F.col("score"), F.col("doc_id")], 10)[0].select("doc_id", "score")


@query(f"WITH {BM25} SELECT doc_id, score, (SELECT CAST(count(*) AS BIGINT) FROM scored WHERE lang = 'en') AS total FROM scored WHERE lang = 'en' ORDER BY score, doc_id LIMIT 5 OFFSET 5")
def fts_filtered_paged(spark, sf_dir):
    rows, total = search.page(scored(spark, sf_dir, F.col("lang") == "en"), [F.col("score"), F.col("doc_id")], 5, 5)
    return rows.crossJoin(F.broadcast(total)).select("doc_id", "score", "total")  # one row


def documents_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(table(spark, sf_dir, "documents"), "doc_id", ["lang", "text"])


@query(f"""WITH {WORDS}, each AS (SELECT doc_id, unnest(list_concat(regexp_extract_all(strip_accents(lower(coalesce(lang, ''))), '[\\p{{L}}\\p{{N}}]+'), w)) AS term FROM words)
SELECT term, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs, CAST(count(*) AS BIGINT) AS n_places FROM each GROUP BY term UNION ALL SELECT '', count(*), count(*) FROM words""")
def index_terms(spark, sf_dir):
    return documents_index(spark, sf_dir).groupBy("term").agg(F.count("*").alias("n_docs"), F.sum(F.size("places")).alias("n_places"))


@query(f"""WITH {WORDS}, counted AS (SELECT doc_id, lang, len(w) + len(regexp_extract_all(coalesce(lang, ''), '[\\p{{L}}\\p{{N}}]+')) AS dl, w[1] AS first, ' ' || array_to_string(w, '  ') || ' ' AS t FROM words),
hits AS (SELECT *, (length(t) - length(replace(t, ' apache  license ', ''))) // 17 AS f0, len(string_split(t, ' idiot ')) - 1 AS f1, CAST(first = 'the' AS INTEGER) AS f2 FROM counted),
facts AS (SELECT count(*) AS n, avg(dl) AS mean, count(*) FILTER (f0 > 0) AS d0, count(*) FILTER (f1 > 0) AS d1, count(*) FILTER (f2 > 0) AS d2 FROM hits)
SELECT doc_id, round(- greatest(ln((n - d0 + 0.5) / (d0 + 0.5)), 1e-6) * f0 * 2.2 / (f0 + 1.2 * (0.25 + 0.75 * dl / mean)) - greatest(ln((n - d1 + 0.5) / (d1 + 0.5)), 1e-6) * f1 * 2.2 / (f1 + 1.2 * (0.25 + 0.75 * dl / mean))
- greatest(ln((n - d2 + 0.5) / (d2 + 0.5)), 1e-6) * f2 * 2.2 / (f2 + 1.2 * (0.25 + 0.75 * dl / mean)), 6) AS score FROM hits, facts WHERE (f0 > 0 OR f1 > 0 OR f2 > 0) AND lang IS DISTINCT FROM 'de'""")
def index_lookup(spark, sf_dir):
    hits = search.looked_up(documents_index(spark, sf_dir), "doc_id", "(apache + license OR text: idiot OR {text}: ^the) NOT -text: de", ["lang", "text"])
    return hits.select("doc_id", F.round("score", 6).alias("score"))


@query(f"""WITH {WORDS}, places AS (SELECT doc_id, unnest(w) AS term, generate_subscripts(w, 1) AS place FROM words), a AS (SELECT * FROM places WHERE term = 'under'), b AS (SELECT * FROM places WHERE term = 'license')
SELECT a.doc_id, CAST(count(DISTINCT a.place) AS BIGINT) AS n_under, CAST(count(DISTINCT b.place) AS BIGINT) AS n_license FROM a JOIN b ON a.doc_id = b.doc_id AND abs(a.place - b.place) - 1 <= 3 GROUP BY a.doc_id""")
def index_near(spark, sf_dir):
    of = lambda word: F.flatten(F.collect_list(F.when(F.col("term") == word, F.col("places"))))
    rows = search.postings(table(spark, sf_dir, "documents"), "doc_id", ["text"]).where("term in ('under', 'license')").groupBy("doc_id").agg(of("under").alias("a"), of("license").alias("b"))
    return search.together_within(rows.where("size(a) > 0 and size(b) > 0"), "doc_id", [("a", 1, "n_under"), ("b", 1, "n_license")], 3)


@query("SELECT p_name, p_partkey FROM part WHERE p_name ILIKE '%R%' ORDER BY p_name, p_partkey LIMIT 20 OFFSET 20")
def search_like_paged(spark, sf_dir):
    return search.page(table(spark, sf_dir, "part").where(F.col("p_name").ilike("%R%")).select("p_name", "p_partkey"), [F.col("p_name"), F.col("p_partkey")], 20, 20)[0]


# Rendering: a conversation is a file, its turns are methods ----------------------------------------------------------
def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    path = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    return c.select(
        path.alias("file_path"), F.when(F.col("role") == "user", "Function").otherwise("Method").alias("label"), F.when(F.col("turn") > 0, "Talk").otherwise("").alias("parent"),
        F.col("turn").cast("int").alias("start_line"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")).alias("signature"), F.concat(path, F.lit("."), F.col("turn").cast("string")).alias("qualified_name"),
    )


TURNS = "turns AS (SELECT 'c' || conv_id AS file_path, CASE WHEN role = 'user' THEN 'Function' ELSE 'Method' END AS label, turn > 0 AS inner_one, turn AS start_line, replace(coalesce(text, ''), chr(10), ' ') AS signature, 'c' || conv_id || '.' || turn AS qn FROM conversations)"


def turn_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation imports one to twelve modules."""
    k = F.col("conv_id")
    modules = F.transform(F.sequence(F.lit(0).cast("long"), k % 12), lambda i: F.struct(F.concat(F.lit("pkg.talk.m"), i.cast("string")).alias("module_path")))
    return table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), k.cast("string")).alias("path"), modules.alias("imports")).distinct()


def blocks(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    return context.blocks(turns(spark, sf_dir).withColumn("properties", F.lit(None).cast("string")), turn_files(spark, sf_dir), mode)


@query(f"""WITH {TURNS}, i AS (SELECT DISTINCT 'c' || conv_id AS file_path, '# imports: ' || array_to_string(list_transform(range(least(conv_id % 12 + 1, 8)), lambda j: 'talk.m' || j), ', ') || CASE WHEN conv_id % 12 >= 8 THEN ' ...' ELSE '' END AS line FROM conversations)
SELECT t.file_path, chr(10) || '### ' || t.file_path || chr(10) || any_value(i.line) || chr(10) || string_agg(CASE WHEN inner_one THEN '    ' ELSE '' END || signature || '  # ' || qn, chr(10) ORDER BY start_line, qn) AS block FROM turns t JOIN i ON t.file_path = i.file_path GROUP BY t.file_path""")
def skeleton_lines(spark, sf_dir):
    return blocks(spark, sf_dir, "skeleton")


@query(f"""WITH {TURNS}, cut AS (SELECT *, CASE WHEN length(signature) <= 80 THEN signature ELSE left(signature, coalesce(list_max(list_filter(range(58, 78), lambda i: substring(signature, i + 1, 1) IN (',', ' '))), 77)) || '...' END AS short FROM turns)
SELECT file_path, chr(10) || '### ' || file_path || chr(10) || string_agg(CASE WHEN inner_one THEN '    ' ELSE '' END || short, chr(10) ORDER BY start_line, qn) AS block FROM cut GROUP BY file_path""")
def compact_signatures(spark, sf_dir):
    return blocks(spark, sf_dir, "compact")


@query(f"""WITH {TURNS} SELECT file_path, CAST(0 AS BIGINT) AS classes, CAST(count(*) FILTER (label = 'Function') AS BIGINT) AS functions, CAST(count(*) FILTER (label = 'Method') AS BIGINT) AS methods, CAST((sum(length(signature)) + count(*) - 1) // 4 AS BIGINT) AS tokens FROM turns GROUP BY file_path""")
def summary_per_file(spark, sf_dir):
    return context.summary(turns(spark, sf_dir))


@query(f"""WITH {TURNS}, t AS (SELECT file_path, CAST(sum(length(signature)) // 4 AS BIGINT) AS tokens FROM turns GROUP BY file_path) SELECT file_path, tokens, CASE WHEN tokens <= 100 THEN 'skeleton' WHEN tokens <= 200 THEN 'compact' WHEN tokens <= 1000 THEN 'summary' ELSE 'deps' END AS mode FROM t""")
def mode_choice(spark, sf_dir):
    sized = turns(spark, sf_dir).groupBy("file_path").agg(F.floor(F.sum(F.char_length("signature")) / text.CHARS_A_TOKEN).alias("tokens"))
    return sized.withColumn("mode", context.mode(F.col("tokens"), 100))


@query("""SELECT DISTINCT 'c' || conv_id AS file_path, array_to_string(list_transform(range(conv_id % 12 + 1), lambda j: 'c' || conv_id || ' -> talk.m' || j), chr(10)) AS block FROM conversations""")
def deps_edges(spark, sf_dir):
    return blocks(spark, sf_dir, "deps")


@query(f"WITH {SUPPLY} SELECT DISTINCT source_qn AS qn, rpad(source_qn, 60, ' ') AS padded, '...' || right('package.module.' || source_qn, 12) AS cut FROM supply WHERE length('package.module.' || source_qn) > 15")
def trace_render_rows(spark, sf_dir):
    qn = F.col("source_qn")
    return supply_edges(spark, sf_dir).select(qn.alias("qn"), text.fitted_name(qn, 60).alias("padded"), text.fitted_name(F.concat(F.lit("package.module."), qn), 15).alias("cut")).distinct()


@query(f"""WITH {FILES} SELECT path, lower(regexp_extract(path, '[^/]*$')) AS name, 'File' AS label, '# ' || path AS signature, 1 AS start_line,
CAST(CASE WHEN source = '' THEN 0 ELSE length(source) - length(replace(source, chr(10), '')) + CASE WHEN ends_with(source, chr(10)) THEN 0 ELSE 1 END END AS INTEGER) AS end_line,
CASE WHEN path LIKE '%.py' THEN 'python' WHEN path LIKE '%.ts' OR path LIKE '%.tsx' THEN 'typescript' WHEN path LIKE '%.go' THEN 'go' WHEN path LIKE '%.js' THEN 'javascript' WHEN path LIKE '%.md' THEN 'markdown' ELSE 'unknown' END AS language,
CAST(strlen(source) AS BIGINT) AS size_bytes, strlen(source) > 524288 AS was_truncated FROM files""")
def fallback_file_nodes(spark, sf_dir):
    return extract.file_rows(files(spark, sf_dir))


SAMPLE = '''import os.path as p
from a.b import c, d as e

@wrap
class Box(Base):
    def run(self, x):
        return self.helper(c(x))(p.join(x))

    async def wait(self):
        def inner():
            e()
        inner()

def broken(:
'''


@query("""SELECT * FROM (VALUES ('Box', 'Class', '', 5, 'class Box(Base):', 'wrap', ''), ('run', 'Function', 'Box', 6, 'def run(self, x):', '', 'self.helper,c,p.join'),
('wait', 'Function', 'Box', 9, 'async def wait(self):', '', 'inner'), ('inner', 'Function', 'Box', 10, 'def inner():', '', 'e')) AS v(name, label, parent, start_line, signature, decorators, calls)""")
def extract_python_symbols(spark, sf_dir):
    rows = extract.symbols(spark.createDataFrame([("src/box.py", SAMPLE), ("src/x.go", "package x")], "path string, source string"))
    return rows.select("name", "label", "parent", "start_line", "signature", F.array_join("decorators", ",").alias("decorators"), F.array_join(F.transform("calls", lambda c: c.callee), ",").alias("calls"))


# Whole path from sources to edges: each part is a file in one of four languages, calling the next part's function -----
def part_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    forms = (
        ("app/p{k}.py", "from app.p{n} import f{n}\n\ndef f{k}(x):\n    return f{n}(x)\n"),
        ("app/p{k}.ts", "// f{n}(0)\nexport function f{k}(x: number): number {\n  return f{n}(x);\n}\n"),
        ("app/p{k}.go", 'package app\n\nfunc f{k}(x int) int {\n\tprintln("f{n}(0)")\n\treturn f{n}(x)\n}\n'),
        ("app/p{k}.java", "class P{k} {\n  private static int f{k}(int x) { return f{n}(x); }\n}\n"),
    )
    filled = lambda form: F.replace(F.replace(F.lit(form), F.lit("{k}"), k.cast("string")), F.lit("{n}"), (k + 1).cast("string"))
    chosen = lambda i: F.get(F.array(*(filled(f[i]) for f in forms)), (k % 4).cast("int"))
    return table(spark, sf_dir, "part").select(chosen(0).alias("path"), chosen(1).alias("source"))


PART_SYMBOLS = """p AS (SELECT p_partkey AS k, 'app.p' || p_partkey || CASE WHEN p_partkey % 4 = 3 THEN '.P' || p_partkey ELSE '' END || '.f' || p_partkey AS qn FROM part)"""


@query(f"""WITH {PART_SYMBOLS} SELECT s.qn AS source_qn, t.qn AS target_qn, CASE WHEN s.k % 4 = 0 THEN 'import_map' ELSE 'fuzzy' END AS strategy, CAST(CASE WHEN s.k % 4 = 0 THEN 0.85 ELSE 0.4 END AS DOUBLE) AS confidence,
CAST([4, 3, 5, 2][s.k % 4 + 1] AS INTEGER) AS line FROM p s JOIN p t ON t.k = s.k + 1""")
def sources_to_edges(spark, sf_dir):
    files = part_sources(spark, sf_dir)
    raw = storage.cut_lineage(extract.extracted(files))
    symbols = storage.cut_lineage(index.symbol_rows(files, raw))
    calls = index.call_rows(symbols).where("callee <> 'println'")
    found = resolve.resolve(calls, index.import_rows(raw, symbols), symbols)
    return index.edge_rows(calls, found, symbols, 0.0).select("source_qn", "target_qn", "strategy", "confidence", "line")


@query("""SELECT 'app/p' || p_partkey || ['.py', '.ts', '.go', '.java'][p_partkey % 4 + 1] AS file_path, 'f' || p_partkey AS name, CASE WHEN p_partkey % 4 = 3 THEN 'P' || p_partkey ELSE '' END AS parent,
CAST([3, 2, 3, 2][p_partkey % 4 + 1] AS INTEGER) AS start_line, CAST([4, 4, 6, 2][p_partkey % 4 + 1] AS INTEGER) AS end_line, CASE WHEN p_partkey % 4 = 3 THEN 'private' ELSE '' END AS visibility,
['def f' || p_partkey || '(x):', 'export function f' || p_partkey || '(x: number): number {', 'func f' || p_partkey || '(x int) int {', 'private static int f' || p_partkey || '(int x) { return f' || (p_partkey + 1) || '(x); }'][p_partkey % 4 + 1] AS signature FROM part""")
def extract_functions(spark, sf_dir):
    return extract.symbols(part_sources(spark, sf_dir)).where("label = 'Function'").select(F.col("path").alias("file_path"), "name", "parent", "start_line", "end_line", "visibility", "signature")


@query(f"""WITH {TURNS} SELECT file_path, rpad(file_path, CAST(greatest(62, length(file_path)) AS INTEGER), ' ') || printf('  %3d  %3d  %4d  (~%d tokens)', 0, count(*) FILTER (label = 'Function'), count(*) FILTER (label = 'Method'), CAST((sum(length(signature)) + count(*) - 1) // 4 AS BIGINT)) AS block FROM turns GROUP BY file_path""")
def context_summary(spark, sf_dir):
    return context.blocks(turns(spark, sf_dir).withColumn("properties", F.lit(None).cast("string")), table(spark, sf_dir, "conversations"), "summary")


OTHER_SOURCES = [
    ("a.rs", "use crate::p::{service::Charge as C, Refund};\nimpl Pay {\n  pub fn new() -> Self { make(1) }\n}\npub trait T { fn t(&self); }\n"),
    ("b.cs", "using SB = System.Text.StringBuilder;\nclass A { public A(int x) { Run(x); } void Run(int y) {} }\n"),
    ("c.rb", "class Foo\n  def bar(x)\n    baz(x) if x\n  end\nend\n"),
    ("d.kt", "import a.b.*\nclass K {\n  fun one(x: Int) = two(x)\n}\n"),
    ("e.lua", "local function a(x)\n  if x then b(x) end\nend\n"),
    ("f.ex", "defmodule App.Pay do\n  def charge(a) do\n    foo(a)\n  end\nend\n"),
    ("g.sh", "build() {\n  make all\n}\n"),
    ("h.php", "<?php\nclass F { static function bar($x) { return baz($x); } }\n"),
]


@query("""SELECT * FROM (VALUES ('a.rs', 'Class', 'Pay', '', ''), ('a.rs', 'Function', 'new', 'Pay', 'make'), ('a.rs', 'Interface', 'T', '', ''), ('a.rs', 'Function', 't', 'T', ''),
('b.cs', 'Class', 'A', '', ''), ('b.cs', 'Function', 'A', 'A', 'Run'), ('b.cs', 'Function', 'Run', 'A', ''), ('c.rb', 'Class', 'Foo', '', ''), ('c.rb', 'Function', 'bar', 'Foo', 'baz'), ('d.kt', 'Class', 'K', '', ''), ('d.kt', 'Function', 'one', 'K', 'two'),
('e.lua', 'Function', 'a', '', 'b'), ('f.ex', 'Class', 'Pay', '', ''), ('f.ex', 'Function', 'charge', 'Pay', 'foo'), ('g.sh', 'Function', 'build', '', ''), ('h.php', 'Class', 'F', '', ''), ('h.php', 'Method', 'bar', 'F', 'baz')) AS v(path, label, name, parent, calls)""")
def extract_other_languages(spark, sf_dir):
    rows = extract.symbols(spark.createDataFrame(OTHER_SOURCES, "path string, source string"))
    return rows.select("path", "label", "name", "parent", F.array_join(F.transform("calls", lambda c: c.callee), ",").alias("calls"))


@query("""SELECT * FROM (VALUES ('a.rs', 'crate::p::service', 'Charge', 'C', 1), ('a.rs', 'crate::p', 'Refund', '', 1), ('b.cs', 'System.Text', 'StringBuilder', 'SB', 1), ('d.kt', 'a.b', '', '', 1)) AS v(path, module_path, names, alias, line)""")
def import_parsers(spark, sf_dir):
    rows = extract.extracted(spark.createDataFrame(OTHER_SOURCES, "path string, source string")).select("path", F.inline("imports"))
    return rows.select("path", "module_path", F.array_join("names", ",").alias("names"), "alias", "line")


# A project of parts: built by the index, asked through store and queries --------------------------------------------
PARTS = f"""{PART_SYMBOLS}, src AS (SELECT k, qn, 'app/p' || k || ['.py', '.ts', '.go', '.java'][k % 4 + 1] AS path, ['python', 'typescript', 'go', 'java'][k % 4 + 1] AS language, [
'from app.p' || (k + 1) || ' import f' || (k + 1) || chr(10) || chr(10) || 'def f' || k || '(x):' || chr(10) || '    return f' || (k + 1) || '(x)' || chr(10),
'// f' || (k + 1) || '(0)' || chr(10) || 'export function f' || k || '(x: number): number {{' || chr(10) || '  return f' || (k + 1) || '(x);' || chr(10) || '}}' || chr(10),
'package app' || chr(10) || chr(10) || 'func f' || k || '(x int) int {{' || chr(10) || chr(9) || 'println("f' || (k + 1) || '(0)")' || chr(10) || chr(9) || 'return f' || (k + 1) || '(x)' || chr(10) || '}}' || chr(10),
'class P' || k || ' {{' || chr(10) || '  private static int f' || k || '(int x) {{ return f' || (k + 1) || '(x); }}' || chr(10) || '}}' || chr(10)][k % 4 + 1] AS source FROM p),
nodes AS (SELECT qn AS qualified_name, 'Function' AS label, path AS file_path, CAST([3, 2, 3, 2][k % 4 + 1] AS INTEGER) AS start_line, CAST([4, 4, 6, 2][k % 4 + 1] AS INTEGER) AS end_line,
['def f' || k || '(x):', 'export function f' || k || '(x: number): number {{', 'func f' || k || '(x int) int {{', 'private static int f' || k || '(int x) {{ return f' || (k + 1) || '(x); }}'][k % 4 + 1] AS signature, k FROM src
UNION ALL SELECT 'app.p' || k || '.P' || k, 'Class', path, 1, 3, 'class P' || k || ' {{', k FROM src WHERE k % 4 = 3),
links AS (SELECT s.k, s.qn AS source_qn, t.qn AS target_qn, CAST(CASE WHEN s.k % 4 = 0 THEN 0.85 ELSE 0.4 END AS DOUBLE) AS confidence FROM p s JOIN p t ON t.k = s.k + 1)"""


def current_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_sources(spark, sf_dir)
    return rows.select("path", "source", F.sha2("source", 256).alias("sha256"), F.lit(1).cast("long").alias("mtime_ns"), F.octet_length("source").cast("long").alias("size_bytes"))


_stores: dict[tuple, MemoryStore] = {}


def part_store(spark: SparkSession, sf_dir: str) -> MemoryStore:
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _stores:
        store = MemoryStore(spark, "parts")
        index.update(store, current_parts(spark, sf_dir), "parts")
        _stores[key] = store
    return _stores[key]


@query(f"WITH {PARTS} SELECT qualified_name, label, file_path, start_line, end_line, signature FROM nodes")
def store_records(spark, sf_dir):
    return part_store(spark, sf_dir).records().select("qualified_name", "label", "file_path", "start_line", "end_line", "signature")


@query(f"""WITH {PARTS} SELECT 'name' AS how, qualified_name, label, start_line FROM nodes WHERE qualified_name = 'app.p8.f8' UNION ALL SELECT 'id', qualified_name, label, start_line FROM nodes WHERE qualified_name = 'app.p9.f9'
UNION ALL SELECT 'file', qualified_name, label, start_line FROM nodes WHERE file_path = 'app/p11.java'""")
def store_lookup(spark, sf_dir):
    store = part_store(spark, sf_dir)
    key = store.ids().where("qualified_name = 'app.p9.f9'").first()["id"]
    found = (("name", store.node_by_name("app.p8.f8")), ("id", store.node_by_id(key)), ("file", store.nodes_of_file("app/p11.java")))
    a, b, c = (rows.select(F.lit(how).alias("how"), "qualified_name", "label", "start_line") for how, rows in found)
    return a.unionByName(b).unionByName(c)


@query(f"WITH {PARTS} SELECT qualified_name FROM nodes WHERE file_path = 'app/p11.java'")
def store_names_of_file(spark, sf_dir):
    return part_store(spark, sf_dir).names_of_file("app/p11.java")


@query(f"WITH {PARTS} SELECT path, source FROM src WHERE k IN (8, 10)")
def store_file_source(spark, sf_dir):
    store = part_store(spark, sf_dir)
    return spark.createDataFrame([(p, store.file_source(p)) for p in ("app/p8.py", "app/p10.go")], "path string, source string")


@query(f"WITH {PARTS} SELECT path, sha256(source) AS sha256, CAST(strlen(source) AS BIGINT) AS size_bytes, CAST(1 AS BIGINT) AS mtime_ns FROM src")
def store_hashes(spark, sf_dir):
    return part_store(spark, sf_dir).hashes().select("path", "sha256", "size_bytes", "mtime_ns")


@query(f"WITH {PARTS} SELECT path, language, source, CAST(length(source) - length(replace(source, chr(10), '')) AS INTEGER) AS line_count, CAST(strlen(source) AS BIGINT) AS size_bytes FROM src")
def store_files(spark, sf_dir):
    return part_store(spark, sf_dir).table("files").select("path", "language", "source", "line_count", "size_bytes")


@query(f"WITH {PARTS} SELECT (SELECT CAST(count(*) AS BIGINT) FROM nodes) AS n_symbols, (SELECT CAST(count(*) AS BIGINT) FROM links) AS n_edges, (SELECT CAST(count(*) AS BIGINT) FROM src) AS n_files, 1 AS schema_version")
def store_counts(spark, sf_dir):
    return part_store(spark, sf_dir).counts()


@query(f"WITH {PARTS} SELECT language, CAST(count(*) AS BIGINT) AS n FROM src GROUP BY language")
def store_languages(spark, sf_dir):
    return part_store(spark, sf_dir).languages()


@query(f"WITH {PARTS} SELECT file_path, signature, qualified_name FROM nodes UNION ALL SELECT 'class:' || file_path, signature, qualified_name FROM nodes WHERE label = 'Class'")
def skeleton_stream(spark, sf_dir):
    store = part_store(spark, sf_dir)
    return store.skeleton().unionByName(store.skeleton(("Class",)).withColumn("file_path", F.concat(F.lit("class:"), "file_path")))


@query(f"""WITH {PARTS} SELECT 'label' AS kind, label AS name, CAST(count(*) AS BIGINT) AS n FROM nodes GROUP BY label UNION ALL SELECT 'type', 'CALLS', count(*) FROM links UNION ALL SELECT 'total', 'nodes', count(*) FROM nodes
UNION ALL SELECT 'total', 'edges', count(*) FROM links UNION ALL SELECT 'sample', qualified_name, 1 FROM (SELECT qualified_name FROM nodes ORDER BY qualified_name LIMIT 10)""")
def store_summary(spark, sf_dir):
    found = questions.summary(part_store(spark, sf_dir))
    rows = [("label", k, n) for k, n in found["node_labels"]] + [("type", k, n) for k, n in found["edge_types"]] + [("total", "nodes", found["total_nodes"]), ("total", "edges", found["total_edges"])]
    return spark.createDataFrame(rows + [("sample", q, 1) for q in found["sample_qns"]], "kind string, name string, n long")


@query(f"""WITH {PARTS} SELECT 'symbols' AS what, CAST(5 AS BIGINT) AS n UNION ALL SELECT 'files', 0 UNION ALL SELECT 'file_hashes', 0 UNION ALL SELECT 'edges', 0 UNION ALL SELECT 'newer_schema', 1
UNION ALL SELECT 'loose_edges', count(*) FROM links WHERE k % 10 = 0""")
def store_check(spark, sf_dir):
    store, bad = part_store(spark, sf_dir), MemoryStore(spark, "bad")
    tables = {n: store.table(n) for n in ("files", "file_hashes", "symbols", "edges", "project")}
    few = tables["symbols"].where("qualified_name in ('app.p4.f4', 'app.p5.f5', 'app.p6.f6', 'app.p8.f8', 'app.p9.f9')")
    k = F.regexp_extract("source_qn", r"f([0-9]+)$", 1).cast("long")
    loose = F.when(k % 10 == 0, F.concat("target_qn", F.lit(".gone"))).otherwise(F.col("target_qn"))
    bad.commit(tables | {"symbols": tables["symbols"].unionByName(few), "edges": tables["edges"].withColumn("target_qn", loose), "project": tables["project"].withColumn("schema_version", F.lit(2))})
    return spark.createDataFrame(list(bad.check().items()), "what string, n long")


def changed_parts(spark: SparkSession, sf_dir: str) -> index.Result | MemoryStore:
    """The store of the parts that 5 does not divide, brought up to those that 7 does not, a third of them with a comment more."""
    key = spark.sparkContext.applicationId, sf_dir, "changed"
    if key not in _stores:
        store, now = MemoryStore(spark, "changing"), current_parts(spark, sf_dir).withColumn("k", F.regexp_extract("path", "p([0-9]+)", 1).cast("long"))
        index.update(store, now.where("k % 5 <> 0").drop("k"))
        more = F.when((F.col("k") % 3 == 0) & (F.col("k") % 4 != 0), F.concat("source", F.lit("// more\n"))).otherwise(F.col("source"))
        edited = now.where("k % 7 <> 0").withColumn("source", more).withColumn("sha256", F.sha2("source", 256)).withColumn("mtime_ns", F.when(F.col("k") % 11 == 0, 2).otherwise(1).cast("long"))
        store.told = index.update(store, edited.drop("k"))
        _stores[key] = store
    return _stores[key]


@query(f"""WITH {PARTS}, c AS (SELECT k, k % 5 <> 0 AS old, k % 7 <> 0 AS new, k % 11 = 0 OR (k % 3 = 0 AND k % 4 <> 0) AS edited FROM p)
SELECT CAST(count(*) FILTER (NOT old AND new) AS BIGINT) AS added, CAST(count(*) FILTER (old AND new AND edited) AS BIGINT) AS changed, CAST(count(*) FILTER (old AND NOT new) AS BIGINT) AS removed,
CAST(count(*) FILTER (old AND new AND NOT edited) AS BIGINT) AS unchanged, (SELECT CAST(count(*) AS BIGINT) FROM nodes WHERE k % 7 <> 0) AS nodes, (SELECT CAST(count(*) AS BIGINT) FROM links WHERE k % 7 <> 0 AND (k + 1) % 7 <> 0) AS edges FROM c""")
def update_counts(spark, sf_dir):
    t = changed_parts(spark, sf_dir).told
    return spark.createDataFrame([(t.files_added, t.files_changed, t.files_removed, t.files_unchanged, t.nodes_total, t.edges_total)], "added long, changed long, removed long, unchanged long, nodes long, edges long")


@query(f"WITH {PARTS} SELECT source_qn, target_qn, confidence FROM links WHERE k % 7 <> 0 AND (k + 1) % 7 <> 0")
def update_edges(spark, sf_dir):
    return changed_parts(spark, sf_dir).table("edges").select("source_qn", "target_qn", "confidence")


@query(f"WITH {PARTS} SELECT qualified_name, file_path FROM nodes WHERE k % 7 <> 0")
def update_nodes(spark, sf_dir):
    return changed_parts(spark, sf_dir).table("symbols").select("qualified_name", "file_path")


@query(f"WITH {PARTS} SELECT CAST(10 - k AS INTEGER) AS hop, source_qn AS qualified_name, confidence FROM links WHERE k BETWEEN 7 AND 9")
def trace_callers(spark, sf_dir):
    found = questions.trace(part_store(spark, sf_dir), "app.p10.f10", depth=3)
    return spark.createDataFrame([(s.hop, s.qualified_name, s.confidence) for s in found.visited], "hop int, qualified_name string, confidence double")


@query(f"""WITH {PARTS} SELECT 'caller' AS kind, source_qn AS qualified_name FROM links WHERE k = 9 UNION ALL SELECT 'callee', target_qn FROM links WHERE k = 10
UNION ALL SELECT 'source', trim(array_to_string(list_slice(string_split(source, chr(10)), 3, 6), chr(10)), chr(10)) FROM src WHERE k = 10""")
def get_source_rows(spark, sf_dir):
    found = questions.get_source(part_store(spark, sf_dir), "app.p10.f10")
    rows = [("caller", s.qualified_name) for s in found.callers] + [("callee", s.qualified_name) for s in found.callees] + [("source", found.source)]
    return spark.createDataFrame(rows, "kind string, qualified_name string")


@query(f"""WITH {PARTS}, hit AS (SELECT qualified_name, 'f' || k AS name FROM nodes WHERE label = 'Function' AND file_path ILIKE '%.GO') SELECT (SELECT CAST(count(*) AS BIGINT) FROM hit) AS total, qualified_name FROM hit ORDER BY name, qualified_name LIMIT 7 OFFSET 2""")
def search_without_terms(spark, sf_dir):
    hits = questions.find_symbols(part_store(spark, sf_dir), "", label="Function", file_pattern="%.GO", limit=7, offset=2)
    return spark.createDataFrame([(hits.total, s.qualified_name) for s in hits.matches], "total long, qualified_name string")


@query(f"WITH {PARTS} SELECT CAST(2 AS BIGINT) AS total, qualified_name FROM nodes WHERE k IN (9, 10) AND label = 'Function'")
def search_terms(spark, sf_dir):
    hits = questions.find_symbols(part_store(spark, sf_dir), "f10 NOT class", label="Function")
    return spark.createDataFrame([(hits.total, s.qualified_name) for s in hits.matches], "total long, qualified_name string")


# Branches of resolution, payloads of all shapes, rules and names ------------------------------------------------------
def class_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text_of = lambda c: c.cast("string")
    module, owner = F.concat(F.lit("app.m"), text_of(k % 20)), F.concat(F.lit("C"), text_of(k % 7))
    rows = F.array(
        F.struct(F.concat_ws(".", module, owner).alias("qualified_name"), owner.alias("name"), F.lit("Class").alias("label")),
        F.struct(F.concat_ws(".", module, owner, F.concat(F.lit("g"), text_of(k % 5))).alias("qualified_name"), F.concat(F.lit("g"), text_of(k % 5)).alias("name"), F.lit("Function").alias("label")),
        F.struct(F.concat_ws(".", module, F.concat(F.lit("h"), text_of(k % 9))).alias("qualified_name"), F.concat(F.lit("h"), text_of(k % 9)).alias("name"), F.lit("Function").alias("label")),
    )
    return table(spark, sf_dir, "part").where("p_partkey % 60 < 25").select(F.inline(rows)).distinct()


def qualified_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = lambda c, m: (F.col(c) % m).cast("string")
    v = F.col("l_linenumber") % 5
    file = F.concat(F.lit("app/m"), n("l_orderkey", 20), F.lit(".py"))
    callee = F.when(v == 0, F.concat(F.lit("self.h"), n("l_partkey", 9))).when(v == 1, F.concat(F.lit("C"), n("l_partkey", 7), F.lit(".g"), n("l_suppkey", 5))).when(v == 4, F.concat(F.lit("ren"), n("l_partkey", 4))).otherwise(F.concat(F.lit("g"), n("l_suppkey", 5)))
    qualifier = F.when(v == 2, F.concat(F.lit("al"), n("l_suppkey", 3))).when(v == 3, F.concat(F.lit("cls.C"), n("l_partkey", 7))).otherwise("")
    return table(spark, sf_dir, "lineitem").select(file.alias("file_path"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("call_index"), callee.alias("callee"), qualifier.alias("qualifier"), F.lit("app.run").alias("in_function"), naming.module(file).alias("module_qn"))


def class_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By number modulo 3: a module under an alias, two classes by name, a function renamed."""
    k = F.col("s_suppkey")
    n = lambda m: (k % m).cast("string")
    names = F.when(k % 3 == 1, F.array(F.concat(F.lit("C"), n(7)), F.concat(F.lit("C"), (k * 2 % 7).cast("string")))).when(k % 3 == 2, F.array(F.concat(F.lit("h"), n(9)))).otherwise(F.array().cast("array<string>"))
    alias = F.when(k % 3 == 0, F.concat(F.lit("al"), (k * 5 % 9 % 3).cast("string"))).when(k % 3 == 2, F.concat(F.lit("ren"), n(4))).otherwise("")
    module = F.concat(F.lit("app.m"), (k * 11 % 20).cast("string"), F.when(k % 3 == 0, F.concat(F.lit(".C"), n(7))).otherwise(""))
    return table(spark, sf_dir, "supplier").select(F.concat(F.lit("app/m"), (k * 3 % 20).cast("string"), F.lit(".py")).alias("file_path"), k.alias("ordinal"), module.alias("module_path"), names.alias("names"), alias.alias("alias"), F.lit("").alias("in_function"))


@query("""WITH k AS (SELECT p_partkey AS k, 'app.m' || (p_partkey % 20) AS m FROM part WHERE p_partkey % 60 < 25),
syms AS (SELECT DISTINCT m || '.C' || (k % 7) AS qn, 'Class' AS label FROM k UNION SELECT m || '.C' || (k % 7) || '.g' || (k % 5), 'Function' FROM k UNION SELECT m || '.h' || (k % 9), 'Function' FROM k),
calls AS (SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS call_index, l_orderkey % 20 AS f, 'app.m' || (l_orderkey % 20) AS m,
  CASE l_linenumber % 5 WHEN 0 THEN 'h' || (l_partkey % 9) WHEN 4 THEN 'ren' || (l_partkey % 4) ELSE 'g' || (l_suppkey % 5) END AS bare,
  CASE l_linenumber % 5 WHEN 1 THEN 'C' || (l_partkey % 7) WHEN 2 THEN 'al' || (l_suppkey % 3) WHEN 3 THEN 'C' || (l_partkey % 7) ELSE '' END AS qual FROM lineitem),
imports AS (SELECT s_suppkey * 3 % 20 AS f, s_suppkey AS ord, 'app.m' || (s_suppkey * 11 % 20) || CASE WHEN s_suppkey % 3 = 0 THEN '.C' || (s_suppkey % 7) ELSE '' END AS module,
  CASE s_suppkey % 3 WHEN 1 THEN ['C' || (s_suppkey % 7), 'C' || (s_suppkey * 2 % 7)] WHEN 2 THEN ['h' || (s_suppkey % 9)] ELSE [] END AS names,
  CASE s_suppkey % 3 WHEN 0 THEN 'al' || (s_suppkey * 5 % 9 % 3) WHEN 2 THEN 'ren' || (s_suppkey % 4) ELSE '' END AS alias FROM supplier),
tried AS (
  SELECT call_index, 0 AS rank, 'same_module' AS strategy, c.m || '.' || qual || '.' || bare AS target FROM calls c JOIN syms s ON s.qn = c.m || '.' || qual AND s.label = 'Class' WHERE qual <> ''
  UNION ALL SELECT call_index, 10, 'same_module', m || '.' || bare FROM calls
  UNION ALL SELECT call_index, 100 + ord, 'import_map', CASE WHEN qual <> '' THEN CASE WHEN alias = qual THEN CASE WHEN len(names) > 0 THEN module || '.' || names[1] || '.' || bare ELSE module || '.' || bare END WHEN list_contains(names, qual) THEN module || '.' || qual || '.' || bare END
    ELSE CASE WHEN list_contains(names, bare) THEN module || '.' || bare WHEN alias = bare THEN CASE WHEN len(names) > 0 THEN module || '.' || names[1] ELSE module END END END FROM calls c JOIN imports i ON c.f = i.f
  UNION ALL SELECT call_index, 1000000000, 'fuzzy', u.target FROM calls c JOIN (SELECT regexp_extract(qn, '[^.]*$') AS name, min(qn) AS target FROM syms GROUP BY ALL HAVING count(*) = 1) u ON u.name = c.bare),
best AS (SELECT t.* FROM tried t JOIN syms s ON s.qn = t.target QUALIFY row_number() OVER (PARTITION BY call_index ORDER BY rank, target) = 1)
SELECT c.call_index, b.target, coalesce(b.strategy, 'unresolved') AS strategy FROM calls c LEFT JOIN best b ON c.call_index = b.call_index""")
def resolve_qualified(spark, sf_dir):
    return resolve.resolve(qualified_calls(spark, sf_dir), class_imports(spark, sf_dir), class_symbols(spark, sf_dir)).select("call_index", "target", "strategy")


@query("""WITH syms AS (SELECT 'f' || (p_partkey % 700) AS name, CASE WHEN p_partkey % 3 = 0 THEN 'proj.' ELSE 'other.' END || 'm' || p_partkey || '.f' || (p_partkey % 700) AS qn FROM part),
named AS (SELECT name, count(*) AS n, min(qn) AS only_one, count(*) FILTER (starts_with(qn, 'proj.')) AS n_own, min(qn) FILTER (starts_with(qn, 'proj.')) AS own FROM syms GROUP BY name),
known AS (SELECT name, CASE WHEN n = 1 THEN only_one WHEN n <= 5 AND n_own = 1 THEN own END AS target FROM named)
SELECT CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS call_index, target FROM lineitem JOIN known ON name = 'f' || (l_partkey % 900) WHERE target IS NOT NULL""")
def resolve_fuzzy_project(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.concat(F.lit("f"), (k % 700).cast("string"))
    symbols = table(spark, sf_dir, "part").select(name.alias("name"), F.concat(F.when(k % 3 == 0, "proj.").otherwise("other."), F.lit("m"), k.cast("string"), F.lit("."), name).alias("qualified_name"))
    calls = table(spark, sf_dir, "lineitem").select(F.lit("a.py").alias("file_path"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("call_index"), F.concat(F.lit("f"), (F.col("l_partkey") % 900).cast("string")).alias("bare"))
    return resolve.fuzzy(calls, symbols, "proj").select("call_index", "target")


SHAPES = """CASE CAST(event_id % 9 AS INT)
WHEN 0 THEN '{"imports": "a.b", "calls": null, "call_sites": [" g ", {"callee": 7, "name": "x"}, {"callee": "", "name": "h", "qual": "q", "line": "3"}], "unsupported_calls": 2}'
WHEN 1 THEN '{"imports": [" a ", "", 3, {"module": "m", "names": "x, y,", "as": "z", "line": 4}, {"module_path": [], "path": "p", "scope": "local"}], "unsupported_calls": -1}'
WHEN 2 THEN '{"imports": {"import": "q.r", "names": ["n", 5, " o "], "in_function": " f.g ", "scope": "local"}, "unsupported_calls": "2"}'
WHEN 3 THEN '{"imports": 5, "calls": true}'
WHEN 4 THEN '{"imports": [{"names": ["x"]}, {"module_path": 5, "module": "m"}, {"module_path": "  "}], "calls": {"target": "t", "source_qn": "s.q", "line": 9}}'
WHEN 5 THEN '{"imports": null, "calls": []}' WHEN 6 THEN 'no json' WHEN 7 THEN '{"calls": [{"callee": "f", "line": 2.5}, {"callee": "f", "line": 0}, [1]]}' ELSE NULL END"""


def shaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("own."), "event_type").alias("owner"), F.concat(F.lit("file"), (F.col("event_id") % 27).cast("string")).alias("file"), F.expr(SHAPES).alias("payload"))


IMPORT_SHAPES = """v(k, pos, module_path, names, alias, line, scope, malformed) AS (VALUES (0, 0, 'a.b', '', '', 0, '', 0), (1, 0, 'a', '', '', 0, '', 0), (1, 1, NULL, '', '', 0, '', 1), (1, 2, NULL, '', '', 0, '', 1), (1, 3, 'm', 'x|y', 'z', 4, '', 0), (1, 4, 'p', '', '', 0, 'local', 0),
(2, 0, 'q.r', 'n|o', '', 0, 'f.g', 0), (3, 0, NULL, '', '', 0, '', 1), (4, 0, NULL, 'x', '', 0, '', 1), (4, 1, NULL, '', '', 0, '', 1), (4, 2, NULL, '', '', 0, '', 1))"""
CALL_SHAPES = """w(k, pos, callee, line, qual, inside, malformed) AS (VALUES (0, 0, 'g', 0, '', '', 0), (0, 1, NULL, 0, '', '', 1), (0, 2, 'h', 0, 'q', '', 0), (3, 0, NULL, 0, '', '', 1), (4, 0, 't', 9, '', 's.q', 0), (7, 0, 'f', 0, '', '', 0), (7, 1, 'f', 0, '', '', 0), (7, 2, NULL, 0, '', '', 1))"""


@query(f"""WITH {IMPORT_SHAPES} SELECT event_id, pos, module_path, names, alias, line, CASE WHEN scope = 'local' THEN 'own.' || event_type ELSE scope END AS in_function, malformed FROM events JOIN v ON event_id % 9 = v.k""")
def payload_imports(spark, sf_dir):
    rows = payload.import_rows(shaped(spark, sf_dir), "payload", "owner")
    return rows.select("event_id", "pos", "module_path", F.array_join("names", "|").alias("names"), "alias", "line", "in_function", "malformed")


@query(f"""WITH {CALL_SHAPES} SELECT event_id, pos, callee, line, qual, CASE WHEN inside = '' THEN 'own.' || event_type ELSE inside END AS in_function, malformed FROM events JOIN w ON event_id % 9 = w.k""")
def payload_call_sites(spark, sf_dir):
    return payload.call_rows(shaped(spark, sf_dir), "payload", "owner").select("event_id", "pos", "callee", "line", "qual", "in_function", "malformed")


@query(f"""WITH {IMPORT_SHAPES}, {CALL_SHAPES}, i AS (SELECT event_id % 27 AS file, v.* EXCLUDE (scope), CASE WHEN scope = 'local' THEN 'own.' || event_type ELSE scope END AS inside FROM events JOIN v ON event_id % 9 = v.k),
c AS (SELECT event_id % 27 AS file, w.* EXCLUDE (inside), CASE WHEN inside = '' THEN 'own.' || event_type ELSE inside END AS inside FROM events JOIN w ON event_id % 9 = w.k)
SELECT (SELECT CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT file, callee, line, qual, inside FROM c WHERE malformed = 0)) AS calls, (SELECT CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT file, module_path, names, alias, line, inside FROM i WHERE malformed = 0)) AS imports,
(SELECT CAST(sum(malformed) AS BIGINT) FROM (SELECT malformed FROM i UNION ALL SELECT malformed FROM c)) AS malformed, (SELECT CAST(2 * count(*) AS BIGINT) FROM events WHERE event_id % 9 = 0) AS unsupported""")
def payload_totals(spark, sf_dir):
    return payload.totals(shaped(spark, sf_dir), "payload", "owner", "file")


IGNORE_SPECS = [("", ["# rules", "*.min.js", "doc_1*.go", "!doc_11*.go", "/s0/en/", "tmp?/", "!/s0/en/doc_5.py"]), ("s1", ["/de/**/*.py", "*.md", "!doc_3*.md"]), ("s2/fr", ["doc_[0-4]*.ts"])]


@query(r"""WITH f AS (SELECT doc_id, 's' || (doc_id % 4) || '/' || lang || CASE WHEN doc_id % 10 = 3 THEN '/tmp1' ELSE '' END || '/doc_' || doc_id || ['.py', '.test.ts', '.go', '.md', '', '.min.js'][doc_id % 6 + 1] AS path FROM documents)
SELECT path, ends_with(path, '.min.js') OR (regexp_matches(path, '/doc_1[^/]*\.go$') AND NOT regexp_matches(path, '/doc_11[^/]*\.go$')) OR starts_with(path, 's0/en/') OR contains(path, '/tmp1/')
OR regexp_matches(path, '^s1/de/.*\.py$') OR (regexp_matches(path, '^s1/.*\.md$') AND NOT regexp_matches(path, '/doc_3[^/]*\.md$')) OR regexp_matches(path, '^s2/fr/(.*/)?doc_[0-4][^/]*\.ts$') AS ignored FROM f""")
def ignore_layers(spark, sf_dir):
    k = F.col("doc_id")
    suffix = F.element_at(F.array(*map(F.lit, (".py", ".test.ts", ".go", ".md", "", ".min.js"))), (k % 6 + 1).cast("int"))
    path = F.concat(F.lit("s"), (k % 4).cast("string"), F.lit("/"), "lang", F.when(k % 10 == 3, "/tmp1").otherwise(""), F.lit("/doc_"), k.cast("string"), suffix)
    return table(spark, sf_dir, "documents").select(path.alias("path")).select("path", repo.ignored_below(F.col("path"), IGNORE_SPECS).alias("ignored"))


@query("""SELECT o_orderkey, ['src', 'node_modules', '.git', 'lib/vendor', 'a/build/b', 'targets'][o_orderkey % 6 + 1] || '/f' || o_orderkey || ['.py', '.PNG', '.zip', '.rs', ''][o_orderkey % 5 + 1] AS path,
o_orderkey % 6 IN (0, 5) AND o_orderkey % 5 NOT IN (1, 2) AND o_totalprice * 20 <= 2097152 AS wanted FROM orders""")
def skip_folders(spark, sf_dir):
    k = F.col("o_orderkey")
    pick = lambda values, m: F.element_at(F.array(*map(F.lit, values)), (k % m + 1).cast("int"))
    path = F.concat(pick(("src", "node_modules", ".git", "lib/vendor", "a/build/b", "targets"), 6), F.lit("/f"), k.cast("string"), pick((".py", ".PNG", ".zip", ".rs", ""), 5))
    return table(spark, sf_dir, "orders").select("o_orderkey", path.alias("path"), "o_totalprice").select("o_orderkey", "path", repo.wanted(F.col("path"), F.col("o_totalprice") * 20).alias("wanted"))


@query("""SELECT p_partkey, ['..pkg.m' || p_partkey, './src/a' || p_partkey || '.ts', 'x/y.test.js', 'crate', 'a/b.pyi'][p_partkey % 5 + 1] AS written,
['pkg.m' || p_partkey, '.src.a' || p_partkey, 'x.y.test', 'crate', 'a.b'][p_partkey % 5 + 1] AS module, ['pkg', 'x/y', '', './d/e', '.'][p_partkey % 5 + 1] AS dir, ['pkg', 'x.y', '', 'd.e', ''][p_partkey % 5 + 1] AS folder FROM part""")
def import_module_paths(spark, sf_dir):
    k = F.col("p_partkey")
    n = k.cast("string")
    written = F.element_at(F.array(F.concat(F.lit("..pkg.m"), n), F.concat(F.lit("./src/a"), n, F.lit(".ts")), F.lit("x/y.test.js"), F.lit("crate"), F.lit("a/b.pyi")), (k % 5 + 1).cast("int"))
    folder = F.element_at(F.array(*map(F.lit, ("pkg", "x/y", "", "./d/e", "."))), (k % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", written.alias("written"), folder.alias("dir")).select("p_partkey", "written", naming.module_path(F.col("written")).alias("module"), "dir", naming.folder(F.col("dir")).alias("folder"))


@query(f"""WITH {FILES} SELECT 'unread' AS kind, language AS name FROM (SELECT DISTINCT CASE WHEN path LIKE '%.md' THEN 'markdown' WHEN NOT contains(path, '.') THEN 'unknown' END AS language FROM files) WHERE language IS NOT NULL
UNION ALL SELECT 'language', unnest(['bash', 'c', 'c_sharp', 'cpp', 'elixir', 'go', 'java', 'javascript', 'kotlin', 'lua', 'php', 'python', 'ruby', 'rust', 'scala', 'swift', 'typescript']) UNION ALL SELECT 'extensions', '30'""")
def language_lists(spark, sf_dir):
    known = spark.createDataFrame([("language", n) for n in naming.supported_languages()] + [("extensions", str(len(naming.supported_extensions())))], "kind string, name string")
    return naming.unavailable(files(spark, sf_dir)).select(F.lit("unread").alias("kind"), F.col("language").alias("name")).unionByName(known)


@query(f"WITH {PARTS}, e AS (SELECT qualified_name, unnest(range(1, len(string_split(qualified_name, '.')))) AS i FROM nodes) SELECT array_to_string(list_slice(string_split(qualified_name, '.'), 1, i), '.') AS prefix, CAST(count(*) AS BIGINT) AS n FROM e GROUP BY prefix")
def prefix_index(spark, sf_dir):
    return naming.by_prefix(part_store(spark, sf_dir).table("symbols")).groupBy("prefix").agg(F.count("*").alias("n"))


@query(r"""SELECT p_partkey, array_to_string(regexp_extract_all(strip_accents(lower(p_name || ' Čeština_ŽLUTÝ.kůň n' || p_partkey || ' Łódź Ő')), '[\p{L}\p{N}]+'), '|') AS terms FROM part""")
def fold_terms(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.terms(F.concat("p_name", F.lit(" Čeština_ŽLUTÝ.kůň n"), F.col("p_partkey").cast("string"), F.lit(" Łódź Ő"))), "|").alias("terms"))


@query("""WITH gone AS (SELECT p_partkey FROM part WHERE p_size < 10) SELECT CAST(count(*) FILTER (p_partkey IN (SELECT p_partkey FROM gone)) AS BIGINT) AS n_deleted, CAST(count(*) FILTER (p_partkey NOT IN (SELECT p_partkey FROM gone)) AS BIGINT) AS n_left,
CAST(count(*) FILTER (p_size % 7 <> 0) AS BIGINT) AS n_named, (SELECT CAST(count(*) AS BIGINT) FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier) AND l_partkey IN (SELECT p_partkey FROM part))) AS n_inserted FROM part""")
def write_counts(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    left, n = storage.deleted(parts, parts.where("p_size < 10").select("p_partkey"))
    named = storage.named_nodes(parts.select(F.when(F.col("p_size") % 7 != 0, F.col("p_partkey").cast("string")).otherwise("").alias("qualified_name")), strict=False)
    known = table(spark, sf_dir, "part").select(F.concat(F.lit("p."), F.col("p_partkey").cast("string")).alias("qualified_name")).unionByName(table(spark, sf_dir, "supplier").select(F.concat(F.lit("s."), F.col("s_suppkey").cast("string")).alias("qualified_name")))
    inserted = storage.inserted(supply_edges(spark, sf_dir), known, ["ord"])
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return n.select(F.col("n").alias("n_deleted")).crossJoin(one(left, "n_left")).crossJoin(one(named, "n_named")).withColumn("n_inserted", F.lit(inserted).cast("long"))  # one row each


@query(f"""WITH {SUPPLY}, few AS (SELECT * FROM supply WHERE CAST(substring(target_qn, 3) AS BIGINT) % 50 = 0), l1 AS (SELECT target_qn AS part, min(ord) AS ord FROM few WHERE source_qn = 's.1' GROUP BY ALL),
l2 AS (SELECT f.source_qn AS node, l1.part, l1.ord AS first, f.ord FROM few f JOIN l1 ON f.target_qn = l1.part WHERE f.source_qn <> 's.1' QUALIFY row_number() OVER (PARTITION BY f.source_qn ORDER BY l1.ord, l1.part, f.ord) = 1),
per AS (SELECT part, first, count(*) AS n FROM l2 GROUP BY ALL), run AS (SELECT *, coalesce(sum(n) OVER (ORDER BY first, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM per),
kept AS (SELECT part FROM run WHERE before + 1 + (SELECT count(*) FROM l1) < (SELECT count(*) FROM l1) + 9)
SELECT part AS node, 1 AS hop FROM l1 UNION ALL SELECT node, 2 FROM l2 WHERE part IN (SELECT part FROM kept)""")
def bfs_capped(spark, sf_dir):
    e = supply_edges(spark, sf_dir).where("cast(substring(target_qn, 3) as bigint) % 50 = 0")
    both = e.unionByName(e.select(F.col("target_qn").alias("source_qn"), F.col("source_qn").alias("target_qn"), "type", "ord", "confidence"))
    direct = both.where("source_qn = 's.1'").select("target_qn").distinct().count()
    return graph.bfs(both, "s.1", callers=False, max_depth=2, max_nodes=direct + 9).select("node", "hop")
