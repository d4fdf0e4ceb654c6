"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import crosspolytope, line_dedup, mixing, pii, pivot_search, quality, sentencepiece_codec, simhash, token_store, url_filter

#: (action, host, path)
URL_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Target shares of tokens, by domain of ``labels``.
MIX_WEIGHTS = {"good": 0.9, "low": 0.08, "toxic": 0.02}
MIX_KEEP = ("good",)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domain_labels(labels: DataFrame) -> DataFrame:
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "low")
    return labels.select("doc_id", domain.alias("domain"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sentencepiece_codec.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), packed=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_components(table(spark, sf_dir, "documents"))


def op5_pivot_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_search.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"size(filter(base, s -> s.kind = '{k}'))").cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.shown("base"), 256).alias("base_sha256"), pii.shown("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), domain_labels(table(spark, sf_dir, "labels")), MIX_WEIGHTS, keep=MIX_KEEP)
    return mixed.select("doc_id", "n_tokens", "rate", "copies", "targets_met")


def op8_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspolytope.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_and_read(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", "removed_lines")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_sentencepiece, op2_url_filters, op3_quality, op4_simhash, op5_pivot_search, op6_pii, op7_mixing, op8_cross_polytope, op9_token_store, op10_line_dedup, pipeline)
}

ORACLE_SQL: dict[str, str] = {
    "op2_url_filters": r"""
WITH rules(verdict, h, p) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
located AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
places AS (SELECT DISTINCT host, path FROM located),
best AS (
  SELECT host, path, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM places JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY host, path)
SELECT l.page_id, l.host, l.path, b.rule, coalesce(b.verdict, 'allow') AS verdict
FROM located l LEFT JOIN best b ON l.host = b.host AND l.path = b.path
""",
    "op5_pivot_search": """
WITH v AS (
  SELECT vec_id, min(list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE)))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 GROUP BY vec_id),
scored AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
""",
    "op10_line_dedup": """
WITH raw AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos
  FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
lines AS (SELECT doc_id, text, pos, trim(raw, chr(32) || chr(9) || chr(13)) AS line, 1 + length(line) - length(replace(line, ' ', '')) AS words FROM raw WHERE line <> ''),
placed AS (SELECT *, sum(words) OVER (PARTITION BY doc_id, text ORDER BY pos) - words AS begins FROM lines),
framed AS (
  SELECT doc_id, text, pos, max(pos) OVER w AS last, max(begins + words) OVER w - begins AS weight, md5(string_agg(line, chr(10)) OVER w) AS content
  FROM placed WINDOW w AS (PARTITION BY doc_id, text ORDER BY begins RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY doc_id NULLS LAST, text, pos) AS nth FROM framed WHERE weight >= 50),
gone AS (SELECT DISTINCT doc_id, text, unnest(range(pos, last + 1)) AS pos FROM ordered WHERE nth > 1),
stay AS (
  SELECT r.doc_id, r.text, string_agg(r.raw, chr(10) ORDER BY r.pos) FILTER (WHERE g.pos IS NULL) AS kept, count(g.pos) AS n
  FROM raw r LEFT JOIN gone g ON r.doc_id IS NOT DISTINCT FROM g.doc_id AND r.text = g.text AND r.pos = g.pos GROUP BY r.doc_id, r.text)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(s.kept, '') END AS text, CAST(coalesce(s.n, 0) AS BIGINT) AS removed_lines
FROM documents d LEFT JOIN stay s ON d.doc_id IS NOT DISTINCT FROM s.doc_id AND d.text = s.text
""",
}
