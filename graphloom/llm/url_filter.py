"""URL filters: host-suffix and path-prefix rules, looked up by short hash prefixes.

Each distinct (host, path) is expanded into expressions ``suffix + prefix``: all
suffixes of the host at label borders, and the prefixes of the path whose
lengths occur in the rules.  Expressions meet rules in an equi-join on the first
32 bits of their SHA-256; the full digest is compared afterwards, and the
longest rule decides.  A host's suffixes have no more labels than the longest of the rules',
so that a url's expressions are as many as the rules' shapes at most.
All of it is DataFrame functions.

A rule fits its host and all subdomains where the path starts with the rule's.
The longest ``host + path`` wins, then the longer host, then ``block``.
Where no rule fits, the verdict is ``default``.

Nulls: a null url, or one without ``://``, has empty host and path and gets the
default.  Rules with a null or empty host, or an action other than block or
allow, fit nothing.  Repeated rows give repeated results; empty tables give
empty ones.  Columns ``host``, ``path``, ``rule`` and ``verdict`` of the input
are replaced.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import free, lower_ascii

#: Rules up to this number are sent to every executor (about 20 MB at most); more are shuffled.
MOST_BROADCAST = 100_000


def url_host(url: Column) -> Column:
    """Empty where there is no ``://``."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def expressions(host: Column, path: Column, lengths: list[int], most_labels: int) -> Column:
    """Host suffixes of up to ``most_labels`` labels, at label borders, each with the path prefixes of the given lengths."""
    end = F.substring_index(host, ".", -most_labels)  # no longer than the rules' hosts in labels
    labels = F.split(end, r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fit = F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.char_length(path))
    prefixes = F.transform(fit, lambda n: F.substr(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(F.concat(s, p).alias("text"), F.char_length(s).alias("cut")))))


def filter_urls(pages: DataFrame, rules: DataFrame | Iterable[tuple[str, str, str]], url: str = "url", default: str = "allow", most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``pages`` with host, path, rule (null if none fits) and verdict.

    rules: rows (action, host, path), action being block or allow.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([tuple(r) for r in rules], "action string, host string, path string")
    rules = (
        rules.select("action", lower_ascii(F.col("host")).alias("h"), F.coalesce("path", F.lit("")).alias("p"))
        .where("action in ('block', 'allow') and h <> ''")
        .groupBy(F.concat("h", "p").alias("rule"), F.char_length("h").alias("cut"))
        .agg(F.max("action").alias("verdict"))  # block comes after allow
        .withColumn("digest", F.sha2("rule", 256))
        .withColumn("short", F.substr("digest", F.lit(1), F.lit(8)))
    )
    # bounded: as many numbers as there are lengths of a rule's path
    facts = rules.agg(F.count("*").alias("n"), F.sort_array(F.collect_set(F.char_length("rule") - F.col("cut"))).alias("lengths"), F.max(F.size(F.split(F.substr("rule", F.lit(1), F.col("cut")), r"\.", -1))).alias("labels")).first()
    side = F.broadcast(rules) if facts["n"] <= most_broadcast else rules

    own = [c for c in pages.columns if c.lower() not in ("host", "path", "rule", "verdict")]
    places = pages.select(url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path")).where("host <> ''").distinct()
    asked = (
        places.withColumn("e", F.explode(expressions(F.col("host"), F.col("path"), facts["lengths"] or [], facts["labels"])))
        .select("host", "path", F.col("e.text").alias("asked"), F.col("e.cut").alias("asked_cut"), F.sha2("e.text", 256).alias("asked_digest"))
        .withColumn("asked_short", F.substr("asked_digest", F.lit(1), F.lit(8)))
    ) if facts["lengths"] else places.selectExpr("host", "path", "'' asked", "0 asked_cut", "'' asked_digest", "'' asked_short").limit(0)
    at_host, at_path, best = (free([*own, "host", "path"], n) for n in ("at_host", "at_path", "best"))
    found = (
        asked.join(side, F.col("asked_short") == F.col("short"))
        .where("asked_digest = digest and asked = rule and asked_cut = cut")
        .groupBy(F.col("host").alias(at_host), F.col("path").alias(at_path))
        .agg(F.max(F.struct(F.char_length("rule"), "cut", "verdict", "rule")).alias(best))
    )
    located = pages.select(*own, url_host(F.col(url)).alias("host"), url_path(F.col(url)).alias("path"))
    return located.join(found, (F.col("host") == F.col(at_host)) & (F.col("path") == F.col(at_path)), "left").select(
        *own, "host", "path", F.col(f"{best}.rule").alias("rule"), F.coalesce(f"{best}.verdict", F.lit(default)).alias("verdict")
    )
