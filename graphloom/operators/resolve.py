"""Call resolution: ranked candidates, joined to symbols, the best of each call.

symbols: qualified_name, name, label.  calls: file_path, call_index, callee,
qualifier, in_function, module_qn.  imports: file_path, ordinal, module_path,
names (array), alias, in_function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import naming

# Confidence of each strategy, and bounds of the search by name alone.
CONFIDENCE = {"same_module": 0.95, "import_map": 0.85, "fuzzy": 0.40, "unresolved": 0.0}
MOST_FUZZY, SHORTEST_FUZZY = 5, 2
QUALIFIED, PLAIN, IMPORTED, FUZZY = 0, 10, 100, 1_000_000_000_000


def prepared(calls: DataFrame) -> DataFrame:
    """Calls inside a function, with their bare name and qualifier."""
    name = naming.without_self(F.col("callee"))
    inside = calls.where(F.coalesce("in_function", F.lit("")) != "")
    given = naming.without_self(F.coalesce("qualifier", F.lit("")))
    return inside.select("*", naming.bare(name).alias("bare"), F.when(given != "", given).otherwise(naming.qualifier(name)).alias("qual"))


def same_module(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_path, call_index, rank, target): a definition in the caller's module or up to two packages above."""
    parts = F.split("module_qn", r"\.")
    scopes = F.transform(F.filter(F.array(*map(F.lit, range(3))), lambda i: i < F.size(parts)), lambda i: F.struct(i.alias("up"), F.array_join(F.slice(parts, 1, F.size(parts) - i), ".").alias("scope")))
    at = calls.select("file_path", "call_index", "bare", "qual", F.explode(scopes).alias("s"))
    plain = at.select("file_path", "call_index", (F.col("s.up") + PLAIN).cast("long").alias("rank"), F.concat_ws(".", "s.scope", "bare").alias("qualified_name"))
    owner = F.concat_ws(".", "s.scope", naming.bare(F.col("qual")))
    owned = at.where("qual <> ''").select("file_path", "call_index", (F.col("s.up") + QUALIFIED).cast("long").alias("rank"), owner.alias("owner"), F.concat_ws(".", owner, "bare").alias("qualified_name"))
    classes = symbols.where("label in ('Class', 'Interface')").select(F.col("qualified_name").alias("owner")).distinct()
    tried = plain.unionByName(owned.join(classes, "owner", "left_semi").drop("owner"))
    return tried.join(symbols.select("qualified_name").distinct(), "qualified_name").select("file_path", "call_index", "rank", F.col("qualified_name").alias("target"))


def visible_names(imports: DataFrame) -> DataFrame:
    """(file_path, ordinal, scope, key, base, named, bare): what each import lets a file see under which name.

    ``base`` is the full name of it, ``named`` tells a name from an alias.  An alias comes before an equal name where a call has a
    qualifier (``bare`` false), and the other way round where it has none.
    """
    module, has_names = naming.module_path(F.col("module_path")), F.coalesce(F.size("names") > 0, F.lit(False))
    first = F.when(has_names, F.concat_ws(".", module, F.get("names", F.lit(0)))).otherwise(module)
    names = F.coalesce(F.array_distinct("names"), F.array().cast("array<string>"))
    seen = F.transform(names, lambda n: F.struct(n.alias("key"), F.concat_ws(".", module, n).alias("base"), F.lit(True).alias("named"), F.coalesce(n == F.col("alias"), F.lit(False)).alias("shadowed")))
    alias = F.when(F.coalesce("alias", F.lit("")) != "", F.array(F.struct(F.col("alias").alias("key"), first.alias("base"), F.lit(False).alias("named"), F.array_contains(names, F.col("alias")).alias("shadowed"))))
    each = imports.select("file_path", "ordinal", F.coalesce("in_function", F.lit("")).alias("scope"), F.explode(F.concat(seen, F.coalesce(alias, F.filter(seen, lambda _: F.lit(False))))).alias("s"))
    return each.select("file_path", "ordinal", "scope", "s.*")


def import_map(calls: DataFrame, imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """A definition that an import of the file names; imports of a function count inside it only.

    Calls meet the visible names of their file by file and name, not all of its imports.
    """
    qualified = F.col("qual") != ""
    asked = calls.select("file_path", "call_index", "in_function", "bare", qualified.alias("qualified"), F.when(qualified, F.substring_index("qual", ".", 1)).otherwise(F.col("bare")).alias("key"))
    met = asked.join(visible_names(imports), ["file_path", "key"]).where("(scope = '' or scope = in_function) and not (shadowed and named = qualified)")
    target = F.when(F.col("qualified"), F.concat_ws(".", "base", "bare")).otherwise(F.col("base"))
    tried = met.select("file_path", "call_index", (F.col("ordinal") + IMPORTED).cast("long").alias("rank"), target.alias("qualified_name"))
    return tried.join(symbols.select("qualified_name").distinct(), "qualified_name").select("file_path", "call_index", "rank", F.col("qualified_name").alias("target"))


def fuzzy(calls: DataFrame, symbols: DataFrame, project: str = "") -> DataFrame:
    """The only definition of that name anywhere, or of two to ``MOST_FUZZY`` the only one in the project."""
    own = F.col("qualified_name").startswith(f"{project}.") if project else F.lit(False)
    names = symbols.select("name", "qualified_name").distinct().groupBy("name")
    named = names.agg(F.count("*").alias("n"), F.min("qualified_name").alias("only"), F.count_if(own).alias("n_own"), F.min(F.when(own, F.col("qualified_name"))).alias("own"))
    target = F.when(F.col("n") == 1, F.col("only")).when((F.col("n") <= MOST_FUZZY) & (F.col("n_own") == 1), F.col("own"))
    known = named.select("name", target.alias("target")).where("target is not null")
    tried = calls.where(F.char_length("bare") >= SHORTEST_FUZZY)
    return tried.join(known, tried.bare == known.name).select("file_path", "call_index", F.lit(FUZZY).cast("long").alias("rank"), "target")


def resolve(calls: DataFrame, imports: DataFrame, symbols: DataFrame, project: str = "") -> DataFrame:
    """file_path, call_index, target, strategy and confidence of every call inside a function; the first strategy that fits wins."""
    own = prepared(calls)
    found = same_module(own, symbols).unionByName(import_map(own, imports, symbols)).unionByName(fuzzy(own, symbols, project))
    best = found.groupBy("file_path", "call_index").agg(F.min(F.struct("rank", "target")).alias("b"))
    strategy = F.when(F.col("b.rank") < IMPORTED, "same_module").when(F.col("b.rank") < FUZZY, "import_map").when(F.col("b.rank") == FUZZY, "fuzzy").otherwise("unresolved")
    joined = own.select("file_path", "call_index", "in_function").join(best, ["file_path", "call_index"], "left").withColumn("strategy", strategy)
    return joined.select("file_path", "call_index", F.col("in_function").alias("source"), F.col("b.target").alias("target"), "strategy", naming.mapped(F.col("strategy"), {k: str(v) for k, v in CONFIDENCE.items()}).cast("double").alias("confidence"))
