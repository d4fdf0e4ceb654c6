"""Import and call payloads of mixed shape (JSON), as typed rows with a count of malformed items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANKS = " \t\n\r\x0b\x0c"


def kind(item: Column) -> Column:
    return F.schema_of_variant(item)


def stripped(item: Column) -> Column:
    """A text without blanks around it; null for other kinds."""
    return F.when(kind(item) == "STRING", F.btrim(F.try_variant_get(item, "$", "string"), F.lit(BLANKS)))


def holds(item: Column) -> Column:
    """Whether a value is one that counts: no null, empty text, list or object, zero or false."""
    of = kind(item)
    plain = F.try_variant_get(item, "$", "string")
    return item.isNotNull() & ~of.isin("VOID", "ARRAY<VOID>", "OBJECT<>") & ~((of == "STRING") & (plain == "")) & ~((of == "BOOLEAN") & (plain == "false")) & ~(~of.isin("STRING", "BOOLEAN") & (F.try_variant_get(item, "$", "double") == 0))


def text_at(item: Column, *keys: str) -> Column:
    """What the first key that holds something holds, without blanks; null if that is no text, or blank."""
    found = [F.try_variant_get(item, f"$.{k}", "variant") for k in keys]
    first = F.coalesce(*(F.when(F.coalesce(holds(v), F.lit(False)), F.struct(stripped(v).alias("text"))) for v in found))
    return F.nullif(first.text, F.lit(""))


def int_at(item: Column, key: str) -> Column:
    """A whole number under the key; zero for anything else."""
    found = F.try_variant_get(item, f"$.{key}", "variant")
    return F.coalesce(F.when(kind(found) == "BIGINT", F.try_variant_get(found, "$", "int")), F.lit(0))


def items(rows: DataFrame, payload: str, *keys: str) -> DataFrame:
    """The items under the first of the keys that is there: an array's, or the value itself; ``pos`` tells their order.

    A value that is no text, object or array is one item, too, and malformed.
    """
    doc = F.try_parse_json(payload)
    there = [F.try_variant_get(doc, f"$.{k}", "variant") for k in keys]
    value = F.coalesce(*(F.when(kind(v) != "VOID", v) for v in there))
    many = kind(value).startswith("ARRAY")
    listed = F.when(many, F.try_variant_get(value, "$", "array<variant>")).when(value.isNotNull(), F.array(value))
    return rows.select(*rows.columns, F.posexplode(listed).alias("pos", "item"))


def call_rows(rows: DataFrame, payload: str, owner: str) -> DataFrame:
    """callee, line, qualifier, in_function and malformed of each item under ``calls``, or else ``call_sites``."""
    each = items(rows, payload, "calls", "call_sites")
    item = F.col("item")
    named = kind(item).startswith("OBJECT")
    callee = F.when(named, text_at(item, "callee", "name", "target")).otherwise(F.nullif(stripped(item), F.lit("")))
    given = F.when(named, F.coalesce(text_at(item, "qualifier", "qual"), F.lit(""))).otherwise("")
    inside = F.coalesce(F.when(named, text_at(item, "in_function", "source_qn")), F.col(owner))
    line = F.when(named, int_at(item, "line")).otherwise(0)
    return each.select(*rows.columns, "pos", callee.alias("callee"), line.alias("line"), given.alias("qual"), inside.alias("in_function"), callee.isNull().cast("int").alias("malformed"))


def import_rows(rows: DataFrame, payload: str, owner: str) -> DataFrame:
    """module_path, names, alias, line, in_function and malformed of each item under ``imports``."""
    each = items(rows, payload, "imports")
    item = F.col("item")
    named = kind(item).startswith("OBJECT")
    module = F.when(named, text_at(item, "module_path", "module", "path", "import")).otherwise(F.nullif(stripped(item), F.lit("")))
    given = F.try_variant_get(item, "$.names", "variant")
    listed = F.filter(F.transform(F.try_variant_get(given, "$", "array<variant>"), stripped), lambda n: n.isNotNull())
    parted = F.filter(F.transform(F.split(F.try_variant_get(given, "$", "string"), ","), lambda n: F.btrim(n, F.lit(BLANKS))), lambda n: n != "")
    names = F.when(named & kind(given).startswith("ARRAY"), listed).when(named & (kind(given) == "STRING"), parted)
    scope = F.when(named, stripped(F.try_variant_get(item, "$.scope", "variant")))
    inside = F.coalesce(F.when(named, text_at(item, "in_function", "source_qn")), F.when(scope == "local", F.col(owner)), F.lit(""))
    return each.select(
        *rows.columns, "pos", module.alias("module_path"), F.coalesce(names, F.array().cast("array<string>")).alias("names"), F.coalesce(F.when(named, text_at(item, "alias", "as")), F.lit("")).alias("alias"),
        F.when(named, int_at(item, "line")).otherwise(0).alias("line"), inside.alias("in_function"), module.isNull().cast("int").alias("malformed"),
    )


def unsupported(payload: str) -> Column:
    """The number under ``unsupported_calls``; zero unless it is whole and positive."""
    return F.greatest(F.lit(0), F.coalesce(int_at(F.try_parse_json(payload), "unsupported_calls"), F.lit(0)))


def totals(rows: DataFrame, payload: str, owner: str, file: str) -> DataFrame:
    """One row: distinct calls and imports of files, malformed items of both kinds, and unsupported calls."""
    calls, imports = call_rows(rows, payload, owner), import_rows(rows, payload, owner)
    good_calls = calls.where("malformed = 0").select(file, "callee", "line", "qual", "in_function").distinct()
    good_imports = imports.where("malformed = 0").select(file, "module_path", "names", "alias", "line", "in_function").distinct()
    one = lambda df, c, name: df.agg(F.coalesce(c, F.lit(0)).cast("long").alias(name))
    bad = calls.select("malformed").unionByName(imports.select("malformed"))
    parts = [one(good_calls, F.count("*"), "calls"), one(good_imports, F.count("*"), "imports"), one(bad, F.sum("malformed"), "malformed"), one(rows.select(unsupported(payload).alias("u")), F.sum("u"), "unsupported")]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.crossJoin(part)  # one row each
    return whole
