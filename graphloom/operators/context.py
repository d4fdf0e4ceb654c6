"""Rendering of a project within a budget of tokens: skeleton, compact, summary and dependency modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text

# The budget, and the modes' reach as multiples of it.
BUDGET, COMPACT_REACH, SUMMARY_REACH, IMPORTS_SHOWN = 8_000, 2, 10, 8


def summary(symbols: DataFrame) -> DataFrame:
    """Counts by label and estimated tokens of each file."""
    count = lambda *labels: F.count_if(F.col("label").isin(*labels))
    joined = F.sum(F.char_length("signature")) + F.count("*") - 1
    return symbols.groupBy("file_path").agg(count("Class").alias("classes"), count("Function").alias("functions"), count("Method").alias("methods"), F.floor(joined / text.CHARS_A_TOKEN).alias("tokens"))


def mode(tokens: Column, budget: int = BUDGET) -> Column:
    return F.when(tokens <= budget, "skeleton").when(tokens <= budget * COMPACT_REACH, "compact").when(tokens <= budget * SUMMARY_REACH, "summary").otherwise("deps")


def shown_symbols(symbols: DataFrame) -> DataFrame:
    """Definitions, and the File rows of files that have none but whose language or kind is known."""
    plain = symbols.where("label = 'File'").where(F.coalesce(F.get_json_object("properties", "$.reason"), F.lit("")) != "no_language")
    return symbols.where("label <> 'File'").unionByName(plain)


def imports_line(files: DataFrame, most: int = IMPORTS_SHOWN) -> DataFrame:
    """file_path, its modules in order of appearance, shortened, and the line that shows the first of them."""
    modules = F.array_distinct(F.filter(F.transform("imports", lambda i: text.last_components(i.module_path)), lambda m: m != ""))
    shown = F.concat(F.lit("# imports: "), F.array_join(F.slice("modules", 1, most), ", "), F.when(F.size("modules") > most, " ...").otherwise(""))
    return files.select(F.col("path").alias("file_path"), modules.alias("modules")).where(F.size("modules") > 0).withColumn("line", shown)


def blocks(symbols: DataFrame, files: DataFrame, chosen: str) -> DataFrame:
    """file_path and the block of lines that a mode shows of each file; a file's lines are the unit that must fit in memory."""
    shown = shown_symbols(symbols)
    if chosen == "deps":
        defined = symbols.where("label <> 'File'").select("file_path").distinct()
        arrows = F.transform("modules", lambda m: F.concat("file_path", F.lit(" -> "), m))
        return imports_line(files).join(defined, "file_path", "left_semi").select("file_path", F.array_join(arrows, "\n").alias("block"))
    if chosen == "summary":
        row = "concat(rpad(file_path, greatest(62, char_length(file_path)), ' '), format_string('  %3d  %3d  %4d  (~%d tokens)', classes, functions, methods, tokens))"
        return summary(shown).select("file_path", F.expr(row).alias("block"))
    signature = F.coalesce("signature", F.lit(""))
    inner = (F.coalesce("parent", F.lit("")) != "") & (F.lit(chosen == "compact") | (F.col("label") != "Class"))
    indent = F.when(inner, "    ").otherwise("")
    if chosen == "compact":
        line = F.when(F.col("label") != "File", F.concat(indent, text.short_signature(signature)))
    else:
        line = F.when(F.col("label") == "File", signature).otherwise(F.concat(indent, signature, F.lit("  # "), "qualified_name"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("start_line", "qualified_name", line.alias("line")))), lambda x: x.line)
    by_file = shown.groupBy("file_path").agg(lines.alias("lines"), F.bool_or(F.col("label") != "File").alias("defined"))
    if chosen == "skeleton":
        by_file = by_file.join(imports_line(files).select("file_path", F.col("line").alias("imported")), "file_path", "left")
    else:
        by_file = by_file.withColumn("imported", F.lit(None).cast("string"))
    return by_file.select("file_path", F.concat_ws("\n", F.concat(F.lit("\n### "), "file_path"), F.when(F.col("defined"), F.col("imported")), F.nullif(F.array_join("lines", "\n"), F.lit(""))).alias("block"))
