"""Sizes, lines and signatures of source texts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits in bytes, characters and lines.
STORED_BYTES, FILE_BYTES, SHOWN_BYTES = 524_288, 2_097_152, 32_768
LONG_LINE, LINES_LOOKED_AT = 5_000, 10
TRUNCATED = "\n# [truncated: file exceeded 512 KB]\n"
CHARS_A_TOKEN = 4
BREAKS = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def line_count(text: Column) -> Column:
    """Newlines, and one more for a last line without."""
    newlines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    return newlines + F.when((text != "") & ~text.endswith("\n"), 1).otherwise(0)


def split_lines(text: Column) -> Column:
    """Lines at any line break; a break at the end starts no further line."""
    lines = F.split(text, BREAKS, -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def tokens(text: Column) -> Column:
    return F.floor(F.char_length(text) / CHARS_A_TOKEN)


def minified(text: Column) -> Column:
    return F.exists(F.slice(split_lines(text), 1, LINES_LOOKED_AT), lambda x: F.char_length(x) > LONG_LINE)


def short_signature(signature: Column, most: int = 80) -> Column:
    """Cut before the last comma or blank among the 20 characters up to the one behind the limit's, else at the limit, with dots."""
    cut = most - 3
    tail = F.substring(signature, cut - 18, 20)  # the characters at cut - 19 to cut, from zero
    behind = F.char_length(F.regexp_extract(tail, "([^, ]*)$", 1))
    at = F.when(behind < 20, cut - behind).otherwise(cut)
    return F.when(F.char_length(signature) <= most, signature).otherwise(F.concat(F.substr(signature, F.lit(1), at), F.lit("...")))


def fitted_name(name: Column, width: int) -> Column:
    return F.when(F.char_length(name) <= width, F.rpad(name, width, " ")).otherwise(F.concat(F.lit("..."), F.right(name, F.lit(width - 3))))


def last_components(name: Column, n: int = 2) -> Column:
    parts = F.split(name, r"\.")
    return F.when(F.size(parts) > n, F.array_join(F.slice(parts, -n, n), ".")).otherwise(name)


# Letters with marks, and what they are without.
MARKED = "àáâãäåāăąçćĉċčďèéêëēĕėęěĝğġģĥìíîïĩīĭįĵķĺļľñńņňòóôõöōŏőŕŗřśŝşšţťùúûüũūŭůűųŵýÿŷźżžǎǐǒǔșțạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹơư"
PLAIN = "aaaaaaaaacccccdeeeeeeeeegggghiiiiiiiijklllnnnnoooooooorrrssssttuuuuuuuuuuwyyyzzzaioustaaaaaaaaaaaaeeeeeeeeiioooooooooooouuuuuuuyyyyou"


COMBINING = "".join(map(chr, range(0x300, 0x370)))  # marks that stand behind their letter


def folded(text: Column) -> Column:
    """Lower case, marks of Latin letters removed, be they part of a letter or behind it."""
    low = F.lower(text)
    return F.when(F.octet_length(text) == F.char_length(text), low).otherwise(F.translate(low, MARKED + COMBINING, PLAIN))


def folded_word(word: str) -> str:
    """The same of one word, as queries have it."""
    return word.lower().translate(str.maketrans(MARKED, PLAIN, COMBINING))


def terms(text: Column) -> Column:
    """Runs of letters and digits, folded."""
    return F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
