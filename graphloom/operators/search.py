"""Full-text search: postings, boolean queries, BM25 and pages."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import folded_word, terms
from graphloom.storage import cut_lineage

# BM25's saturation and length normalisation, and the least inverse frequency.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: A place in a stored index is the column's number times this, and the term's number in the column.
COLUMN = 1 << 28


class QueryError(ValueError):
    """The query text has no valid form."""


def indexed(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``docs`` with ``words``, the terms of all columns in order; a null between columns keeps phrases apart."""
    parts = [F.concat(terms(F.coalesce(F.col(c), F.lit(""))), F.array(F.lit(None).cast("string"))) for c in columns]
    return docs.withColumn("words", F.concat(*parts))


def phrase_count(words: Column, phrase: list[str]) -> Column:
    """How often the terms stand one after another; the last may be a prefix (``w*``)."""
    fit = lambda w, t: F.coalesce(w.startswith(t[:-1]) if t.endswith("*") else w == t, F.lit(False))
    if not phrase:
        return F.lit(0)
    if len(phrase) == 1:
        return F.size(F.filter(words, lambda w: fit(w, phrase[0])))
    if not phrase[-1].endswith("*"):  # on the joined terms, once for a row; occurrences that overlap count as one
        joined = F.concat(F.lit(" "), F.array_join(words, "  ", "|"), F.lit(" "))
        sought = " " + "  ".join(phrase) + " "
        return ((F.char_length(joined) - F.char_length(F.replace(joined, F.lit(sought), F.lit("")))) / len(sought)).cast("int")
    starts = F.sequence(F.lit(0), F.size(words) - 1)
    hit = lambda i: reduce(lambda a, b: a & b, [fit(F.get(words, i + k), t) for k, t in enumerate(phrase)])
    return F.when(F.size(words) < 1, 0).otherwise(F.size(F.filter(starts, hit)))


def parse(query: str) -> tuple:
    """The tree of a query, of ('term', words, columns) and ('and' | 'or' | 'not', left, right).

    Words side by side mean AND and bind closest, then NOT, AND, OR.  ``a + b``
    is a phrase like ``"a b"``; ``^a`` stands first in its column (its words begin
    with ``^``); ``name: a``, ``{name path}: (a OR b)`` and ``-name: a`` look in these
    columns, or in all but these; columns is None or (names, whether they are left out).  ``NEAR(a "b c", 5)`` is
    ('near', terms, 5): all of them with no more than five words (ten, if no number
    is given) between the end of the first and the start of the last.
    """
    found = re.findall(r'"[^"]*"|[():^+{},-]|[^\s():^+{},"-]+', query)
    if sum(c == '"' for c in query) % 2 or not found:
        raise QueryError(query)
    at = 0

    def peek(ahead: int = 0) -> str | None:
        return found[at + ahead] if at + ahead < len(found) else None

    def take(wanted: str | None = None) -> str:
        nonlocal at
        token = peek()
        if token is None or (wanted is not None and token != wanted):
            raise QueryError(query)
        at += 1
        return token

    def name() -> str:
        token = take()
        if not re.fullmatch(r"\w+", token):
            raise QueryError(query)
        return token.lower()

    def names() -> tuple | None:
        """The columns named in front of a colon, if there are any."""
        if peek() not in ("-", "{") and peek(1) != ":":
            return None
        without = peek() == "-" and bool(take())
        chosen = [name()] if peek() != "{" else []
        if not chosen:
            take("{")
            while peek() != "}":
                chosen.append(name())
            take("}")
        take(":")
        return tuple(chosen), without

    def words() -> list[str]:
        token = take()
        if token[0] == '"':
            some = re.findall(r"[^\W_]+", folded_word(token))
            return [*some[:-1], some[-1] + "*"] if some and peek() == "*" and take() else some
        if token in ("AND", "OR", "NOT") or not re.fullmatch(r"[^\W_]+(_[^\W_]+)*\*?", token):
            raise QueryError(query)
        return [w for w in folded_word(token).split("_") if w]

    def primary(columns: tuple | None) -> tuple:
        columns = names() or columns
        if peek() == "(":
            take()
            inner = either(columns)
            take(")")
            return inner
        if peek() == "NEAR" and peek(1) == "(":
            return near(columns)
        return phrase(columns)

    def near(columns: tuple | None) -> tuple:
        take("NEAR")
        take("(")
        inner, most = [phrase(columns)], "10"
        while peek() not in (")", ","):
            inner.append(phrase(columns))
        if peek() == ",":
            take()
            most = take()
        take(")")
        if not re.fullmatch("[0-9]{1,9}", most):
            raise QueryError(query)
        return ("near", inner, int(most)) if len(inner) > 1 else inner[0]

    def phrase(columns: tuple | None) -> tuple:
        first = peek() == "^" and bool(take())
        joined = words()
        while peek() == "+":
            take()
            joined = joined + words()
        return ("term", ["^" + joined[0], *joined[1:]] if first and joined else joined, columns)

    def row(columns: tuple | None) -> tuple:
        left = primary(columns)
        while peek() not in (None, ")", "AND", "OR", "NOT"):
            left = ("and", left, primary(columns))
        return left

    def chain(word: str, part):
        def parsed(columns: tuple | None) -> tuple:
            left = part(columns)
            while peek() == word:
                take()
                left = (word.lower(), left, part(columns))
            return left

        return parsed

    either = chain("OR", chain("AND", chain("NOT", row)))
    tree = either(None)
    if at != len(found):
        raise QueryError(query)
    return tree


def matches(words: Column, tree: tuple) -> Column:
    """Whether the terms of a table without an index match; columns, first places and NEAR are for stored indexes."""
    if tree[0] == "near":
        raise QueryError("NEAR needs a stored index")
    if tree[0] == "term":
        if tree[2] or (tree[1] and tree[1][0].startswith("^")):
            raise QueryError("columns need a stored index")
        return phrase_count(words, tree[1]) > 0
    a, b = matches(words, tree[1]), matches(words, tree[2])
    return a & b if tree[0] == "and" else a | b if tree[0] == "or" else a & ~b


def leaves(tree: tuple, scored: bool = False) -> list[tuple]:
    """The phrases of a query, or those that count for the rank: not what is behind a NOT."""
    if tree[0] in ("term", "near"):
        return [tree] if tree[0] == "term" else list(tree[1])
    return leaves(tree[1], scored) + ([] if scored and tree[0] == "not" else leaves(tree[2], scored))


def groups(tree: tuple) -> list[tuple]:
    """The NEAR groups of a query."""
    return [tree] if tree[0] == "near" else [] if tree[0] == "term" else groups(tree[1]) + groups(tree[2])


def scored_terms(tree: tuple) -> list[list[str]]:
    return [leaf[1] for leaf in leaves(tree, True)]


def bm25(frequencies: list[Column], documents: list[Column], length: Column, n: Column, mean: Column) -> Column:
    """The rank of a row by how often it has each phrase, and how many rows have it; lower is better."""
    score = F.lit(0.0)
    for f, d in zip(frequencies, documents, strict=True):
        idf = F.log((n - d + 0.5) / (d + 0.5))
        score = score - F.greatest(idf, F.lit(LEAST_IDF)) * f * (K1 + 1) / (f + K1 * (1 - B + B * length / mean))
    return score


def ranked(docs: DataFrame, query: str, keep: Column | None = None) -> DataFrame:
    """Matching rows of an ``indexed`` table with ``score`` by BM25, lower being better.

    Frequencies and lengths are of all rows, whatever ``keep`` leaves.  Texts are looked
    through once; their counts, a few numbers a row, are kept in the shared folder for the scores.
    """
    tree = parse(query)
    phrases = scored_terms(tree)
    own = [c for c in docs.columns if c != "words"]
    length = F.size(F.filter("words", lambda w: w.isNotNull()))
    hit = matches(F.col("words"), tree) & (F.lit(True) if keep is None else keep)
    frequencies = [phrase_count(F.col("words"), p).alias(f"_f{k}") for k, p in enumerate(phrases)]
    shown = [F.when(F.col("_hit"), F.col(c)).alias(c) for c in own]  # of rows that do not match nothing but the counts
    counted = cut_lineage(docs.select(*own, length.alias("_length"), hit.alias("_hit"), *frequencies).select(*shown, "_length", "_hit", *(f"_f{k}" for k in range(len(phrases)))))
    facts = counted.agg(F.count("*").alias("n"), F.avg("_length").alias("mean"), *(F.sum((F.col(f"_f{k}") > 0).cast("long")).alias(f"d{k}") for k in range(len(phrases))))  # one row
    both = counted.where("_hit").crossJoin(F.broadcast(facts))
    score = bm25([F.col(f"_f{k}") for k in range(len(phrases))], [F.col(f"d{k}") for k in range(len(phrases))], F.col("_length"), F.col("n"), F.col("mean"))
    return both.select(*own, score.alias("score"))


def postings(docs: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(term, key, length, places): where each term of a row stands, and how many terms the row has.

    The empty term stands in every row, so that rows and lengths can be summed from
    its postings alone.  A null column has no terms.
    """

    def placed(column: str, k: int) -> Column:
        return F.transform(terms(F.coalesce(F.col(column), F.lit(""))), lambda w, i: F.struct(w.alias("term"), (i + k * COLUMN).alias("place")))

    parts = [placed(c, k) for k, c in enumerate(columns)]
    rows = docs.select(key, F.concat(*parts, F.array(F.struct(F.lit("").alias("term"), F.lit(0).alias("place")))).alias("w"))
    each = rows.select(key, (F.size("w") - 1).alias("length"), F.inline("w"))
    return each.groupBy("term", key, "length").agg(F.sort_array(F.collect_list("place")).alias("places"))


def in_order(rows: DataFrame, key: str) -> DataFrame:
    """Postings dealt by ranges of (term, key) and sorted, so that files and row groups tell their terms; a term that all rows have is many tasks' work."""
    return rows.repartitionByRange("term", key).sortWithinPartitions("term", key)


def together_within(rows: DataFrame, key: str, members: list[tuple[str, int, str]], most: int) -> DataFrame:
    """(key, a count for each member): how many of the places of each stand in a stretch that has all of them.

    Members are (column of places, words, name of the count).  A stretch ends where a member begins, and is
    whole there if of each member a place before it ends no more than ``most`` words ahead.  One pass
    forwards tells such ends, one pass backwards the nearest of them for each place; both are linear.
    """

    def marked(column: str, k: int, n: int) -> Column:
        return F.transform(column, lambda x: F.struct(x.alias("at"), F.lit(k).alias("k"), F.lit(n).alias("n")))

    each = rows.select(F.col(key).alias("row"), F.inline(F.concat(*(marked(c, k, n) for k, (c, n, _) in enumerate(members)))))
    ahead = Window.partitionBy("row").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    behind = Window.partitionBy("row").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    whole = reduce(lambda a, b: a & b, [F.coalesce(F.max(F.when(F.col("k") == k, F.col("at") + F.col("n"))).over(ahead) >= F.col("at") - most, F.lit(False)) for k in range(len(members))])
    ends = each.withColumn("whole", whole).withColumn("end", F.min(F.when(F.col("whole"), F.col("at"))).over(behind))
    return ends.where(F.col("end") <= F.col("at") + F.col("n") + most).groupBy(F.col("row").alias(key)).agg(*(F.count(F.when(F.col("k") == k, 1)).alias(name) for k, (_, _, name) in enumerate(members)))


def looked_up(index: DataFrame, key: str, query: str, columns: list[str]) -> DataFrame:
    """(key, score) of the rows that match, from their postings; only those of the query's terms are read."""
    tree = parse(query)
    every = leaves(tree)
    wanted = sorted({w.lstrip("^") for leaf in every for w in leaf[1]})
    number = {w: k for k, w in enumerate(wanted)}
    fits = [F.col("term").startswith(w[:-1]) if w.endswith("*") else F.col("term") == w for w in wanted]
    totals = index.where("term = ''").agg(F.count("*").alias("n"), F.avg("length").alias("mean"))  # one row
    asked = index.where(reduce(lambda a, b: a | b, fits, F.lit(False)))
    rows = asked.groupBy(key).agg(F.max("length").alias("length"), *(F.flatten(F.collect_list(F.when(f, F.col("places")))).alias(f"p{k}") for k, f in enumerate(fits)))

    def place(part: tuple) -> int:
        return next(k for k, leaf in enumerate(every) if leaf is part)

    def back(word: str, k: int) -> Column:
        return F.transform(f"p{number[word.lstrip('^')]}", lambda x: x - k)

    def starts(leaf: tuple) -> Column:
        _, phrase, chosen = leaf
        if not phrase:
            return F.array().cast("array<int>")
        found = reduce(F.array_intersect, [back(w, k) for k, w in enumerate(phrase)])
        if phrase[0].startswith("^"):
            found = F.filter(found, lambda x: x % COLUMN == 0)
        if chosen:
            if unknown := set(chosen[0]) - set(columns):
                raise QueryError(f"no such column: {', '.join(sorted(unknown))}")
            some = [k for k, c in enumerate(columns) if (c in chosen[0]) != chosen[1]]
            found = F.filter(found, lambda x: F.floor(x / COLUMN).isin(some))
        return found

    def holds(part: tuple) -> Column:
        if part[0] in ("term", "near"):
            return F.col(f"f{place(part if part[0] == 'term' else part[1][0])}") > 0
        a, b = holds(part[1]), holds(part[2])
        return a & b if part[0] == "and" else a | b if part[0] == "or" else a & ~b

    grouped = {place(leaf): group for group in groups(tree) for leaf in group[1]}
    counts = rows.select(key, "length", *((starts(leaf).alias(f"s{k}") if k in grouped else F.size(starts(leaf)).alias(f"f{k}")) for k, leaf in enumerate(every)))
    for group in groups(tree):
        members = [(f"s{k}", len(every[k][1]), f"f{k}") for k in map(place, group[1])]
        full = counts.where(reduce(lambda a, b: a & b, [F.size(c) > 0 for c, _, _ in members]))
        counts = counts.join(together_within(full, key, members, group[2]), key, "left")
    counted = cut_lineage(counts.select(key, "length", *(F.coalesce(F.col(f"f{k}"), F.lit(0)).alias(f"f{k}") for k in range(len(every)))))
    scored = [place(leaf) for leaf in leaves(tree, True)]
    facts = counted.agg(*(F.sum((F.col(f"f{k}") > 0).cast("long")).alias(f"d{k}") for k in scored)).crossJoin(totals)  # one row
    hits = counted.where(holds(tree)).crossJoin(F.broadcast(facts))
    return hits.select(key, bm25([F.col(f"f{k}") for k in scored], [F.col(f"d{k}") for k in scored], F.col("length"), F.col("n"), F.col("mean")).alias("score"))


def page(rows: DataFrame, order: list[Column], limit: int = 20, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """A page of the rows, and the number of all (one row)."""
    return rows.orderBy(*order).offset(offset).limit(limit), rows.agg(F.count("*").alias("total"))
