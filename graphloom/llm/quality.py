"""Quality classifier: gradient-boosted trees over statistics of a document.

Every text is reduced to ``FEATURES`` in one pass.  The trees are grown in
numpy from histograms of binned statistics, on labelled rows outside the
held-out fold, and are flattened into arrays (feature, threshold, leaf value),
through which all rows of a batch descend together, one level at a time.

Fitting reads at most about ``most_rows`` labelled ids, chosen by a hash of their id
(the documented bound); everything else reads all rows.  An id that
several documents have is learnt from once, from the smallest statistics.

Nulls: a null text counts as empty; an empty text has statistics of zero and a
score like any other.  Labels that are null are left out; several labels of a
document count as their mean, 0.5 and more being 1.  A null doc_id is not in
the held-out fold and has no label.  Without any label every score is 0.5.
Repeated rows give repeated results; an empty table gives an empty one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import importable, slices

FEATURES = (
    "bytes", "words", "lines", "word_bytes", "upper", "digit", "exclaim", "stop", "comma", "bar", "symbol", "quote", "other_mark", "blank",
    "not_ascii", "types", "top_word", "same_next", "pair_types", "short_words", "long_words", "longest_word", "words_a_line", "line_types", "top_line", "ended_lines", "short_lines", "marked_words",
)
SYMBOLS, QUOTES = b"#$%&*@^~", b"\"'`"
OTHER_MARKS = bytes(set(range(33, 127)) - set(b"!.,|0123456789" + SYMBOLS + QUOTES) - set(range(65, 91)) - set(range(97, 123)))
MARKS = tuple(bytes([m]) for m in SYMBOLS + b"!|")


def statistics(text: str) -> list[float]:
    raw = text.encode()
    words = raw.split()
    n, w = len(raw), len(words)
    if not w:
        return [0.0] * len(FEATURES)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    of = lambda chars: float(count[list(chars)].sum()) / n
    sizes = np.fromiter(map(len, words), np.int64, w)
    seen = Counter(words)
    lines = [x for x in (x.strip() for x in raw.split(b"\n")) if x]
    same = Counter(lines)
    most = same.most_common(1)[0][0]
    return [
        np.log1p(n), np.log1p(w), np.log1p(len(lines)), float(sizes.mean()),
        float(count[65:91].sum()) / max(1.0, float(count[65:91].sum() + count[97:123].sum())),
        of(range(48, 58)), of(b"!"), of(b"."), of(b","), of(b"|"), of(SYMBOLS), of(QUOTES), of(OTHER_MARKS), of(b" \t\n"), float(count[128:].sum()) / n,
        len(seen) / w, max(seen.values()) / w, sum(map(eq, words, words[1:])) / w, len(set(zip(words, words[1:]))) / max(1, w - 1),
        float((sizes <= 3).mean()), float((sizes > 12).mean()), float(sizes.max()),
        w / len(lines), len(same) / len(lines), len(most) * same[most] / n,
        sum(x.endswith((b".", b"!", b"?", b'"')) for x in lines) / len(lines), sum(len(x) < 30 for x in lines) / len(lines), sum(x.endswith(MARKS) for x in words) / w,
    ]


@dataclass
class Trees:
    """Complete trees of one depth: feature and threshold of each inner node, value of each leaf."""

    depth: int
    start: float
    feature: np.ndarray  # (trees, 2**depth - 1)
    threshold: np.ndarray
    leaf: np.ndarray  # (trees, 2**depth)

    def margin(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.full(len(x), self.start)
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > threshold[at])
            total += leaf[at - len(feature)]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least_weight: float = 5.0) -> Trees:
    """Boosted trees for log loss; splits are sought over histograms of ``bins`` bins a feature."""
    n, f = x.shape
    inner = 2**depth - 1
    none = Trees(depth, 0.0, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if not n:
        return none
    p = np.clip(y.mean(), 0.01, 0.99)
    none.start = float(np.log(p / (1 - p)))
    if y.min() == y.max():
        return none
    edges = np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1], axis=0).T  # (f, bins - 1)
    binned = np.stack([np.searchsorted(edges[k], x[:, k], side="left") for k in range(f)], axis=1)
    cell = binned + np.arange(f) * bins
    margin = np.full(n, none.start)
    features, thresholds, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        at, feature, split = np.zeros(n, np.int64), np.zeros(inner, np.int64), np.full(inner, bins)
        for level in range(depth):
            base, nodes = 2**level - 1, 2**level
            key = ((at - base)[:, None] * (f * bins) + cell).ravel()
            g, h = (np.bincount(key, np.repeat(v, f), nodes * f * bins).reshape(nodes, f, bins).cumsum(axis=2) for v in (grad, hess))
            g_all, h_all = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + l2) + (g_all - g) ** 2 / (h_all - h + l2) - g_all**2 / (h_all + l2)
            gain[(h < least_weight) | (h_all - h < least_weight)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            found = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9
            feature[base : base + nodes] = np.where(found, best // bins, 0)
            split[base : base + nodes] = np.where(found, best % bins, bins)  # beyond all bins: all go left
            at = 2 * at + 1 + (binned[np.arange(n), feature[at]] > split[at])
        leaf = at - inner
        value = -rate * np.bincount(leaf, grad, inner + 1) / (np.bincount(leaf, hess, inner + 1) + l2)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(np.where(split >= bins - 1, np.inf, edges[feature, np.minimum(split, bins - 2)]))
        leaves.append(value)
    return Trees(depth, none.start, np.array(features), np.array(thresholds), np.array(leaves))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def with_statistics(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``statistics`` array<double> of every row."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, len(keep)):
            x = np.array([statistics(t) for t in batch.column(len(keep)).to_pylist()])
            found = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), found], names=[*keep, "statistics"])

    schema = docs.select(*keep).schema.add("statistics", T.ArrayType(T.DoubleType()))
    return docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(run, schema)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", id_col: str = "doc_id", most_rows: int = 30_000) -> Trees:
    """Fit trees to the statistics of about ``most_rows`` labelled rows outside the held-out fold; only these rows' texts are read for it."""
    known = (
        labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
        .groupBy(F.col(id_col).alias("id"))
        .agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    )
    n = known.count()
    share = min(1.0, most_rows / max(1, n))
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))  # about most_rows of them
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id")
    once = with_statistics(texts, "text", ("id", "y")).groupBy("id", "y").agg(F.min("statistics").alias("statistics"))  # however often an id stands in docs
    rows = once.select("statistics", "y", F.xxhash64("id").alias("h")).toArrow()
    rows = rows.sort_by([("h", "ascending"), ("y", "ascending")])
    x = rows.column("statistics").combine_chunks().values.to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)) if len(rows) else np.zeros((0, len(FEATURES)))
    order = np.lexsort((*x.T, rows.column("h").to_numpy())) if len(rows) else slice(0)
    return fit(x[order], rows.column("y").to_numpy().astype(float)[order])


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", id_col: str = "doc_id", most_rows: int = 30_000) -> DataFrame:
    """id, held_out, score (of label 1) and predicted of every document."""
    trees = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, text, id_col, most_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            x = np.array([statistics(t or "") for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(trees.value.score(x))], names=["id", "score"])

    every = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    schema = every.select("id").schema.add("score", "double")
    return every.mapInArrow(run, schema).select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", id_col: str = "doc_id", least: float = 0.5, most_rows: int = 30_000) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least ``least``; the score is computed where the row is, without a join."""
    trees = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, text, id_col, most_rows))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            x = np.array([statistics(t or "") for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(trees.value.score(x) >= least))

    return docs.mapInArrow(run, docs.schema)
