"""Exact top-k search by inner product over a pivot-distance index.

Vectors are integers.  With M the largest norm, x -> (x, sqrt(M^2 - |x|^2))
puts all of them on one sphere, where d(q, x)^2 = |q|^2 + M^2 - 2 q.x for a query (q, 0): the
highest inner products are the nearest neighbours, and distances obey the
triangle inequality.  The index keys each vector by its nearest pivot and its
distance to it, sorted, in blocks of ``block_rows`` (annuli).  No vector of an annulus [a, b]
around pivot p can be nearer to q than the gap between d(q, p) and
[a, b]; a query expands annuli in order of that gap and stops at the first
whose gap exceeds its k-th best distance so far.

Queries are sorted by pivot and distance, too, and cut into blocks of ``query_rows``;
``slice_blocks`` annuli that follow each other are a slice.  A
bounded, documented number of vectors (``sample_rows``) gives each query a
first bound; it is one any k candidates give, so the result stays exact.  For each
pivot a block knows the range of its queries' distances, and the farthest of their
bounds: pairs of block and slice whose annuli all lie beyond it are dropped
by these few numbers alone, before any vector moves.  Of the pairs that stay the
blocks are sent to the slices, which stay where they are; a pair returns k
rows a query at most, and the best k of all slices are the result.  Pivots are drawn
from the same sample.  All rows are indexed.

How much is pruned depends on the data: where few dimensions or tight clusters
spread the distances, most pairs go; among vectors of many independent
dimensions all distances are alike, the bounds hold nothing back, and every pair is computed.

Scores are exact: products are summed in double precision where no sum can
leave 2**53, else as Python integers; those beyond 64 bits are held at the
largest or smallest 64-bit integer.

Nulls: vectors that are null, empty or hold null or non-finite components take no part,
nor do rows whose id is null.  Of rows with one id the smallest vector (in
Spark's order of arrays) counts.  Vectors shorter than the
longest count as if filled up with zeros.  Ties go to the smaller id.  With
fewer than k other vectors all are returned; an empty table gives an empty one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import few_rows_a_batch, importable, written

#: An annulus: its pivot, least and greatest distance, and number of vectors.
CELLS = pa.list_(pa.struct([("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("n", pa.int32())]))
#: Distances are computed in floating point; bounds give way by this share of the sphere's size.
SLACK = 1e-9


def usable(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, v): one row an id, v array<double> of finite components."""
    v = F.col(vector).cast("array<double>")
    fine = v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & fine).select(F.col(id_col).cast("long").alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The lists of a column as rows, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes])] = flat
    return out


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer-valued rows, as 64-bit integers."""
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * q.shape[1] < 2.0**53:
        return (q @ x.T).astype(np.int64)
    exact = np.array([[int(c) for c in r] for r in q], object) @ np.array([[int(c) for c in r] for r in x], object).T
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, smaller ids first among equals."""
    return np.lexsort((ids, -scores))[:k]


def lifted(x: np.ndarray, radius: float) -> np.ndarray:
    return np.column_stack((x, np.sqrt(np.maximum(0.0, radius**2 - (x * x).sum(axis=1)))))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * a @ b.T))


class Search:
    """One query block's running result, and its expansion of annuli."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, pivots: np.ndarray, radius: float, floor: np.ndarray):
        self.ids, self.q, self.k, self.radius = ids, q, k, radius
        self.to_pivots = distances(np.column_stack((q, np.zeros(len(q)))), pivots)
        self.square = (q * q).sum(axis=1)
        self.floor = floor.copy()  # a score that k candidates are known to reach; -inf if none
        self.found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in ids]

    def bound(self) -> np.ndarray:
        """Distances beyond which nothing can enter the result."""
        with np.errstate(invalid="ignore"):
            return np.sqrt(np.maximum(0.0, self.square + self.radius**2 - 2 * self.floor)) + SLACK * (self.radius + np.sqrt(self.square))

    def expand(self, annuli: list[tuple[int, float, float, np.ndarray, np.ndarray]]) -> int:
        """Search annuli (pivot, least, most, ids, vectors); returns the number of query-annulus pairs computed."""
        gaps = np.stack([np.maximum(0.0, np.maximum(low - self.to_pivots[:, p], self.to_pivots[:, p] - high)) for p, low, high, _, _ in annuli], axis=1)
        order, work = np.argsort(gaps, axis=1, kind="stable"), 0
        active = np.arange(len(self.ids))
        for rank in range(len(annuli)):
            turn = order[active, rank]
            active = active[gaps[active, turn] <= self.bound()[active]]  # later gaps are no smaller: the others stop here
            if not len(active):
                break
            turn = order[active, rank]
            for a in np.unique(turn).tolist():
                rows = active[turn == a]
                _, _, _, ids, x = annuli[a]
                scores = products(self.q[rows], x)
                work += len(rows)
                for row, s in zip(rows.tolist(), scores, strict=True):
                    ok = np.flatnonzero((s >= self.floor[row]) & (ids != self.ids[row]))
                    if len(ok):
                        self.add(row, s[ok], ids[ok])
        return work

    def add(self, row: int, scores: np.ndarray, ids: np.ndarray) -> None:
        held = [*self.found[row], (scores, ids)]
        scores, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        top = best(scores, ids, self.k)
        self.found[row] = [(scores[top], ids[top])]
        if len(top) == self.k:
            self.floor[row] = max(self.floor[row], scores[top[-1]])


def search(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector: str = "embedding", pivots: int = 64, sample_rows: int = 2048, block_rows: int = 1024, slice_blocks: int = 24, query_rows: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other vectors of each row that ``is_query``, over the column id, picks.

    Components are floor(scale * x).
    """
    spark = vectors.sparkSession
    importable(spark)
    whole = usable(vectors, id_col, vector).select("id", F.transform("v", lambda x: F.floor(F.lit(scale) * x).cast("double")).alias("v"))
    rows = written(whole.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))), "vectors")
    facts = rows.agg(F.max("norm").alias("norm"), F.max(F.size("v")).alias("width"), F.count("*").alias("n")).first()
    result = "query_id long, rank int, vec_id long, score long"
    if not facts["n"]:
        return spark.createDataFrame([], result)
    radius, width = facts["norm"] * (1 + 1e-12), facts["width"]
    block_rows, query_rows = (min(n, max(1, (8 << 20) // (8 * width))) for n in (block_rows, query_rows))  # 8 MB at most
    slice_blocks = min(slice_blocks, max(1, (16 << 20) // (8 * width * block_rows)))
    share = min(1.0, sample_rows / facts["n"])  # about sample_rows
    sample = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("id", "v").toArrow().sort_by("id")
    sample_ids, sample_x = sample.column("id").to_numpy(), matrix(sample.column("v"), width) if len(sample) else np.zeros((0, width))
    centers = choose_pivots(lifted(sample_x, radius), pivots) if len(sample) else np.zeros((1, width + 1))
    shared = spark.sparkContext.broadcast((centers, sample_ids, sample_x))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = shared.value[0]
        for batch in batches:
            if batch.num_rows:
                d = distances(lifted(matrix(batch.column(1), width), radius), centers)
                p = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.astype(np.int32)), pa.array(d[np.arange(len(p)), p])], names=["id", "v", "pivot", "distance"])

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Slices of a sorted partition: annuli, cut where the pivot changes, and the vectors one after another."""
        held: list[tuple] = []

        def packed() -> pa.RecordBatch:
            cells = [{"pivot": h[0], "low": h[1], "high": h[2], "n": len(h[3])} for h in held]
            row = ([cells], [b"".join(h[3].astype("<i8").tobytes() for h in held)], [b"".join(h[4].astype("<f8").tobytes() for h in held)])
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (CELLS, pa.binary(), pa.binary()), strict=True)], names=["annuli", "ids", "x"])

        for batch in batches:
            if not batch.num_rows:
                continue
            p, d, x, ids = batch.column(2).to_numpy(), batch.column(3).to_numpy(), matrix(batch.column(1), width), batch.column(0).to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(p)) + 1).tolist(), len(p)]
            for a, z in itertools.pairwise(cut):
                for b in range(a, z, block_rows):
                    e = min(z, b + block_rows)
                    held.append((int(p[b]), float(d[b]), float(d[e - 1]), ids[b:e], x[b:e]))
                    if len(held) == slice_blocks:
                        yield packed()
        if held:
            yield packed()

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of sorted queries: ids, vectors, first bounds, the range of distances to each pivot and the farthest bound."""
        centers, sample_ids, sample_x = shared.value
        for batch in batches:
            for b in range(0, batch.num_rows, query_rows):
                part = batch.slice(b, query_rows)
                ids, q = part.column(0).to_numpy(), matrix(part.column(1), width)
                floor = np.full(len(ids), -np.inf)
                if len(sample_ids) > k:
                    s = products(q, sample_x).astype(float)
                    s[ids[:, None] == sample_ids] = -np.inf
                    floor = np.partition(s, -k, axis=1)[:, -k]
                own = Search(ids, q, k, centers, radius, floor)
                row = ([ids.astype("<i8").tobytes()], [q.astype("<f8").tobytes()], [floor.tobytes()], [own.to_pivots.min(axis=0).tolist()], [own.to_pivots.max(axis=0).tolist()], [float(own.bound().max())])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, (pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.float64()), strict=True)], names=["q_ids", "q", "floor", "least", "most", "bound"])

    order = ["pivot", "distance", "id"]
    cells = "array<struct<pivot: int, low: double, high: double, n: int>>"
    placed = lambda chosen: chosen.select("id", "v").mapInArrow(keyed, "id long, v array<double>, pivot int, distance double").repartitionByRange(*order).sortWithinPartitions(*order)
    index = written(placed(rows).mapInArrow(sliced, f"annuli {cells}, ids binary, x binary").withColumn("slice", F.monotonically_increasing_id()), "slices")
    asked = written(placed(rows.where(is_query)).mapInArrow(blocked, "q_ids binary, q binary, floor binary, least array<double>, most array<double>, bound double").withColumn("block", F.monotonically_increasing_id()), "queries")
    near = near_pairs(asked.select("block", "least", "most", "bound"), index.select("slice", "annuli"))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = shared.value[0]
        for batch in batches:
            for r in range(batch.num_rows):
                q_ids, q, floor, annuli, ids, x = (batch.column(c)[r] for c in range(6))
                q_ids, floor, ids = (np.frombuffer(c.as_buffer(), t) for c, t in ((q_ids, "<i8"), (floor, "<f8"), (ids, "<i8")))
                q, x = (np.frombuffer(c.as_buffer(), "<f8").reshape(-1, width) for c in (q, x))
                held, at = [], 0
                for c in annuli.as_py():
                    held.append((c["pivot"], c["low"], c["high"], ids[at : at + c["n"]], x[at : at + c["n"]]))
                    at += c["n"]
                run = Search(q_ids, q, k, centers, radius, floor)
                run.expand(held)
                out = [(np.full(len(others), query), others, scores) for query, found in zip(q_ids.tolist(), run.found, strict=True) for scores, others in found]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    sent = near.join(asked.select("block", "q_ids", "q", "floor"), "block").join(index, "slice")
    with few_rows_a_batch(spark, 4):  # rows hold a block and a slice
        partial = written(sent.select("q_ids", "q", "floor", "annuli", "ids", "x").mapInArrow(answer, "query_id long, vec_id long, score long"), "partial")
    # k rows of each slice at most; each query's are merged
    top = partial.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id", "score"))), 1, k).alias("top"))
    return top.select("query_id", F.posexplode("top").alias("at", "t")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), F.col("t.score").alias("score"))


def near_pairs(blocks: DataFrame, slices: DataFrame, spread: int = 64) -> DataFrame:
    """(block, slice) of each block of queries and each slice with an annulus that a query's bound may reach.

    Of a block only the ranges of distances are compared.  Slices are dealt by a hash
    and blocks sent to each hash, so that the comparison has ``spread`` parts.
    """
    dealt = slices.withColumn("part", F.pmod(F.xxhash64("slice"), F.lit(spread)))
    every = blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(spread - 1).cast("long"))))
    reach = F.exists("annuli", lambda a: (a.low - F.get("most", a.pivot) <= F.col("bound")) & (F.get("least", a.pivot) - a.high <= F.col("bound")))
    return every.join(dealt, "part").where(reach).select("block", "slice")


def choose_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """Points of x far from each other: each next one is the farthest from those chosen."""
    chosen = [0]
    d = distances(x, x[:1])[:, 0]
    while len(chosen) < min(n, len(x)) and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, distances(x, x[chosen[-1] :][:1])[:, 0])
    return x[chosen]
