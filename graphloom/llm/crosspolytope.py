"""Embedding near-dedup with cross-polytope hashing after fast Hadamard rotations.

In each of ``tables`` tables a unit vector is rotated ``hashes`` times at random
(three rounds of random signs and a fast Hadamard transform); a hash is the
axis, with its sign, that the rotated vector lies nearest to.  Their
combination names a bucket; the ``probes`` best combinations are used.  Vectors that share
any bucket are candidates, and every candidate pair's cosine is verified in
double precision: no link is below the threshold; a link may be missed with a small
chance (over 99 % are found at cosine 0.95).

Equal vectors are one class and hashed once.  Buckets of a single class are
dropped before any vector is moved.  A bucket of more than ``block_rows`` is
cut into blocks by a hash, and all pairs of its blocks are compared: bounded
tasks, and nothing is left out.  A pair met in several buckets counts in the
first of them only, which each task tells from the two vectors' bucket lists;
so links are counted without writing pairs.  Each group yields counts and a spanning
forest of its links, for the components.

Nulls: vectors that are null, empty, zero, or hold null or non-finite components
link with nothing and are their own component.  Rows with a null id take no
part: no links, a null component, not kept.  Rows of one id are one vector, the smallest in
Spark's order of arrays, and get equal results.  Ties cannot arise.  An empty table gives an empty one.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import connected_components, forest, importable, written
from graphloom.llm.pivot_search import matrix, usable

SEED = 20_240_229
#: Axes considered for each hash when probes are formed.
NEAREST_AXES = 3


def hadamard(y: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of rows, whose length is a power of two."""
    n, d = y.shape
    h = 1
    while h < d:
        y = y.reshape(n, d // (2 * h), 2, h)
        y = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return y / np.sqrt(d)


class Hasher:
    def __init__(self, width: int, tables: int, hashes: int, probes: int):
        self.padded = 1 << max(1, (width - 1).bit_length())
        self.width, self.tables, self.hashes, self.probes = width, tables, hashes, probes
        self.signs = np.random.default_rng(SEED).choice([-1.0, 1.0], (tables, hashes, 3, self.padded))
        self.choices = np.array(list(itertools.product(range(min(NEAREST_AXES, self.padded)), repeat=hashes)))

    def buckets(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables, probes) bucket codes; a row's codes in a table are sorted."""
        n = len(unit)
        padded = np.zeros((n, self.padded))
        padded[:, : self.width] = unit
        out = np.empty((n, self.tables, self.probes), np.int64)
        rows = np.arange(n)[:, None]
        for t in range(self.tables):
            loss, code = np.zeros((n, len(self.choices))), np.zeros((n, len(self.choices)), np.int64)
            for k in range(self.hashes):
                y = padded
                for signs in self.signs[t, k]:
                    y = hadamard(y * signs)
                size = np.abs(y)
                axes = np.argsort(-size, axis=1, kind="stable")[:, : self.choices.max() + 1]
                signed = 2 * axes + (y[rows, axes] < 0)
                loss += (size[rows, axes[:, :1]] - size[rows, axes])[:, self.choices[:, k]]
                code = code * (2 * self.padded) + signed[:, self.choices[:, k]]
            best = np.argsort(loss, axis=1, kind="stable")[:, : self.probes]
            out[:, t] = np.sort(code[rows, best], axis=1)
        return out


def owned(i: np.ndarray, j: np.ndarray, codes: np.ndarray, table: int, code: int) -> np.ndarray:
    """Of pairs that share bucket (table, code), those that share none before it."""
    first = np.ones(len(i), bool)
    for t in range(table + 1):
        if not first.any():
            break
        at = np.flatnonzero(first)
        same = codes[i[at], t, :, None] == codes[j[at], t, None, :]
        if t < table:
            first[at] = ~same.any(axis=(1, 2))
        else:  # the smallest code in common
            least = np.where(same.any(axis=2), codes[i[at], t], np.iinfo(np.int64).max).min(axis=1)
            first[at] = least == code
    return first


def linked(x: np.ndarray, size: np.ndarray, codes: np.ndarray, blocks: np.ndarray, split: bool, table: int, code: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a group's rows with a cosine of ``least`` or more that this bucket owns."""
    for a in range(0, len(x), 256):
        cosine = (x[a : a + 256] @ x.T) / (size[a : a + 256, None] * size)
        i, j = np.nonzero(cosine >= least)
        i += a
        ok = i < j
        if split:
            ok &= blocks[i] != blocks[j]
        i, j = i[ok], j[ok]
        for k in range(0, len(i), 1 << 16):
            p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            mine = owned(p, q, codes, table, code)
            if mine.any():
                yield p[mine], q[mine]


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows, sorted by the first ``keys`` columns, that agree in them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.column_stack([batch.column(k).to_numpy() for k in range(keys)])
        border = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for a, z in itertools.pairwise(border):
            now = tuple(key[a].tolist())
            if now != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(batch.slice(a, z - a))
    if held:
        yield pa.Table.from_batches(held)


def near_vectors(vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector: str = "embedding", tables: int = 10, hashes: int = 3, probes: int = 4, block_rows: int = 1024) -> DataFrame:
    """id, n_links, component_id and kept of every row."""
    spark = vectors.sparkSession
    importable(spark)
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = written(usable(vectors, id_col, vector).where(size > 0).withColumn("h", F.xxhash64("v")), "vectors")
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    classes = written(rows.groupBy("h", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    hasher = spark.sparkContext.broadcast(Hasher(width, tables, hashes, probes))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1), width)
                codes = hasher.value.buckets(x / np.sqrt((x * x).sum(axis=1, keepdims=True)))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * (tables * probes)), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.astype("<f8").tobytes() for r in x], pa.binary()), batch.column(2), lists], names=["rep", "x", "copies", "codes"])

    coded = written(classes.select("rep", "v", "copies").mapInArrow(hashed, "rep long, x binary, copies long, codes array<long>"), "codes")
    each = coded.select("rep", F.posexplode("codes").alias("k", "code"))
    entries = written(each.select("rep", F.expr(f"k div {probes}").cast("int").alias("table"), "code"), "buckets")
    full = entries.groupBy("table", "code").count().where("count > 1")
    met = (
        entries.join(full, ["table", "code"])
        .withColumn("blocks", F.ceil(F.col("count") / block_rows))
        .withColumn("block", F.pmod(F.xxhash64("rep"), "blocks"))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("table", "code", F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), "block", "rep")
    )
    order = ["table", "code", "a", "b"]
    grouped = met.join(coded, "rep").select(*order, "block", "rep", "copies", "x", "codes").repartition(*order).sortWithinPartitions(*order)

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (u, null, links) count u's links, rows (u, v, 0) are edges."""
        for group in groups(batches, 4):
            if group.num_rows < 2:
                continue
            group = group.combine_chunks()
            table, code, a, b = (group.column(k)[0].as_py() for k in range(4))
            blocks, rep, copies = (group.column(k).to_numpy() for k in (4, 5, 6))
            x = np.frombuffer(b"".join(group.column(7).to_pylist()), "<f8").reshape(len(rep), width)
            codes = group.column(8).combine_chunks().flatten().to_numpy().reshape(len(rep), tables, probes)
            links = np.zeros(len(rep), np.int64)

            def counted(links=links, copies=copies, pairs=linked(x, np.sqrt((x * x).sum(axis=1)), codes, blocks, a != b, table, code, least)):
                for i, j in pairs:
                    np.add.at(links, i, copies[j])
                    np.add.at(links, j, copies[i])
                    yield i, j

            u, v = forest(len(rep), counted())
            own = np.flatnonzero(links)
            if len(own):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate((rep[own], rep[u]))), pa.array([*[None] * len(own), *rep[v].tolist()], pa.int64()), pa.array(np.concatenate((links[own], np.zeros(len(u), np.int64))))], names=["u", "v", "links"]
                )

    found = written(grouped.mapInArrow(verified, "u long, v long, links long"), "links")
    counts = found.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("v is not null").select("u", "v"))
    of_class = (
        classes.select("h", "v", "rep", "copies")
        .join(counts, "rep", "left")
        .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .select("h", "v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    )
    of_id = rows.join(of_class, ["h", "v"]).select("id", "n_links", "component_id")
    every = vectors.select(id_col).withColumn("_id", F.col(id_col).cast("long"))
    return every.join(of_id, F.col("_id") == F.col("id"), "left").select(
        id_col, F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "_id").alias("component_id"), F.coalesce(F.col("_id") == F.coalesce("component_id", "_id"), F.lit(False)).alias("kept")
    )
