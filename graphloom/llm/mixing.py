"""Mixing sources to target weights with soft domain membership.

A softmax classifier over hashed words, fitted on a labelled table, gives
every document posterior probabilities of the domains.  Nonnegative rates
r_i, how often document i is to be used, then minimise

    1/2 sum_k (E_k - T_k)^2 / T_k  +  ridge/2 sum_i t_i (r_i - 1)^2,    E_k = sum_i r_i t_i p_ik

with t_i tokens, p_ik posteriors and T_k the target tokens of domain k, by
accelerated projected gradient.  The gradient of r_i needs only the E_k, so each iteration is
one distributed sum of a few numbers over all documents; a document replays
the short history of gradients and no rate is stored.  A document is used
``floor(rate + u)`` times, u being uniform and fixed by its id and text.

Targets are scaled so that no domain of ``keep`` needs fewer tokens than it has.

Fitting reads at most about ``most_rows`` labelled documents (the documented bound),
a third of which calibrate the posteriors' temperature; all else reads all rows.

Nulls: a null text is empty; an empty text has no tokens, the domains'
prior and rate 1, and is used once.  Labels with a null domain or id are left out; of several
domains of one id the smallest counts.  Domains without target have target 0;
targets without labelled documents are left out and the rest rescaled.
Of several documents of one labelled id one is learnt from.  If the targets
cannot be met within the tolerance, a warning and ``targets_met`` say so.
Without any label all rates are 1.  Rows equal in id and text
fare alike; an empty table gives an empty one.
"""

from __future__ import annotations

import warnings
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import free, importable, slices, written

BUCKETS = 1 << 16
EDGE_MARKS = b".,;:!?\"'()[]#$%&*|"


class WordBuckets(dict):
    """From a word to its bucket; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        bucket = self[word] = zlib.crc32(word.strip(EDGE_MARKS).lower()) % BUCKETS
        return bucket


def traits(words: list[bytes], kinds: set[bytes]) -> list[bytes]:
    """What a text looks like, as words of their own: marks behind its words, capitals, repetition; of all its words."""
    marks = Counter(w[len(w.rstrip(EDGE_MARKS)) :] for w in kinds)
    found = [b"\x01marks" + m for m, n in marks.items() if 10 * n > len(kinds)]
    if 2 * sum(map(bytes.isupper, kinds)) > len(kinds):
        found.append(b"\x01capitals")
    return [*found, b"\x01types%d" % (10 * len(kinds) // max(1, len(words)))]


def presence(text: str, buckets: WordBuckets) -> tuple[int, np.ndarray]:
    """The number of words of a text, and the buckets of its distinct words, A-Z lower-cased, and traits."""
    words = text.encode().split()
    kinds = set(words)
    found = set(map(buckets.__getitem__, kinds))
    found.update(zlib.crc32(t) % BUCKETS for t in (traits(words, kinds) if words else ()))
    return len(words), np.fromiter(sorted(found), np.int64, len(found))


@dataclass
class DomainModel:
    domains: list[str]
    prior: np.ndarray  # log probabilities
    weight: np.ndarray  # (BUCKETS, domains + 1): weights, and the square of a bucket's scale
    temperature: float = 1.0

    def posterior(self, sums: np.ndarray) -> np.ndarray:
        """Of the sums of the weights of texts' buckets."""
        z = self.prior + sums[..., :-1] / (np.sqrt(sums[..., -1:]) + 1e-9) / self.temperature
        if not self.domains:
            return z
        z = np.exp(z - z.max(axis=-1, keepdims=True))
        return z / z.sum(axis=-1, keepdims=True)


@dataclass
class Rates:
    """Rates by posterior, as a replay of gradients: one vector over the domains each iteration.

    Each step is taken from a point ahead of the rates, on the line from the rates before (Nesterov's acceleration).
    """

    step: float
    ridge: float
    gradients: list[np.ndarray] = field(default_factory=list)
    met: bool = True  # whether the expected tokens are within the tolerance of their targets

    def both(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rates, and the point ahead at which the next gradient is taken."""
        r = ahead = np.ones(len(p))
        for k, g in enumerate(self.gradients):
            after = np.maximum(0.0, ahead - self.step * (p @ g + self.ridge * (ahead - 1)))
            ahead = after + k / (k + 3) * (after - r)
            r = after
        return r, ahead

    def of(self, p: np.ndarray) -> np.ndarray:
        return self.both(p)[0]


def labelled_share(labels: DataFrame, domain: str, id_col: str, most_rows: int) -> DataFrame:
    known = labels.where(F.col(domain).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(domain).alias("domain"))
    share = min(1.0, most_rows / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))


def train(docs: DataFrame, labels: DataFrame, domain: str, text: str = "text", id_col: str = "doc_id", most_rows: int = 15_000) -> DomainModel:
    """Softmax regression over word presence; about ``most_rows`` labelled documents are read."""
    importable(docs.sparkSession)
    chosen = labelled_share(labels, domain, id_col, most_rows)  # a bounded number of rows
    known = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    rows = known.select("text", "id", "domain", (F.pmod(F.xxhash64("id", F.lit(7)), F.lit(3)) == 0).alias("check"))
    schema = T.StructType([T.StructField("buckets", T.ArrayType(T.IntegerType())), *rows.schema.fields[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = WordBuckets()
        for batch in slices(batches, 0):
            found = [presence(t, buckets)[1] for t in batch.column(0).to_pylist()]
            offsets = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
            flat = np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), *batch.columns[1:]], names=schema.names)

    # bounded: the buckets of most_rows documents, one an id
    seen = rows.mapInArrow(run, schema).groupBy("id", "domain", "check").agg(F.min("buckets").alias("buckets")).select("buckets", "domain", "check").toArrow()
    return fit_domains(seen)


def fit_domains(seen: pa.Table, rounds: int = 60, l2: float = 1e-4) -> DomainModel:
    """Softmax regression on (buckets, domain, check); rows to check calibrate the temperature only.

    A bucket counts by how much its naive Bayes ratio tells of any domain, so
    words that only tell languages apart weigh little; each document's
    features have length one.
    """
    names, lists = seen.column("domain").to_pylist(), seen.column("buckets").combine_chunks()
    check = seen.column("check").to_numpy()
    domains = sorted({d for d, c in zip(names, check, strict=True) if not c})
    if not domains:
        return DomainModel([], np.zeros(0), np.zeros((BUCKETS, 1)))
    place = {d: k for k, d in enumerate(domains)}
    k, truth = len(domains), np.array([place.get(d, -1) for d in names])
    order = np.argsort([hash_of(lists[r].values.to_numpy(), names[r]) for r in range(len(names))], kind="stable")  # whatever the order of rows
    chosen, held = order[~check[order]], order[check[order] & (truth[order] >= 0)]

    def flat(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [lists[r].values.to_numpy() for r in rows.tolist()]
        sizes = np.array([len(x) for x in parts], np.int64)
        return np.concatenate([*parts, np.zeros(0, np.int32)]).astype(np.int64), np.repeat(np.arange(len(rows)), sizes)

    buckets, owner = flat(chosen)
    y = np.zeros((len(chosen), k))
    y[np.arange(len(chosen)), truth[chosen]] = 1
    counts = np.stack([np.bincount(buckets, y[owner, j], BUCKETS) for j in range(k)], axis=1)
    n = y.sum(axis=0)
    scale = np.abs(np.log((counts + 1) / (counts.sum(axis=1, keepdims=True) / n.sum() * n + 1))).max(axis=1)
    length = np.sqrt(np.bincount(owner, scale[buckets] ** 2, len(chosen))) + 1e-9
    x = scale[buckets] / length[owner]
    weight = ahead = np.zeros((BUCKETS, k))
    prior = np.log(n / n.sum())
    for r in range(rounds):
        z = prior + np.stack([np.bincount(owner, x * ahead[buckets, j], len(chosen)) for j in range(k)], axis=1)
        z = np.exp(z - z.max(axis=1, keepdims=True))
        off = z / z.sum(axis=1, keepdims=True) - y
        step = np.stack([np.bincount(buckets, x * off[owner, j], BUCKETS) for j in range(k)], axis=1) / len(chosen)
        after = ahead - 40.0 * (step + l2 / 40 * ahead)
        weight, ahead = after, after + r / (r + 3) * (after - weight)
    model = DomainModel(domains, prior, np.column_stack((weight * scale[:, None], scale**2)))
    if len(held):
        buckets, owner = flat(held)
        sums = np.stack([np.bincount(owner, model.weight[buckets, j], len(held)) for j in range(k + 1)], axis=1)

        def loss(t: float) -> float:
            model.temperature = t
            return float(-np.log(np.maximum(model.posterior(sums)[np.arange(len(held)), truth[held]], 1e-12)).sum())

        model.temperature = min((2 ** (j / 4) for j in range(-12, 13)), key=loss)
    return model


def hash_of(buckets: np.ndarray, domain: str) -> int:
    return zlib.crc32(buckets.tobytes(), zlib.crc32(domain.encode()))


def posteriors(docs: DataFrame, model: DomainModel, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id, th (hash of text), n_tokens and posterior (array<double>) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(id_col).schema.add("th", "long").add("n_tokens", "long").add("posterior", T.ArrayType(T.DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, buckets = shared.value, WordBuckets()
        for batch in slices(batches, 2):
            tokens, p = membership(batch.column(2).to_pylist(), m, buckets)
            found = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * p.shape[1]), pa.array(p.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(tokens), found], names=schema.names)

    clean = F.coalesce(F.col(text), F.lit(""))
    return docs.select(id_col, F.xxhash64(clean).alias("_th"), clean.alias("_text")).mapInArrow(run, schema)


def membership(texts: list[str], model: DomainModel, buckets: WordBuckets) -> tuple[np.ndarray, np.ndarray]:
    found = [presence(t, buckets) for t in texts]
    sums = np.array([model.weight[b].sum(axis=0) for _, b in found]).reshape(len(texts), len(model.domains) + 1)
    return np.array([n for n, _ in found], np.int64), model.posterior(sums)


def expected(found: DataFrame, rates: Rates, k: int) -> np.ndarray:
    """E_k at the rates, then at the point ahead: a distributed sum over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 * k)
        for batch in batches:
            if batch.num_rows:
                p = batch.column(1).flatten().to_numpy().reshape(-1, k)
                t = batch.column(0).to_numpy()
                total += np.concatenate([(r * t) @ p for r in rates.both(p)])
        yield pa.RecordBatch.from_arrays([pa.array([v]) for v in total.tolist()], names=[f"e{j}" for j in range(2 * k)])

    sums = found.select("n_tokens", "posterior").mapInArrow(run, ", ".join(f"e{j} double" for j in range(2 * k)))
    return np.array(sums.agg(*(F.coalesce(F.sum(f"e{j}"), F.lit(0.0)) for j in range(2 * k))).first(), float).reshape(2, k)


def targets_of(now: np.ndarray, domains: list[str], weights: dict[str, float], keep: tuple[str, ...]) -> np.ndarray:
    """Target tokens: in the proportions of the weights, and no fewer than now for the domains to keep."""
    share = np.array([max(0.0, weights.get(d, 0.0)) for d in domains])
    if not share.sum() or not now.sum():
        return now
    share = share / share.sum()
    held = [now[k] / share[k] for k, d in enumerate(domains) if d in keep and share[k]]
    return share * (max(held) if held else now.sum())


def solve(found: DataFrame, domains: list[str], weights: dict[str, float], keep: tuple[str, ...] = (), ridge: float = 0.005, tolerance: float = 0.01, most_rounds: int = 40) -> tuple[Rates, np.ndarray]:
    """Rates whose expected tokens meet the targets, and the targets; where they do not meet them, ``met`` is false and a warning says so."""
    k = len(domains)
    now = expected(found, Rates(1.0, ridge), k)[0] if k else np.zeros(0)
    targets = targets_of(now, domains, weights, keep)
    if not now.sum():
        return Rates(1.0, ridge), targets
    scale = np.maximum(targets, 0.02 * targets.sum())
    rates = Rates(1 / (ridge + float((now / scale).max())), ridge)
    e = ahead = now
    off = float((np.abs(e - targets) / scale).max())
    for _ in range(most_rounds):
        if off < tolerance:
            break
        rates.gradients.append((ahead - targets) / scale)
        e, ahead = expected(found, rates, k)
        off = float((np.abs(e - targets) / scale).max())
    rates.met = off < tolerance
    if not rates.met:
        warnings.warn(f"after {most_rounds} rounds the expected tokens of a domain are off their target by {off:.1%}, tolerance {tolerance:.1%}", RuntimeWarning, stacklevel=2)
    return rates, targets


def uniform(id_col: Column, th: Column) -> Column:
    return F.pmod(F.xxhash64(id_col, th, F.lit("mix")), F.lit(1 << 40)) / float(1 << 40)


def fitted(docs: DataFrame, labels: DataFrame, weights: dict[str, float], domain: str, keep: tuple[str, ...], text: str, id_col: str, most_rows: int) -> tuple[DomainModel, Rates, DataFrame]:
    model = train(docs, labels, domain, text, id_col, most_rows)
    found = written(posteriors(docs, model, text, id_col), "posteriors")
    rates, _ = solve(found, model.domains, weights, keep)
    return model, rates, found


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], domain: str = "domain", keep: tuple[str, ...] = (), text: str = "text", id_col: str = "doc_id", most_rows: int = 15_000) -> DataFrame:
    """id, n_tokens, posterior, rate, copies and targets_met (the same in all rows) of every row; labels: rows (id, domain)."""
    model, rates, found = fitted(docs, labels, weights, domain, keep, text, id_col, most_rows)
    k = len(model.domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(3).flatten().to_numpy().reshape(batch.num_rows, k)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rates.of(p))], names=[*batch.schema.names, "rate"])

    rated = found.mapInArrow(run, T.StructType([*found.schema.fields, T.StructField("rate", T.DoubleType())]))
    rate = F.when(F.col("n_tokens") == 0, F.lit(1.0)).otherwise(F.col("rate"))
    done = rated.withColumn("rate", rate).withColumn("copies", F.floor(F.col("rate") + uniform(F.col(id_col), F.col("th"))).cast("int"))
    return done.select(id_col, "n_tokens", "posterior", "rate", "copies", F.lit(rates.met).alias("targets_met"))


def mixed(docs: DataFrame, labels: DataFrame, weights: dict[str, float], domain: str = "domain", keep: tuple[str, ...] = (), text: str = "text", id_col: str = "doc_id", most_rows: int = 15_000) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as its rate says; decided where the row is, without a join."""
    model, rates, _ = fitted(docs, labels, weights, domain, keep, text, id_col, most_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    u = free(docs.columns, "u")
    schema = T.StructType([*docs.schema.fields, T.StructField(u, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, buckets = shared.value, WordBuckets()
        for batch in slices(batches, at):
            tokens, p = membership([t or "" for t in batch.column(at).to_pylist()], m, buckets)
            rate = np.where(tokens == 0, 1.0, rates.of(p))
            copies = np.floor(rate + batch.column(batch.num_columns - 1).to_numpy()).astype(np.int64)
            yield batch.take(pa.array(np.repeat(np.arange(len(copies)), copies)))

    clean = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumn(u, uniform(F.col(id_col), F.xxhash64(clean))).mapInArrow(run, schema).drop(u)
