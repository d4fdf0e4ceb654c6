"""Content-addressed store of token ids.

Writing: documents are tokenised, and each document's id stream is cut where a
rolling hash over the last ``WINDOW`` ids says so, hence at the same places
wherever the same ids occur.  A chunk's address is the BLAKE2b digest of its
ids; each address is stored once.  Below the store's folder lie Parquet tables

- ``packs/kind=chunk``: sorted in each file by key (address), n_ids, payload (the ids, little-endian,
  2 bytes each where the vocabulary allows, else 4), crc (of the ids as
  unsigned 32-bit integers);
- ``recipes``: documents in ascending id order, in shards: doc_id, shard, row,
  start (ids before it in the shard), n_tokens, recipe (addresses and lengths)
  and root, the Merkle root over the document's chunks;
- ``manifest``: for each shard its number of documents and ids, the ids before
  it, and the Merkle root over its documents' roots.

Reading: every payload is hashed again and compared with its address, every
recipe's Merkle root is rebuilt from the chunks found and compared, and so is
each shard's; a difference raises an error.  A document's CRC is combined from
those of its chunks as read, so their contents are not shuffled again.

Tokenising uses a table from blank-separated word to ids, as no token crosses
white space; the table is bounded and refilled by the tokenizers library.

Nulls: a null text counts as empty and has the end id alone.  Documents with a
null id come last; equal ids are ordered by Merkle root, and repeated rows
keep one row each.  An empty table gives an empty store.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import few_rows_a_batch, importable, new_path, slices

#: Parameters of the cut: ids in the rolling hash, bits that must be zero (a chunk in 2**9 ids), bounds of a chunk's length.
WINDOW, CUT_BITS, SHORTEST, LONGEST = 16, 9, 64, 4096
FACTOR = 0x9E3779B97F4A7C15
ADDRESS = 16
_codecs: dict[bytes, WordTable] = {}


def byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable ones themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


class WordTable:
    """Ids of texts by way of their blank-separated words.

    Texts are split and their words made distinct in Arrow; each distinct word's
    ids come from the table and are gathered by position in numpy.  A word the
    table lacks is given to the library; plain words go straight to its model,
    past normalisation.  If the tokenizer lower-cases, A-Z are lowered beforehand, and where
    it parts a letter from the marks behind it, a word's ids are those of the
    word without trailing marks, then those of the marks; both keep the table
    small.  Each of these short cuts is taken only if probes show it to be exact.
    """

    MARKS = ".,!?;:%$#&*|()"
    PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")  # lower-case letters, composed
    LETTER = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]"

    def __init__(self, tokenizer: bytes, most: int = 1_000_000, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer.decode())
        self.model, self.letters = self.tokenizer.model, byte_letters()
        self.most, self.longest, self.table = most, longest, {"": b""}
        self.guards = [t["content"] for t in json.loads(tokenizer)["added_tokens"]]
        words = ("ab", "zoo", "\u00e9t\u00e9", "stra\u00dfe", "unbelievable", "x", "\u00ff\u00e0")
        self.lowers = all(self.whole(p) == self.whole(p.encode().lower().decode()) for p in ("Ab CD", "\u00c9I\u0307", "xK"))
        self.parts = all(self.whole(f"{w}{m}") == self.whole(w) + self.whole(m) for w in words for m in (*self.MARKS, "..", "!?", ".,", "%%%", "|!"))
        self.direct = all(self.plain(w) == self.whole(w) for w in words)

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def plain(self, word: str) -> bytes:
        text = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(text)]).tobytes()

    def learn(self, word: str) -> bytes:
        """The ids of a word that the table lacks; entered, if it is not too long."""
        low = word if word.islower() or not self.lowers else word.lower()
        if self.direct and (low.isascii() and low.isalpha() and low.islower() or self.PLAIN.fullmatch(low)) and (word.isascii() or max(word) < "\u0100"):
            found = self.plain(low)
        else:
            found = self.whole(word)
        if len(word) <= self.longest:
            self.table[word] = found
        return found

    def ids_of(self, words: list[str]) -> list[bytes]:
        out, learn = list(map(self.table.get, words)), self.learn
        for k in [k for k, ids in enumerate(out) if ids is None]:
            out[k] = learn(words[k])
        return out

    def parted(self, words: pa.Array) -> tuple[pa.Array, pa.Array]:
        """Words without the marks behind their last letter, and these marks."""
        if not self.parts:
            return words, pa.nulls(len(words), words.type).fill_null("")
        core = pc.utf8_rtrim(words, self.MARKS)
        lettered = pc.match_substring_regex(core, f"{self.LETTER}$")
        core = pc.if_else(lettered, core, words)
        tail = pc.if_else(lettered, pc.replace_substring_regex(words, f"(?s)^.*[^{re.escape(self.MARKS)}]", ""), "")
        return core, tail

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The unsigned 32-bit ids of each text, no special tokens added."""
        if len(self.table) > self.most:
            self.table = {"": b""}
        if self.lowers:
            lowered = pc.ascii_lower(texts)
            for guard in self.guards:  # a special token must not come about by lowering
                lowered = pc.if_else(pc.match_substring(texts, guard, ignore_case=True), texts, lowered)
            texts = lowered
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        distinct = split.flatten().dictionary_encode()
        parts = [part.dictionary_encode() for part in self.parted(distinct.dictionary)]
        found = [self.ids_of(part.dictionary.to_pylist()) for part in parts]
        store, first, last = packed([*found[0], *found[1]], np.column_stack((parts[0].indices.to_numpy(), len(found[0]) + parts[1].indices.to_numpy())).ravel())
        begins, sizes = first[::2], last[1::2] - first[::2]
        at = distinct.indices.to_numpy()
        ids, ends = gathered(store, begins[at], sizes[at])
        border = np.concatenate(([0], ends))[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return [ids[a:z] for a, z in itertools.pairwise(border.tolist())]


def gathered(store: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of the store one after another, and where each of them ends."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    place = np.int32 if len(store) + total < 1 << 31 else np.int64
    return store[np.repeat((begins - ends + sizes).astype(place), sizes) + np.arange(total, dtype=place)], ends


def packed(pieces: list[bytes], order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of pieces in this order one after another, and where each piece begins and ends."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
    begins = np.cumsum(sizes) - sizes
    ids, ends = gathered(np.frombuffer(b"".join(pieces), "<u4"), begins[order], sizes[order])
    return ids, ends - sizes[order], ends


def cuts(ids: np.ndarray) -> list[int]:
    """Where the chunks of an id stream end."""
    n = len(ids)
    if n <= SHORTEST:
        return [n]
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(FACTOR)
    h ^= h >> np.uint64(29)
    powers = power_table(min(n, LONGEST * 16))
    rolled = np.empty(n, np.uint64)
    step = len(powers) - WINDOW
    for k in range(0, n, step):  # sum of h[i-j] * FACTOR**j over the window, from one running sum
        a = max(0, k - WINDOW)
        part = h[a : k + step]
        total = np.cumsum(part * powers[: len(part)][::-1], dtype=np.uint64)
        rolled[k : k + step] = ((total - np.concatenate((np.zeros(min(WINDOW, len(part)), np.uint64), total[:-WINDOW]))) * inverse_table(len(part)))[k - a :]
    wanted = np.flatnonzero((rolled * np.uint64(FACTOR)) >> np.uint64(64 - CUT_BITS) == 0) + 1
    ends, last = [], 0
    for w in wanted.tolist():
        while w - last > LONGEST:
            last += LONGEST
            ends.append(last)
        if w - last >= SHORTEST and w < n:
            ends.append(w)
            last = w
    while n - last > LONGEST:
        last += LONGEST
        ends.append(last)
    return [*ends, n]


_powers: dict[str, np.ndarray] = {}


def power_table(n: int) -> np.ndarray:
    if len(_powers.get("p", ())) < n:
        with np.errstate(over="ignore"):
            _powers["p"] = np.concatenate(([1], np.cumprod(np.full(LONGEST * 16, FACTOR, np.uint64), dtype=np.uint64))).astype(np.uint64)
            _powers["i"] = np.concatenate(([1], np.cumprod(np.full(LONGEST * 16, pow(FACTOR, -1, 1 << 64), np.uint64), dtype=np.uint64))).astype(np.uint64)
    return _powers["p"]


def inverse_table(n: int) -> np.ndarray:
    """FACTOR**-(n-1-i), which makes the weights of a window independent of its place."""
    power_table(n)
    return _powers["i"][:n][::-1]


def merkle(leaves: list[bytes]) -> bytes:
    if not leaves:
        return bytes(ADDRESS)
    while len(leaves) > 1:
        pairs = [b"".join(leaves[k : k + 2]) for k in range(0, len(leaves), 2)]
        leaves = [blake2b(p, digest_size=ADDRESS, person=b"node").digest() for p in pairs]
    return leaves[0]


def crc_of(payload: bytes, width: int) -> int:
    return zlib.crc32(np.frombuffer(payload, f"<u{width}").astype("<u4").tobytes())


_shifts: dict[int, int] = {}


def multiply(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32, bits reversed."""
    product = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            product ^= b
        b = (b >> 1) ^ (0xEDB88320 if b & 1 else 0)
    return product


def shift_of(n_bytes: int) -> int:
    """The factor that moves a CRC past so many bytes."""
    if n_bytes not in _shifts:
        shift, square, n = 1 << 31, 1 << 23, n_bytes  # 1, and x**8
        while n:
            if n & 1:
                shift = multiply(shift, square)
            square = multiply(square, square)
            n >>= 1
        _shifts[n_bytes] = shift
    return _shifts[n_bytes]


def crc_joined(a: int, b: int, b_bytes: int) -> int:
    """The CRC-32 of two byte strings one after another."""
    return multiply(a, shift_of(b_bytes)) ^ b


def crcs_joined(sizes: np.ndarray, crcs: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """``crc_joined`` over the parts of each of many strings: sizes parts each, one string after another."""
    kinds, place = np.unique(n_bytes, return_inverse=True)
    shifts = np.array([shift_of(int(n)) for n in kinds], np.uint32)[place]
    begins, out = np.cumsum(sizes) - sizes, np.zeros(len(sizes), np.uint32)
    order = np.argsort(-sizes, kind="stable")
    for k in range(int(sizes.max(initial=0))):
        rows = order[: np.searchsorted(-sizes[order], -k, side="left")]  # those with more than k parts
        at = begins[rows] + k
        a, b, product = out[rows], shifts[at].copy(), np.zeros(len(rows), np.uint32)
        for bit in range(31, -1, -1):
            product ^= np.where((a >> np.uint32(bit)) & np.uint32(1), b, np.uint32(0))
            b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
        out[rows] = product ^ crcs[at]
    return out


PACK = "kind string, key binary, doc_id {id}, n_ids long, payload binary, crc long"


def write_store(docs: DataFrame, tokenizer_path: str, path: str, end_id: int | None = 1, text: str = "text", id_col: str = "doc_id") -> None:
    """Tokenise ``docs`` and write the store to the folder ``path``, which must not exist."""
    spark = docs.sparkSession
    importable(spark)
    with open(tokenizer_path, "rb") as f:
        raw = f.read()
    vocabulary = json.loads(raw)
    top = max([*vocabulary["model"]["vocab"].values(), *(t["id"] for t in vocabulary["added_tokens"]), end_id or 0])
    width = 2 if top < 1 << 16 else 4
    model = spark.sparkContext.broadcast(raw)
    tail = np.array([] if end_id is None else [end_id], "<u4")
    id_type = docs.schema[id_col].dataType.simpleString()

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = blake2b(model.value).digest()
        if name not in _codecs:
            _codecs[name] = WordTable(model.value)
        table = _codecs[name]  # kept from task to task
        seen: set[bytes] = set()
        serial = itertools.count()
        for batch in slices(batches, 1, 8 << 20):
            rows: list[tuple] = []
            if len(seen) > 200_000:
                seen.clear()
            for doc, stream in zip(batch.column(0), table.encode(batch.column(1)), strict=True):
                ids = np.concatenate((stream, tail))
                stored, begin, addresses, lengths = ids.astype(f"<u{width}").tobytes(), 0, [], []
                for end in cuts(ids) if len(ids) else ():
                    payload = stored[begin * width : end * width]
                    address = blake2b(payload, digest_size=ADDRESS).digest()
                    addresses.append(address)
                    lengths.append(end - begin)
                    if address not in seen:
                        seen.add(address)
                        rows.append(("chunk", address, None, end - begin, payload, zlib.crc32(ids[begin:end].tobytes())))
                    begin = end
                root = merkle(addresses)
                dealt = blake2b(root + b"%d" % next(serial), digest_size=ADDRESS).digest()  # copies of a document go to different tasks
                rows.append(("doc", dealt, doc, len(ids), root + b"".join(addresses) + np.array(lengths, "<u4").tobytes(), None))
            kinds, keys, owners, counts, payloads, crcs = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kinds), pa.array(keys, pa.binary()), pa.array([o.as_py() if o is not None else None for o in owners], batch.column(0).type), pa.array(counts, pa.int64()), pa.array(payloads, pa.binary()), pa.array(crcs, pa.int64())],
                names=["kind", "key", "doc_id", "n_ids", "payload", "crc"],
            )

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first row of each address, in rows sorted by it, and the rows of documents; nothing but the last address is held."""
        last = np.zeros((0, ADDRESS), np.uint8)
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(1)
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset :]
            keys = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] :][: batch.num_rows * ADDRESS].reshape(-1, ADDRESS)
            before = np.concatenate((last, keys[:-1])) if len(last) else np.concatenate((~keys[:1], keys[:-1]))
            keep = (keys != before).any(axis=1) | pc.equal(batch.column(0), "doc").to_numpy(zero_copy_only=False)
            last = keys[-1:].copy()
            yield batch.filter(pa.array(keep))

    schema = PACK.format(id=id_type)
    made = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).mapInArrow(chunked, schema)
    with few_rows_a_batch(spark, 2000):
        # each task gives an address once, or a few times; so those of an address that all documents hold are as many as tasks
        made.repartition("key").sortWithinPartitions("key").mapInArrow(once, schema).write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/packs")
    root, recipe = F.substring("payload", 1, ADDRESS), F.expr(f"substring(payload, {ADDRESS + 1})")
    docs_of = packs(spark, path, id_type, "doc").select("doc_id", root.alias("root"), F.col("n_ids").alias("n_tokens"), recipe.alias("recipe"))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = start = 0
        for batch in batches:
            n = batch.column(2).to_numpy()
            before = np.cumsum(n) - n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(row, row + len(n))), pa.array(before + start)], names=[*batch.schema.names, "row", "start"])
            row, start = row + len(n), start + int(n.sum())

    order = [F.col("doc_id").asc_nulls_last(), F.col("root")]
    in_order = docs_of.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("shard", F.spark_partition_id())
    in_order.mapInArrow(numbered, f"doc_id {id_type}, root binary, n_tokens long, recipe binary, shard int, row long, start long").write.option("compression", "zstd").parquet(f"{path}/recipes")
    recipes = spark.read.parquet(f"{path}/recipes")
    # bounded: one row a shard
    sums = recipes.groupBy("shard").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("n_tokens")).orderBy("shard").collect()
    before, bases = 0, []
    for s in sums:
        bases.append((s["shard"], s["n"], s["n_tokens"], before))
        before += s["n_tokens"]
    base = spark.createDataFrame(bases, "shard int, n_docs long, n_tokens long, base long")
    shard_roots(recipes).join(F.broadcast(base), "shard").write.parquet(f"{path}/manifest")


def packs(spark: SparkSession, path: str, id_type: str, kind: str) -> DataFrame:
    return spark.read.schema(PACK.format(id=id_type)).parquet(f"{path}/packs").where(F.col("kind") == kind)


def shard_roots(recipes: DataFrame, root: str = "root") -> DataFrame:
    """(shard, root): the Merkle root over the roots of a shard's documents, in order."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, leaves = None, []
        for batch in batches:
            for s, leaf in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != shard and shard is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([merkle(leaves)], pa.binary())], names=["shard", "root"])
                    leaves = []
                shard = s
                leaves.append(leaf)
        if shard is not None:
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([merkle(leaves)], pa.binary())], names=["shard", "root"])

    return recipes.select("shard", "row", root).repartition("shard").sortWithinPartitions("shard", "row").select("shard", root).mapInArrow(fold, "shard int, root binary")


def read_documents(spark: SparkSession, path: str, verify: bool = True) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the store's files."""
    importable(spark)
    recipes = spark.read.parquet(f"{path}/recipes")
    manifest = spark.read.parquet(f"{path}/manifest")
    id_type = recipes.schema["doc_id"].dataType.simpleString()

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(blake2b(p, digest_size=ADDRESS).digest(), n, crc_of(p, len(p) // n)) for n, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            if verify and any(key != r[0] for key, r in zip(batch.column(0).to_pylist(), rows, strict=True)):
                raise ValueError(f"{path}: a chunk differs from its address")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r[2] for r in rows], pa.int64())], names=["key", "n", "crc"])

    with_crc = packs(spark, path, id_type, "chunk").select("key", "n_ids", "payload").mapInArrow(checked, "key binary, n long, crc long")
    refs = recipes.select("shard", "row", "recipe").selectExpr("shard", "row", "explode(sequence(0, length(recipe) div 20 - 1)) as i", "recipe").where("length(recipe) > 0").selectExpr("shard", "row", "i", f"substring(recipe, i * {ADDRESS} + 1, {ADDRESS}) as key")
    found = refs.join(with_crc, "key").groupBy("shard", "row").agg(F.array_sort(F.collect_list(F.struct("i", "key", "n", "crc"))).alias("parts"))
    whole = recipes.join(F.broadcast(manifest.select("shard", "base")), "shard").join(found, ["shard", "row"], "left")

    def combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            sizes = pc.fill_null(pc.list_value_length(col["parts"]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            parts = col["parts"].flatten()
            _, keys, n, crc = (parts.field(k) for k in range(4))
            n, crc = n.to_numpy(zero_copy_only=False), crc.to_numpy(zero_copy_only=False)
            border = np.concatenate(([0], np.cumsum(sizes)))
            keys = keys.to_pylist()
            roots = [merkle(keys[a:z]) for a, z in itertools.pairwise(border.tolist())]
            total = np.concatenate(([0], np.cumsum(n)))[border]
            if verify and (np.diff(total).tolist() != col["n_tokens"].to_pylist() or roots != col["root"].to_pylist()):
                raise ValueError(f"{path}: a document differs from its recipe")
            crcs = crcs_joined(sizes, crc.astype(np.uint32), 4 * n)
            yield pa.RecordBatch.from_arrays([col["doc_id"], col["at"], col["n_tokens"], pa.array(crcs.astype(np.int64)), col["shard"], col["row"], pa.array(roots, pa.binary())], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard", "row", "root"])

    read = whole.select("doc_id", (F.col("base") + F.col("start")).alias("at"), "n_tokens", "root", "shard", "row", "parts").mapInArrow(combined, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long, shard int, row long, root binary")
    if verify:
        off = shard_roots(recipes).withColumnRenamed("root", "again").join(manifest, "shard", "full").where("not (again <=> root)").count()
        if off:
            raise ValueError(f"{path}: {off} shards differ from the manifest")
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id and ids (array<int>) of each document, rebuilt from its chunks."""
    recipes = spark.read.parquet(f"{path}/recipes")
    id_type = recipes.schema["doc_id"].dataType.simpleString()
    refs = recipes.where("length(recipe) > 0").selectExpr("shard", "row", "explode(sequence(0, length(recipe) div 20 - 1)) as i", "recipe").selectExpr("shard", "row", "i", f"substring(recipe, i * {ADDRESS} + 1, {ADDRESS}) as key")
    parts = refs.join(packs(spark, path, id_type, "chunk").select("key", "n_ids", "payload"), "key").groupBy("shard", "row").agg(F.array_sort(F.collect_list(F.struct("i", "n_ids", "payload"))).alias("parts"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [[i for p in parts or () for i in np.frombuffer(p["payload"], f"<u{len(p['payload']) // p['n_ids']}").tolist()] for parts in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return recipes.join(parts, ["shard", "row"], "left").select("doc_id", "parts").mapInArrow(joined, f"doc_id {id_type}, ids array<int>")


def store_and_read(docs: DataFrame, tokenizer_path: str, end_id: int | None = 1, text: str = "text", id_col: str = "doc_id", path: str | None = None) -> DataFrame:
    """Write ``docs`` to a store (in the shared folder unless ``path`` is given) and return what reading it gives."""
    spark = docs.sparkSession
    path = path or new_path(spark, "store")
    write_store(docs, tokenizer_path, path, end_id, text, id_col)
    return read_documents(spark, path)
