"""SentencePiece encoding and decoding through a distinct-chunk table.

Where no piece holds a whitespace marker behind another character, no merge
crosses from a word to the marker of the next, so a text's ids are the ids of
its marked words one after another.  Each task keeps a table from marked word
to ids: the distinct words of a slice of documents that the table lacks are
segmented once, in one call of the library, and the ids are joined back by
position.  The table is bounded (``most_chunks``) and is emptied when full, so
a task's memory does not grow with the corpus; nothing is shuffled.

A model that fails this condition (``chunkable``) is applied to whole texts.

Nulls: a null text counts as empty, any other null column is passed on.  Empty
texts give the begin and end ids alone.  Rows are independent: repeated rows
give repeated results, and an empty table an empty one.  Columns of the input
keep their names; the new ones are ``n_tokens``, ``ids`` and ``decoded``, and
an input column of such a name is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm.common import importable, slices

MARK = "▁"
PROBES = ("a  b", " a", "a ", " ", "  ", f"x{MARK}y", "a\tb\n c", "\U0001f600 é\x00 z", "<s> </s> <unk>", "ab" * 40)


def chunks_of(text: str) -> list[str]:
    """The marked words of a text, each without its first marker and with blanks for further ones."""
    if not text:
        return []
    if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
        found = re.findall(f"{MARK}+[^{MARK}]*", MARK + text.replace(" ", MARK))
        return [c[1:].replace(MARK, " ") for c in found]
    return text.split(" ")


class ChunkCodec:
    """Encodes and decodes texts with one model; holds the distinct-chunk table."""

    def __init__(self, model: bytes, begin: bool = True, end: bool = True, most_chunks: int = 300_000, longest: int = 64):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.head = self.pack([self.sp.bos_id()]) if begin else b""
        self.tail = self.pack([self.sp.eos_id()]) if end else b""
        self.most, self.longest = most_chunks, longest
        self.ids: dict[str, bytes] = {}
        self.odd: dict[str, str] = {}  # chunks that decode to something other than themselves
        pieces = map(self.sp.id_to_piece, range(self.sp.vocab_size()))
        self.chunkable = not any(MARK in p.lstrip(MARK) for p in pieces) and all(
            self.encode([p]) == [self.whole(p)] and self.decode([p]) == [self.sp.decode(np.frombuffer(self.whole(p), "<u4").tolist())] for p in PROBES
        )

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def whole(self, text: str) -> bytes:
        return self.head + self.pack(self.sp.encode(text)) + self.tail

    def learn(self, chunks: set[str]) -> None:
        """Segment the chunks and decode them again."""
        todo = list(chunks)
        ids = self.sp.encode(todo, num_threads=1)
        if "" in chunks:  # a lone marker at a text's end; the library adds none to an empty text
            ids[todo.index("")] = [self.sp.piece_to_id(MARK)]
        for chunk, own, back in zip(todo, ids, self.sp.decode(ids, num_threads=1), strict=True):
            self.ids[chunk] = self.pack(own)
            if back != chunk:
                self.odd[chunk] = back

    def split(self, texts: list[str]) -> list[list[str]]:
        if len(self.ids) > self.most:
            self.ids.clear()
            self.odd.clear()
        split = [chunks_of(t) for t in texts]
        new = set().union(*split).difference(self.ids)
        self.learn(new)
        return split

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.both(texts)[0]

    def decode(self, texts: list[str]) -> list[str]:
        """What the ids of the texts decode to."""
        return self.both(texts)[1]

    def both(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        split = self.split(texts)
        get = self.ids.__getitem__
        ids = [self.head + b"".join(map(get, c)) + self.tail for c in split]
        back = self.odd.get
        texts = [" ".join([back(x, x) for x in c] if self.odd else c) for c in split]
        for c in [c for c in self.ids if len(c) > self.longest]:
            del self.ids[c]
            self.odd.pop(c, None)
        return ids, texts

    def run(self, texts: list[str]) -> tuple[list[bytes], list[str]]:
        if self.chunkable:
            return self.both(texts)
        ids = [self.whole(t) for t in texts]
        return ids, [self.sp.decode(np.frombuffer(i, "<u4").tolist()) for i in ids]


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", begin: bool = True, end: bool = True, packed: bool = False, keep: tuple[str, ...] = ("doc_id",), most_chunks: int = 300_000) -> DataFrame:
    """``keep`` columns, ``n_tokens`` long, ``ids`` and ``decoded`` string of every row.

    ids: array<int>, or with ``packed`` a binary of little-endian unsigned 32-bit
    integers.  ``model_path`` is read on the driver; its bytes go to the executors.
    """
    spark = docs.sparkSession
    importable(spark)
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    keep = tuple(k for k in keep if k not in ("n_tokens", "ids", "decoded"))
    fields = [docs.schema[k] for k in keep]
    ids_type = T.BinaryType() if packed else T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([*fields, T.StructField("n_tokens", T.LongType()), T.StructField("ids", ids_type), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = ChunkCodec(model.value, begin, end, most_chunks)
        for batch in slices(batches, len(keep)):
            ids, decoded = codec.run(batch.column(len(keep)).to_pylist())
            counts = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            if packed:
                column = pa.array(ids, pa.binary())
            else:
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), "<i4")))
            columns = [*(batch.column(i) for i in range(len(keep))), pa.array(counts), column, pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_tokens", "ids", "decoded"])

    return docs.select(*(F.col(k) for k in keep), F.coalesce(F.col(text), F.lit("")).alias("_text")).mapInArrow(run, schema)
