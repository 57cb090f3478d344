"""Packing of documents into sequences along a space-filling curve.

Each document gets a vector of hashed words, projected to a few dimensions; its place on the Hilbert curve through them
is a sort key, under which alike documents are neighbours. Spark sorts by ranges of the key; each range is one stream of
tokens that is cut into full sequences. What is left at the end of a range becomes sequences whose lengths are powers of
two, which need no padding. Copies share a key, so ranges go by key and id: no range is forced to hold all copies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import exchange
from tallyforge.llm.bpe import coder
from tallyforge.llm.words import slices, words_of

LENGTH = 2048
#: The token that ends every document.
END = 1
#: Hashed words, dimensions of the curve, and bits of each.
BUCKETS, DIMENSIONS, BITS = 128, 4, 8


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place of integer points (rows) on the Hilbert curve; by the transposition of Skilling (2004)."""
    x = points.astype(np.int64).T.copy()
    q = 1 << (bits - 1)
    while q > 1:
        for axis in x:
            high = (axis & q) != 0
            swap = np.where(high, 0, (x[0] ^ axis) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            axis ^= swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = key << 1 | (axis >> bit & 1)
    return key


def curve_keys(texts: pa.Array) -> np.ndarray:
    """Place of each text on the curve; texts without words share one."""
    directions = np.random.default_rng(7).normal(size=(BUCKETS, DIMENSIONS))
    directions -= directions.mean(0)
    out = []
    for a, b, data, offsets in slices(texts):
        words = words_of(data, offsets, lower=True)
        text = np.repeat(np.arange(b - a), np.diff(words.first))
        cell = text * BUCKETS + (words.hash % np.uint64(BUCKETS)).astype(np.int64)
        vector = np.sqrt(np.bincount(cell, minlength=(b - a) * BUCKETS).reshape(b - a, BUCKETS))
        vector /= np.maximum(np.linalg.norm(vector, axis=1, keepdims=True), 1e-9)
        at = np.arctan(2 * vector @ directions) / np.pi + 0.5
        out.append(hilbert(np.minimum((at * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS))
    return np.concatenate(out) if out else np.empty(0, np.int64)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(curve_keys(batch.column(1))), *batch.columns], ["key", "doc_id", "text"])


class Stream:
    """Pieces of the sequences of one range."""

    def __init__(self, first: int, length: int):
        self.number, self.length = first, length
        self.filled = 0
        self.done: list[tuple] = []
        self.open: list[tuple] = []  # pieces of the sequence that is not full yet

    def add(self, doc, ids: np.ndarray) -> None:
        at, total = 0, len(ids)
        while at < total:
            take = min(total - at, self.length - self.filled)
            self.open.append((doc, at, ids[at : at + take], total, self.filled))
            self.filled += take
            at += take
            if self.filled == self.length:
                self.close()

    def close(self) -> None:
        self.done += [(*p[:4], self.number, p[4]) for p in self.open]
        self.open, self.filled = [], 0
        self.number += 1

    def finish(self) -> None:
        """Cut what is left where the powers of two of its length end."""
        left, rest = self.open, self.filled
        self.open, self.filled = [], 0
        for doc, start, ids, total, _ in left:
            at = 0
            while at < len(ids):
                room = 1 << (rest.bit_length() - 1)
                take = min(len(ids) - at, room - self.filled)
                self.open.append((doc, start + at, ids[at : at + take], total, self.filled))
                self.filled += take
                at += take
                if self.filled == room:
                    rest -= room
                    self.close()

    def taken(self) -> pa.RecordBatch:
        out, self.done = self.done, []
        names = ("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")
        columns = list(zip(*out)) or [()] * 6
        doc, start, ids, total, number, offset = columns
        values = (doc, start, [len(i) for i in ids], [i.tobytes() for i in ids], total, number, offset)
        return pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if n == "ids" else pa.int64()) for n, v in zip(names, values)], list(names))


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Pieces of sequences: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are little-endian unsigned 32-bit; a document is the ids of its text and one end token. Each id of each row lies in
    exactly one piece. Sequences are full, but for at most one of each smaller power of two in each range, which is
    full as well. Sequence ids are unique; they name the range in their high bits. Null and empty texts are an end token
    alone. Repeated rows are documents of their own, also if their ids are equal or null. Extra columns are not looked at.
    """
    spark = docs.sparkSession
    exchange.small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, stream = coder(path), Stream(TaskContext.get().partitionId() << 40, length)
        mark = np.array([end], "<u4")
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.frombuffer(own.encode(text.as_py()), own.kind).astype("<u4")
                stream.add(doc, np.concatenate([ids, mark]))
                if len(stream.done) >= 500:
                    yield stream.taken()
        stream.finish()
        yield stream.taken()

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        rows.mapInArrow(_keyed, "key long, doc_id long, text string")
        .repartitionByRange(parts, "key", "doc_id").sortWithinPartitions("key", "doc_id").select("doc_id", "text")
        .mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    )
