"""Removal of long passages that occur earlier, over a compacted de Bruijn graph of words.

The edges of the graph are the windows of 20 words of every text; two windows that follow one another in a text meet
in a node of 19 words. Consecutive windows whose smallest ten-word run is the same occurrence form a path without
branches as far as one text tells; such a path is compacted into one record under the hash of that run (its anchor),
so about six windows travel together. Spark joins the records of an anchor, where equal windows always meet. Among
equal windows the source coordinates (document, place) tell which came first; the others are repeats. Repeats of one
record make a span again, and spans are joined with their documents, where overlapping spans become the removed words.

A task keeps only the first of equal windows that it has seen itself and tells the rest at once, so a passage
in a third of all texts reaches the joining task no more than once for some millions of windows read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm import exchange
from tallyforge.llm.words import slices, words_of

WINDOW, ANCHOR = 20, 10
#: Windows held by a task before it sends them on.
HELD = 300_000
#: Ranges of anchors for each shuffle partition; a range is what one task compares at a time.
RANGES = 8

_U = np.uint64
_SPANS = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("spans", pa.binary()), ("blob", pa.binary())])


def anchors(grams: np.ndarray, at: np.ndarray, n: int, starts: np.ndarray) -> np.ndarray:
    """For windows that start at these words: the word where their smallest run begins, the leftmost of equal ones."""
    value = np.full(n + 1, np.iinfo(np.uint64).max, np.uint64)
    value[at] = grams
    width, low, span = 1, np.arange(n + 1), WINDOW - ANCHOR + 1

    def later(by: int) -> np.ndarray:
        other = np.minimum(np.r_[low[by:], np.full(by, n)], n)
        return np.where(value[low] <= value[other], low, other)

    while 2 * width <= span:
        low = later(width)
        width *= 2
    if span > width:
        low = later(span - width)
    return low[starts]


def _spans(doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Packed (first window, number of windows) of the runs of places of each document; sorted input."""
    new = np.r_[True, (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)]
    at = np.flatnonzero(new)
    pairs = np.stack([place[at], np.diff(np.r_[at, len(doc)])], 1).astype("<u4")
    begin, length = exchange.runs(doc[at])
    return doc[at][begin], [pairs[a : a + k].tobytes() for a, k in zip(begin, length)]


def _told(doc: np.ndarray, place: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    if len(doc):
        order = np.lexsort((place, doc))
        ids, spans = _spans(doc[order], place[order])
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids % parts, pa.int32()), pa.array(ids), pa.array(spans, pa.binary()), pa.nulls(len(ids), pa.binary())], schema=_SPANS
        )


def _windows(parts: int):
    """Packed records of each anchor, and spans that this task can tell alone."""

    def pack(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        window, anchor, doc, place, offset = (np.concatenate(x) for x in zip(*held))
        # Equal windows: the first stays, the others are told at once.
        order = np.argsort(window, kind="stable")
        at, length = exchange.runs(window[order])
        again = np.repeat(length > 1, length)
        some = order[again]
        some = some[np.lexsort((place[some], doc[some], window[some]))]
        first = np.ones(len(window), bool)
        # Equal coordinates (a row twice) are neither earlier nor later than each other.
        at, length = exchange.runs(window[some])
        lead = np.repeat(at, length).astype(np.int64)
        later = (doc[some] != doc[some][lead]) | (place[some] != place[some][lead])
        first[some] = False  # one record for each place
        first[some[lead]] = True
        yield from _told(doc[some[later]], place[some[later]], parts)
        keep = np.flatnonzero(first)
        keep = keep[np.lexsort((place[keep], doc[keep], anchor[keep]))]
        window, anchor, doc, place, offset = (x[keep] for x in (window, anchor, doc, place, offset))
        start = place + offset  # the place of the anchor: equal for the windows of one record
        new = np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])]
        record = np.flatnonzero(new)
        count = np.diff(np.r_[record, len(anchor)]).astype(np.uint8)
        where, blobs = [], []
        for part, a, b in exchange.cut(anchor[record], parts):
            x, y = record[a], record[b] if b < len(record) else len(anchor)
            rows = record[a:b]
            head = np.array([b - a, y - x], "<u4").tobytes()
            short = (window[x:y] >> _U(16)).view(np.uint8).reshape(-1, 8)[:, :6]
            blobs.append(
                head + exchange.planes(anchor[rows] >> _U(16)) + exchange.planes(doc[rows]) + exchange.planes(start[rows].astype("<u4"))
                + count[a:b].tobytes() + short.tobytes() + offset[x:y].astype(np.uint8).tobytes()
            )
            where.append(part)
        yield pa.RecordBatch.from_arrays(
            [pa.array(where, pa.int32()), pa.nulls(len(where), pa.int64()), pa.nulls(len(where), pa.binary()), pa.array(blobs, pa.binary())],
            schema=_SPANS,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            batch = batch.filter(batch.column(0).is_valid())
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for a, b, data, offsets in slices(batch.column(1)):
                words = words_of(data, offsets)
                starts, window = words.grams(WINDOW)
                if not len(starts):
                    continue
                at, grams = words.grams(ANCHOR)
                value = np.zeros(len(words.hash) + 1, np.uint64)
                value[at] = grams
                low = anchors(grams, at, len(words.hash), starts)
                text = np.searchsorted(words.first, starts, "right") - 1
                held.append((window, value[low], ids[a:b][text], starts - words.first[text], low - starts))
                size += len(starts)
                if size >= HELD:
                    yield from pack(held)
                    held, size = [], 0
        yield from pack(held)

    return run


def _repeats(table: pa.Table) -> pa.Table:
    """Spans of windows that came earlier, of the records of a range of anchors; spans told before pass through."""
    told = table.filter(table.column("blob").is_null()).select(["doc_id", "spans"])
    columns: list[list[np.ndarray]] = [[], [], [], []]
    for blob in table.column("blob"):
        if not blob.is_valid:
            continue
        data = blob.as_py()
        r, w = np.frombuffer(data[:8], "<u4").astype(int)
        cuts = np.cumsum([8, 8 * r, 8 * r, 4 * r, r, 6 * w, w])
        anchor, doc, start, count, short, offset = (data[a:b] for a, b in zip(cuts[:-1], cuts[1:]))
        count = np.frombuffer(count, np.uint8)
        wide = np.zeros((w, 8), np.uint8)
        wide[:, :6] = np.frombuffer(short, np.uint8).reshape(-1, 6)
        place = np.repeat(exchange.from_planes(start, "<u4").astype(np.int64), count) - np.frombuffer(offset, np.uint8)
        for values, new in zip(
            columns,
            (np.repeat(exchange.from_planes(anchor, "u8"), count), np.repeat(exchange.from_planes(doc, "i8"), count), place, wide.view(np.uint64).ravel()),
        ):
            values.append(new)
    if columns[0]:
        anchor, doc, place, window = (np.concatenate(x) for x in columns)
        order = np.argsort(anchor ^ (window * _U(0x9E3779B97F4A7C15)), kind="stable")
        key = (anchor ^ (window * _U(0x9E3779B97F4A7C15)))[order]
        _, length = exchange.runs(key)
        order = order[np.repeat(length > 1, length)]  # most windows occur once
        anchor, doc, place, window = (x[order] for x in (anchor, doc, place, window))
        order = np.lexsort((place, doc, window, anchor))
        anchor, doc, place, window = (x[order] for x in (anchor, doc, place, window))
        if len(order):
            at = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1])])
            lead = np.repeat(at, np.diff(np.r_[at, len(anchor)]))
            later = (doc != doc[lead]) | (place != place[lead])
            doc, place = doc[later], place[later]
        for batch in _told(doc, place, 1):
            told = pa.concat_tables([told, pa.Table.from_batches([batch]).select(["doc_id", "spans"])])
    return told


def _without(docs: pa.Table, spans: pa.Table, text_column: str) -> pa.Table:
    """Texts of the documents of a part without the words of their spans."""
    rows = docs.column("row").combine_chunks()
    own: dict[int, list[bytes]] = {}
    for doc, span in zip(spans.column("doc_id").to_pylist(), spans.column("spans").to_pylist()):
        own.setdefault(doc, []).append(span)
    kept, total, gone = [], [], []
    for doc, text in zip(docs.column("doc_id").to_pylist(), rows.field(text_column)):
        words = text.as_buffer().to_pybytes().split() if text.is_valid else []  # bytes.split() has the same six separators
        total.append(len(words))
        if doc in own and len(words) >= WINDOW:
            pairs = np.frombuffer(b"".join(own[doc]), "<u4").reshape(-1, 2).astype(np.int64)
            pairs = pairs[pairs.sum(1) <= len(words) - WINDOW + 1]
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, pairs[:, 0], 1)
            np.add.at(change, pairs.sum(1) + WINDOW - 1, -1)
            covered = np.cumsum(change[:-1]) > 0
            gone.append(int(covered.sum()))
            words = [words[i] for i in np.flatnonzero(~covered)]
        else:
            gone.append(0)
        kept.append(b" ".join(words).decode())
    return pa.table(
        {"row": rows, "kept": pa.array(kept, pa.string()), "n_words": pa.array(total, pa.int64()), "n_removed": pa.array(gone, pa.int64())}
    )


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``row`` (all columns of the input as a struct), ``kept`` text, ``n_words``, ``n_removed`` of every row.

    A word goes if it lies in a window of 20 words of its text whose words also start earlier: in a document of a smaller id,
    or in the same document. Kept words are joined by one space. Null and empty texts have no words and an empty ``kept``.
    Rows without an id keep all words, and no other row loses words for them. Rows that share an id are taken for the same
    document: the same row twice loses nothing to itself. Extra columns pass through in ``row``, whatever their names.
    """
    spark = docs.sparkSession
    exchange.small_batches(spark)
    parts = exchange.range_count(spark, RANGES)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.struct("*").alias("row"))

    def without(key, docs: pa.Table, spans: pa.Table) -> pa.Table:
        return _without(docs, spans, text_column)

    spans = (
        rows.select("doc_id", F.col("row")[text_column].alias("text")).mapInArrow(_windows(parts), "part int, doc_id long, spans binary, blob binary")
        .groupBy("part").applyInArrow(_repeats, "doc_id long, spans binary")
    )
    # Rows without an id meet no spans, and are dealt in turn.
    dealt = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.xxhash64("doc_id"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("part")
    schema = T.StructType([rows.schema["row"]]).add("kept", "string").add("n_words", "long").add("n_removed", "long")
    return (
        rows.select(F.pmod(dealt, F.lit(parts)).alias("part"), "doc_id", "row").groupBy("part")
        .cogroup(spans.select(part, "doc_id", "spans").groupBy("part")).applyInArrow(without, schema)
    )
