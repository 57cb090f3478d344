"""Periodic runs of words: the same phrase said over and over.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that no neighbour extends,
``REPEATS`` periods and ``LEAST`` words long at least. It is found by an online sparse dynamic program over the diagonals
(lags) of the text compared with itself: for each word, its earlier occurrence adds one to the match length of its lag; a lag whose
next word does not match ends, and is emitted at once if it is long enough.

What keeps it sparse is the context in which an occurrence counts. A run of period q matches itself at lag q over at least
twice q words. So a lag up to 16 is only asked for where the 16 words from here on stand there too, and a lag from L/2 + 1 to
L where L words do. Within a run of period q, L >= q words never recur sooner than q words on, else q would not be the smallest period. So the
*latest* earlier occurrence in such a context is at lag q at every word of the run, and each word has at most one lag for each L = 16, 32,
64, ...: the work is n log n for any text, also for one word repeated a million times. Occurrences are told exactly: equal contexts have equal
numbers, made for 2L words from the numbers of their halves, and a context that occurs once is left out of all longer ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Periods and words a run has at least. The context of the smallest lags follows from them.
REPEATS, LEAST = 3, 24
CONTEXT = 16
#: Words of several texts that are looked at together; a longer text is looked at alone.
HELD = 200_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _recurring(positions: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions whose key occurs more than once, their keys' numbers, and for each the latest position before with its key, or -1.

    Positions ascend, within the result too.
    """
    order = np.argsort(keys, kind="stable")
    sorted_keys, at = keys[order], positions[order]
    same = sorted_keys[1:] == sorted_keys[:-1]
    number = np.zeros(len(at), np.int64)
    number[1:] = np.cumsum(~same)
    before = np.full(len(at), -1, np.int64)
    before[1:][same] = at[:-1][same]
    again = np.zeros(len(at), bool)
    again[1:] |= same
    again[:-1] |= same
    kept = np.flatnonzero(again)
    kept = kept[np.argsort(at[kept], kind="stable")]
    return at[kept], number[kept], before[kept]


def occurrences(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(word, lag, context) of every word's latest earlier occurrence with a lag that belongs to the context, in order of words.

    Numbers of words must differ between texts that are looked at together.
    """
    n = len(ids)
    found = []
    positions, numbers, before = _recurring(np.arange(n), ids)
    length = 1
    while len(positions):
        if length >= CONTEXT:
            lag = positions - before
            own = (before >= 0) & (lag <= length) & (lag > (0 if length == CONTEXT else length // 2))
            found.append(np.stack([positions[own], lag[own], np.full(own.sum(), length)], 1))
        # Numbers of twice the words, where both halves recur.
        number = np.full(n, -1, np.int64)
        number[positions] = numbers
        inside = positions[positions + length < n]
        right = number[inside + length]
        inside, right = inside[right >= 0], right[right >= 0]
        positions, numbers, before = _recurring(inside, number[inside] * np.int64(n) + right)
        length *= 2
    if not found:
        return []
    every = np.concatenate(found)
    return every[np.argsort(every[:, 0], kind="stable")].tolist()


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of numbered words, by start, then period."""
    out = []
    active: dict[int, list[int]] = {}  # lag -> first word, last word, context

    def emit(lag: int) -> None:
        first, last, context = active.pop(lag)
        length = last - first + context + lag
        if length >= max(LEAST, REPEATS * lag):
            out.append((first - lag, length, lag))

    now = -1
    for at, lag, context in occurrences(ids):
        if at != now:
            for ended in [k for k, diagonal in active.items() if diagonal[1] < at - 1]:
                emit(ended)
            now = at
        diagonal = active.get(lag)
        if diagonal is None:
            active[lag] = [at, at, context]
        elif diagonal[1] == at - 1:
            diagonal[1] = at
        else:  # matched at the word before last, not at the last one
            emit(lag)
            active[lag] = [at, at, context]
    for lag in list(active):
        emit(lag)
    return sorted((start, length, lag) for start, length, lag in out)


def _numbered(texts: Iterator[list[str]]) -> Iterator[tuple[list[list[str]], np.ndarray]]:
    """Batches of word lists with numbers for their words, told apart between texts."""
    held: list[list[str]] = []
    numbers: list[int] = []
    for words in texts:
        if held and len(numbers) + len(words) > HELD:
            yield held, np.array(numbers, np.int64)
            held, numbers = [], []
        index: dict[str, int] = {}
        base = len(numbers)
        numbers += [index.setdefault(word, base + i) for i, word in enumerate(words)]
        held.append(words)
    if held:
        yield held, np.array(numbers, np.int64)


def _analysed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    run = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    for batch in batches:
        texts = batch.column("text")
        done = 0
        for held, ids in _numbered(_WORD.findall(text.as_py() or "") for text in texts):
            starts = np.cumsum([0, *map(len, held)])
            own: list[list[dict]] = [[] for _ in held]
            kept = np.ones(len(ids), bool)
            for start, length, period in runs(ids):
                at = int(np.searchsorted(starts, start, "right")) - 1
                own[at].append({"start": start - int(starts[at]), "length": length, "period": period})
                kept[start + period : start + length] = False
            collapsed = [
                " ".join(words) if not found else " ".join([w for w, keep in zip(words, kept[a : a + len(words)].tolist()) if keep])
                for words, found, a in zip(held, own, starts.tolist())
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row").slice(done, len(held)), pa.array([len(words) for words in held], pa.int64()),
                    pa.array(own, pa.list_(run)), pa.array(collapsed, pa.string()),
                ],
                ["row", "n_words", "runs", "collapsed"],
            )
            done += len(held)


def periodic_runs(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``row`` (all columns of the input as a struct), ``n_words``, ``runs`` and ``collapsed`` of every row.

    ``runs``: array of (start, length, period), in words from 0, by start, then period. ``collapsed``: the words joined by one
    space, without those that a run holds after its first period. Words are runs of bytes other than space and 0x09-0x0D.

    Each row is looked at by itself, so nothing is shuffled and no key can be hot; repeated rows have equal results. Null and empty
    texts have no words and no runs. Very long texts take time in proportion to n log n, whatever they repeat. No column but the text is
    looked at: ids may be null or repeat, and extra columns pass through in ``row``, whatever their names. An empty table gives none.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col(text_column).alias("text"))
    run = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
    found = [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())]
    return rows.mapInArrow(_analysed, T.StructType([rows.schema["row"], *found]))


def most_repeated(runs: Column) -> Column:
    """The run with the greatest exact length / period, of equal ones the first; null without any."""

    def better(best: Column, run: Column) -> Column:
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)
