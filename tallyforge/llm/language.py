"""Language of texts: multinomial naive Bayes over hashed character n-grams.

Letters count in lower case, and every run of other characters as one gap. N-grams of one to three are hashed to a fixed number
of columns. The model is a matrix of log probabilities, columns by languages, which every task gets; a batch of texts is a
sparse matrix of n-grams given by its entries, multiplied by gathering the rows of the model and summing them by text.
Training reads a bounded sample of the labelled rows; predicting reads whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm import exchange
from tallyforge.llm.words import mix, slices

ORDERS = (1, 2, 3)
COLUMNS = 1 << 16
#: Labelled rows of each language that the model is fitted on, about: those with the smallest hashes of id and label.
SAMPLE = 2_000
SMOOTHING = 0.1
#: Texts of so many bytes are scored at a time.
BYTES = 400_000
#: Tasks that count the n-grams of the sample.
TASKS = 16
NONE = "und"

_U = np.uint64
_letters: list[np.ndarray] = []


def _letter(points: np.ndarray) -> np.ndarray:
    """Whether code points are letters."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0][points]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of the text and hashed column of every n-gram, by text, and whether each text has a letter."""
    low = [t.lower() for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(low)), [len(t) for t in low])
    letter = _letter(points)
    lettered = np.bincount(text[letter], minlength=len(low)) > 0
    points = np.where(letter, points, 0)
    keep = letter.copy()
    keep[1:] |= letter[:-1] | (text[1:] != text[:-1])
    if len(keep):
        keep[0] = True
    points, text = points[keep].astype(np.uint64) + _U(1), text[keep]
    rows, columns = [], []
    for order in ORDERS:
        n = len(points) - order + 1
        if n <= 0:
            continue
        value = np.zeros(n, np.uint64)
        for i in range(order):
            value = value * _U(0x110003) + points[i : n + i]
        inside = text[:n] == text[order - 1 :]
        rows.append(text[:n][inside])
        columns.append((mix(value[inside] + _U(order << 60)) % _U(COLUMNS)).astype(np.int64))
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), lettered
    row, column = np.concatenate(rows), np.concatenate(columns)
    order = np.argsort(row, kind="stable")
    return row[order], column[order], lettered


@dataclass
class Model:
    """Languages in alphabetical order, log probabilities of columns by language, and log shares of the languages."""

    languages: list[str]
    log: np.ndarray
    prior: np.ndarray

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Likeliest language of each text and its posterior probability; ties go to the first name."""
        row, column, lettered = grams(texts)
        if not self.languages:
            return [NONE] * len(texts), np.zeros(len(texts))
        total = np.zeros((len(texts), len(self.languages)))
        if len(row):
            at, _ = exchange.runs(row)
            total[row[at]] = np.add.reduceat(self.log[column], at, axis=0, dtype=np.float64)
        total += self.prior
        best = total.argmax(1)
        share = np.exp(total - total.max(1, keepdims=True))
        score = 1 / share.sum(1)
        return [self.languages[b] if ok else NONE for b, ok in zip(best, lettered)], np.where(lettered, score, 0.0)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: dict[str, np.ndarray] = {}
    for batch in batches:
        names = batch.column(0).to_pylist()
        for a, b, _, _ in slices(batch.column(1), BYTES):
            row, column, _ = grams(batch.column(1).slice(a, b - a).to_pylist())
            for name in set(names[a:b]):
                mine = np.array([n == name for n in names[a:b]])
                seen.setdefault(name, np.zeros(COLUMNS, np.int64))
                seen[name] += np.bincount(column[mine[row]], minlength=COLUMNS)
    for name, count in seen.items():
        found = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(found), pa.string()), "place": pa.array(found, pa.int32()), "n": pa.array(count[found], pa.int64())})


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Model of the rows (``key``, ``text``, ``lang``) that have a text and a language; about ``sample`` rows of each.

    The rows of a language are taken whose hash of key and language is below a share of the range of hashes, the same
    rows at every run. What reaches the driver is bounded by columns times languages.
    """
    usable = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    totals = {r[0]: r[1] for r in usable.groupBy("lang").count().collect()}  # a row a language
    if not totals:
        return Model([], np.zeros((COLUMNS, 0), np.float32), np.zeros(0))
    shares = F.create_map(*[F.lit(x) for name, n in totals.items() for x in (name, min(1.0, sample / n))])
    drawn = F.pmod(F.xxhash64("key", "lang"), F.lit(1 << 30)) < shares[F.col("lang")] * (1 << 30)
    chosen = usable.where(drawn).select("lang", "text").repartition(TASKS)
    counts = chosen.mapInArrow(_counts, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(set(counts.column("lang").to_pylist()))
    table = np.zeros((COLUMNS, len(languages)))
    where = {name: i for i, name in enumerate(languages)}
    table[counts.column("place").to_numpy(), [where[x] for x in counts.column("lang").to_pylist()]] = counts.column("n").to_numpy()
    log = np.log((table + SMOOTHING) / (table.sum(0) + SMOOTHING * COLUMNS))
    prior = np.log([totals[x] for x in languages]) - math.log(sum(totals[x] for x in languages)) if languages else np.zeros(0)
    return Model(languages, log.astype(np.float32), prior)


def predict(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """``row`` (all columns of the input as a struct), ``lang_pred`` and ``score`` of every row.

    ``und`` with score 0 if the text is null or has no letter, or if there was nothing to learn from. Rows are independent
    of one another; repeated rows and extra columns stay as they are, whatever their names.
    """
    exchange.small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).field(text_column)
            texts = texts.fill_null("") if texts.null_count else texts
            names, scores = [], []
            for a, b, _, _ in slices(texts, BYTES):
                name, score = sent.value.predict(texts.slice(a, b - a).to_pylist())
                names += name
                scores.append(score)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())],
                ["row", "lang_pred", "score"],
            )

    rows = docs.select(F.struct("*").alias("row"))
    return rows.mapInArrow(run, T.StructType([rows.schema["row"]]).add("lang_pred", "string").add("score", "double"))


def held_out(key: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether a row is kept from learning: the remainder of the crc32 of its key as text; rows without a key are kept out."""
    return F.coalesce(F.crc32(key.cast("string")) % folds == fold, F.lit(True))
