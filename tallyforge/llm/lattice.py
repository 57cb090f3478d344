"""Scores of whole texts under a model of words and subwords, and under add-0.1 word counts.

The subword model takes the pieces of an existing vocabulary and their scores. A word is a lattice: every way to cut it
into pieces (bytes where no piece fits) is a path, and the forward recursion in log space adds up the probabilities of all
paths. The scores of the vocabulary, ranks here, weight the pieces (one over the rank, made to add up to one): that is ``score``. As no piece goes beyond a word, the
probability of a document is the product over its words and its end; how often a word is the last comes from training documents.

``adapted_score`` is the same recursion with other weights: expected counts of the pieces, in one pass over all training words under the
weights above. In it training words themselves are one more arc each, with their own frequency; its share is one less the share of words seen once
(Good and Turing).

Words meet in Spark by their hash. Frequent words, a bounded list, are scored where the documents are read; all other
words of a document ask the range of the lexicon that has them, and the answers are summed by document.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import exchange
from tallyforge.llm.words import slices, words_of
from tallyforge.session import stage

#: Smoothing of the word counts.
ADDED = 0.1
#: Words held by a task before it sends them on.
HELD = 1_500_000
#: Words that are scored where documents are read; bounds what is broadcast (40 bytes each).
FREQUENT = 1 << 17
#: Weight of the first piece probabilities, in pieces, against the expected counts.
PRIOR = 1_000.0
#: Groups in which expected counts are added up before they reach the driver, 8 bytes a piece and group.
SLOTS = 16

START = "▁"
_U = np.uint64
_END = _U(0x9B1A615F1E3D7C25)  # stands for the end of a document, of which there is no word


class Pieces:
    """The pieces of a sentencepiece file with log probabilities."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        ids = [i for i in range(size) if not model.is_control(i) and not model.is_unknown(i)]
        worst = min(s for s in map(model.get_score, ids) if s > -1e8)
        self.size = size
        self.first = np.zeros(size)
        self.id: dict[str, int] = {}
        self.byte = [0] * 256
        for i in ids:
            text = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(text[3:-1], 16)] = i
                self.first[i] = 1 / (1 - worst)
            elif START not in text[1:]:
                self.id[text] = i
                self.first[i] = 1 / (1 - max(model.get_score(i), worst))
        self.first /= self.first.sum()
        #: Pieces, and None for what only begins one: a text that is neither is begun by no piece.
        self.begun: dict[str, tuple[int] | None] = {text[:i]: None for text in self.id for i in range(1, len(text))}
        self.begun.update((text, (i,)) for text, i in self.id.items())
        self.use(self.first)

    def use(self, share: np.ndarray) -> None:
        """Take these probabilities of the pieces."""
        self.log = np.log(np.maximum(share, 1e-300)).tolist()
        self.weight = {text: parts and self.log[parts[0]] for text, parts in self.begun.items()}

    def spelled(self, letter: str) -> tuple[int, ...]:
        """The bytes of a letter, as pieces."""
        return tuple([self.byte[x] for x in letter.encode("utf-8", "surrogatepass")])

    def arcs(self, word: str) -> tuple[int, list[list[tuple[int, float, tuple[int, ...]]]]]:
        """For each end in the marked word: (start, log probability, pieces) of the arcs that end there."""
        text = START + word
        n = len(text)
        into: list[list] = [[] for _ in range(n + 1)]
        begun, log = self.begun, self.log
        for a in range(n):
            for b in range(a + 1, n + 1):
                parts = begun.get(text[a:b], ())
                if parts:
                    into[b].append((a, log[parts[0]], parts))
                else:
                    if b == a + 1:
                        spelled = self.spelled(text[a])
                        into[b].append((a, sum([log[i] for i in spelled]), spelled))
                    if parts is not None:
                        break
        return n, into

    def forward(self, n: int, into: list) -> list[float]:
        """Log of the sum over all paths, up to each place."""
        at = [0.0] * (n + 1)
        for b in range(1, n + 1):
            terms = [at[a] + w for a, w, _ in into[b]]
            if len(terms) == 1:
                at[b] = terms[0]
            else:
                top = max(terms)
                at[b] = top + math.log(sum([math.exp(t - top) for t in terms]))
        return at

    def marginal(self, word: str) -> float:
        """Natural logarithm of the probability of a word over all its segmentations: :meth:`forward`, with the arcs of a place made when it is reached."""
        text = START + word
        n = len(text)
        terms: list[list[float]] = [[] for _ in range(n + 1)]
        weight, log, exp, at = self.weight, self.log, math.exp, 0.0
        for a in range(n):
            for b in range(a + 1, n + 1):
                w = weight.get(text[a:b], 1.0)  # no logarithm of a probability is above 0
                if w is not None and w <= 0:
                    terms[b].append(at + w)
                else:
                    if b == a + 1:
                        terms[b].append(at + sum([log[i] for i in self.spelled(text[a])]))
                    if w is not None:
                        break
            found = terms[a + 1]
            if len(found) == 1:
                at = found[0]
            else:
                top = max(found)
                at = top + math.log(sum([exp(t - top) for t in found]))
        return at

    def expect(self, word: str, weight: float, counts: np.ndarray) -> float:
        """Add the expected numbers of the pieces of a word that occurs ``weight`` times; returns its marginal."""
        n, into = self.arcs(word)
        at = self.forward(n, into)
        back = [-math.inf] * (n + 1)
        back[n] = 0.0
        total = at[n]
        for b in range(n, 0, -1):
            if back[b] == -math.inf:
                continue
            for a, w, parts in into[b]:
                here = w + back[b]
                share = weight * math.exp(at[a] + here - total)
                for i in parts:
                    counts[i] += share
                old = back[a]
                if old < here:
                    old, here = here, old
                back[a] = old + math.log1p(math.exp(here - old))
        return total


_pieces: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    """The pieces of this worker for a file; read once."""
    if path not in _pieces:
        _pieces[path] = Pieces(path)
    return _pieces[path]


def _words_out(parts: int):
    """Packed distinct words with their counts in training documents."""

    def pack(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        key, count = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        size = np.concatenate([h[2] for h in held])
        body = np.frombuffer(b"".join(h[3] for h in held), np.uint8)
        start = np.cumsum(size) - size
        order = np.argsort(key, kind="stable")
        at, _ = exchange.runs(key[order])
        count = np.add.reduceat(count[order], at)
        lead = order[at]
        key, size, start = key[lead], size[lead], start[lead]
        where, blobs = [], []
        for part, a, b in exchange.cut(key, parts):
            where.append(part)
            blobs.append(_lexicon_bytes(key[a:b], count[a:b], np.zeros(0), size[a:b], _gather(body, start[a:b], size[a:b])))
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            learn = ~batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
            for a, b, data, offsets in slices(batch.column(1)):
                words = words_of(data, offsets, lower=True)
                if learn[a:b].any():
                    ends = int(learn[a:b].sum())
                    held.append((np.array([_END]), np.array([ends]), np.zeros(1, np.int64), b""))
                if len(words.hash):
                    order = np.argsort(words.hash, kind="stable")
                    at, _ = exchange.runs(words.hash[order])
                    taught = np.repeat(learn[a:b], np.diff(words.first)).astype(np.int64)
                    lead = order[at]
                    length = words.end[lead] - words.start[lead]
                    held.append((words.hash[lead], np.add.reduceat(taught[order], at), length, _gather(data, words.start[lead], length)))
                    size += len(lead)
            if size >= HELD // 4:
                yield from pack(held)
                held, size = [], 0
        yield from pack(held)

    return run


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
    """Bytes of many places, one after the other."""
    total = int(size.sum())
    return data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(total)].tobytes()


def _lexicon_bytes(key: np.ndarray, count: np.ndarray, value: np.ndarray, size: np.ndarray, body: bytes) -> bytes:
    """Words with their counts, and their marginals once these are known."""
    return b"".join(
        [np.array([len(key), len(value)], "<u4").tobytes(), exchange.planes(key), exchange.planes(count.astype(np.int64)), value.tobytes(), exchange.planes(size.astype("<u4")), body]
    )


def _lexicon_from(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, valued = np.frombuffer(data[:8], "<u4").tolist()
    cuts = np.cumsum([8, 8 * n, 8 * n, 8 * valued, 4 * n])
    parts = [data[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
    key, count, size = (exchange.from_planes(part, kind) for part, kind in zip((parts[0], parts[1], parts[3]), ("u8", "i8", "u4")))
    return key, count, np.frombuffer(parts[2], "f8"), size.astype(np.int64), np.frombuffer(data[cuts[-1] :], np.uint8)


def _text(body: np.ndarray, start: int, size: int) -> str:
    """A word with A-Z as a-z."""
    return body[start : start + size].tobytes().lower().decode("utf-8", "replace")


LEXICON = "part int, words binary, tokens long, distinct long, once long, levels array<long>, expected binary"


def _lexicon(path: str):
    """Words of a range with their counts and marginals, sums over them, and expected counts of pieces."""

    def run(table: pa.Table) -> pa.Table:
        found = [_lexicon_from(b.as_py()) for b in table.column("blob")]
        key, count, size, body = (np.concatenate([f[i] for f in found]) for i in (0, 1, 3, 4))
        start = np.cumsum(size) - size
        order = np.argsort(key, kind="stable")
        at, _ = exchange.runs(key[order])
        count, lead = np.add.reduceat(count[order], at), order[at]
        key, size, start = key[lead], size[lead], start[lead]
        own, expected = pieces(path), np.zeros(pieces(path).size)
        own.use(own.first)
        value = np.zeros(len(key))
        for i in np.flatnonzero(key != _END):
            word = _text(body, start[i], size[i])
            value[i] = own.expect(word, float(count[i]), expected) if count[i] else own.marginal(word)
        levels = np.bincount(np.frexp(count.astype(float))[1], minlength=64)
        return pa.table(
            {
                "part": table.column("part").slice(0, 1).cast(pa.int32()),
                "words": pa.array([_lexicon_bytes(key, count, value, size, _gather(body, start, size))], pa.binary()),
                "tokens": pa.array([int(count.sum())]), "distinct": pa.array([int((count > 0).sum())]),
                "once": pa.array([int((count == 1).sum())]),
                "levels": pa.array([levels.tolist()], pa.list_(pa.int64())), "expected": pa.array([expected.tobytes()], pa.binary()),
            }
        )

    return run


def _added(table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(b.as_py()) for b in table.column("expected"))
    return pa.table({"expected": pa.array([total.tobytes()], pa.binary())})


def _valued(path: str, model):
    """(hash, count, marginal, marginal under the expected counts) of the words of a range, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, (share, least) = pieces(path), model.value
        own.use(share)
        for batch in batches:
            for part, blob in zip(batch.column(0), batch.column(1)):
                key, count, value, size, body = _lexicon_from(blob.as_py())
                start = np.cumsum(size) - size
                adapted = np.array([0.0 if k == _END else own.marginal(_text(body, s, n)) for k, s, n in zip(key, start, size)], float)
                top = count >= least
                packed = [b"".join(column[chosen].tobytes() for column in (key, count, value, adapted)) for chosen in (slice(None), top)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()], pa.int32()), pa.array(packed[:1], pa.binary()), pa.array(packed[1:], pa.binary())], ["part", "words", "top"]
                )

    return run


def _values(data: bytes) -> list[np.ndarray]:
    n = len(data) // 32
    return [np.frombuffer(data[8 * n * i : 8 * n * (i + 1)], kind) for i, kind in enumerate(_KINDS)]


_KINDS = ("u8", "i8", "f8", "f8")


class Model:
    """What scoring needs besides words: sums over the training words."""

    def __init__(self, tokens: int, distinct: int, once: int, ends: int):
        self.tokens, self.distinct = tokens, distinct
        self.end = ends / tokens if tokens else 1.0
        self.words = 1 - (once / tokens if tokens else 1.0)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + ADDED) / (self.tokens + ADDED * (self.distinct + 1)))

    def score(self, marginal: np.ndarray) -> np.ndarray:
        """log10 of the probability of words over all their segmentations, none being the end."""
        return marginal / math.log(10) + math.log10(max(1 - self.end, 1e-300))

    def adapted(self, count: np.ndarray, marginal: np.ndarray) -> np.ndarray:
        """log10 of the probability of words, over the arc of the word itself and all paths of pieces."""
        with np.errstate(divide="ignore"):
            whole = np.log(self.words * count / max(self.tokens, 1))
            paths = np.log((1 - self.words) * (1 - self.end)) + marginal
        return np.maximum(np.logaddexp(whole, paths), -1e6) / math.log(10)

    def end_score(self) -> float:
        return math.log10(max(self.end, 1e-300))


ASKED = "part int, row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, adapted double, blob binary"
_ASKED = ["part", "row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "adapted", "blob"]
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.binary()]


def _scored(parts: int, model: Model, top):
    """Sums over the frequent words of each document, and packed questions about the others."""

    def pack(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        key, row, times = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((row, key))
        key, row, times = key[order], row[order], times[order]
        where, blobs = [], []
        for part, a, b in exchange.cut(key, parts):
            where.append(part)
            blobs.append(exchange.planes(key[a:b]) + exchange.planes(row[a:b]) + exchange.planes(times[a:b].astype("<u4")))
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), *(pa.nulls(len(where), t) for t in _TYPES[1:-1]), pa.array(blobs, pa.binary())], _ASKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, base, score, adapted = top.value
        held, size = [], 0
        for batch in batches:
            row, doc, out, texts = batch.columns
            row = row.to_numpy()
            for a, b, data, offsets in slices(texts):
                words = words_of(data, offsets, lower=True)
                text = np.repeat(np.arange(b - a), np.diff(words.first))
                at = np.searchsorted(keys, words.hash) if len(keys) else np.zeros(len(text), np.int64)
                at[at == len(keys)] = 0
                hit = keys[at] == words.hash if len(keys) else np.zeros(len(text), bool)
                own, place = text[hit], at[hit]
                sums = [np.bincount(own, weights=w[place], minlength=b - a) for w in (base, score, adapted, counts > 0)]
                number = np.diff(words.first) + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row[a:b] % parts, pa.int32()), pa.array(row[a:b]), doc.slice(a, b - a), out.slice(a, b - a), pa.array(number, pa.int64()),
                        pa.array(sums[3].astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2]), pa.nulls(b - a, pa.binary()),
                    ],
                    _ASKED,
                )
                rest, text = words.hash[~hit], text[~hit]
                if len(rest):
                    order = np.lexsort((rest, text))
                    rest, text = rest[order], text[order]
                    new = np.flatnonzero(np.r_[True, (rest[1:] != rest[:-1]) | (text[1:] != text[:-1])])
                    held.append((rest[new], row[a:b][text[new]], np.diff(np.r_[new, len(rest)])))
                    size += len(new)
            if size >= HELD:
                yield from pack(held)
                held, size = [], 0
        yield from pack(held)

    return run


ANSWERED = "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double, adapted double"


def _answered(model: Model):
    """Sums over the words of a range for every document that asked; those made before pass through."""

    def run(key, asked: pa.Table, lexicon: pa.Table) -> pa.Table:
        told = asked.filter(asked.column("blob").is_null()).drop_columns(["part", "blob"])
        questions: list[list[np.ndarray]] = [[], [], []]
        for blob in asked.column("blob"):
            if blob.is_valid:
                data = blob.as_py()
                n = len(data) // 20
                for values, new in zip(
                    questions, (exchange.from_planes(data[: 8 * n], "u8"), exchange.from_planes(data[8 * n : 16 * n], "i8"), exchange.from_planes(data[16 * n :], "u4"))
                ):
                    values.append(new)
        if not questions[0]:
            return told
        word, row, times = (np.concatenate(q) for q in questions)
        keys, counts, marginal, adapted = _values(lexicon.column("words")[0].as_py())
        at = np.searchsorted(keys, word)  # every word of a document is in the lexicon
        order = np.argsort(row, kind="stable")
        begin, _ = exchange.runs(row[order])
        sums = [np.add.reduceat((times * v[at])[order], begin) for v in (counts > 0, model.base(counts), model.score(marginal), model.adapted(counts, adapted))]
        n = len(begin)
        return pa.concat_tables(
            [
                told,
                pa.table(
                    {
                        "row": row[order][begin], "doc_id": pa.nulls(n, pa.int64()), "held_out": pa.nulls(n, pa.bool_()), "n_tokens": pa.nulls(n, pa.int64()),
                        "known": sums[0].astype(np.int64), "base": sums[1], "score": sums[2], "adapted": sums[3],
                    }
                ),
            ]
        )

    return run


def score(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, adapted_score`` of every row; logarithms to base 10.

    Learns from rows whose crc32 of the id as text is not 0 modulo 10; rows without an id are held out. Tokens are words
    with A-Z as a-z, and one end for every row, also for null and empty texts. Each row is scored by itself: repeated rows
    count as often as they occur. Extra columns are not looked at. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    exchange.small_batches(spark)
    parts = exchange.range_count(spark)
    held_out = F.coalesce(F.crc32(F.col(id_column).cast("long").cast("string")) % 10 == 0, F.lit(True))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("doc_id"), held_out.alias("held_out"),
        F.col(text_column).alias("text"),
    )
    lexicon = stage(
        rows.select("held_out", "text").mapInArrow(_words_out(parts), "part int, blob binary").groupBy("part").applyInArrow(_lexicon(path), LEXICON),
        "word-counts",
    )
    sums = lexicon.agg(F.sum("tokens"), F.sum("distinct"), F.sum("once"), *(F.sum(F.col("levels")[i]) for i in range(64))).first()
    levels = [x or 0 for x in sums[3:]]
    least, total = 64, 0
    while least > 1 and total + levels[least - 1] <= FREQUENT:
        least -= 1
        total += levels[least]
    slots = lexicon.select(F.pmod("part", F.lit(SLOTS)).alias("slot"), "expected").groupBy("slot").applyInArrow(_added, "expected binary")
    own = Pieces(path)
    expected = own.first * PRIOR + sum((np.frombuffer(r[0]) for r in slots.collect()), np.zeros(own.size))  # SLOTS rows
    share = spark.sparkContext.broadcast((expected / expected.sum(), 1 << (least - 1)))
    valued = stage(lexicon.select("part", "words").mapInArrow(_valued(path, share), "part int, words binary, top binary"), "word-values")
    found = [_values(r[0]) for r in valued.select("top").collect()]  # FREQUENT words at most
    frequent = [np.concatenate([f[i] for f in found]) if found else np.empty(0, kind) for i, kind in enumerate(_KINDS)]
    order = np.argsort(frequent[0])
    keys, counts, marginal, adapted = (column[order] for column in frequent)
    ends = int(counts[keys == _END].sum())
    if not ends and sums[0]:
        ends = rows.where("NOT held_out").count()
    model = Model(sums[0] or 0, sums[1] or 0, sums[2] or 0, ends)
    top = spark.sparkContext.broadcast((keys, counts, model.base(counts), model.score(marginal), model.adapted(counts, adapted)))
    asked = rows.mapInArrow(_scored(parts, model, top), ASKED)
    answers = asked.groupBy("part").cogroup(valued.select("part", "words").groupBy("part")).applyInArrow(_answered(model), ANSWERED)
    end_base = float(model.base(np.array([ends]))[0])
    return answers.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        (F.sum("known") + int(ends > 0)).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.sum("base") + end_base).alias("base_score"), (F.sum("score") + model.end_score()).alias("score"),
        (F.sum("adapted") + model.end_score()).alias("adapted_score"),
    ).drop("row")
