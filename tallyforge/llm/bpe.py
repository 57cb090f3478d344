"""Encoding and decoding with byte-pair vocabularies, by forced boundaries.

A pair of neighbouring bytes that occurs inside no token of the vocabulary can be joined by no merge, so a word may
be cut there before anything is known about its merges. The fragments between such cuts are encoded independently and
their ids are joined; fragments recur far more often than words, and words more often than texts, so both are kept.

Texts are taken apart at single spaces and line ends first, which the tokenizer drops anyway. Normalising and splitting
follow the library: directly for Latin letters, digits and punctuation, through the library's own parts for other
characters. Pieces with the text of a special token go to the library whole.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from operator import add
from string import punctuation

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from tallyforge.llm import exchange

#: Words kept by a worker, in each of two generations.
KEPT = 150_000
#: Fragments, and words that stand inside longer ones, kept beside them.
KEPT_PARTS = 50_000
#: Documents encoded at a time.
ROWS = 200

#: Marks that follow words; an apostrophe may belong to them.
_TAIL = punctuation.replace("'", "")

#: Characters before this one are composed already, and Python and the library agree on their lower case.
LATIN_END = chr(0x130)


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if it is printable, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Kept(dict):
    """Ids (as bytes) of pieces of text; two generations, the older is dropped when the newer is full."""

    def __init__(self, coder: Coder, older: dict | None = None):
        super().__init__()
        self.coder, self.older = coder, older or {}

    def __missing__(self, piece: str) -> bytes:
        found = self.older.get(piece)
        if found is None:
            found = self.coder.piece(piece)
        self[piece] = found
        return found


class Coder:
    """A vocabulary file of the tokenizers library with word ends, ready to encode."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        model = described["model"]
        self.end = model["end_of_word_suffix"]
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        # Words are kept here, so the models need not keep them as well.
        self.last = models.BPE(vocab=model["vocab"], merges=merges, end_of_word_suffix=self.end, cache_capacity=0)
        self.inner = models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0)
        size = 1 + max([*model["vocab"].values(), *(t["id"] for t in described["added_tokens"])])
        self.tokens = [""] * size
        for text, i in [*model["vocab"].items(), *((t["content"], t["id"]) for t in described["added_tokens"])]:
            self.tokens[i] = text
        self.special = [t["content"] for t in described["added_tokens"]]
        self.mark = os.path.commonprefix(self.special)
        self.kind, self.code = (np.dtype("<u2"), "H") if size <= 1 << 16 else (np.dtype("<u4"), "I")
        self.letters = byte_letters()
        self.shown = "".join(self.letters[b] for b in range(256))
        self.split = regex.compile(described["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        # Pairs of letters inside tokens; at the end of a word the second letter carries the mark.
        self.pairs, self.last_pairs = set(), set()
        for text in model["vocab"]:
            body = text.removesuffix(self.end)
            whole = body is not text and len(body) < len(text)
            self.pairs.update(body[i : i + 2] for i in range(len(body) - 1 - whole))
            if whole and len(body) > 1:
                self.last_pairs.add(body[-2:])
        self.odd = self._odd_letters()
        self.tails: dict[str, bytes] = {}
        self.fragments: dict = {}
        self.kept = Kept(self)

    def _odd_letters(self) -> set[str]:
        """Letters without which every pair of letters of the vocabulary is in ``pairs``: a word with none of them is cut nowhere but at its end."""
        letters = sorted({letter for pair in self.pairs for letter in pair})
        lacking = np.array([[a + b not in self.pairs for b in letters] for a in letters], bool).reshape(len(letters), -1)
        left = np.ones(len(letters), bool)
        while (missing := (lacking[:, left].sum(1) + lacking[left].sum(0)) * left).any():
            left[missing.argmax()] = False
        return set(self.letters.values()).difference(letter for letter, stays in zip(letters, left) if stays)

    def fragment(self, letters: str, last: bool = True) -> bytes:
        """Ids of a fragment; ``last`` if it ends its word."""
        tokens = (self.last if last else self.inner).tokenize(letters)
        return array(self.code, [t.id for t in tokens]).tobytes()

    def word(self, letters: str) -> bytes:
        """Ids of a word given by the letters of its bytes: cut at forced boundaries, encoded, joined."""
        found = self.fragments.get(letters)
        if found is None:
            # A word that occurred by itself is kept as such; only letters whose bytes they are can be looked up there.
            found = self.kept.get(letters) if letters.isascii() and letters.isalpha() else None
            if found is None:
                found = self.cut(letters)
            if len(self.fragments) >= KEPT_PARTS:
                self.fragments.clear()
            self.fragments[letters] = found
        return found

    def cut(self, letters: str) -> bytes:
        """Ids of a word that is not known yet."""
        pairs, end = self.pairs, len(letters) - 1
        whole = not end or letters[-2:] in self.last_pairs
        if whole and (self.odd.isdisjoint(letters) or pairs.issuperset(map(add, letters[:-2], letters[1:-1]))):
            return array(self.code, [t.id for t in self.last.tokenize(letters)]).tobytes()
        cuts = [i for i in range(1, end) if letters[i - 1 : i + 1] not in pairs] + [end] * (not whole)
        out = []
        for a, b in zip([0, *cuts], cuts):
            part = letters[a:b]
            found = self.fragments.get((part, False))
            if found is None:
                found = self.fragments[part, False] = self.fragment(part, False)
            out.append(found)
        return b"".join(out) + self.word(letters[cuts[-1] :])

    def piece(self, piece: str) -> bytes:
        """Ids of a piece of text without spaces and line ends."""
        ascii_only = piece.isascii()
        if ascii_only and piece.isalpha():
            if not piece.islower():
                return self.word(piece.lower())
            found = self.fragments.get(piece)
            return self.cut(piece) if found is None else found
        if self.mark in piece and any(s in piece for s in self.special):
            return array(self.code, self.library.encode(piece, add_special_tokens=False).ids).tobytes()
        if piece.isprintable() and (ascii_only or max(piece) < LATIN_END):
            piece = piece.lower()
            stem = piece.rstrip(_TAIL)
            # Letters with marks after them are most of what is not a bare word.
            if stem.isalpha():
                word = self.word(stem if ascii_only else stem.encode().decode("latin-1").translate(self.shown))
                return word + self.tail(piece[len(stem) :]) if len(stem) < len(piece) else word
            words = self.split.findall(piece)
            return b"".join(map(self.word, words if ascii_only else [w.encode().decode("latin-1").translate(self.shown) for w in words]))
        piece = self.library.normalizer.normalize_str(piece)
        return b"".join(self.word(w) for w, _ in self.library.pre_tokenizer.pre_tokenize_str(piece))

    def tail(self, tail: str) -> bytes:
        """Ids of marks that follow letters."""
        found = self.tails.get(tail)
        if found is None:
            if len(self.tails) >= KEPT_PARTS:
                self.tails.clear()
            found = self.tails[tail] = b"".join(map(self.word, self.split.findall("a" + tail)[1:]))
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text, as bytes of ``kind``."""
        if not text:
            return b""
        if len(self.kept) > KEPT:
            self.kept.older = {}
            self.kept = Kept(self, self.kept)
        return b"".join(map(self.kept.__getitem__, text.replace("\n", " ").split(" ")))

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: their tokens joined by spaces, as the library does without a decoder."""
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


_coders: dict[str, Coder] = {}


def coder(path: str) -> Coder:
    """The coder of this worker for a file; made once."""
    if path not in _coders:
        _coders[path] = Coder(path)
    return _coders[path]


def encode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id``, ``ids`` (array of int) and ``decoded`` of every row; ``path`` is the vocabulary file on every machine.

    Ids are those of the library with add_special_tokens=False, without truncation and padding; ``decoded`` is the
    library's decoding of them with special tokens. Null and empty texts have no ids and an empty decoding. Rows are
    independent of one another: repeated rows and null ids stay as they are, extra columns are not looked at.
    """
    exchange.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                coded = [np.frombuffer(own.encode(t), own.kind) for t in some.column(1).to_pylist()]
                ids = pa.array(np.concatenate(coded).astype(np.int32) if coded else [], pa.int32())
                offsets = pa.array(np.r_[0, np.cumsum([len(c) for c in coded])], pa.int32())
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": some.column(0), "ids": pa.ListArray.from_arrays(offsets, ids), "decoded": pa.array([own.decode(c) for c in coded], pa.string())}
                )

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded string")
