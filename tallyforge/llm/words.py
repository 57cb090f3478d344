"""Words of whole texts as numpy arrays, taken straight from Arrow's text buffers.

A word is a run of bytes other than space and 0x09-0x0D. These bytes occur in no multi-byte character, so runs of
bytes are runs of characters. Texts are handled in slices of a few MB, which bounds memory; a slice holds whole texts.
Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000

_U = np.uint64
_BASE, _BASE_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_CHAIN, _CHAIN_INVERSE = 0xD6E8FEB86659FD93, pow(0xD6E8FEB86659FD93, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatter 64-bit values (finalizer of SplitMix64, public domain)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64)) | _U(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first n powers of a base modulo 2^64; kept, and made longer on demand."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, 1 << 16), base, np.uint64)
        have[0] = 1
        _powers[base] = have = np.multiply.accumulate(have)
    return have[:n]


def _sums(values: np.ndarray, base: int) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.multiply(values, powers(base, len(values)), out=total[1:])
    np.cumsum(total[1:], out=total[1:])
    return total


@dataclass
class Words:
    """Words of one slice of texts. ``first[d]`` is the index of the first word of text d; it has one entry more."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Index of the first word and hash of every run of ``size`` words inside one text."""
        n = len(self.hash)
        if n < size:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        total = _sums(self.hash, _CHAIN)
        at = np.arange(n - size + 1)
        text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        at = at[text[at] == text[at + size - 1]]
        return at, mix((total[at + size] - total[at]) * powers(_CHAIN_INVERSE, n + 1)[at] + _U(size))

    def whole(self, d: int) -> np.uint64:
        """Hash of all words of text d as one run."""
        own = self.hash[self.first[d] : self.first[d + 1]]
        return mix(np.array([(own * powers(_CHAIN, len(own))).sum() + _U(len(own))], np.uint64))[0]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of rows of at most ``limit`` bytes (or one text), with their bytes and offsets."""
    offsets, data = buffers(texts)
    at, n = 0, len(texts)
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a text column."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def words_of(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    """Words of a slice; ``lower`` lets A-Z count as a-z."""
    # Bytes below 9 wrap around, so one comparison tells 9 to 13; a table of all bytes takes longer.
    shown = (data != 32) & (data - np.uint8(9) > 4)
    begins, ends = shown.copy(), shown.copy()
    begins[1:] &= ~shown[:-1]
    ends[:-1] &= ~shown[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    begins[inner] |= shown[inner]
    ends[inner - 1] |= shown[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    total = _sums((_BYTE_LOWER if lower else _BYTE).take(data, mode="clip"), _BASE)
    hashes = mix((total[end] - total[start]) * powers(_BASE_INVERSE, len(data) + 1)[start])
    return Words(data, start, end, np.searchsorted(start, offsets), hashes)
