"""Words of many texts at once, as NumPy arrays over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text worked on at a time; a longer text is worked on alone.
CHUNK_BYTES = 1 << 20

ASCII_SPACE = np.zeros(256, dtype=bool)
ASCII_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# Everything ASCII that is no letter; bytes of other characters count as letters.
NO_LETTER = np.zeros(256, dtype=bool)
NO_LETTER[:128] = [not chr(i).isalpha() for i in range(128)]
SAME = np.arange(256, dtype=np.uint8)
LOWER = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], dtype=np.uint8)

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every bit of 64-bit words (splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse, kept for the next chunk of usual size."""
    if len(_POWERS[0]) >= n:
        return _POWERS[0], _POWERS[1]
    n += -n % (1 << 18)
    up, down = np.full(n, _BASE, np.uint64), np.full(n, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    found = np.cumprod(up, out=up), np.cumprod(down, out=down)
    if n <= 2 * CHUNK_BYTES:
        _POWERS[:] = found
    return found


@dataclass
class Words:
    """Words of some texts in order: hash, first and end byte in ``data``, and each text's first word."""

    data: np.ndarray
    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # one more entry than texts
    text_start: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def split_words(texts: list[bytes | None], delimiter: np.ndarray = ASCII_SPACE, fold: np.ndarray = SAME) -> Words:
    """Maximal runs of bytes that are no delimiter, with a 64-bit hash of each; None has no words.

    A word's hash is the polynomial of its folded bytes, from prefix sums, so no word is visited in Python.
    """
    joined = np.frombuffer(b"\n".join([b"", *[t or b"" for t in texts], b""]), dtype=np.uint8)
    sizes = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    text_start = np.concatenate([[0], np.cumsum(sizes + 1)]) + 1
    word = ~delimiter[joined]
    edges = np.flatnonzero(word[1:] != word[:-1]) + 1
    start, end = edges[0::2], edges[1::2]
    up, down = _powers(len(joined))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[fold[joined]] * up[: len(joined)])])
    hashes = mix((sums[end] - sums[start]) * down[start])
    return Words(joined, hashes, start, end, np.searchsorted(start, text_start), text_start)


def shingles(words: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of each run of ``width`` words; a shorter text with words is one shingle, with its length mixed in."""
    n, counts, owner = len(words.hashes), words.counts, words.owner
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    factor = [np.uint64((_BASE * (2 * k + 3)) & _MASK) for k in range(width)]
    padded = np.concatenate([words.hashes, np.zeros(width, np.uint64)])
    left = words.first[1:][owner] - np.arange(n)  # words from here to the text's end
    total = np.zeros(n, np.uint64)
    for k in range(width):
        part = padded[k:n + k] * factor[k]
        total += np.where(left > k, part, np.uint64(0)) if k else part
    short = np.minimum(counts[owner], width)
    keep = (left >= width) | (np.arange(n) == words.first[:-1][owner])
    return mix(total + short.astype(np.uint64))[keep], owner[keep]


def distinct_sets(hashes: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of every text, one after the other, and each text's first entry; ``owner`` ascends."""
    h, cuts = hashes.copy(), np.searchsorted(owner, np.arange(texts + 1))
    for a, b in zip(cuts.tolist(), cuts[1:].tolist()):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    return h[keep], np.searchsorted(owner[keep], np.arange(texts + 1))


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text",
                most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Slices of Arrow batches with about ``most`` bytes of text each, at least one row."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes) // most
        cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(sizes)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                piece = batch.slice(a, b - a)
                yield piece, piece.column(piece.schema.get_field_index(column)).to_pylist()


def over_texts(fn: Callable[[pa.RecordBatch, list[bytes | None]], pa.RecordBatch], column: str = "text"):
    """A mapInArrow function that applies ``fn`` to bounded slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece, texts in text_chunks(batches, column):
            yield fn(piece, texts)

    return run
