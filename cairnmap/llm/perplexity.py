"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model of trusted text.

Tokens are words, as 64-bit hashes; words that no trusted text has share one class of the mass that the discounts free.
A token's log probability is a sum of one term for each word, word pair and 3-gram that trusted text knows. 3-grams are dealt
by their middle word: all counts of a 3-gram, its context, its last pair and that pair's context then meet in one part, and only
the continuation count of the last word comes from elsewhere. A part holds the trusted 3-grams of its words, and the texts'
3-grams stream past them as packed arrays; a frequent middle word has a part of its own, cut into blocks by the first word.
The parts are handled in a few passes over the texts, so that only a share of the 3-grams lies on disk at a time.
A trusted text is not judged by n-grams that only its own text has. Thresholds are quantiles per language.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import reduce
from itertools import chain, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from cairnmap.llm.bytetext import mix, split_words, text_chunks
from cairnmap.llm.mixing import word_count
from cairnmap.session import discard, written

# A document's log perplexity may exceed the trusted texts' median of its language by this many times the
# distance of the median from this quantile.
QUANTILE, MARGIN = 0.99, 1.5
# Tokens of average text that every document is given, so short texts are not judged by a few tokens.
PRIOR_TOKENS = 10
# Passes over the texts at most, and trusted tokens from which on there is one more.
PASSES, PASS_TOKENS = 5, 1 << 19
# Trusted tokens per part on average, and per block of a middle word that has a part of its own.
PART_TOKENS = 1 << 17
# Tokens per task that reads packed rows, beyond which there are more tasks than cores.
TASK_TOKENS = 1 << 23
# Tokens that a task packs at a time, and of one part in a packed row.
PACKED_TOKENS, BLOB_TOKENS = 1 << 19, 1 << 16
# Bytes of texts or packed rows that a task gets at a time.
BATCH_BYTES = 1 << 22
# Texts whose sums a task holds.
HELD_SUMS = 1 << 20
# Trusted ids that are broadcast; more are joined.
BROADCAST_IDS = 1 << 22
# What stands before a text's first word and after its last.
START, END = np.uint64(0), np.uint64(1)
# Blocks of a part in the order in which they are read: continuation counts, pairs of a frequent word, 3-grams.
_KNOWN, _PAIRS = -(1 << 31), -(1 << 30)
_BLOB = "part int, block int, kind int, data binary"


def _discounts(counts: dict[int, int]) -> tuple[float, float, float]:
    """Discounts of counts 1, 2 and 3 or more from the counts of counts."""
    n1, n2, n3, n4 = (counts.get(i, 0) for i in (1, 2, 3, 4))
    if not n1 or not n2:
        return 0.5, 0.75, 0.9  # too few counts to estimate from
    y = n1 / (n1 + 2 * n2)
    found = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2.0)
    return tuple(min(max(d, 0.05), i + 0.95) for i, d in enumerate(found))


def _freed(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(n == 1, d[0], np.where(n == 2, d[1], d[2]))


def _own(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(n - _freed(n, d), 0.0)


def _folded(*hashes: np.ndarray) -> np.ndarray:
    """One key for a sequence of word hashes; sequences of different lengths have different keys."""
    total = np.full(len(hashes[-1]), len(hashes), np.uint64)
    for h in hashes:
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + h)
    return total


def _sequences(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, at, text): the places of each word and each text's start, so that words at - 1, at and at + 1 are a 3-gram, and its text."""
    w = split_words(texts)
    filled = np.flatnonzero(w.counts)
    first = np.concatenate([[0], np.cumsum(w.counts[filled] + 3)])  # START START words END
    row = np.full(first[-1], START)
    row[np.arange(len(w.hashes)) + np.repeat(3 * np.arange(len(filled)) + 2, w.counts[filled])] = w.hashes
    row[first[1:] - 1] = END
    middle = np.ones(len(row), bool)
    middle[first[:-1]] = middle[first[1:] - 1] = False
    return row, np.flatnonzero(middle), np.repeat(filled, w.counts[filled] + 1)


@dataclass(frozen=True)
class _Layout:
    """How 3-grams are dealt, and the figures of the model that every part needs."""

    parts: int
    passes: int
    hot: np.ndarray  # sorted middle words with a part of their own
    blocks: np.ndarray  # the blocks of each
    discounts: tuple = ()
    total: int = 0
    unknown: float = 1.0

    def part(self, b: np.ndarray) -> np.ndarray:
        """Each middle word's part."""
        part = ((b >> np.uint64(17)) % np.uint64(self.parts)).astype(np.int32)
        if len(self.hot):
            at, own = _found(self.hot, b)
            part[own] = self.parts + at[own]
        return part

    def block(self, part: np.ndarray, a: np.ndarray) -> np.ndarray:
        """The block of a 3-gram in its part."""
        block, own = np.zeros(len(part), np.int32), np.flatnonzero(part >= self.parts)
        block[own] = mix(a[own] + np.uint64(0x9FB21C651E98DF25)) % self.blocks[part[own] - self.parts].astype(np.uint64)
        return block

    def p1(self, n: np.ndarray) -> np.ndarray:
        return _own(n, self.discounts[0]) / max(self.total, 1) + self.unknown


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([(x.itemsize, len(x)) for x in arrays], np.int64)
    return b"".join([head.tobytes(), *[np.ascontiguousarray(x).tobytes() for x in arrays]])


def _unpack(data: bytes, n: int) -> list[np.ndarray]:
    head, at, out = np.frombuffer(data, np.int64, 2 * n), 16 * n, []
    for size, length in head.reshape(n, 2).tolist():
        out.append(np.frombuffer(data, f"u{size}", length, at))
        at += size * length
    return out


def _packed_grams(a, b, c, key, flag) -> bytes:
    """3-grams as places in the list of their words, and runs of equal (key, flag)."""
    words, code = np.unique(np.concatenate([a, b, c]), return_inverse=True)
    start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (flag[1:] != flag[:-1])]))
    return _pack(words, code.astype(np.uint16 if len(words) <= 1 << 16 else np.uint32), key[start].view(np.uint64), flag[start].view(np.uint8),
                 np.diff(np.append(start, len(key))).astype(np.uint32))


def _unpacked_grams(data: bytes) -> tuple[np.ndarray, ...]:
    """(a, b, c, key, flag, first): key and flag of each run, and each run's first 3-gram."""
    words, code, key, flag, runs = _unpack(data, 5)
    a, b, c = words[code].reshape(3, -1)
    return a, b, c, key.view(np.int64), flag.view(bool), np.concatenate([[0], np.cumsum(runs)[:-1]]).astype(np.int64)


def _blobs(parts: list[int], blocks: list[int], kinds: list[int], data: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in (parts, blocks, kinds)] + [pa.array(data, pa.binary())], names=["part", "block", "kind", "data"])


def _dealt(layout: _Layout, passes: int, at: int, kind: int, key: str, flag: str | None, pairs: bool = False):
    """A mapInArrow function: the 3-grams of a pass in packed rows; with ``pairs`` those of frequent words once more, to be read first."""

    def emptied(held: list[tuple]) -> pa.RecordBatch:
        part, block, *grams = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((block, part))
        part, block, grams = part[order], block[order], [x[order] for x in grams]
        cuts = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (block[1:] != block[:-1])]))
        out = []
        for i, j in zip(cuts.tolist(), [*cuts[1:].tolist(), len(part)]):
            for s in range(i, j, BLOB_TOKENS):
                data = _packed_grams(*[x[s:min(s + BLOB_TOKENS, j)] for x in grams])
                out.append((int(part[i]), int(block[i]), kind, data))
                if pairs and part[i] >= layout.parts:
                    out.append((int(part[i]), int(block[i]) + _PAIRS, kind, data))
        return _blobs(*map(list, zip(*out)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for piece, texts in text_chunks(batches):
            words, places, owner = _sequences(texts)
            part = layout.part(words[places])
            kept = np.flatnonzero(part % passes == at)
            part, places, owner = part[kept], places[kept], owner[kept]
            keys = piece.column(key).to_numpy(zero_copy_only=False)[owner]
            flags = piece.column(flag).to_numpy(zero_copy_only=False).astype(bool)[owner] if flag else np.ones(len(kept), bool)
            a = words[places - 1]
            held.append((part, layout.block(part, a), a, words[places], words[places + 1], keys, flags))
            size += len(kept)
            if size >= PACKED_TOKENS:
                yield emptied(held)
                held, size = [], 0
        if size:
            yield emptied(held)

    return run


@dataclass
class _Counted:
    """n-grams with one row per key, in its order: their words, count, and the least and largest hash of a text that has them."""

    key: np.ndarray
    words: list[np.ndarray]
    n: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    @property
    def sole(self) -> np.ndarray:
        return self.lo == self.hi

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each key's place and whether it is there."""
        return _found(self.key, key)


def _found(table: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(table, key), len(table) - 1)
    return at, table[at] == key


def _counted(key, words, n, lo, hi) -> _Counted:
    if not len(key):
        return _Counted(key, words, n, lo, hi)
    order = np.argsort(key, kind="stable")
    key = key[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    at = order[start]
    return _Counted(key[start], [x[at] for x in words], np.add.reduceat(n[order], start), np.minimum.reduceat(lo[order], start), np.maximum.reduceat(hi[order], start))


def _joined(tables: list[_Counted]) -> _Counted:
    if len(tables) == 1:
        return tables[0]
    both = lambda f: np.concatenate([f(t) for t in tables])
    return _counted(both(lambda t: t.key), [both(lambda t: t.words[i]) for i in range(len(tables[0].words))], both(lambda t: t.n), both(lambda t: t.lo), both(lambda t: t.hi))


_NONE = np.zeros(0, np.uint64)
_NOTHING = np.zeros(0, np.int64)


def _no_grams(width: int) -> _Counted:
    return _Counted(_NONE, [_NONE] * width, _NOTHING, _NOTHING, _NOTHING)


def _block_grams(blobs: Iterator[bytes]) -> _Counted:
    """The distinct 3-grams of a block; equal ones are joined as they come."""
    held, size = [_no_grams(3)], 0
    for data in blobs:
        a, b, c, key, _, first = _unpacked_grams(data)
        own = np.repeat(key, np.diff(np.append(first, len(a))))
        held.append(_counted(_folded(a, b, c), [a, b, c], np.ones(len(a), np.int64), own, own))
        size += len(held[-1].key)
        if size > 2 * PART_TOKENS + 2 * len(held[0].key):
            held, size = [_joined(held)], 0
    return _joined(held)


def _lower(grams: _Counted) -> tuple[_Counted, _Counted, _Counted]:
    """Last pairs with the number of words before them, middle words with the number of words before them, and first pairs, of a block."""
    a, b, c = grams.words
    on, one = np.flatnonzero(c != END), np.ones(len(a), np.int64)
    last = _counted(_folded(b[on], c[on]), [b[on], c[on]], one[on], grams.lo[on], grams.hi[on])
    front = _counted(_folded(a, b), [a, b], one, grams.lo, grams.hi)
    middle = front.words[1]
    return last, _counted(middle, [middle], np.ones(len(middle), np.int64), front.lo, front.hi), front


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, bytes]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(k)[i].as_py() for k in range(4))


def _summed_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per part: (0, -, word, words before it), (1, part, last word of a pair, 0), (2, order, count, n-grams of that count up to 4)."""
    def out(what: int, part: int, word: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(word), what, np.int32)), pa.array(np.full(len(word), part, np.int32)),
                                           pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], names=["what", "part", "word", "count"])

    def counts(order: int, n: np.ndarray) -> pa.RecordBatch:
        return out(2, order, np.arange(5), np.bincount(np.where(n > 4, 0, n), minlength=5))  # at 0 the larger ones

    for part, of_part in groupby(_rows(batches), itemgetter(0)):
        pairs, words = [_no_grams(2)], [_no_grams(1)]
        for _, blobs in groupby(of_part, itemgetter(1)):
            grams = _block_grams(x[3] for x in blobs)
            yield counts(3, grams.n[grams.words[2] != END])
            last, middle, _ = _lower(grams)
            pairs, words = [_joined([*pairs, last])], [_joined([*words, middle])]
        yield counts(2, pairs[0].n)
        here = words[0].key != START
        yield counts(1, words[0].n[here])
        yield out(0, -1, words[0].key[here], words[0].n[here])
        last = np.unique(pairs[0].words[1])
        yield out(1, part, last, np.zeros(len(last)))


def _packed_known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Continuation counts (part, word, count) in packed rows."""
    for batch in batches:
        part, word, count = (batch.column(x).to_numpy() for x in ("part", "word", "count"))
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
        rows = [(int(part[i[0]]), _KNOWN, 0, _pack(word[i].view(np.uint64), count[i])) for i in np.split(order, cuts[1:]) if len(i)]
        if rows:
            yield _blobs(*map(list, zip(*rows)))


def _summed(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    key, flag, value = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((flag, key))
    key, flag = key[order], flag[order]
    start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (flag[1:] != flag[:-1])]))
    return key[start], flag[start], np.add.reduceat(value[order], start)


def _scored(layout: _Layout, own: bool):
    """A mapInArrow function over the packed rows of whole parts: (_row, trusted, what their terms add to the text's log probability).

    With ``own`` the model's texts are judged as well, under their hash.
    """
    d1, d2, d3 = layout.discounts

    def of_words(pairs: _Counted, words: _Counted, known: tuple[np.ndarray, np.ndarray]):
        """(terms of middle words at and after them, p2 of last pairs, their terms)."""
        at, _ = words.find(pairs.words[0])
        total = np.bincount(at, pairs.n, len(words.key))
        freed = np.bincount(at, _freed(pairs.n, d2), len(words.key))
        gamma = np.where(total > 0, freed / np.maximum(total, 1), 1.0)
        end = np.where(words.key == START, 0.0, np.log(layout.p1(words.n)) - math.log(layout.unknown))
        place, there = _found(known[0], pairs.words[1])
        p1 = layout.p1(np.where(there, known[1][place], 1) if len(known[0]) else np.ones(len(place), np.int64))
        p2 = _own(pairs.n, d2) / np.maximum(total[at], 1) + gamma[at] * p1
        return end, np.log(gamma), p2, np.log(p2) - np.log(gamma[at]) - np.log(p1)

    def of_grams(grams: _Counted, front: _Counted, pairs: _Counted, p2: np.ndarray):
        """(terms after first pairs, terms of 3-grams; those past a text's end have none)."""
        a, b, c = grams.words
        on = c != END
        at, _ = front.find(_folded(a, b))
        total = np.bincount(at[on], grams.n[on], len(front.key))
        freed = np.bincount(at[on], _freed(grams.n[on], d3), len(front.key))
        gamma = np.where(total > 0, freed / np.maximum(total, 1), 1.0)
        place, _ = pairs.find(_folded(b, c))
        lower = np.where(on, p2[place], 1.0) if len(p2) else np.ones(len(a))
        p3 = _own(grams.n, d3) / np.maximum(total[at], 1) + gamma[at] * lower
        return np.log(gamma), np.where(on, np.log(p3) - np.log(gamma[at]) - np.log(lower), 0.0)

    def asked(data: bytes, words, pairs, front, grams, terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, c, key, flag, first = _unpacked_grams(data)
        trusted = np.repeat(flag, np.diff(np.append(first, len(a))))
        w_end, w_before, pair_end, front_before, gram_end = terms
        total, on = np.zeros(len(a)), c != END

        def add(table: _Counted, of: np.ndarray, keys: np.ndarray, *values: np.ndarray) -> np.ndarray:
            at, there = table.find(keys)
            good = there & ~(trusted[of] & table.sole[at]) if len(table.key) else there
            for i, value in enumerate(values):
                use = good & on[of] if i else good
                total[of[use]] += value[at[use]]
            return of[there]

        every = np.arange(len(a))
        seen = add(words, every, b, w_end, w_before)
        zero = np.zeros(len(front.key))
        both = add(front, seen, _folded(a[seen], b[seen]), zero, front_before)
        seen = seen[on[seen]]
        last = add(pairs, seen, _folded(b[seen], c[seen]), pair_end)
        both = np.intersect1d(both, last, assume_unique=True)
        add(grams, both, _folded(a[both], b[both], c[both]), gram_end)
        return key, flag, np.add.reduceat(total, first)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for _, of_part in groupby(_rows(batches), itemgetter(0)):
            known, lower, figures = (_NONE, _NOTHING), None, None
            for block, blobs in groupby(of_part, itemgetter(1)):
                if block == _KNOWN:
                    word, count = (np.concatenate(x) for x in zip(*[_unpack(x[3], 2) for x in blobs]))
                    order = np.argsort(word)
                    known = word[order], count[order].view(np.int64)
                    continue
                if block < 0:
                    last, middle, _ = _lower(_block_grams(x[3] for x in blobs))
                    lower = (last, middle) if lower is None else (_joined([lower[0], last]), _joined([lower[1], middle]))
                    continue
                kinds = groupby(blobs, itemgetter(2))
                kind, of_kind = next(kinds)
                taught = [x[3] for x in of_kind] if kind == 1 else []
                grams = _block_grams(iter(taught))
                last, middle, front = _lower(grams)
                if figures is None:
                    pairs, words = lower or (last, middle)
                    figures = of_words(pairs, words, known)
                w_end, w_before, p2, pair_end = figures
                terms = (w_end, w_before, pair_end, *of_grams(grams, front, pairs, p2))
                if kind == 1:
                    kind, of_kind = next(kinds, (2, ()))
                for data in chain(taught if own else [], (x[3] for x in of_kind)):
                    yield asked(data, words, pairs, front, grams, terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        out = lambda key, flag, value: pa.RecordBatch.from_arrays([pa.array(key), pa.array(flag), pa.array(value)], names=["_row", "trusted", "_s"])
        for some in sums(batches):
            held.append(some)
            size += len(some[0])
            if size > HELD_SUMS:
                held = [_summed(held)]
                size = len(held[0][0])
                if size > HELD_SUMS // 2:
                    yield out(*held[0])
                    held, size = [], 0
        if held:
            yield out(*_summed(held))

    return run


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, count) of the words that are frequent in some texts, and their tokens under START."""
    for _, texts in text_chunks(batches):
        words, places, _ = _sequences(texts)
        b = words[places]
        word, n = np.unique(b, return_counts=True)
        some = (n * 2048 >= len(b)) & (word != START)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(word[some], START).view(np.int64)), pa.array(np.append(n[some], len(b)))], names=["word", "count"])


@contextmanager
def _lean(spark: SparkSession):
    """What a query shuffled is deleted when it ends, not when the driver collects garbage; Python gets few packed rows at a time."""
    wanted = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def _gathered(rows: DataFrame, layout: _Layout, passes: int, tokens: int) -> DataFrame:
    """Packed rows with each part in one partition, its blocks in order."""
    parts = -(-layout.parts // passes) + -(-len(layout.hot) // passes)
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-tokens // (passes * TASK_TOKENS)))
    return rows.repartition(min(parts, tasks), "part").sortWithinPartitions("part", "block", "kind")


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, tables)


def word_model(trusted: DataFrame) -> tuple[DataFrame, float]:
    """((part, word, count) of every word that ends a pair of the texts in ``text``, log probability of an unknown word).

    ``count`` is the number of distinct words before the word, ``part`` where the pair's first word is dealt. ``score_words``
    counts the 3-grams of a part when it gets there, so it reads the texts again; they and the layout come along with the table.
    """
    source = trusted.select(F.xxhash64("text").alias("_own"), F.col("text").cast("binary").alias("text"))
    spark = source.sparkSession
    counts = source.mapInArrow(_frequent, "word long, count long").groupBy("word").agg(F.sum("count").alias("count"))
    found = {r["word"]: r["count"] for r in counts.filter((F.col("word") == int(START)) | (F.col("count") > 2 * PART_TOKENS)).collect()}
    tokens = found.pop(int(START), 0)
    hot = np.array(sorted(np.array(list(found), np.int64).view(np.uint64)), np.uint64)
    blocks = np.array([-(-found[int(w)] // PART_TOKENS) for w in hot.view(np.int64)], np.int64)
    passes = int(min(PASSES, max(1, tokens // PASS_TOKENS)))
    layout = _Layout(max(8 * passes, -(-tokens // PART_TOKENS)), passes, hot, blocks)
    some, steps = max(1, passes // 2), []
    with _lean(spark):
        for at in range(some):
            grams = source.mapInArrow(_dealt(layout, some, at, 1, "_own", None), _BLOB)
            steps.append(written(_gathered(grams, layout, some, tokens).mapInArrow(_summed_up, "what int, part int, word long, count long")))
        table = _union(steps)
        n = {(r["part"], r["word"]): r["n"] for r in table.filter("what = 2").groupBy("part", "word").agg(F.sum("count").alias("n")).collect()}
        d1, d2, d3 = (_discounts({i: n.get((order, i), 0) for i in range(1, 5)}) for order in (1, 2, 3))
        words = table.filter("what = 0")
        ones = words.agg(F.sum("count").alias("total"), F.count("*").alias("words"), *[F.count_if(F.least("count", F.lit(3)) == i).alias(f"n{i}") for i in (1, 2, 3)]).first()
        total = ones["total"] or 0
        spare = sum(d * ones[f"n{i}"] for i, d in enumerate(d1, 1)) / total if total else 1.0
        unknown = spare / (ones["words"] + 1)
        known = written(table.filter("what = 1").select("part", "word").join(words.select("word", "count"), "word").select("part", "word", "count").sortWithinPartitions("part"))
    discard(*steps)
    known._source, known._layout = source, replace(layout, discounts=(d1, d2, d3), total=total, unknown=unknown)
    return known, math.log(unknown)


def score_words(rows: DataFrame, model: DataFrame, unknown: float, counted: DataFrame | None = None, own: bool = False) -> DataFrame:
    """(_row, trusted, n_tokens, log_perplexity) of the rows (_row, trusted, text, n_tokens) with tokens, one row per (_row, trusted).

    Rows that share ``_row`` have the same text. ``counted`` may hold the rows without their text, which are then not counted again.
    ``own`` says that the trusted rows are the model's texts, with their hash as ``_row``; those are then judged as the model reads them.
    """
    layout, source, spark = model._layout, model._source, rows.sparkSession
    counted = (rows if counted is None else counted).filter("n_tokens > 0")
    tokens = counted.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0
    slim = (rows.filter("not trusted") if own else rows).select("_row", "trusted", F.col("text").cast("binary").alias("text"))
    steps = []
    with _lean(spark):
        for at in range(layout.passes):
            known = model.filter((F.col("part") % layout.passes == at) & (F.col("count") > 1)).mapInArrow(_packed_known, _BLOB)
            taught = source.mapInArrow(_dealt(layout, layout.passes, at, 1, "_own", None, pairs=True), _BLOB)
            asked = slim.mapInArrow(_dealt(layout, layout.passes, at, 2, "_row", "trusted"), _BLOB)
            found = _gathered(_union([known, taught, asked]), layout, layout.passes, tokens).mapInArrow(_scored(layout, own), "_row long, trusted boolean, _s double")
            steps.append(written(found.groupBy("_row", "trusted").agg(F.sum("_s").alias("_s"))))
    sums = _union(steps).groupBy("_row", "trusted").agg(F.sum("_s").alias("_s"))
    each = counted.groupBy("_row", "trusted").agg(F.max("n_tokens").alias("n_tokens"), F.count("*").alias("_copies"))
    return each.join(sums, ["_row", "trusted"], "left").select(
        "_row", "trusted", "n_tokens", (-(F.coalesce("_s", F.lit(0.0)) / F.col("_copies") / F.col("n_tokens") + unknown)).alias("log_perplexity"))


def classify_quality(docs: DataFrame, labels: DataFrame, keep: list[str], text: str = "text", lang: str = "lang", doc_id: str = "doc_id",
                     label: str = "quality", quantile: float = QUANTILE, margin: float = MARGIN, prior: int = PRIOR_TOKENS) -> DataFrame:
    """The columns ``keep`` with ``n_tokens``, ``log_perplexity``, ``threshold`` and ``kept``.

    Trusted are rows whose ``doc_id`` has label 1 (in any of its rows). With m the median and q the given quantile of
    the trusted rows' log perplexity in the row's language, the threshold is m + margin * (q - m); each log
    perplexity is drawn to m as if the text had ``prior`` more tokens of that value. A null language is
    a language; one without trusted rows uses the figures of all trusted rows, and with none at all every
    text with words is kept. A null or empty text has null figures and is not kept. Rows are judged one by one, repeated rows
    alike. Columns in ``keep`` must not bear the added names.
    """
    marks = labels.groupBy(F.col("doc_id").alias("_label_of")).agg(F.max(label).alias("_label")).filter("_label = 1").select("_label_of")
    marks = F.broadcast(marks) if marks.count() <= BROADCAST_IDS else marks
    slim = docs.select(F.xxhash64(text).alias("_row"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("_lang"), F.col(doc_id).alias("_doc"),
                       *[F.col(f"`{c}`") for c in keep], F.col(text).alias("text"))
    texts = slim.join(marks, slim["_doc"] == marks["_label_of"], "left").withColumn("trusted", F.col("_label_of").isNotNull()).drop("_label_of", "_doc")
    texts = texts.withColumn("n_tokens", word_count(F.col("text")))
    counted = written(texts.drop("text"))
    model, unknown = word_model(texts.filter("trusted").select("text"))
    scored = score_words(texts, model, unknown, counted, own=True)
    rows = written(counted.drop("n_tokens").join(scored, ["_row", "trusted"], "left"))
    discard(model)
    good = rows.filter(F.col("trusted") & F.col("n_tokens").isNotNull())

    def figures(frame: DataFrame, value: str, at: float, name: str, keys: list[str]) -> DataFrame:
        return frame.groupBy(*keys).agg(F.percentile_approx(value, at, 10_000).alias(name))

    def drawn(middle):
        return (F.col("n_tokens") * F.col("log_perplexity") + prior * middle) / (F.col("n_tokens") + prior)

    all_middle = figures(good, "log_perplexity", 0.5, "x", []).first()["x"]
    all_middle = math.inf if all_middle is None else all_middle
    middles = figures(good, "log_perplexity", 0.5, "_m", ["_lang"])
    with_middle = rows.join(middles, "_lang", "left").withColumn("_m", F.coalesce("_m", F.lit(all_middle)))
    smooth = with_middle.withColumn("_x", F.when(F.lit(math.isinf(all_middle)), F.col("log_perplexity")).otherwise(drawn(F.col("_m"))))
    trusted_rows = smooth.filter(F.col("trusted") & F.col("n_tokens").isNotNull())
    all_high = figures(trusted_rows.withColumn("_x", F.col("_x") - F.col("_m")), "_x", quantile, "x", []).first()["x"]
    highs = figures(trusted_rows, "_x", quantile, "_q", ["_lang"])
    judged = smooth.join(highs, "_lang", "left").withColumn(
        "threshold", F.when(F.lit(math.isinf(all_middle)), F.lit(math.inf)).otherwise(
            F.col("_m") + margin * F.coalesce(F.col("_q") - F.col("_m"), F.lit(all_high))))
    return judged.select(*[F.col(f"`{c}`") for c in keep], F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
                         F.col("_x").alias("log_perplexity"), "threshold",
                         F.coalesce(F.col("_x") <= F.col("threshold"), F.lit(False)).alias("kept"))
