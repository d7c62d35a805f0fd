"""Document fingerprints by one-permutation MinHash, and how alike a text is to its edited text and to the next document.

Every shingle is hashed once; the hash's top bits are its bin and the smallest hash of a bin is kept. Empty bins take the value of a
bin that a universal hash of (bin, attempt) finds filled (optimal densification), so every bin agrees between two
texts with the probability of their sets' Jaccard similarity. Of each value, hashed with its bin, a few low-order bits are packed; values that
differ agree in those by chance, independently per bin, and the likeness corrects for that share.

Documents meet their successors in range partitions of the id: texts are moved once, a task reads its rows in
order and holds two of them, and only the first and last row of each partition are paired afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from cairnmap.functions.frames import from_pandas
from cairnmap.llm.bytetext import ASCII_SPACE, CHUNK_BYTES, LOWER, distinct_sets, mix, shingles, split_words
from cairnmap.session import written

# Bins (a power of two), and bits kept of each bin's value.
BINS, BITS, WIDTH = 256, 4, 5
# The last such part of a text is replaced in its edited text.
EDITED = 4
# Bytes of text per range partition.
PARTITION_BYTES = 64 << 20


def densify(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Values of all bins (texts x bins); a bin that is empty takes that of the first filled bin its attempts meet.

    Attempts are hashes of (bin, attempt), the same for all texts. Past as many attempts as are likely to meet every bin
    they go through the bins in order, so they end. Rows without a filled bin are left as they are.
    """
    n, bins = values.shape
    out, some = values.copy(), filled.any(axis=1)
    row, at = np.nonzero(~filled & some[:, None])
    attempt = 0
    while len(row):
        if attempt < 8 * bins:
            guess = (mix((at.astype(np.uint64) << np.uint64(32)) | np.uint64(attempt + 1)) % np.uint64(bins)).astype(np.int64)
        else:
            guess = (at + attempt) % bins
        hit = filled[row, guess]
        out[row[hit], at[hit]] = values[row[hit], guess[hit]]
        row, at = row[~hit], at[~hit]
        attempt += 1
    return out


def fingerprints(texts: list[bytes], width: int = WIDTH, bins: int = BINS, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(texts x bins low-order bits, whether a text has words)."""
    hashes, owner = shingles(split_words(texts, ASCII_SPACE, LOWER), width)
    members, first = distinct_sets(hashes, owner, len(texts))
    shift = np.uint64(64 - int(np.log2(bins)))
    flat = np.repeat(np.arange(len(texts)), np.diff(first)) * bins + (members >> shift).astype(np.int64)
    least = np.ones(len(flat), bool)  # members ascend within a text, so a bin's first is its smallest
    least[1:] = flat[1:] != flat[:-1]
    values, filled = np.zeros(len(texts) * bins, np.uint64), np.zeros(len(texts) * bins, bool)
    values[flat[least]], filled[flat[least]] = members[least], True
    whole = densify(values.reshape(-1, bins), filled.reshape(-1, bins))
    # a value that fills many bins would agree by chance in all of them at once, so each bin hashes it anew
    salt = mix(np.arange(1, bins + 1, dtype=np.uint64))
    return (mix(whole + salt) & np.uint64((1 << bits) - 1)).astype(np.uint8), np.diff(first) > 0


def packed(low: np.ndarray, bits: int = BITS) -> list[str]:
    """The low-order bits of each row, packed, as hexadecimal digits."""
    spread = (low[:, :, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1
    return [r.tobytes().hex() for r in np.packbits(spread.reshape(len(low), -1).astype(np.uint8), axis=1)]


def likeness(a: np.ndarray, a_words: np.ndarray, b: np.ndarray, b_words: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Estimated similarity of the sets, by rows: the share of equal values less what agrees by chance.

    Two texts without words are alike (1); one without words is like no other (0).
    """
    chance = 2.0 ** -bits
    share = ((a == b).mean(axis=1) - chance) / (1 - chance)
    return np.where(a_words & b_words, np.clip(share, 0, 1), (a_words == b_words).astype(float))


def edited(text: str, following: str, part: int = EDITED) -> str:
    """``text`` with its last 1/``part`` of code points replaced by the first as many of ``following``."""
    n = len(text) // part
    return text[:len(text) - n] + following[:n] if n else text


_DECODED = ("utf-8", "surrogateescape")  # bytes that are no text count one code point each

_COLUMNS = {"n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(),
            "near_edited": pa.float64(), "near_next": pa.float64()}
_SCHEMA = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_pairs(pairs: list[tuple[str, str]], width: int = WIDTH, bins: int = BINS, bits: int = BITS, part: int = EDITED) -> dict[str, list]:
    """The result columns for pairs of (text, next text)."""
    changed = [edited(a, b, part) for a, b in pairs]
    encoded = [t.encode(*_DECODED) for t in [a for a, _ in pairs] + changed + [b for _, b in pairs]]
    low, words = fingerprints(encoded, width, bins, bits)
    own, new, other = (slice(i * len(pairs), (i + 1) * len(pairs)) for i in range(3))
    named = lambda s: [p if w else "" for p, w in zip(packed(low[s], bits), words[s])]
    return {"n_chars": [len(a) for a, _ in pairs], "edited_sha256": [sha256(t).hexdigest() for t in encoded[new]],
            "fingerprint": named(own), "edited_fingerprint": named(new),
            "near_edited": likeness(low[own], words[own], low[new], words[new], bits).tolist(),
            "near_next": likeness(low[own], words[own], low[other], words[other], bits).tolist()}


def _pairs_in_order(width: int, bins: int, bits: int, part: int):
    """Rows (_id, text) of a partition in order: the result of every row but the last, then its first and last text."""

    def result(ids: list, pairs: list[tuple[str, str]], where: int) -> pa.RecordBatch:
        found = compare_pairs(pairs, width, bins, bits, part)
        columns = [pa.array(ids, pa.int64()), *[pa.array(found[n], k) for n, k in _COLUMNS.items()], pa.array([where] * len(ids), pa.int64()),
                   pa.nulls(len(ids), pa.string()), pa.nulls(len(ids), pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["_id", *_COLUMNS, "_part", "_end", "_text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, first, last, ids, pairs, held = TaskContext.get().partitionId(), None, None, [], [], 0
        for batch in batches:
            for i, raw in zip(batch.column("_id").to_pylist(), batch.column("text")):
                row = (i, (raw.as_py() or b"").decode(*_DECODED))
                if last is None:
                    first = row
                else:
                    ids.append(last[0])
                    pairs.append((last[1], row[1]))
                    held += len(last[1])
                last = row
                if held >= CHUNK_BYTES:
                    yield result(ids, pairs, where)
                    ids, pairs, held = [], [], 0
        if ids:
            yield result(ids, pairs, where)
        if last is not None:
            ends = [("first", *first), ("last", *last)]
            columns = [pa.array([i for _, i, _ in ends], pa.int64()), *[pa.nulls(2, k) for k in _COLUMNS.values()], pa.array([where] * 2, pa.int64()),
                       pa.array([e for e, _, _ in ends]), pa.array([t.encode(*_DECODED) for _, _, t in ends], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["_id", *_COLUMNS, "_part", "_end", "_text"])

    return run


def _joints(width: int, bins: int, bits: int, part: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():  # one row per partition, one text at a time
                pair = ((row["_text"] or b"").decode(*_DECODED), (row["_next"] or b"").decode(*_DECODED))
                found = compare_pairs([pair], width, bins, bits, part)
                yield pa.RecordBatch.from_arrays([pa.array([row["_id"]], pa.int64()), *[pa.array(found[n], k) for n, k in _COLUMNS.items()]], names=["_id", *_COLUMNS])

    return run


def fingerprint_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, bins: int = BINS, bits: int = BITS,
                          part: int = EDITED) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    A fingerprint covers the set of distinct ``width``-word shingles of the text with A-Z lower-cased; a text of fewer words is one shingle. The
    edited text has its last floor(n_chars / ``part``) code points replaced by the first as many (or all) of the next document's
    text in the order of ids, the first after the last. A null text is an empty one. A text without words has the fingerprint "", is like other such texts (1) and like no other
    (0). A null id comes last; rows that repeat an id follow each other by a hash of their texts, equal rows in any order, which gives the same rows. A single row
    follows itself. An empty table gives an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), F.col(f"`{text}`").cast("binary").alias("text"), F.monotonically_increasing_id().alias("_row"))
    size = base.agg(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    order = [F.col("_id").asc_nulls_last(), F.xxhash64("text"), F.col("_row")]  # the row number parts equal rows
    ranged = base.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("_id", "text")
    done = written(ranged.mapInArrow(_pairs_in_order(width, bins, bits, part), f"_id long, {_SCHEMA}, _part long, _end string, _text binary"))
    ends = done.filter("_end IS NOT NULL")
    where = sorted(r["_part"] for r in ends.filter("_end = 'last'").select("_part").collect())  # numbers of the partitions that have rows
    after = from_pandas(spark, pd.DataFrame({"_from": np.array(where, np.int64), "_to": np.array(where[1:] + where[:1], np.int64)}), "_from long, _to long")
    lasts = ends.filter("_end = 'last'").select("_id", "_part", "_text").join(after, F.col("_part") == F.col("_from"))
    firsts = ends.filter("_end = 'first'").select(F.col("_part").alias("_other"), F.col("_text").alias("_next"))
    joints = lasts.join(firsts, lasts["_to"] == firsts["_other"]).select("_id", "_text", "_next").mapInArrow(_joints(width, bins, bits, part), f"_id long, {_SCHEMA}")
    rows = done.filter("_end IS NULL").select("_id", *_COLUMNS).union(joints)
    return rows.select(F.col("_id").alias(doc_id), *_COLUMNS)
