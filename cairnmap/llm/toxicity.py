"""Toxicity by multiple-instance learning: sentences are scored, documents are labelled.

A sentence's probability is logistic in its hashed words; a document is toxic if any sentence is, so its
probability is the noisy-or 1 - prod(1 - p). Weights are trained from document labels alone on a bounded
sample of labelled rows; all texts are then scored where they are read, whole, and the sentences with the
highest scores locate the offence.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cairnmap.llm.bytetext import CHUNK_BYTES, LOWER, NO_LETTER, Words, over_texts, split_words

BUCKETS_BITS = 18
# Labelled rows of each label that training may use, chosen by a hash of the text, and bytes of such a text at most.
TRAINING_ROWS, TRAINING_BYTES = 3_000, 1 << 15
# Words get a weight if they are in so many training documents and their share of toxic ones lies so many
# standard deviations above the sample's; all others keep weight 0.
MIN_DOCS, MIN_DEVIATION = 3, 3.5
EPOCHS, RATE, DECAY = 100, 0.1, 1e-5
THRESHOLD = 0.7  # fixed value
# A sentence from this probability on is an offence.
SENTENCE_THRESHOLD = 0.5
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?\n"]] = True


def sentences(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(sentence number of each word, first word of each sentence with words); texts never share a sentence."""
    if len(words.start) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum(_ENDS[words.data])
    number = ends[words.start]  # texts are joined by a newline, which ends a sentence
    fresh = np.ones(len(number), bool)
    fresh[1:] = number[1:] != number[:-1]
    return np.cumsum(fresh) - 1, np.flatnonzero(fresh)


def buckets(words: Words) -> np.ndarray:
    return (words.hashes >> np.uint64(64 - BUCKETS_BITS)).astype(np.int64)


def _split(texts: list[bytes | None]) -> Words:
    return split_words(texts, NO_LETTER, LOWER)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def score_texts(texts: list[bytes | None], weights: np.ndarray, bias: float):
    """(document probability, and per text the (start byte, end byte, probability) of its sentences)."""
    words = _split(texts)
    number, first = sentences(words)
    if not len(first):
        return np.zeros(len(texts)), words, first, np.zeros(0), np.zeros(0, np.int64)
    p = _sigmoid(np.add.reduceat(weights[buckets(words)].astype(np.float64), first) + bias)
    owner = words.owner[first]
    safe = np.bincount(owner, np.log1p(-p), minlength=len(texts))
    return -np.expm1(safe), words, first, p, owner


def fit(texts: list[bytes | None], toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights by bucket and the bias, by Adam on the whole (bounded) sample; deterministic."""
    weights, bias = np.zeros(1 << BUCKETS_BITS, np.float32), -6.0
    if not len(texts) or toxic.min() == toxic.max():
        return weights, bias
    parts, texts_done, sentences_done = [], 0, 0
    size = np.cumsum([len(t or b"") for t in texts]) // CHUNK_BYTES
    for chunk in np.split(np.arange(len(texts)), np.flatnonzero(size[1:] != size[:-1]) + 1):
        words = _split([texts[i] for i in chunk])
        number, first = sentences(words)
        parts.append((buckets(words), words.owner + texts_done, number + sentences_done, words.owner[first] + texts_done))
        texts_done, sentences_done = texts_done + len(chunk), sentences_done + len(first)
    at, owner, number, doc = (np.concatenate(x) for x in zip(*parts))
    if not len(doc):
        return weights, bias
    pairs = np.unique(owner * np.int64(1 << BUCKETS_BITS) + at)
    bucket, holder = pairs & ((1 << BUCKETS_BITS) - 1), pairs >> BUCKETS_BITS
    n, toxic_n, share = len(texts), np.bincount(bucket, toxic[holder] == 1, minlength=len(weights)), (toxic == 1).mean()
    docs_with = np.bincount(bucket, minlength=len(weights))
    deviation = (toxic_n - docs_with * share) / np.sqrt(np.maximum(docs_with, 1) * share * (1 - share))
    used_bucket = (docs_with >= MIN_DOCS) & (deviation >= MIN_DEVIATION)
    dense = np.cumsum(used_bucket) - 1
    used = used_bucket[at]
    column, row = dense[at[used]], number[used]
    with_, odd = docs_with[used_bucket], toxic_n[used_bucket]
    w = np.log((odd + 0.5) / (share * n + 1)) - np.log((with_ - odd + 0.5) / ((1 - share) * n + 1))  # start: log odds
    bad = toxic == 1
    mean, spread = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, EPOCHS + 1):
        p = _sigmoid(np.bincount(row, w[column], minlength=len(doc)) + bias)
        safe = np.bincount(doc, np.log1p(-p), minlength=len(texts))
        prob = np.clip(-np.expm1(safe), 1e-9, 1.0)
        # d loss / d z of a sentence: p in a clean document, p * (1 - 1 / prob) in a toxic one
        slope = np.where(bad, 1 - 1 / prob, 1.0)[doc] * p
        grad = np.append(np.bincount(column, slope[row], minlength=len(w)) / len(texts) + DECAY * w, slope.sum() / len(texts))
        mean += 0.1 * (grad - mean)
        spread += 0.01 * (grad * grad - spread)
        move = RATE * (mean / (1 - 0.9 ** step)) / (np.sqrt(spread / (1 - 0.99 ** step)) + 1e-8)
        w -= move[:-1]
        bias -= move[-1]
    weights[used_bucket] = w
    return weights, float(bias)


def train(docs: DataFrame, label: str, text: str = "text", rows: int = TRAINING_ROWS, most_bytes: int = TRAINING_BYTES) -> tuple[np.ndarray, float]:
    """Fit on at most ``rows`` rows of each label (0 and 1; others are ignored), the lowest by a hash of the text; longer texts than ``most_bytes`` are not drawn.

    The sample is the only thing that comes to the driver, and its size in rows and bytes does not grow with the input.
    """
    usable = docs.filter(F.col(label).isin(0, 1) & F.col(text).isNotNull() & (F.octet_length(text) <= most_bytes)).select(
        F.col(label).cast("int").alias("y"), F.col(text).cast("binary").alias("text"), F.xxhash64(F.col(text)).alias("h"))
    parts = [usable.filter(F.col("y") == y).orderBy("h").limit(rows).select("y", "text").toArrow() for y in (0, 1)]
    table = pa.concat_tables(parts)
    if not table.num_rows:
        return np.zeros(1 << BUCKETS_BITS, np.float32), -6.0
    return fit(table.column("text").to_pylist(), table.column("y").to_numpy().astype(np.int64))


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str], text: str = "text",
                   threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``keep`` with ``score``, ``predicted`` and ``offences``.

    ``offences`` lists (start, end, score) of the sentences with at least ``SENTENCE_THRESHOLD``, as byte
    places in the UTF-8 text from the sentence's first to its last word. A null or empty text and a text
    without letters score 0. Rows are scored one by one; an empty table gives an empty table. Columns in
    ``keep`` must not bear the added names or ``text``.
    """
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def fn(piece: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        prob, words, first, p, owner = score_texts(texts, *shared.value)
        found: list[list[dict]] = [[] for _ in texts]
        after = np.append(first[1:], len(words.start))
        for i in np.flatnonzero(p >= SENTENCE_THRESHOLD):
            base = words.text_start[owner[i]]
            found[owner[i]].append({"start": int(words.start[first[i]] - base), "end": int(words.end[after[i] - 1] - base),
                                    "score": float(p[i])})
        kept = [(c, f) for c, f in zip(piece.columns, piece.schema) if f.name != "text"]
        return pa.RecordBatch.from_arrays(
            [c for c, _ in kept] + [pa.array(prob, pa.float64()), pa.array(found, kind)],
            schema=pa.schema([f for _, f in kept] + [pa.field("score", pa.float64()), pa.field("offences", kind)]))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "text")
    scored = slim.mapInArrow(over_texts(fn), f"{schema}, score double, offences array<struct<start: long, end: long, score: double>>")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
