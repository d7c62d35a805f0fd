"""Language identification by the nearest of several TF-IDF centroids per language.

Texts become normalised TF-IDF vectors over hashed n-grams of 1 to 3 bytes of lower-cased letters. For
every language a spherical k-means over a bounded sample gives a few centroids; a text gets the language of the
centroid with the highest cosine, and is marked as rejected if it is farther from it than nearly all of
that centroid's own training texts were. Document frequencies come from all training rows, summed per
task first; classification reads each text once, whole, where it is stored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cairnmap.functions.ranking import top_per_group
from cairnmap.llm.bytetext import NO_LETTER, over_texts
from cairnmap.session import written

BITS = 12
DIMENSIONS = 1 << BITS
CENTROIDS = 4
# Training rows per language for the centroids, the lowest by a hash of the text.
SAMPLE_ROWS = 800
# The centroid table is sent to every task; more languages than fit are refused.
MAX_MODEL_BYTES = 256 << 20
# Share of a centroid's own training texts that lie within its rejection distance.
REJECT_QUANTILE = 0.995
UNDETERMINED = "und"  # fixed value
_LETTER = bytes(0x20 if NO_LETTER[i] else i for i in range(256))


def counts(text: bytes | None) -> np.ndarray:
    """Hashed n-gram counts (n = 1, 2, 3 bytes, words framed by blanks) of one lower-cased text."""
    runs = b" ".join((text or b"").translate(_LETTER).split())
    if not runs:
        return np.zeros(DIMENSIONS, np.float32)
    b = np.frombuffer(b" " + runs + b" ", dtype=np.uint8).astype(np.uint32)
    two = b[:-1] * np.uint32(257) + b[1:]
    three = two[:-1] * np.uint32(263) + b[2:]
    spread = lambda x, k: (x * np.uint32(2654435761) + np.uint32(k)) >> np.uint32(32 - BITS)
    total = np.bincount(spread(b, 1), minlength=DIMENSIONS)
    total += np.bincount(spread(two, 2 << 20), minlength=DIMENSIONS)
    total += np.bincount(spread(three, 3 << 20), minlength=DIMENSIONS)
    return total.astype(np.float32)


def vectors(texts: list[bytes | None], idf: np.ndarray) -> np.ndarray:
    x = np.stack([counts(t) for t in texts]) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def cluster(x: np.ndarray, k: int = CENTROIDS, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from farthest-first seeds: unit centroids and the least cosine each accepts."""
    mean = x.mean(axis=0)
    seeds = [int(np.argmax(x @ mean))]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin((x @ x[seeds].T).max(axis=1))))
    centers = x[seeds]
    for _ in range(rounds):
        near = np.argmax(x @ centers.T, axis=1)
        sums = np.stack([x[near == i].sum(axis=0) if (near == i).any() else centers[i] for i in range(len(centers))])
        centers = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    cosine = x @ centers.T
    near = cosine.argmax(axis=1)
    floor = [np.quantile(cosine[near == i, i], 1 - REJECT_QUANTILE) if (near == i).any() else 0.0 for i in range(len(centers))]
    return centers, np.array(floor)


@dataclass
class Model:
    idf: np.ndarray
    centers: np.ndarray
    floor: np.ndarray
    languages: list[str]

    def predict(self, texts: list[bytes | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(language, cosine, whether the nearest centroid is farther than its rejection distance)."""
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cosine = vectors(texts, self.idf) @ self.centers.T
        best = cosine.argmax(axis=1)
        top = np.clip(cosine[np.arange(len(texts)), best].astype(np.float64), 0, 1)
        return [self.languages[i] for i in best], top, top < self.floor[best]


def _folded(docs: DataFrame, text: str):
    return F.lower(F.col(text)).cast("binary").alias("text")


def _frequencies(batches):
    """Per task the number of texts with each bucket, and under -1 the number of texts."""
    from cairnmap.llm.bytetext import text_chunks

    total, n = np.zeros(DIMENSIONS, np.int64), 0
    for _, texts in text_chunks(batches):
        for t in texts:
            total += counts(t) > 0
        n += len(texts)
    yield pa.RecordBatch.from_arrays([pa.array([*range(DIMENSIONS), -1], pa.int32()), pa.array([*total, n], pa.int64())], names=["bucket", "n"])


def train(docs: DataFrame, lang: str = "lang", text: str = "text", sample: int = SAMPLE_ROWS) -> Model:
    """Learn from rows with a language and a text with a letter; without any, the model knows no language.

    Document frequencies are those of all rows, the centroids those of at most ``sample`` distinct texts per language, the lowest by a hash of the text.
    """
    usable = docs.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("lang"), _folded(docs, text))
    sums = usable.select("text").mapInArrow(_frequencies, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = sums.set_index("bucket")["n"].reindex(range(-1, DIMENSIONS), fill_value=0).to_numpy()
    idf = (np.log((df[0] + 1) / (df[1:] + 1)) + 1).astype(np.float32)
    # ranked by hash alone and once per distinct text, so neither texts nor copies meet by language; then the few texts are fetched
    hashed = usable.withColumn("h", F.xxhash64("text"))
    drawn = written(top_per_group(hashed.select("lang", "h").distinct(), ["lang"], [F.col("h")], sample).select("lang", "h"))
    if drawn.select("lang").distinct().count() * 4 * DIMENSIONS > MAX_MODEL_BYTES:
        raise ValueError("more languages than the centroid table may hold")
    picked = hashed.join(F.broadcast(drawn), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))

    def centroids(group: pd.DataFrame) -> pd.DataFrame:
        centers, floor = cluster(vectors(group["text"].tolist(), idf))
        return pd.DataFrame({"lang": group["lang"].iloc[0], "floor": floor, "center": [c.astype(np.float32).tobytes() for c in centers]})

    table = picked.select("lang", "text").groupBy("lang").applyInPandas(centroids, "lang string, floor double, center binary")
    found = table.orderBy("lang", "center").limit(MAX_MODEL_BYTES // (4 * DIMENSIONS) + 1).toPandas()
    if len(found) * 4 * DIMENSIONS > MAX_MODEL_BYTES:
        raise ValueError("more languages than the centroid table may hold")
    centers = np.stack([np.frombuffer(c, np.float32) for c in found["center"]]) if len(found) else np.zeros((0, DIMENSIONS), np.float32)
    return Model(idf, centers, found["floor"].to_numpy(float), found["lang"].tolist())


def identify(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` with ``lang_pred``, ``score`` (cosine, 0 to 1) and ``rejected``.

    A null text and a text without a letter get ``und``, score 0 and rejected; otherwise ``lang_pred`` is the
    nearest centroid's language (ties: first by language), also where ``rejected`` says that it is too far
    to be trusted. If the model knows no language everything is ``und``. Rows are judged one by one; an
    empty table gives an empty table. Columns in ``keep`` must not bear the added names or ``text``.
    """
    has_letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.when(has_letter, F.lower(F.col(text))).cast("binary").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(piece: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        langs, top, far = shared.value.predict(texts)
        void = np.array([t is None for t in texts])
        kept = [(c, f) for c, f in zip(piece.columns, piece.schema) if f.name != "text"]
        return pa.RecordBatch.from_arrays(
            [c for c, _ in kept] + [pa.array([UNDETERMINED if v else x for v, x in zip(void, langs)], pa.string()),
                                    pa.array(np.where(void, 0.0, top), pa.float64()), pa.array(far | void)],
            schema=pa.schema([f for _, f in kept] + [pa.field("lang_pred", pa.string()), pa.field("score", pa.float64()), pa.field("rejected", pa.bool_())]))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema if f.name != "text")
    return slim.mapInArrow(over_texts(fn), f"{schema}, lang_pred string, score double, rejected boolean")
