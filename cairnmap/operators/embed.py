"""Vectors for texts and files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, IDF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from cairnmap.functions import text as X, vectors as V
from cairnmap.functions.partitions import widen
from cairnmap.session import written

BATCH_ROWS = 8
MAX_TOKENS = 8192
TASK_PREFIX = "clustering: "
HASHED_MODEL = "hashed-tfidf"
HASHED_WIDTH = 1024


def _stored(vectors: DataFrame, model: str, vector: Column) -> DataFrame:
    return vectors.select(
        F.col("representation_id").alias("embedding_id"), "representation_id", "item_id",
        F.lit(model).alias("model_name"), F.size("vector").alias("dimensions"), vector.cast("array<float>").alias("vector"),
    )


def clean_vectors(vectors: DataFrame, model: str) -> DataFrame:
    """Unit length, NaN vectors zeroed, one embedding per representation."""
    return _stored(vectors, model, V.l2_normalize(V.zero_if_nan(F.col("vector"))))


def batch_vectors(df: DataFrame, keys: list[str], column: str, fn: Callable[[list], np.ndarray],
                  batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Vectors through a caller's batch function over a text or binary column, keys passed through.

    ``fn`` runs in the tasks on ``batch_rows`` values at a time; it should load
    its model once per Python worker.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[list[float]] = []
            for start in range(0, len(batch), batch_rows):
                values = list(batch[column][start:start + batch_rows])
                out.extend(np.asarray(fn(values), dtype=np.float32).tolist())
            yield batch[keys].assign(vector=out)

    types = dict(df.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", vector array<float>"
    return widen(df.select(*keys, column)).mapInPandas(run, schema)


def embed(df: DataFrame, column: str, fn: Callable[[list], np.ndarray], model: str,
          batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Embeddings of representations through a caller's batch function."""
    return clean_vectors(batch_vectors(df, ["representation_id", "item_id"], column, fn, batch_rows), model)


def embed_texts(pending: DataFrame, fn: Callable[[list[str]], np.ndarray], model: str,
                max_tokens: int = MAX_TOKENS, task_prefix: str = TASK_PREFIX) -> DataFrame:
    """Text vectors: cut to the token budget, prefixed, embedded in batches."""
    ready = pending.withColumn("text", X.within_budget(F.col("text"), max_tokens, task_prefix))
    return embed(ready, "text", fn, model)


def embed_hashed(pending: DataFrame, width: int = HASHED_WIDTH) -> DataFrame:
    """Built-in text vectors without a pretrained model: hashed TF-IDF, all in the JVM.

    Texts are read once: their sparse counts are stored, and document frequencies and weights follow from those.
    """
    tokens = RegexTokenizer(inputCol="text", outputCol="_tokens", pattern=r"[^\p{L}\p{N}]+").transform(widen(pending))
    hashed = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=width).transform(tokens)
    counted = written(hashed.select("representation_id", "item_id", "_tf"))
    weighted = IDF(inputCol="_tf", outputCol="_tfidf").fit(counted).transform(counted)
    unit = Normalizer(inputCol="_tfidf", outputCol="_unit").transform(weighted)
    dense = unit.select("representation_id", "item_id", vector_to_array("_unit", "float32").alias("vector"))
    return _stored(dense, HASHED_MODEL, F.col("vector"))


def embed_summary(embeddings: DataFrame) -> DataFrame:
    """Per model: vectors, items, width, and how many vectors are all zero."""
    zero = ~F.exists("vector", lambda x: x != 0)
    return embeddings.groupBy("model_name").agg(
        F.count("*").alias("embedded"), F.max("dimensions").alias("dimensions"), F.count_if(zero).alias("zero_vectors")
    )


def item_vectors(embeddings: DataFrame, model: str) -> DataFrame:
    """Vectors of one model by item; models are never mixed."""
    return embeddings.filter(F.col("model_name") == model).select("item_id", "vector")
