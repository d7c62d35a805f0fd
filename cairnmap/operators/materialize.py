"""Items to embedding texts, and what is still to be embedded."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cairnmap.functions import text as X
from cairnmap.functions.partitions import widen
from cairnmap.sources.artifacts import is_image

EMBEDDING_TEXT = "embedding_text"


def pending_items(rows: DataFrame, representations: DataFrame) -> DataFrame:
    """Rows without an embedding text."""
    done = representations.filter(F.col("representation_type") == EMBEDDING_TEXT).select("item_id")
    return rows.join(done, rows["row_id"] == done["item_id"], "left_anti")


def representations(rows: DataFrame, extracted: DataFrame | None = None, first_path: DataFrame | None = None) -> DataFrame:
    """Embedding text and its hash per item; items without any text are left out.

    ``extracted(item_id, extracted_text)`` is the text of attached files and
    ``first_path(item_id, original_path)`` gives the file name used when nothing
    else is there.
    """
    spark = rows.sparkSession
    if extracted is None:
        extracted = spark.createDataFrame([], "item_id long, extracted_text string")
    if first_path is None:
        first_path = spark.createDataFrame([], "item_id long, original_path string")
    built = X.embedding_text(F.col("row_name"), F.col("metadata"), F.col("extracted_text"))
    text = (
        rows.withColumnRenamed("row_id", "item_id")
        .join(extracted, "item_id", "left")
        .join(first_path, "item_id", "left")
        .select("item_id", F.when(X.is_blank(built), X.file_stem(F.col("original_path"))).otherwise(built).alias("text"))
        .filter(~X.is_blank(F.col("text")))
    )
    return text.select(
        F.col("item_id").alias("representation_id"), "item_id",
        F.lit(EMBEDDING_TEXT).alias("representation_type"), "text", X.text_hash(F.col("text")).alias("text_hash"),
    )


def describe(files: DataFrame, fn: Callable[[list[bytes]], list[str]], batch_rows: int = 8) -> DataFrame:
    """Text per distinct file ``(artifact_id, content)`` through ``fn``; a file it fails on gets the empty text."""

    def one(content: bytes) -> str:
        try:
            return fn([content])[0] or ""
        except Exception:  # noqa: BLE001 - a bad file must not stop the rest
            return ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts: list[str] = []
            for start in range(0, len(batch), batch_rows):
                chunk = list(batch["content"][start:start + batch_rows])
                try:
                    texts.extend(t or "" for t in fn(chunk))
                except Exception:  # noqa: BLE001 - find the bad file by asking one at a time
                    texts.extend(one(c) for c in chunk)
            yield pd.DataFrame({"artifact_id": batch["artifact_id"], "text": texts})

    distinct = files.select("artifact_id", "content").dropDuplicates(["artifact_id"])
    return widen(distinct).mapInPandas(run, "artifact_id string, text string")


def _without_model(reps: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    done = embeddings.filter(F.col("model_name") == model).select("representation_id")
    return reps.join(done, "representation_id", "left_anti")


def _image_links(item_artifacts: DataFrame, artifacts: DataFrame) -> DataFrame:
    images = artifacts.filter(is_image(F.col("mime_type"))).select("artifact_id", "stored_path")
    return item_artifacts.join(images, "artifact_id").select("item_id", "stored_path")


def pending_text(reps: DataFrame, item_artifacts: DataFrame, artifacts: DataFrame,
                 embeddings: DataFrame, model: str) -> DataFrame:
    """Embedding texts of items without an image that this model has not embedded."""
    texts = reps.filter(F.col("representation_type") == EMBEDDING_TEXT)
    return _without_model(
        texts.join(_image_links(item_artifacts, artifacts).select("item_id"), "item_id", "left_anti"), embeddings, model
    ).select("representation_id", "item_id", "text")


def pending_images(reps: DataFrame, item_artifacts: DataFrame, artifacts: DataFrame,
                   embeddings: DataFrame, model: str) -> DataFrame:
    """One image per image-linked item that this model has not embedded."""
    paths = _image_links(item_artifacts, artifacts).groupBy("item_id").agg(F.min("stored_path").alias("stored_path"))
    texts = reps.filter(F.col("representation_type") == EMBEDDING_TEXT)
    return _without_model(texts, embeddings, model).join(paths, "item_id").select(
        "representation_id", "item_id", "stored_path"
    )
