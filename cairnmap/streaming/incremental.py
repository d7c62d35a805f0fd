"""Incremental ingest with Structured Streaming.

New files of a folder become texts or map cells as they arrive. ``first_of_key`` keeps the keys seen so far in Spark's state store and
``write_batches`` gives every batch a folder of its own, so a batch costs what it brings, however much is stored, and one that runs twice after a failure
replaces what its first try wrote. ``append_new`` is for sinks that other writers fill as well: it looks the batch's keys up in what is stored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from cairnmap.functions import text as X
from cairnmap.operators.som import best_nodes


def watch(spark: SparkSession, folder: str, schema: StructType | str, fmt: str = "parquet", name_filter: str | None = None,
          files_per_batch: int | None = None) -> DataFrame:
    """Rows of the files that appear in a folder."""
    reader = spark.readStream.format(fmt).schema(schema)
    if name_filter:
        reader = reader.option("pathGlobFilter", name_filter)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if fmt == "csv":
        reader = reader.option("header", True).option("escape", '"')
    return reader.load(folder)


def watch_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Rows of a table that is one file or a folder of files, to which more files may come.

    A stream takes folders only; a pattern that fits just this path is followed to either.
    """
    folder, _, name = path.rstrip("/").rpartition("/")
    return watch(spark, f"{folder}/[{name[0]}]{name[1:]}", schema)


def text_stream(rows: DataFrame) -> DataFrame:
    """Embedding texts of a stream of rows (row_id, row_name, metadata, extracted_text)."""
    text = X.embedding_text(F.col("row_name"), F.col("metadata"), F.col("extracted_text"))
    return (
        rows.select(F.col("row_id").alias("item_id"), text.alias("text"))
        .filter(~X.is_blank(F.col("text")))
        .select(
            F.col("item_id").alias("representation_id"), "item_id", F.lit("embedding_text").alias("representation_type"),
            "text", X.text_hash(F.col("text")).alias("text_hash"),
        )
    )


def cell_stream(vectors: DataFrame, codebook: DataFrame) -> DataFrame:
    """Cells of a stream of vectors on a trained map; the codebook is broadcast."""
    return best_nodes(vectors, codebook)


def first_of_key(stream: DataFrame, key: str, event_time: str | None = None, within: str | None = None) -> DataFrame:
    """The first row of each key over the stream's life; rows whose key came before are dropped by the state store.

    With an event time the key is forgotten ``within`` that time after the watermark, which bounds the state; without one every key is kept.
    """
    if event_time is None:
        return stream.dropDuplicates([key])
    if within is None:
        raise ValueError("an event time needs the time within which keys repeat")
    return stream.withWatermark(event_time, within).dropDuplicatesWithinWatermark([key])


def write_batches(path: str) -> Callable[[DataFrame, int], None]:
    """Batch writer with one folder per batch number, replaced when the batch runs again."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    return write


def append_new(path: str, key: str) -> Callable[[DataFrame, int], None]:
    """Batch writer that adds the rows whose key is not stored yet, one per key."""

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        # The folder has to exist for its keys to be read.
        batch.limit(0).write.mode("append").parquet(path)
        stored = spark.read.schema(batch.schema).parquet(path).select(key)
        fresh.join(stored, key, "left_anti").write.mode("append").parquet(path)

    return write


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process everything that is there now, then stop; progress is kept in ``checkpoint``."""
    query = (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
