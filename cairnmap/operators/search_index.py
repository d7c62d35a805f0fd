"""Substring search through a stored index of three-character grams.

A text that contains a word contains all grams of the word. The index has a row per gram and item, in folders by a hash of the gram and
sorted by gram within a file, so a query reads the folders and row groups of its own grams. Items that have
all of them are candidates; only those are tested for the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cairnmap.operators.views import search_match

GRAM, BUCKETS = 3, 64
# Bytes of texts whose grams a task lists at once; a longer text is taken alone.
PIECE_BYTES = 1 << 21


def haystack(name: Column, text: Column) -> Column:
    """What ``search_match`` looks in."""
    return F.lower(F.concat(F.coalesce(name, F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, item_id): the distinct grams of each (item_id, text in UTF-8), some millions of bytes at a time."""
    for batch in batches:
        texts, first, held = batch.column("text").to_pylist(), 0, 0
        for i, text in enumerate(texts):
            held += len(text)
            if held < PIECE_BYTES and i + 1 < len(texts):
                continue
            points = [np.frombuffer(t.decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for t in texts[first:i + 1]]
            c, owner = np.concatenate(points).astype(np.int64), np.repeat(np.arange(len(points)), [len(p) for p in points])
            # three code points of 21 bits
            whole = owner[GRAM - 1:] == owner[:len(owner) - GRAM + 1] if len(owner) >= GRAM else np.zeros(0, bool)
            codes, which = np.unique(((c[:-2] << 42) | (c[1:-1] << 21) | c[2:])[whole] if len(whole) else np.zeros(0, np.int64), return_inverse=True)
            place = np.unique(owner[:len(whole)][whole] * max(len(codes), 1) + which)
            names = pa.array(["".join(map(chr, (x >> 42, x >> 21 & 0x1FFFFF, x & 0x1FFFFF))) for x in codes.tolist()], pa.string())
            items = batch.column("item_id").slice(first, i + 1 - first)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(place % max(len(codes), 1))), items.take(pa.array(place // max(len(codes), 1)))], ["gram", "item_id"])
            first, held = i + 1, 0


def postings(items: DataFrame) -> DataFrame:
    """(gram, item_id, bucket): the distinct grams of each item's (item_id, name, text); a text below three characters has none."""
    held = items.select(F.col("item_id").cast("long").alias("item_id"), haystack(F.col("name"), F.col("text")).cast("binary").alias("text"))
    found = held.mapInArrow(_grams, "gram string, item_id long")
    return found.select("gram", "item_id", _bucket(F.col("gram")).alias("bucket"))


def add_to_index(path: str, items: DataFrame) -> None:
    """Append the items' postings; an item belongs to the index once."""
    found = postings(items)
    # every task sorts what it read and adds a file to each bucket: postings are many times their texts, and dealing them out would move all of them
    found.sortWithinPartitions("bucket", "gram").write.mode("append").partitionBy("bucket").parquet(path)


def query_grams(query: str) -> list[str]:
    """The distinct grams of the query's words of three characters or more."""
    words = [w for w in query.lower().split() if len(w) >= GRAM]
    return sorted({w[i:i + GRAM] for w in words for i in range(len(w) - GRAM + 1)})


def candidates(spark: SparkSession, path: str, query: str) -> DataFrame | None:
    """(item_id) of the items that have all grams of the query; None if the query has none, so that every item is a candidate."""
    grams = query_grams(query)
    if not grams:
        return None
    index = spark.read.schema("gram string, item_id long, bucket int").parquet(path)
    row = spark.range(1).select(*[_bucket(F.lit(g)).alias(f"b{i}") for i, g in enumerate(grams)]).first()
    asked = index.filter(F.col("bucket").isin(*sorted(set(row))) & F.col("gram").isin(*grams))
    return asked.groupBy("item_id").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == len(grams)).select("item_id")


def search(items: DataFrame, path: str, query: str, filters: dict[str, str] | None = None) -> DataFrame:
    """The rows of (item_id, name, text, metadata) that hold all words of the query and all metadata substrings; case is ignored."""
    found = candidates(items.sparkSession, path, query)
    narrowed = items if found is None else items.join(found, "item_id", "left_semi")
    return narrowed.filter(search_match(query, filters or {}, F.col("name"), F.col("text"), F.col("metadata")))
