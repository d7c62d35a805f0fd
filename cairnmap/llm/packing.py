"""Best-fit packing under conflicts: documents into sequences of a fixed length.

A bin never holds two pieces of one duplicate cluster, and only so many of one source. Pieces are dealt
to shards of bounded size by a hash, counted from the pieces, so a hot source or cluster is spread over all of them; a shard is packed by
best-fit decreasing. Its open bins are kept in the order of what is left in them, with bitmaps of their
sources and clusters; the search starts at the successor of the piece's size and goes on until the
tightest compatible bin, or opens a new one.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cairnmap.llm import jaccard
from cairnmap.llm.mixing import word_count
from cairnmap.session import written

CAPACITY = 2_048
# Pieces of one source in a bin at most.
SOURCE_LIMIT = 4
# Pieces in a shard, on average.
SHARD_PIECES = 16_384
_BITS = 64


def pack(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int = CAPACITY,
         source_limit: int = SOURCE_LIMIT) -> np.ndarray:
    """Bin number of each piece, pieces being taken in the order given; sizes lie in 1..capacity.

    ``sources`` and ``clusters`` are codes from 0. A bitmap bit is a code modulo 64; where it is set, the bin's exact
    counts decide, so bitmaps save time and change nothing. Bins with equal room stand in the order
    they were opened.
    """
    bins = np.zeros(len(sizes), np.int64)
    rooms: list[tuple[int, int]] = []  # (room left, bin), ascending
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    held: list[tuple[dict[int, int], set[int]]] = []
    for i, (size, source, cluster) in enumerate(zip(sizes.tolist(), sources.tolist(), clusters.tolist())):
        source_bit, cluster_bit = 1 << (source % _BITS), 1 << (cluster % _BITS)
        at = bisect_left(rooms, (size, -1))
        while at < len(rooms):
            room, b = rooms[at]
            clash = cluster_bits[b] & cluster_bit and cluster in held[b][1]
            if not clash and source_bits[b] & source_bit:
                clash = held[b][0].get(source, 0) >= source_limit
            if not clash:
                del rooms[at]
                break
            at += 1
        else:
            room, b = capacity, len(held)
            source_bits.append(0)
            cluster_bits.append(0)
            held.append(({}, set()))
        bins[i] = b
        source_bits[b] |= source_bit
        cluster_bits[b] |= cluster_bit
        counts, seen = held[b]
        counts[source] = counts.get(source, 0) + 1
        seen.add(cluster)
        if room > size:
            insort(rooms, (room - size, b))
        else:
            held[b] = ({}, set())  # a full bin is never looked at again
    return bins


def pack_documents(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", cluster=None,
                   capacity: int = CAPACITY, source_limit: int = SOURCE_LIMIT, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """(doc_id, source, cluster, piece, start, n_words, bin_id, bin_offset): where each piece of each row goes.

    A text of more than ``capacity`` words is cut into pieces of that many and a rest; full pieces have a bin of their
    own. ``cluster`` is a column whose equal non-null values must not meet in a bin; by default the text's MD5.
    A null source is a source; a row without a cluster conflicts with nothing. A null or empty text is one piece of 0
    words without a bin. Repeated rows are pieces like any other, ties in size go by id, cluster and start.
    ``bin_id`` is unique over all shards and offsets lie within the bin. An empty table gives an empty table.
    """
    sized = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("_size"),
        (F.md5(F.coalesce(F.col(text), F.lit(""))) if cluster is None else cluster.cast("string")).alias("cluster"))
    return _packed(written(sized.withColumn("_row", F.monotonically_increasing_id())), capacity, source_limit, shard_pieces)


def _packed(sized: DataFrame, capacity: int, source_limit: int, shard_pieces: int) -> DataFrame:
    """The pieces of rows (doc_id, source, _size, cluster, _row), dealt to as many shards as their number asks for.

    A piece's shard is a hash of its row's id, cluster and number; rows that repeat an id are told apart by ``_row``, so no shard gets
    all repeats of a row.
    """
    last = F.greatest(F.ceil(F.col("_size") / capacity) - 1, F.lit(0)).cast("int")
    total = sized.agg(F.sum(last.cast("long") + 1)).first()[0] or 0
    shards = max(1, -(-total // shard_pieces))
    repeats = sized.groupBy("doc_id").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("doc_id").alias("_again"))
    apart = sized.join(repeats.withColumn("_repeated", F.lit(True)), F.col("doc_id").eqNullSafe(F.col("_again")), "left")
    pieces = apart.withColumn("piece", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("piece").cast("long") * capacity
    shard = F.pmod(F.xxhash64("doc_id", "cluster", "piece", F.when(F.col("_repeated"), F.col("_row"))), F.lit(shards))
    dealt = pieces.select("doc_id", "source", "cluster", "piece", start.alias("start"), F.least(F.col("_size") - start, F.lit(capacity)).alias("n_words"), shard.alias("shard"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["n_words", "doc_id", "cluster", "start"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        sources = pd.factorize(group["source"], use_na_sentinel=False)[0]
        clusters = pd.factorize(group["cluster"])[0]
        alone = clusters < 0
        clusters = np.where(alone, clusters.max(initial=0) + 1 + np.arange(len(group)), clusters)
        full = group["n_words"].to_numpy() > 0
        bins = np.full(len(group), -1, np.int64)
        bins[full] = pack(group["n_words"].to_numpy()[full], sources[full], clusters[full], capacity, source_limit)
        group["bin_id"] = pd.Series(bins + (group["shard"].iloc[0] << 32)).where(pd.Series(full)).astype("Int64")
        group["bin_offset"] = (group.groupby(bins)["n_words"].cumsum() - group["n_words"]).where(pd.Series(full)).astype("Int64")
        return group.drop(columns="shard")

    kind = sized.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("shard").applyInPandas(
        run, f"doc_id {kind}, source string, cluster string, piece int, start long, n_words long, bin_id long, bin_offset long")


def pack_near_copies(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", capacity: int = CAPACITY,
                     source_limit: int = SOURCE_LIMIT, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pack_documents`` with groups of near copies (``jaccard_components`` of the texts) as clusters, named by their smallest id.

    A row without words has no cluster; nor has one without an id unless a row with an id has the same text. Rows that
    repeat an id are one cluster.
    """
    found = jaccard.components_with(docs, (doc_id, source), doc_id, text)
    rows = found.select(F.col("kept_0").alias("doc_id"), F.col("kept_1").cast("string").alias("source"), F.col("n_words").alias("_size"),
                        F.when(F.col("n_words") > 0, F.col("component_id")).cast("string").alias("cluster"), F.monotonically_increasing_id().alias("_row"))
    return _packed(written(rows), capacity, source_limit, shard_pieces)
