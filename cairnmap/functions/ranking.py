"""Ranks that do not pull one key's rows into a single task."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from cairnmap.functions.frames import from_pandas
from cairnmap.session import written

# Ids per bucket of a two-level rank.
RANK_WIDTH = 65_536


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows of each group.

    The rank is filtered directly, so Spark puts a group limit before the
    shuffle: a map task sends at most ``k`` rows per key, however hot the key.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
    return kept.withColumn(rank, F.col(rank).cast("long"))


def rank_by_id(df: DataFrame, id_col: str, keys: list[str] = (), rank: str = "rank",
               width: int = RANK_WIDTH) -> DataFrame:
    """Add the 1-based position of a unique integer id within its keys.

    Ranks are taken within buckets of ``width`` consecutive ids and shifted by
    the row counts of the earlier buckets, so a single hot key is still spread
    over many tasks; only one count per bucket meets in one place.
    """
    keys = list(keys)
    bucketed = df.withColumn("_bucket", F.floor(F.col(id_col) / F.lit(width)))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy(*keys, "_bucket").count().select(
        *keys, "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(id_col)
    ranked = bucketed.withColumn("_inside", F.row_number().over(inside))
    match = reduce(
        lambda a, b: a & b,
        [ranked[c].eqNullSafe(offsets[c]) for c in (*keys, "_bucket")],
    )
    return ranked.join(offsets, match).select(
        *[ranked[c] for c in df.columns], (F.col("_inside") + F.col("_offset")).alias(rank)
    )


# Rows per range partition of a global rank.
RANGE_ROWS = 1 << 20


def rank_rows(df: DataFrame, order: list[Column], rank: str = "rank", rows: int | None = None) -> DataFrame:
    """``df``, written, with each row's 0-based place in the given order, which must tell all rows apart.

    Range partitions are sorted on their own; a place within one is shifted by the sizes of those before it, of
    which one number per partition comes to the driver.
    """
    spark = df.sparkSession
    rows = df.count() if rows is None else rows
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE_ROWS)) if rows > RANGE_ROWS // 16 else 1
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = written(ranged.withColumn("_at", F.monotonically_increasing_id()))  # partition and place within it
    sizes = {r["part"]: r["n"] for r in placed.groupBy(F.shiftright("_at", 33).alias("part")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for part in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(part, 0)
    offsets = from_pandas(spark, pd.DataFrame({"_part": np.arange(len(before), dtype=np.int64), "_before": np.array(before, np.int64)}), "_part long, _before long")
    joined = placed.join(F.broadcast(offsets), F.shiftright("_at", 33) == F.col("_part"))
    return joined.withColumn(rank, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_at", "_part", "_before")


def latest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row with the highest version per key, by partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_row")).select(*keys, "_row.*")
